"""Every query of the analysis against its SQL."""

import pytest

from linewave.plans.oracles import SQL
from linewave.plans.queries import QUERIES
from tests.compare import canonical, sql_rows


def test_every_query_but_the_tree_has_sql():
    assert set(QUERIES) - set(SQL) == {"greedy_tree"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = canonical(QUERIES[name](spark, sf_dir).toPandas()), sql_rows(sf_dir, SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["image_id", "direction", "channel", "scale", "y", "x"]
