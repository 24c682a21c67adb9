"""The operators' queries against their SQL."""

import pytest

from linewave.llm.queries import QUERIES, SQL
from tests.compare import canonical, sql_rows


@pytest.mark.parametrize("name", ["op11_repairs", "op12_resampling", "op13_repeats"])
def test_query_equals_sql(spark, sf_dir, name):
    got, want = canonical(QUERIES[name](spark, sf_dir).toPandas()), sql_rows(sf_dir, SQL[name])
    assert got[0] == want[0] and len(got[1]) > 0
    assert got[1] == want[1]
