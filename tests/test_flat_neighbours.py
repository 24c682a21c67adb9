"""Neighbours as rows straight from the map, against the lists of the graph."""

import pytest

from linewave.operators import neighbors
from tests.test_graphs import dots


@pytest.mark.parametrize("small", [2048, 50])
def test_neighbours_equal_the_lists_of_the_graph(spark, monkeypatch, small):
    monkeypatch.setattr(neighbors, "SMALL", small)
    points = dots(spark)
    got, want = neighbors.nearest(points, 5), neighbors.ranked(neighbors.graph(points, 5))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4 * 3 + 90 * 5


def test_neighbours_of_small_groups_are_never_lists(spark):
    plan = neighbors.nearest(dots(spark), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "nn#" not in plan
