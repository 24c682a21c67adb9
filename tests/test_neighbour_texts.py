"""Texts of neighbours straight from the map, against those of the graph's lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewave.operators import neighbors
from linewave.sources import sinks
from tests.test_graphs import dots


@pytest.mark.parametrize(("small", "k"), [(2048, 0), (2048, 1), (2048, 200), (50, 5)])
def test_texts_equal_those_of_the_lists(spark, monkeypatch, small, k):
    monkeypatch.setattr(neighbors, "SMALL", small)
    points, label = dots(spark).withColumns({"x": F.col("x") * 977, "y": F.col("y") - 5}), F.col("scale").cast("string")
    got, want = neighbors.texts(points, k), neighbors.listed_texts(neighbors.graph(points, k))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == (94 if k else 0)
    text = sinks.graph_text(got, k, label)
    if k:
        assert sorted(text.collect()) == sorted(sinks.neighbour_text(neighbors.nearest(points, k), points, k, label).collect())


def test_small_groups_are_printed_without_lists(spark):
    plan = sinks.graph_text(neighbors.texts(dots(spark), 5), 5, F.lit("1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "nn#" not in plan and "lambda" not in plan


def test_each_distance_is_printed_once():
    """Distances that round to halves and hundredths, as the lists' SQL prints them; points without neighbours have empty texts."""
    far = np.array([0, 1, 2, 3, 10, 10**4, 10**10 + 1, 2])
    ids, text = neighbors.text_arrays(np.array([3, 0, 5]), np.arange(8), far, np.arange(8) * 7)
    assert ids.to_pylist() == ["0, 7, 14", "", "21, 28, 35, 42, 49"]
    assert text.to_pylist() == ["0.00, 1.00, 1.41", "", "1.73, 3.16, 100.00, 100000.00, 1.41"]
