"""Neighbour graphs with a row a point, against neighbours joined with their points."""

import numpy as np
from pyspark.sql import functions as F

from linewave.operators import neighbors
from linewave.sources import sinks


def dots(spark):
    rnd = np.random.RandomState(4)
    rows = [(g, g % 2, g % 3, 1.5, "max_by_row", i, int(x), int(y)) for g, n in ((1, 1), (2, 4), (3, 90)) for i, (x, y) in enumerate(rnd.randint(0, 12, (n, 2)))]
    return spark.createDataFrame(rows, "image_id long, direction int, channel int, scale double, extreme_type string, point_idx int, x int, y int")


def test_edges_of_a_graph_need_no_join(spark):
    points = dots(spark)
    want, got = neighbors.edges(neighbors.nearest(points, 5), points), neighbors.graph_edges(neighbors.graph(points, 5))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4 * 3 + 90 * 5


def test_text_of_a_graph_needs_no_join(spark):
    points, label = dots(spark), F.col("scale").cast("string")
    want = sinks.neighbour_text(neighbors.nearest(points, 5), points, 5, label)
    got = sinks.graph_text(neighbors.graph(points, 5), 5, label)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_small_and_large_groups_give_the_same(spark, monkeypatch):
    points = dots(spark).withColumn("channel", F.when(F.col("image_id") != 3, F.col("channel")))
    want = {str(r) for r in neighbors.graph(points, 5).collect()}
    monkeypatch.setattr(neighbors, "SMALL", 50)
    assert {str(r) for r in neighbors.graph(points, 5).collect()} == want and len(want) == 94
