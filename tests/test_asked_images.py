"""Images that no task asks for: ranked with the others, but their channels are not worked out."""

from linewave.sources import images


def test_channels_are_worked_out_of_asked_images_only(spark, sf_dir):
    asked = spark.createDataFrame([(3, "a"), (3, "b"), (7, "c"), (None, "d"), (10**9, "e")], "image_id long, other string")
    every, some = images.embedding_rows(spark, sf_dir), images.embedding_rows(spark, sf_dir, asked=asked)
    assert some.columns == every.columns
    want = every.where("image_id in (3, 7)").collect()
    assert sorted(some.collect()) == sorted(want) and len(want) > 0
    tree = some._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < tree.index("lambda") < tree.index("Join LeftSemi")
