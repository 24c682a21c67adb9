"""Tasks with settings of their own in one run, against a run for each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewave.operators import color, neighbors
from linewave.plans.pipeline import Options, analyse
from linewave.plans.tasks import run_tasks
from linewave.sources import images

SCHEMA = "task_id long, image_id long, color1 array<int>, color2 array<int>, scales array<double>, k int, rows boolean, cols boolean, max boolean, min boolean"
RED, GREY = [200, 10, 5], [90, 91, 95]


def pictures(spark):
    rnd = np.random.RandomState(2)
    rows = [(i, y, *rnd.randint(0, 256, (3, w)).astype(float).tolist()) for i, (h, w) in enumerate(((40, 36), (33, 50))) for y in range(h)]
    return spark.createDataFrame(rows, images.ROWS)


TASKS = [
    (10, 0, RED, GREY, [1.0, 2.0], 3, True, True, True, True),
    (11, 0, RED, [], [4.0, 1.5, 4.0], None, True, False, None, True),
    (12, 1, GREY, RED, [3.0], 1, False, True, True, False),
    (13, 1, None, None, [2.0], 0, None, None, None, None),
]


def test_every_task_equals_a_run_of_its_own(spark):
    rows = pictures(spark)
    run = run_tasks(rows, spark.createDataFrame(TASKS, SCHEMA))
    points = {tuple(r) for r in run.points.collect()}
    near = {tuple(r) for r in run.neighbours().select(*neighbors.GROUP, "point_idx", "nbr_rank", "nbr_idx", "distance").collect()}
    want_points, want_near = set(), set()
    for task, image, first, second, scales, k, *flags in TASKS:
        by_row, by_col, high, low = (f is not False for f in flags)
        types = tuple(t for t, on in (("max_by_row", by_row and high), ("max_by_column", by_col and high), ("min_by_row", by_row and low), ("min_by_column", by_col and low)) if on)
        own = analyse(rows.where(F.col("image_id") == image), Options(scales=tuple(scales), types=types, colours=(tuple(first), tuple(second)) if first and second else None, k=5 if k is None else k))
        want_points |= {(task, *tuple(r)[1:]) for r in own.points.collect()}
        want_near |= {(task, *tuple(r)[1:]) for r in own.neighbours().select(*neighbors.GROUP, "point_idx", "nbr_rank", "nbr_idx", "distance").collect()}
    assert points == want_points and near == want_near
    assert {p[0] for p in points} == {10, 11, 12, 13} and {p[0] for p in near} == {10, 11, 12}


def test_files_lie_in_the_folder_of_task_and_scale(spark):
    tasks = spark.createDataFrame(TASKS, SCHEMA).withColumn("name", F.concat(F.lit("T"), "task_id"))
    files = run_tasks(pictures(spark), tasks).files(F.col("name"), F.expr("timestamp_ntz'2024-03-05 07:08:09'"))
    folders = {r.folder for r in files.select("folder").distinct().collect()}
    at = "05_03_2024_07_08"
    assert folders == {f"ВП_{at}/{t} {at}/Scale_{s}" for t, s in (("T10", 1.0), ("T10", 2.0), ("T11", 4.0), ("T11", 1.5), ("T12", 3.0), ("T13", 2.0))} | {f"ВП_{at}/T{t} {at}" for t in (10, 11, 12, 13)}
    heads = {(r.folder.split("/")[1][:3], r.text) for r in files.where("line = 3 and file like 'KNN%'").collect()}
    assert heads == {("T10", "Количество соседей (k): 3"), ("T11", "Количество соседей (k): 5"), ("T12", "Количество соседей (k): 1")}


def test_unready_tasks_are_refused_or_left_out(spark):
    rows = pictures(spark)
    for bad in ((20, None, None, None, [1.0], 1), (20, 0, None, None, [], 1), (20, 0, None, None, None, 1)):
        tasks = spark.createDataFrame([TASKS[0], (*bad, None, None, None, None)], SCHEMA)
        with pytest.raises(ValueError, match="task 20"):
            run_tasks(rows, tasks)
        assert {r.image_id for r in run_tasks(rows, tasks, skip=True).points.select("image_id").distinct().collect()} == {10}
    none = run_tasks(rows, spark.createDataFrame([], SCHEMA))
    assert none.points.count() == none.neighbours().count() == 0
    with pytest.raises(Exception, match="too short"):
        run_tasks(rows, spark.createDataFrame([(1, 0, None, None, [20.0], 1, None, None, None, None)], SCHEMA))


def test_bases_by_row_equal_the_basis_of_two_colours(spark):
    pairs = [(RED, GREY), (GREY, RED), ([1, 0, 0], [1, 1, 0])]
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>").select("a", "b", color.basis_of(F.col("a"), F.col("b")).alias("m"))
    for r in df.collect():
        assert np.allclose(r.m, color.orthonormal_basis(r.a, r.b), atol=1e-12)
    assert spark.createDataFrame([(None, RED)], "a array<int>, b array<int>").select(color.basis_of(F.col("a"), F.col("b"))).first()[0] is None
    for pair in (([0, 0, 0], RED), (RED, [2 * v for v in RED])):
        with pytest.raises(Exception, match="black nor parallel"):
            spark.createDataFrame([pair], "a array<int>, b array<int>").select(color.basis_of(F.col("a"), F.col("b"))).collect()
