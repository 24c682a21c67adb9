"""Tasks over images that are transformed once: what is written, and matrices beyond one block of lines."""

import os

from pyspark.sql import functions as F

from linewave.operators import neighbors
from linewave.plans import tasks as plan
from linewave.storage import Scratch

from tests.test_tasks import SCHEMA, TASKS, pictures


def _sizes(block: Scratch) -> dict[str, int]:
    """Name of a scratch table -> bytes of all tables of that name."""
    out: dict[str, int] = {}
    for path in block.paths:
        path = path.removeprefix("file://").removeprefix("file:")
        name = os.path.basename(path).split("-")[0]
        out[name] = out.get(name, 0) + sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    return out


def _many(n: int):
    return [(i, 0, [1 + i % 200, 5, 9], [7, 1 + i % 90, 200], [1.0, 2.0], 2, True, True, True, True) for i in range(n)]


def test_coefficients_of_the_tasks_are_never_written(spark):
    wrote = []
    for n in (4, 200):
        with Scratch(spark) as block:
            files = plan.run_tasks(pictures(spark), spark.createDataFrame(_many(n), SCHEMA)).files(F.col("task_id").cast("string"), F.expr("timestamp_ntz'2024-03-05 07:08:09'"), ("coefs", "points", "neighbours"))
            assert files.select("folder").distinct().count() == 2 * n
        wrote.append(_sizes(block))
        block.clear()
    assert wrote[1]["coefs"] == wrote[0]["coefs"] and wrote[1]["waves"] == wrote[0]["waves"]


def test_small_groups_are_searched_without_scratch_tables(spark):
    with Scratch(spark) as block:
        run = plan.run_tasks(pictures(spark), spark.createDataFrame(TASKS, SCHEMA))
        assert run.neighbours().where("nbr_rank = 1").count() > 0
    assert set(_sizes(block)) == {"settings", "tasks", "coefs", "waves"}
    block.clear()


def test_coefficients_need_no_points(spark):
    with Scratch(spark) as block:
        run = plan.run_tasks(pictures(spark), spark.createDataFrame(TASKS[:1], SCHEMA))
        assert run.coefficients(3).count() == 2 * 3 * (40 + 36)
    assert "points" not in _sizes(block)
    block.clear()


def test_matrices_beyond_one_block_give_the_same(spark, monkeypatch):
    tasks = spark.createDataFrame(TASKS[:2], SCHEMA)
    columns = [*neighbors.GROUP, "point_idx", "x", "y", "n", "nn", "k"]
    want = {str(r) for r in plan.run_tasks(pictures(spark), tasks).graph().select(*columns).collect()}
    monkeypatch.setattr(plan, "BLOCK", 300)
    run = plan.run_tasks(pictures(spark), tasks)
    assert run._beyond and {str(r) for r in run.graph().select(*columns).collect()} == want
