"""Text results as named files: bytes, order, retries, failures."""

import os

import pytest
from pyspark.sql import functions as F

from linewave.sources.textfiles import save_files

SCHEMA = "folder string, file string, line int, text string"


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs}


def rows(n):
    return [(f"ВП/{i % 3}", f"Точки_{i % 2}", j, f"{i}é, {j}") for i in range(6) for j in range(n)]


def test_files_have_their_names_and_lines_in_order(spark, tmp_path):
    df = spark.createDataFrame(rows(200), SCHEMA).repartition(7).withColumn("more", F.lit(1))
    save_files(df, str(tmp_path))
    want = {}
    for folder, file, _, text in sorted(rows(200), key=lambda r: r[:3] + (r[3],)):
        want[f"{folder}/{file}.txt"] = want.get(f"{folder}/{file}.txt", b"") + f"{text}\n".encode()
    assert tree(tmp_path) == want
    assert not os.path.exists(tmp_path / "_staging")


def test_a_taken_name_is_an_error_unless_overwritten(spark, tmp_path):
    save_files(spark.createDataFrame([("a", "b", 0, "old")], SCHEMA), str(tmp_path))
    new = spark.createDataFrame([("a", "b", 1, None), ("a", "b", 0, "new"), ("a/c", "d", 0, "")], SCHEMA)
    with pytest.raises(Exception, match="there already"):
        save_files(new, str(tmp_path))
    assert tree(tmp_path) == {"a/b.txt": b"old\n"}
    save_files(new, "file://" + str(tmp_path), overwrite=True)
    assert tree(tmp_path) == {"a/b.txt": b"new\n\n", "a/c/d.txt": b"\n"}


@pytest.mark.parametrize("folder, file", [("..", "x"), ("a//b", "x"), ("a", "x/y"), ("_staging", "x"), ("/etc", "x")])
def test_names_beyond_the_target_are_refused_and_leave_nothing(spark, tmp_path, folder, file):
    with pytest.raises(Exception, match="not the name of a file"):
        save_files(spark.createDataFrame([("good", "g", 0, "t"), (folder, file, 0, "t")], SCHEMA), str(tmp_path))
    assert tree(tmp_path) == {}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(rows(50), SCHEMA)
    failing = df.withColumn("text", F.when((F.col("line") == 49) & F.col("folder").endswith("2"), F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        save_files(failing, str(tmp_path))
    assert tree(tmp_path) == {} and not os.path.exists(tmp_path / "_staging")
    save_files(df.limit(0), str(tmp_path))
    assert tree(tmp_path) == {}


def test_leftovers_of_other_attempts_are_not_taken(spark, tmp_path):
    from linewave.sources.textfiles import NamedTextWriter

    writer = NamedTextWriter(str(tmp_path), False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"folder": "a", "file": "b", "line": 0, "text": "t"}])
    writer.write(iter([batch]))  # an attempt whose message is lost
    kept = writer.write(iter([batch]))
    writer.commit([kept, None])
    assert tree(tmp_path) == {"a/b.txt": b"t\n"}
