"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_watching: list["Scratch"] = []


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="linewave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/linewave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is unset, a temporary folder is taken by a local master; any other raises an error."""
    path = f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for block in _watching:
        block.paths.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result that was made of them is needed any more."""
    _delete(spark, _scratch_root(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The scratch paths given out within a ``with`` block; :meth:`clear` deletes them once no result needs them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        _watching.append(self)
        return self

    def __exit__(self, *_) -> None:
        _watching.remove(self)

    def clear(self) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
