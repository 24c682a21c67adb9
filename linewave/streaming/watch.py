"""Analyse images as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linewave.plans.pipeline import Options, analyse
from linewave.sources.images import PATTERN, image_rows, read_images


def watch_images(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Start a query that writes each batch's points to ``out``/batch=N.

    A batch holds at most ``files_per_batch`` new files; its paths alone go to the driver. A batch that is
    run again replaces its own folder, so results are there once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_per_batch).load(path)

    def each(batch: DataFrame, number: int) -> None:
        files = [r.path for r in batch.select("path").collect()]
        if files:
            points = analyse(image_rows(read_images(spark, files)), options).points
            points.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
