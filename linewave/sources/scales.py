"""Scales from a range or from text, their summary, and task checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewave.functions.scalars import scale_label


def scales_from_range(spark: SparkSession, start: int = 1, end: int = 10, step: int = 1) -> DataFrame:
    """(scale_idx, scale, scale_label) of start, start+step, ... up to ``end``; empty where start > end."""
    if step <= 0:
        raise ValueError("the step must be positive")
    rows = spark.range(start, end + 1, step).select(F.col("id").cast("double").alias("scale"))
    return rows.select(((F.col("scale") - start) / step).cast("int").alias("scale_idx"), "scale", scale_label(F.col("scale"), True).alias("scale_label"))


def scales_of_ranges(ranges: DataFrame, *keys: str, start: str = "start", end: str = "end", step: str = "step") -> DataFrame:
    """(keys, scale_idx, scale, scale_label) of the whole numbers start, start+step, ... before ``end`` + 1, for every row.

    A negative step counts down and stops before ``end`` + 1 as well; ranges of no numbers give no rows; a step of 0 raises an
    error. A null start or step is 1, a null end 10, as blank fields are. ``keys`` tell the ranges apart.
    """
    a, b, d = (F.coalesce(F.col(c).cast("long"), F.lit(n)) for c, n in ((start, 1), (end, 10), (step, 1)))
    step_of = F.when(d != 0, d).otherwise(F.raise_error(F.lit("the step must not be 0")).cast("long"))
    n = F.greatest(F.lit(0), F.ceil((b + 1 - a) / step_of)).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (a + (i - 1) * d).cast("double"))
    listed = ranges.select(*keys, F.posexplode(F.when(n > 0, each)).alias("scale_idx", "scale"))
    return listed.withColumn("scale_label", scale_label(F.col("scale"), True))


def parse_scales(lines: DataFrame, text: str = "value", order: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, scale_idx, scale, scale_label) of white-space separated numbers in (keys, line_no, value) rows.

    Order and repetitions are kept, empty and null lines give nothing, a word that is no number raises an error. A scale file is
    a line of settings: its numbers are gathered in one row for each value of ``keys``.
    """
    at = F.col("line_no") if order is None else order
    split = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    words = lines.select(*keys, at.alias("line_no"), F.posexplode(split).alias("place", "word")).where("word <> ''")
    numbers = words.select(*keys, "line_no", "place", F.col("word").cast("double").alias("scale"))
    all_of = numbers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "place", "scale"))).alias("all"))
    placed = all_of.select(*keys, F.posexplode("all").alias("scale_idx", "s"))
    return placed.select(*keys, "scale_idx", F.col("s.scale").alias("scale"), scale_label(F.col("s.scale"), False).alias("scale_label"))


def scales_from_file(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_scales` of a text file, read as one value."""
    return parse_scales(spark.read.text(path, wholetext=True).withColumn("line_no", F.lit(0)))


def scale_summary(scales: DataFrame, *keys: str) -> DataFrame:
    """For each key: number of scales and, up to five, their list as given, else the smallest and the largest."""
    own = scales.groupBy(*keys).agg(F.count("*").alias("n_scales"), F.min_by("scale_label", "scale").alias("least"), F.max_by("scale_label", "scale").alias("most"), F.array_sort(F.collect_list(F.struct("scale_idx", "scale_label"))).alias("s"))
    listed = F.array_join(F.transform("s", lambda s: s["scale_label"]), ", ")
    span = F.concat("least", F.lit(".."), "most")
    return own.select(*keys, "n_scales", F.when(F.col("n_scales") <= 5, listed).otherwise(span).alias("summary"))


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """(n_tasks, n_ready, all_ready): tasks with an image and at least one scale."""
    ready = F.col("image_path").isNotNull() & (F.coalesce(F.size("scales"), F.lit(0)) > 0)
    counts = tasks.agg(F.count("*").alias("n_tasks"), F.count_if(ready).alias("n_ready"))
    return counts.withColumn("all_ready", (F.col("n_tasks") > 0) & (F.col("n_tasks") == F.col("n_ready")))
