"""Lines of images: rows, columns, transposition, means and centring.

``lines(image_id, direction, channel, line, v)``: direction 0 runs along rows (line = y, position = x), 1 along
columns. Functions of (line, position) relations serve both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewave.sources.images import CHANNELS

ROWS, COLUMNS = 0, 1
#: Side of the tiles in which lines are turned across.
TILE = 128


def row_lines(rows: DataFrame) -> DataFrame:
    """Lines along rows, a map over ``rows``."""
    each = F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias("v")) for i, c in enumerate(CHANNELS)))
    return rows.select("image_id", F.col("y").alias("line"), F.explode(each).alias("c")).select("image_id", F.lit(ROWS).alias("direction"), "c.channel", "line", "c.v")


def transposed(lines: DataFrame, keys: list[str], line: str = "line", values: str = "v", tile: int = TILE) -> DataFrame:
    """Lines across the given ones: (keys, line, values) with line and position swapped.

    Lines are cut into segments of ``tile`` values, and the segments of ``tile`` lines meet as a tile, which is turned
    where it is; the turned segments meet by the new line. Two shuffles of segments, none of single values; no group holds more
    than a tile or the segments of one line. Null and empty lines have no segments; lines may have unlike lengths.
    """
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), ((n - 1) / tile).cast("int")), lambda i: F.slice(values, i * tile + 1, F.lit(tile)))
    segments = lines.where(F.col(values).isNotNull() & (n > 0)).select(*keys, F.col(line).alias("_from"), F.posexplode(cut).alias("_tx", "_v"))
    tiles = segments.groupBy(*keys, F.floor(F.col("_from") / tile).cast("int").alias("_ty"), "_tx").agg(F.array_sort(F.collect_list(F.struct("_from", "_v"))).alias("_rows"))
    widest = F.array_max(F.transform("_rows", lambda r: F.size(r["_v"])))
    turned = F.transform(F.sequence(F.lit(0), widest - 1), lambda i: F.transform(F.filter("_rows", lambda r: F.size(r["_v"]) > i), lambda r: F.get(r["_v"], i)))
    across = tiles.select(*keys, "_ty", "_tx", F.posexplode(turned).alias("_i", "_v"))
    whole = across.groupBy(*keys, (F.col("_tx") * tile + F.col("_i")).cast("int").alias(line)).agg(F.array_sort(F.collect_list(F.struct("_ty", "_v"))).alias("_all"))
    return whole.select(*keys, line, F.flatten(F.transform("_all", lambda s: s["_v"])).alias(values))


def column_lines(rows: DataFrame) -> DataFrame:
    """Lines along columns."""
    across = transposed(row_lines(rows).drop("direction"), ["image_id", "channel"])
    return across.select("image_id", F.lit(COLUMNS).alias("direction"), "channel", "line", "v")


def select_channels(lines: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """The lines of these channels; of all by default."""
    return lines if channels is None else lines.where(F.col("channel").isin(channels))


def mean_of(values: Column) -> Column:
    """Mean of an array, summed from its first element on; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def line_means(lines: DataFrame) -> DataFrame:
    """(image_id, direction, channel, line, mean)."""
    return lines.select("image_id", "direction", "channel", "line", mean_of(F.col("v")).alias("mean"))


def centred(lines: DataFrame) -> DataFrame:
    """Lines with their own mean taken off; a map, no window and no shuffle.

    The mean stands beside the lambda, as a repeated value: inside it would be summed again for each point.
    """
    means = F.array_repeat(mean_of(F.col("v")), F.size("v"))
    return lines.withColumn("v", F.zip_with("v", means, lambda v, m: v - m))
