"""Images as relations: files, rows of channels, pixels, colour lookup.

The working form of an image is one row per image line: ``rows(image_id, y, r, g, b)`` with an array of
doubles per channel. Channels are 0 red, 1 green, 2 blue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")
ROWS = "image_id long, y int, r array<double>, g array<double>, b array<double>"
LINES = "image_id long, direction int, channel int, line int, v array<double>"
#: Lines of an image that is made of vectors.
HEIGHT = 64
#: Image kinds that are read, whatever the case of their extensions.
PATTERN = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}"


def read_images(spark: SparkSession, path: str | list[str], pattern: str = PATTERN) -> DataFrame:
    """(image_id, origin, height, width, n_channels, data) of the images below ``path``; 8-bit BGR bytes.

    ``image_id`` is a hash of the origin, so it does not depend on what else is read. Files that are no
    images raise an error.
    """
    raw = spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", "false").load(path).select("image.*")
    checked = raw.withColumn("data", F.when(F.col("height") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), "origin")).cast("binary")))
    return checked.select(F.xxhash64("origin").alias("image_id"), "origin", "height", "width", F.col("nChannels").alias("n_channels"), "data")


def _pixels_of(row: dict) -> np.ndarray:
    """(3, height, width) red, green, blue; grey is repeated, alpha dropped."""
    flat = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["n_channels"])
    return np.repeat(flat, 3, axis=2).transpose(2, 0, 1) if row["n_channels"] == 1 else flat[:, :, 2::-1].transpose(2, 0, 1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("image_id", "height", "width", "n_channels", "data")}
            yield row["image_id"], _pixels_of(row)


def _arrays(block: np.ndarray) -> pa.ListArray:
    """A list array of the rows of a matrix."""
    offsets = np.arange(0, block.size + 1, max(1, block.shape[1]), dtype=np.int32) if block.shape[1] else np.zeros(len(block) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(block, dtype=np.float64).ravel()))


def image_rows(images: DataFrame) -> DataFrame:
    """Decoded ``rows`` of :func:`read_images`; a map over images, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image_id, rgb in _each(batches):
            h = rgb.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([image_id] * h, pa.int64()), pa.array(np.arange(h), pa.int32()), *map(_arrays, rgb)], names=["image_id", "y", *CHANNELS])

    return images.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, ROWS)


def image_lines(images: DataFrame, direction: int) -> DataFrame:
    """``lines`` along rows (0) or columns (1), straight from the images' bytes: neither needs a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image_id, rgb in _each(batches):
            for channel, block in enumerate(rgb):
                block = block.T if direction else block
                n = len(block)
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, t) for v, t in ((image_id, pa.int64()), (direction, pa.int32()), (channel, pa.int32()))] + [pa.array(np.arange(n), pa.int32()), _arrays(block)], names=["image_id", "direction", "channel", "line", "v"])

    return images.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, LINES)


def pixels(rows: DataFrame) -> DataFrame:
    """(image_id, channel, y, x, v) of ``rows``."""
    per_channel = F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias("v")) for i, c in enumerate(CHANNELS)))
    return rows.select("image_id", "y", F.explode(per_channel).alias("c")).select("image_id", "c.channel", "y", F.posexplode("c.v").alias("x", "v")).select("image_id", "channel", "y", "x", "v")


def pixel_lookup(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b) at (image_id, y, x) places; those outside an image give no row.

    The small side is ``places``; rows are matched on image and line, so no pixel is exploded.
    """
    at = places.select("image_id", "y", "x").where("x >= 0 and y >= 0")
    hit = rows.join(at, ["image_id", "y"]).where(F.col("x") < F.size("r"))
    return hit.select("image_id", "y", "x", *(F.get(c, F.col("x")).cast("smallint").alias(c) for c in CHANNELS))


def embedding_rows(spark: SparkSession, sf_dir: str, slot: int = 1 << 16, asked: DataFrame | None = None) -> DataFrame:
    """``rows`` of images made of the embeddings: a vector is an image line, 3 x 21 of its 64 numbers.

    The vectors of a label, in the order of vec_id, are cut into images of :data:`HEIGHT` lines; the last one takes the rest too. So
    an image stays below twice that height and their number grows with the table; the image_id is label + 10 * part.

    A line's place is its rank within the label: its rank among the vectors of its slot, ids of a common ``vec_id div slot``, and the
    number of those in earlier slots. So a label is ranked by as many tasks as it has slots. With ``asked`` (image_id), all vectors are
    ranked, but only those images are returned, and the channels of no others are worked out.
    """
    scaled = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.lit(128.0) + F.lit(256.0) * e.cast("double")).cast("double")))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("label"), "vec_id", F.floor(F.col("vec_id") / slot).alias("slot"), "embedding")
    label = Window.partitionBy("label")
    before = F.coalesce(F.sum("n").over(label.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.greatest(F.lit(1), F.floor(F.sum("n").over(label) / HEIGHT))
    slots = vectors.groupBy("label", "slot").agg(F.count("*").alias("n")).select("label", "slot", before.alias("before"), parts.alias("parts"))
    own = F.row_number().over(Window.partitionBy("label", "slot").orderBy("vec_id")) - 1
    ranked = vectors.withColumn("own", own).join(slots, ["label", "slot"]).withColumn("rank", F.col("own") + F.col("before"))
    part = F.least(F.floor(F.col("rank") / HEIGHT), F.col("parts") - 1)
    placed = ranked.select((F.col("label") + 10 * part).alias("image_id"), (F.col("rank") - HEIGHT * part).cast("int").alias("y"), "embedding")
    placed = placed if asked is None else placed.join(asked.select("image_id").distinct(), "image_id", "left_semi")
    return placed.select("image_id", "y", *(F.transform(F.slice("embedding", 1 + 21 * i, 21), scaled).alias(c) for i, c in enumerate(CHANNELS)))
