"""Rectangle and contour crops of image rows.

A rectangle is a filter and a map of arrays. Contours are data: their edges are named by the rows they cross, and a row meets its
crossings by an equi-join, so a contour of thousands of vertices costs what its crossings cost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewave.sources.images import CHANNELS

#: A selection of this many pixels or fewer along either axis is no crop.
LEAST_SIDE = 10


def _slice(rows: DataFrame, x1: int, x2: Column, y1: int) -> DataFrame:
    return rows.select("image_id", (F.col("y") - y1).alias("y"), *(F.slice(c, x1 + 1, F.greatest(x2 - x1, F.lit(0))).alias(c) for c in CHANNELS))


def crop_rectangle(rows: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Half-open box x1..x2, y1..y2, clamped to each image, with coordinates from 0 again.

    Corners may come in any order and are rounded half to even. A box with a side of 10 pixels or less
    raises an error; one that misses an image leaves none of its lines.
    """
    (x1, x2), (y1, y2) = sorted((x1, x2)), sorted((y1, y2))
    if x2 - x1 <= LEAST_SIDE or y2 - y1 <= LEAST_SIDE:
        raise ValueError(f"the rectangle must be more than {LEAST_SIDE} pixels wide and high")
    a, b, c, d = max(0, round(x1)), max(0, round(y1)), round(x2), round(y2)
    inside = rows.where((F.col("y") >= b) & (F.col("y") < d) & (F.size("r") > a))
    return _slice(inside, a, F.least(F.lit(c), F.size("r")), b)


def bounding_box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    """Smallest x, y and largest x, y."""
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def contour_edges(vertices: DataFrame) -> DataFrame:
    """(contour_id, xa, ya, xb, yb) of (contour_id, place, x, y) vertices: each with the next by place, the last with the first.

    A contour of fewer than three vertices raises an error; equal places go by x and y; null coordinates are left out.
    """
    own = Window.partitionBy("contour_id").orderBy("place", "x", "y")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = vertices.where("x is not null and y is not null").select("contour_id", "place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    after = lambda c: F.coalesce(F.lead(c).over(own), F.first(c).over(whole)).alias(f"{c}b")
    edges = known.select("contour_id", F.col("x").alias("xa"), F.col("y").alias("ya"), after("x"), after("y"), F.count("*").over(whole).alias("n"))
    few = F.raise_error(F.lit("a contour needs at least three points")).cast("double")
    return edges.select("contour_id", F.when(F.col("n") >= 3, F.col("xa")).otherwise(few).alias("xa"), "ya", "xb", "yb")


def scanlines(edges: DataFrame) -> DataFrame:
    """(contour_id, y, cuts): where the edges of each contour cross each whole row, in order of x.

    An edge is active from its upper end, which counts, to its lower one, which does not; so it is named once for each row that it
    crosses, whatever the number of edges. Level edges cross nothing. The rows of a contour are its own, one array each.
    """
    low, high = F.ceil(F.least("ya", "yb")).cast("int"), (F.ceil(F.greatest("ya", "yb")) - 1).cast("int")
    active = edges.where(low <= high).withColumn("y", F.explode(F.sequence(low, high)))
    at = (F.col("xb") - F.col("xa")) * (F.col("y") - F.col("ya")) / (F.col("yb") - F.col("ya")) + F.col("xa")
    return active.groupBy("contour_id", "y").agg(F.array_sort(F.collect_list(at)).alias("cuts"))


def _inside(cuts: Column, n: Column) -> Column:
    """For x = 0 .. n-1: whether the number of cuts to the right of x is odd. Runs between the cuts, so no pixel looks at all cuts."""
    ends = F.transform(cuts, lambda c: F.least(n, F.greatest(F.lit(0), F.ceil(c).cast("int"))))  # x < c as x < ceil(c)
    edges = F.concat(F.array(F.lit(0)), ends, F.array(n))
    runs = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.array_repeat((F.size(cuts) - i) % 2 == 1, F.get(edges, i + 1) - F.get(edges, i)))
    return F.flatten(runs)


def _filled(rows: DataFrame, lines: DataFrame, outside: float, on: list[str]) -> DataFrame:
    """``rows`` with ``outside`` beyond the contour whose ``lines`` they meet; rows that no line meets are outside as a whole."""
    met = rows.join(lines, on, "left").withColumn("_in", _inside(F.coalesce("cuts", F.array().cast("array<double>")), F.size("r")))
    return met.withColumns({c: F.zip_with(c, "_in", lambda v, i: F.when(i, v).otherwise(F.lit(float(outside)))) for c in CHANNELS}).drop("_in", "cuts")


def _masked(rows: DataFrame, points: list[tuple[float, float]], outside: float) -> DataFrame:
    """Even-odd rule on pixel centres at whole coordinates, by the scanlines of one contour."""
    vertices = rows.sparkSession.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "contour_id long, place long, x double, y double")
    return _filled(rows, scanlines(contour_edges(vertices)).drop("contour_id"), outside, ["y"]).select("image_id", "y", *CHANNELS)


def contoured(rows: DataFrame, contours: DataFrame, vertices: DataFrame, outside: float = 255.0, crop: bool = False) -> DataFrame:
    """(contour_id, image_id, y, r, g, b): the images of (contour_id, image_id) ``contours``, ``outside`` beyond each contour.

    ``vertices`` (contour_id, place, x, y) are data: a contour may have thousands, and images may have several. With ``crop``, an image is
    cut to its contour's box (rounded half to even, half-open, clamped), with coordinates from 0. Contours without vertices and
    images that are not there give no rows. Three equi-joins and a grouping, all by contour or image.
    """
    edges = contour_edges(vertices)
    lines = scanlines(edges)
    box = edges.groupBy("contour_id").agg(*(f(c).alias(n) for n, f, c in (("x1", F.min, "xa"), ("y1", F.min, "ya"), ("x2", F.max, "xa"), ("y2", F.max, "ya"))))
    box = box.select("contour_id", *(F.greatest(F.lit(0), F.bround(c).cast("int")).alias(c) for c in ("x1", "y1", "x2", "y2")))
    own = contours.select("contour_id", "image_id").join(box, "contour_id").join(rows, "image_id")
    if crop:
        own = own.where((F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.size("r") > F.col("x1")))
    filled = _filled(own, lines, outside, ["contour_id", "y"])
    if crop:
        wide = F.greatest(F.least(F.col("x2"), F.size("r")) - F.col("x1"), F.lit(0))
        filled = filled.withColumns({c: F.slice(c, F.col("x1") + 1, wide) for c in CHANNELS}).withColumn("y", F.col("y") - F.col("y1"))
    return filled.select("contour_id", "image_id", "y", *CHANNELS)


def _checked(points: list[tuple[float, float]]) -> None:
    if len(points) < 3:
        raise ValueError("a polygon needs at least three points")


def crop_polygon(rows: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """Black outside the polygon, cut to its bounding box (half-open, clamped to the image)."""
    _checked(points)
    x1, y1, x2, y2 = bounding_box(points)
    a, b, c, d = max(0, round(x1)), max(0, round(y1)), round(x2), round(y2)
    inside = rows.where((F.col("y") >= b) & (F.col("y") < d) & (F.size("r") > a))
    return _slice(_masked(inside, points, 0.0), a, F.least(F.lit(c), F.size("r")), b)


def mask_polygon(rows: DataFrame, points: list[tuple[float, float]], outside: float = 255.0) -> DataFrame:
    """The image in its size, ``outside`` (white) beyond the polygon."""
    _checked(points)
    if not math.isfinite(outside):
        raise ValueError("the outside value must be finite")
    return _masked(rows, points, outside)
