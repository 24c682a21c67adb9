"""Queries over the driver's tables, one for each operator; the images are made of ``embeddings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewave.functions.scalars import clamp, colours_selected, cropped_name, duration_text, hex_colour, is_image_name, output_code, round_half_even, scale_label, task_status
from linewave.operators import cluster, color, extrema, geometry, lines, neighbors, transform
from linewave.plans import tasks
from linewave.plans.pipeline import Options, analyse
from linewave.sources import images, scales, sinks

SCALES = [1.0, 2.0, 4.0]
#: Two sample colours.
COLOUR_1, COLOUR_2 = (73, 47, 110), (162, 115, 135)
BOX = (2.0, 3.0, 14.0, 20.0)
TRIANGLE = [(2.0, 2.0), (18.0, 6.0), (6.0, 30.0)]
EPS = 2.0
TASK_SCALES = ((1.0, 2.0), (4.0, 1.5), (3.0, 1.0, 3.0))
K = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.embedding_rows(spark, sf_dir)


def _lines(spark: SparkSession, sf_dir: str, direction: int) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return lines.column_lines(rows) if direction else lines.row_lines(rows)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, 0).unionByName(_lines(spark, sf_dir, 1))


def _coefs(spark: SparkSession, sf_dir: str, *directions: int) -> DataFrame:
    parts = [transform.rounded(transform.morlet(lines.centred(_lines(spark, sf_dir, d)), SCALES)) for d in directions]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _long(df: DataFrame, value: str, digits: int) -> DataFrame:
    keys = [c for c in df.columns if c != value]
    return df.select(*keys, F.posexplode(value).alias("pos", "x")).select(*keys, "pos", round_half_even(F.col("x"), digits).alias(value))


# --- sources, geometry, colours ---------------------------------------------------------------


@query
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of all images."""
    return images.pixels(_rows(spark, sf_dir))


@query
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels decoded from BGR bytes of all files that are named like images; every fourth image is not."""
    bytes_of = F.array_join(F.transform(F.arrays_zip("b", "g", "r"), lambda p: F.concat(*(F.lpad(F.hex(p[c].cast("int")), 2, "0") for c in ("b", "g", "r")))), "")
    packed = _rows(spark, sf_dir).groupBy("image_id").agg(F.count("*").cast("int").alias("height"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", bytes_of.alias("h")))), lambda s: s["h"]), "").alias("h"))
    ends = F.element_at(F.array(*map(F.lit, (".Png", ".JPG", ".jpeg", ".txt"))), (F.col("image_id") % 4 + 1).cast("int"))
    files = packed.select("image_id", F.concat(F.lit("/images/"), "image_id", ends).alias("origin"), "height", F.lit(21).alias("width"), F.lit(3).alias("n_channels"), F.unhex("h").alias("data"))
    return images.pixels(images.image_rows(files.where(is_image_name(F.col("origin")))))


@query
def channel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first and third channel in both directions, a row a pixel."""
    return _long(lines.select_channels(_both(spark, sf_dir), [0, 2]), "v", 6)


@query
def pixel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours at a place for each event, some of them outside the image or of images that are not there."""
    n = F.col("event_id")
    places = spark.read.parquet(f"{sf_dir}/events.parquet").select((n % 30).alias("image_id"), (F.floor(n / 30) % 80 - 3).cast("int").alias("y"), (F.floor(n / 7) % 26 - 2).cast("int").alias("x"))
    found = images.pixel_lookup(_rows(spark, sf_dir), places)
    return found.withColumn("colour", hex_colour(F.col("r"), F.col("g"), F.col("b")))


@query
def crop_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a rectangle."""
    return images.pixels(geometry.crop_rectangle(_rows(spark, sf_dir), *BOX))


@query
def crop_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a polygon's box, black outside it."""
    return images.pixels(geometry.crop_polygon(_rows(spark, sf_dir), TRIANGLE))


def _contours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A contour of 500 vertices for each 500 orders, around the middle of an image; the prices are the distances."""
    n, price = F.col("o_orderkey"), F.col("o_totalprice")
    turn, far = 2 * F.pi() * (n % 500) / 500, 2 + price % 1000 / 100
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    vertices = orders.select(F.floor(n / 500).alias("contour_id"), (n % 500).alias("place"), (10 + far * F.cos(turn)).alias("x"), (25 + 2 * far * F.sin(turn)).alias("y"))
    full = vertices.groupBy("contour_id").agg(F.count("*").alias("n")).where("n >= 3")
    return full.select("contour_id", (F.col("contour_id") % 10).alias("image_id")), vertices.join(full.select("contour_id"), "contour_id", "left_semi")


@query
def crop_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the boxes of freehand contours, black outside them."""
    return _contour_pixels(geometry.contoured(_rows(spark, sf_dir), *_contours(spark, sf_dir), 0.0, crop=True))


@query
def mask_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels of the images of freehand contours, white outside them."""
    return _contour_pixels(geometry.contoured(_rows(spark, sf_dir), *_contours(spark, sf_dir)))


def _contour_pixels(found: DataFrame) -> DataFrame:
    own = images.pixels(found.drop("image_id").withColumnRenamed("contour_id", "image_id"))
    return own.withColumnRenamed("image_id", "contour_id")


@query
def mask_polygon_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels, white outside a polygon."""
    return images.pixels(geometry.mask_polygon(_rows(spark, sf_dir), TRIANGLE))


def _colour(*parts: Column) -> Column:
    return F.array(*(p.cast("int") for p in parts))


@query
def gs_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthonormal basis of two colours of each part."""
    n = F.col("p_partkey")
    pairs = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", color.basis_of(_colour(1 + n * 37 % 255, n * 91 % 256, F.lit(0)), _colour(n * 13 % 256, n * 29 % 256, 1 + n * 71 % 255)).alias("basis"))
    weights = pairs.select("p_partkey", F.explode(color.basis_weights(F.col("basis"))).alias("w")).select("p_partkey", "w.*")
    return weights.withColumn("weight", round_half_even(F.col("weight"), 9))


@query
def gs_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the new basis."""
    return images.pixels(color.change_basis(_rows(spark, sf_dir), COLOUR_1, COLOUR_2)).withColumn("v", round_half_even(F.col("v"), 6))


@query
def basis_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the new channels differ from the old ones."""
    rows = _rows(spark, sf_dir)
    return color.basis_applied(color.change_basis(rows, COLOUR_1, COLOUR_2), rows)


@query
def scale_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of a range for each order, some of them empty and some counted down."""
    n = F.col("o_orderkey")
    ranges = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (1 + n % 4).alias("start"), (n % 13 - 1).alias("end"), F.when(n % 5 == 0, -2).otherwise(1 + n % 3).alias("step"))
    return scales.scales_of_ranges(ranges, "o_orderkey")


@query
def scale_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales from the lines of text of each customer, a line for each order, some of them empty."""
    n = F.col("o_orderkey")
    text = F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\t"), n % 90 + 1, F.lit("  "), (n % 7 + 1) / 2, F.lit(" ")))
    lines_of = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", n.alias("line_no"), text.alias("value"))
    return scales.parse_scales(lines_of, keys=("o_custkey",))


# --- lines and transform -----------------------------------------------------------------------


def _means(spark: SparkSession, sf_dir: str, direction: int) -> DataFrame:
    return lines.line_means(_lines(spark, sf_dir, direction)).withColumn("mean", round_half_even(F.col("mean"), 9))


@query
def row_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each row."""
    return _means(spark, sf_dir, 0)


@query
def col_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each column."""
    return _means(spark, sf_dir, 1)


@query
def center_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their mean."""
    return _long(lines.centred(_lines(spark, sf_dir, 0)), "v", 6)


@query
def center_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without their mean."""
    return _long(lines.centred(_lines(spark, sf_dir, 1)), "v", 6)


@query
def reflect_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored index of every point of every padded line of both directions."""
    pad = transform.padding(SCALES)
    sized = _both(spark, sf_dir).select("image_id", "direction", "channel", "line", F.size("v").alias("n"))
    k = F.explode(F.sequence(F.lit(-pad), F.col("n") + pad - 1))
    return sized.withColumn("k", k).select("image_id", "direction", "channel", "line", "k", transform.reflected(F.col("k"), F.col("n")).alias("m"))


@query
def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel weights for every line length."""
    lengths = _lines(spark, sf_dir, 0).unionByName(_lines(spark, sf_dir, 1)).select(F.size("v").alias("n"))
    return transform.kernel_frame(spark, lengths, SCALES).withColumn("w", round_half_even(F.col("w"), 9))


@query
def morlet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients along rows."""
    return transform.cells(_coefs(spark, sf_dir, 0))


@query
def morlet_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients along columns."""
    return transform.cells(_coefs(spark, sf_dir, 1))


@query
def morlet_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of both directions by SQL functions alone."""
    return transform.cells(transform.rounded(transform.morlet_native(lines.centred(_both(spark, sf_dir)), SCALES, check=False)))


@query
def morlet_mirrored_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of both directions, each scale with its own pad."""
    return transform.cells(transform.rounded(transform.morlet(lines.centred(_both(spark, sf_dir)), SCALES, "mirrored_each")))


@query
def morlet_unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of both directions without a pad."""
    return transform.cells(transform.rounded(transform.morlet(lines.centred(_both(spark, sf_dir)), SCALES, "none")))


# --- extrema -------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return extrema.raw_points(_coefs(spark, sf_dir, 0, 1), [name]).drop("extreme_type")


@query
def row_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict maxima within rows."""
    return _raw(spark, sf_dir, "max_by_row")


@query
def row_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict minima within rows."""
    return _raw(spark, sf_dir, "min_by_row")


@query
def col_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict maxima within columns."""
    return _raw(spark, sf_dir, "max_by_column")


@query
def col_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict minima within columns."""
    return _raw(spark, sf_dir, "min_by_column")


@query
def extreme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of strict extrema of each type in each matrix."""
    return extrema.point_counts(extrema.raw_points(_coefs(spark, sf_dir, 0, 1)))


def _envelope(spark: SparkSession, sf_dir: str, axis: int, upper: bool) -> DataFrame:
    return _long(extrema.envelopes(extrema.matrix_lines(_coefs(spark, sf_dir, 0, 1), axis), upper), "env", 6)


@query
def env_upper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper envelope of every row."""
    return _envelope(spark, sf_dir, 0, True)


@query
def env_lower_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower envelope of every row."""
    return _envelope(spark, sf_dir, 0, False)


@query
def env_upper_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper envelope of every column."""
    return _envelope(spark, sf_dir, 1, True)


@query
def env_lower_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower envelope of every column."""
    return _envelope(spark, sf_dir, 1, False)


def _points(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    return extrema.numbered(extrema.peak_points(_coefs(spark, sf_dir, 0, 1), list(types) or None))


@query
def peaks_max_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the rows' upper envelopes."""
    return _points(spark, sf_dir, "max_by_row")


@query
def peaks_min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the rows' lower envelopes, upside down."""
    return _points(spark, sf_dir, "min_by_row")


@query
def peaks_max_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the columns' upper envelopes."""
    return _points(spark, sf_dir, "max_by_column")


@query
def peaks_min_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the columns' lower envelopes, upside down."""
    return _points(spark, sf_dir, "min_by_column")


@query
def point_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of envelope peaks of each image and of all."""
    return extrema.peak_points(_coefs(spark, sf_dir, 0, 1)).rollup("image_id").agg(F.count("*").alias("n_points"))


# --- neighbours ----------------------------------------------------------------------------------


def _analysed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(_rows(spark, sf_dir), Options(scales=tuple(SCALES), k=K)).points


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", round_half_even(F.col("distance"), 6))


@query
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every point in its matrix and type."""
    return _plain(neighbors.nearest(_analysed_points(spark, sf_dir), K))


@query
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from points to their neighbours."""
    return _plain(neighbors.graph_edges(neighbors.graph(_analysed_points(spark, sf_dir), K)))


@query
def knn_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections and points of each graph."""
    return neighbors.degrees(neighbors.nearest(_analysed_points(spark, sf_dir), K))


# --- text outputs and task tables ------------------------------------------------------------------


@query
def channel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original channels as text."""
    return sinks.channel_text(_lines(spark, sf_dir, 0))


@query
def means_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of both directions as text."""
    return sinks.means_text(lines.line_means(_both(spark, sf_dir)))


@query
def coef_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of both directions as text with three decimals, a matrix row a line."""
    return sinks.coefficient_text(extrema.matrix_lines(transform.morlet(lines.centred(_both(spark, sf_dir)), SCALES), 0))


@query
def points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as text."""
    return sinks.point_text(_points(spark, sf_dir))


@query
def knn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour graphs as text."""
    return sinks.graph_text(neighbors.texts(_analysed_points(spark, sf_dir), K), K, F.col("scale").cast("string"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags and a number for each order, as stand-ins for task settings."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("image"), (F.col("o_orderkey") % 3 == 0).alias("text"), F.col("o_totalprice").alias("value"))


@query
def output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output code of the flags."""
    return _flags(spark, sf_dir).select("o_orderkey", output_code(F.col("image"), F.col("text")).alias("code"))


@query
def duration_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as seconds in hours, minutes and seconds."""
    return _flags(spark, sf_dir).select("o_orderkey", duration_text(F.col("value")).alias("duration"))


@query
def clamp_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices limited to a range."""
    return _flags(spark, sf_dir).select("o_orderkey", clamp(F.col("value"), 50000.0, 150000.0).alias("v"))


@query
def cropped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cropped copies of the pages' addresses taken as paths."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", cropped_name(F.col("url")).alias("name"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task table made of the orders: image, scales and colours are there or not by the key."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("task_id"),
        F.when(key % 5 != 0, F.concat(F.lit("/images/"), key, F.lit(".png"))).alias("image_path"),
        F.when(key % 3 != 0, F.transform(F.sequence(F.lit(1), (1 + key % 7).cast("int")), lambda i: i.cast("double"))).alias("scales"),
        F.when(key % 2 == 0, F.array(F.lit(73), F.lit(47), F.lit(110))).alias("color1"),
        F.when(key % 4 == 0, F.array(F.lit(162), F.lit(115), F.lit(135))).otherwise(F.array().cast("array<int>")).alias("color2"),
    )


@query
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task waits for."""
    chosen = colours_selected(F.col("color1"), F.col("color2"))
    return _tasks(spark, sf_dir).select("task_id", chosen.alias("colours"), task_status(F.col("image_path").isNotNull(), F.size("scales"), chosen).alias("status"))


@query
def result_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder of each task's results at each of its scales; a task began when its order was placed."""
    began = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("began"))
    each = _tasks(spark, sf_dir).select("task_id", F.explode("scales").alias("scale")).join(began, "task_id")
    folder = sinks.result_folder(F.concat(F.lit("Задача "), "task_id"), F.col("began"), scale_label(F.col("scale"), True))
    return each.select("task_id", "scale", folder.alias("folder"))


@query
def ready_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks are ready."""
    return scales.ready_tasks(_tasks(spark, sf_dir))


@query
def scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of each task's scales where they come in no order."""
    each = _tasks(spark, sf_dir).select("task_id", F.posexplode(F.transform("scales", lambda s: s * 5 % 8)).alias("scale_idx", "scale"))
    return scales.scale_summary(each.withColumn("scale_label", scale_label(F.col("scale"), True)), "task_id")


# --- clusters ----------------------------------------------------------------------------------------


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.density_clusters(_points(spark, sf_dir), EPS)


def _rounded_centroids(clusters: DataFrame) -> DataFrame:
    return cluster.centroids(clusters).withColumns({c: round_half_even(F.col(c), 6) for c in ("x", "y")})


@query
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the peaks of all four types."""
    return _clusters(spark, sf_dir)


@query
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of clusters of each matrix and type."""
    return cluster.cluster_counts(_clusters(spark, sf_dir))


@query
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the clusters of all four types."""
    return _rounded_centroids(_clusters(spark, sf_dir))


@query
def argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each matrix's largest coefficient."""
    return extrema.largest_coefficients(_coefs(spark, sf_dir, 0, 1))


@query
def greedy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tree over the centroids of every matrix and type, from the place of the matrix's largest coefficient.

    Of several such places the first by (y, x) is the root.
    """
    run = analyse(_rows(spark, sf_dir), Options(scales=tuple(SCALES)))
    largest = extrema.largest_coefficients(transform.rounded(run.coefs))
    roots = largest.groupBy(*extrema.MATRIX).agg(F.min(F.struct("y", "x")).alias("at")).select(*extrema.MATRIX, "at.x", "at.y")
    return cluster.greedy_trees(cluster.centroids(cluster.density_clusters(run.points, EPS)), roots)


@query
def pipeline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the whole analysis after the change of basis."""
    return analyse(_rows(spark, sf_dir), Options(scales=tuple(SCALES), colours=(COLOUR_1, COLOUR_2))).points


# --- runs of tasks -------------------------------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str) -> tasks.TaskRun:
    """A task for each supplier: image, colours, scales, k and flags by its number; every ninth has no scales and is left out."""
    n = F.col("s_suppkey")
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        n.alias("task_id"),
        (n % 10).alias("image_id"),
        F.when(n % 4 != 0, _colour(1 + n * 37 % 255, n * 91 % 256, F.lit(0))).alias("color1"),
        _colour(n * 13 % 256, n * 29 % 256, 1 + n * 71 % 255).alias("color2"),
        F.when(n % 9 != 0, F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in TASK_SCALES)), (n % 3 + 1).cast("int"))).alias("scales"),
        F.when(n % 6 != 0, (n % 6).cast("int")).alias("k"),
        (n % 5 != 0).alias("rows"),
        (n % 7 != 0).alias("cols"),
        F.when(n % 2 == 0, n % 11 != 0).alias("max"),
        "s_name",
    )
    return tasks.run_tasks(images.embedding_rows(spark, sf_dir, asked=own), own, skip=True)


def _of_task(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("image_id", "task_id")


@query
def task_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of every task at its own scales, after its own change of basis."""
    return _of_task(transform.cells(_run(spark, sf_dir).coefficients(3)))


@query
def task_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every task, of the types that it asks for."""
    return _of_task(_run(spark, sf_dir).points)


@query
def task_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every task's points, as many as it asks for."""
    return _of_task(_plain(_run(spark, sf_dir).neighbours()))


@query
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, points and neighbour graphs as text files of their names, in the folders of their tasks and scales."""
    began = F.make_timestamp(F.lit(2024), F.lit(1) + F.col("task_id").cast("int") % 12, F.lit(1), F.col("task_id").cast("int") % 24, F.lit(30), F.lit(0))
    return _run(spark, sf_dir).files(F.col("s_name"), began.cast("timestamp_ntz"), ("coefs", "points", "neighbours"))
