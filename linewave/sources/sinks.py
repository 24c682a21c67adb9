"""Text forms of channels, means, coefficients, points and neighbours, and the folder layout they go to.

Each function gives rows of text with the keys of the file they belong to and their place in it; ``save_text`` writes
them as partitioned text files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewave.functions.scalars import round_half_even
from linewave.operators.extrema import MATRIX
from linewave.operators.neighbors import GROUP, listed_texts

# Names and captions of the text outputs.
COLOURS = ("Red", "Green", "Blue")
DIRECTIONS = ("Str", "Tr")
ROOT_FOLDER, SCALE_FOLDER = "ВП_", "Scale_"
CHANNEL_FILE = "Исходный_цветовой_канал_"
KNN_HEAD = ("Масштаб: ", "Канал: ", "Тип экстремумов: ", "Количество соседей (k): ", "Всего точек: ")
COLOUR_NAMES = ("Красный", "Зелёный", "Синий")
COEFFICIENT_FILE = ("Расчет_вейвлетов_", "_Масштаб_")
POINT_FILES = {"max_by_row": "Точки_максимума_по_строкам", "max_by_column": "Точки_максимума_по_cтолбцам", "min_by_row": "Точки_минимума_по_строкам", "min_by_column": "Точки_минимума_по_cтолбцам"}
POINT_SCALE = "_масштаб_"
KNN_FILE = ("KNN_", "_Info_Scale_", "_Channel_")
KNN_CAPTION = "Индекс точки, X координата, Y координата, Индексы соседей, Расстояния до соседей"


def colour_name(channel: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COLOURS)), channel + 1)


def channel_text(row_lines: DataFrame) -> DataFrame:
    """(image_id, file, line, text): whole numbers, comma-separated, an image row a line."""
    text = F.array_join(F.transform("v", lambda v: v.cast("long").cast("string")), ",")
    return row_lines.select("image_id", F.concat(F.lit(CHANNEL_FILE), colour_name(F.col("channel"))).alias("file"), "line", text.alias("text"))


def means_text(means: DataFrame) -> DataFrame:
    """(image_id, file, line, text): one mean a line."""
    kind = F.when(F.col("direction") == 0, F.lit("rows")).otherwise(F.lit("cols"))
    return means.select("image_id", F.concat(F.lit("mean_to_"), kind, F.lit("_by_channel_"), F.col("channel")).alias("file"), "line", F.col("mean").cast("string").alias("text"))


def coefficient_text(row_coefs: DataFrame) -> DataFrame:
    """(matrix keys, line, text): three decimals of the unrounded coefficients, comma-separated, a matrix row a line."""
    return row_coefs.select(*MATRIX, "line", F.array_join(F.transform("c", lambda c: F.format_string("%.3f", c)), ",").alias("text"))


def decimals(values: np.ndarray, ends: np.ndarray, digits: int) -> pa.Array:
    """Texts of lists of numbers, the values between ``ends``: so many decimals, comma-separated, with a minus also before a negative number that rounds to 0."""
    whole = np.rint(values * float(10**digits)).astype(np.int64)
    unscaled = np.stack([whole, whole >> 63], axis=1)  # 128 bits a number
    text = pa.Array.from_buffers(pa.decimal128(38, digits), len(whole), [None, pa.py_buffer(unscaled.tobytes())]).cast(pa.string())
    below = (whole == 0) & (values < 0)
    if below.any():
        text = pc.if_else(pa.array(below), f"-{0:.{digits}f}", text)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text), ",")


def point_text(points: DataFrame) -> DataFrame:
    """(group keys, line, text): ``x, y`` a line; groups without points have no line."""
    other = [c for c in points.columns if c not in (*GROUP, "point_idx", "x", "y")]
    return points.select(*GROUP, *other, F.col("point_idx").alias("line"), F.concat_ws(", ", "x", "y").alias("text"))


def neighbour_text(neighbours: DataFrame, points: DataFrame, k: int | str, label: Column) -> DataFrame:
    """(group keys, line, text): five lines of head, an empty one, the caption, then a line a point.

    Groups of fewer than two points have no text. ``label`` is how a scale is printed; ``k`` a number or a column of ``points``.
    """
    own = neighbours.groupBy(*GROUP, "point_idx").agg(F.array_sort(F.collect_list(F.struct("nbr_rank", "nbr_idx", "distance"))).alias("nn"))
    ids = F.array_join(F.transform("nn", lambda s: s["nbr_idx"].cast("string")), ", ")
    far = F.array_join(F.transform("nn", lambda s: F.format_string("%.2f", round_half_even(s["distance"], 2))), ", ")
    body = points.select(*GROUP, "point_idx", "x", "y").join(own, [*GROUP, "point_idx"]).select(*GROUP, (F.col("point_idx") + 7).cast("int").alias("line"), F.concat_ws(" ", "point_idx", "x", "y", ids, far).alias("text"))
    sizes = points.groupBy(*GROUP, (F.col(k) if isinstance(k, str) else F.lit(k)).alias("_k")).agg(F.count("*").alias("n")).where("n > 1")
    values = (label, colour_name(F.col("channel")), F.col("extreme_type"), F.col("_k"), F.col("n"))
    head = F.array(*(F.concat(F.lit(h), v.cast("string")) for h, v in zip(KNN_HEAD, values)), F.lit(""), F.lit(KNN_CAPTION))
    return sizes.select(*GROUP, F.posexplode(head).alias("line", "text")).unionByName(body)


def graph_text(graph: DataFrame, k: int | str, label: Column) -> DataFrame:
    """:func:`neighbour_text` of a :func:`~linewave.operators.neighbors.graph` or of its :func:`~linewave.operators.neighbors.texts`, a map: the head comes with point 0, which every group must have."""
    graph = listed_texts(graph) if "nn" in graph.columns else graph
    body = F.concat_ws(" ", "point_idx", "x", "y", "ids", "far")
    values = (label, colour_name(F.col("channel")), F.col("extreme_type"), F.col(k) if isinstance(k, str) else F.lit(k), F.col("n"))
    head = [F.concat(F.lit(h), v.cast("string")) for h, v in zip(KNN_HEAD, values)] + [F.lit(""), F.lit(KNN_CAPTION)]
    first = F.col("point_idx") == 0
    text = graph.select(*graph.columns, F.posexplode(F.when(first, F.array(*head, body)).otherwise(F.array(body))).alias("_at", "text"))
    other = [c for c in graph.columns if c not in (*GROUP, "point_idx", "x", "y", "n", "ids", "far", k)]
    return text.select(*GROUP, *other, F.when(first, F.col("_at")).otherwise(F.col("point_idx") + len(head)).cast("int").alias("line"), "text")


def _one_of(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def coefficient_file(label: Column) -> Column:
    """Name of the file of a matrix' coefficients; ``label`` is how its scale is printed."""
    return F.concat(F.lit(COEFFICIENT_FILE[0]), _one_of(DIRECTIONS, F.col("direction")), F.lit(COEFFICIENT_FILE[1]), label, F.lit("_"), _one_of(COLOUR_NAMES, F.col("channel")))


def point_file(label: Column) -> Column:
    """Name of the file of a matrix' points of one type."""
    kind = F.create_map(*(F.lit(v) for pair in POINT_FILES.items() for v in pair))[F.col("extreme_type")]
    return F.concat(_one_of(DIRECTIONS, F.col("direction")), F.lit("_"), kind, F.lit(POINT_SCALE), label, F.lit("_"), _one_of(COLOUR_NAMES, F.col("channel")))


def neighbour_file(label: Column) -> Column:
    """Name of the file of a matrix' neighbour graph of one type."""
    return F.concat(F.lit(KNN_FILE[0]), _one_of(DIRECTIONS, F.col("direction")), F.lit(KNN_FILE[1]), label, F.lit(KNN_FILE[2]), colour_name(F.col("channel")), F.lit("_"), F.col("extreme_type"))


def task_folder(task: Column, began: Column) -> Column:
    """Folder of a task's results: the day's root, the task with its time."""
    at = F.date_format(began, "dd_MM_yyyy_HH_mm")
    return F.concat(F.lit(ROOT_FOLDER), at, F.lit("/"), task, F.lit(" "), at)


def result_folder(task: Column, began: Column, label: Column) -> Column:
    """Folder of a task's results at one scale, within :func:`task_folder`."""
    return scale_folder(task_folder(task, began), label)


def scale_folder(folder: Column, label: Column) -> Column:
    """Folder of one scale within a task's."""
    return F.concat(folder, F.lit("/" + SCALE_FOLDER), label)


def save_text(text: DataFrame, path: str, folders: list[str]) -> None:
    """Write text rows below ``path``, a folder for each value of ``folders``, lines in order within a file.

    Rows of one folder go to one task, which a file's order asks for; a folder is one matrix of one image.
    """
    keys = [c for c in text.columns if c not in ("line", "text")]
    rows = text.repartition(*keys).sortWithinPartitions(*keys, "line").select(*folders, F.col("text").alias("value"))
    rows.write.mode("error").partitionBy(*folders).text(path)


def save_table(df: DataFrame, path: str, folders: tuple[str, ...] = ("scale", "direction", "channel")) -> None:
    """Write a result as Parquet below ``path``, partitioned as the folder layout is."""
    df.write.mode("error").partitionBy(*(f for f in folders if f in df.columns)).parquet(path)
