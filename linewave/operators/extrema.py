"""Strict extrema, linear envelopes through them, and peaks of the envelopes.

All of it works within one line's array, so nothing is shuffled but the lines that must be turned across: of a
coefficient matrix, rows and columns are both examined, and only one of the two lies ready.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewave.operators.lines import transposed

MATRIX = ["image_id", "direction", "channel", "scale"]
#: Extreme type -> (axis of its lines: 0 rows, 1 columns; sign that makes it a maximum).
TYPES = {"max_by_row": (0, 1), "max_by_column": (1, 1), "min_by_row": (0, -1), "min_by_column": (1, -1)}
#: An envelope is drawn through this many knots at least.
LEAST_KNOTS = 4


def matrix_lines(coefs: DataFrame, axis: int) -> DataFrame:
    """(matrix keys, line, c) of every coefficient matrix along rows (0) or columns (1).

    Coefficients of that direction pass as they are; those of the other are turned, one shuffle by line.
    """
    ready = coefs.where(F.col("direction") == axis).select(*MATRIX, "line", "c")
    return ready.unionByName(transposed(coefs.where(F.col("direction") != axis), MATRIX, values="c"))


def strict_extrema(values: Column, sign: int) -> Column:
    """Positions greater (sign 1) or smaller (-1) than both neighbours; never the first or last."""
    at = lambda i: F.get(values, i)
    beyond = (lambda a, b: a > b) if sign > 0 else (lambda a, b: a < b)
    inner = F.when(F.size(values) > 2, F.sequence(F.lit(1), F.size(values) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(inner, lambda i: beyond(at(i), at(i - 1)) & beyond(at(i), at(i + 1)))


def raw_points(coefs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(matrix keys, extreme_type, y, x) of the strict extrema of the given types (all four by default)."""
    out = None
    for axis in (0, 1):
        own = [t for t in types or TYPES if TYPES[t][0] == axis]
        if own:
            found = F.array(*(F.struct(F.lit(t).alias("extreme_type"), strict_extrema(F.col("c"), TYPES[t][1]).alias("at")) for t in own))
            part = matrix_lines(coefs, axis).select(*MATRIX, "line", F.explode(found).alias("e"))
            part = part.select(*MATRIX, "e.extreme_type", "line", F.explode("e.at").alias("pos"))
            part = _as_points(part, axis)
            out = part if out is None else out.unionByName(part)
    return out


def _as_points(df: DataFrame, axis: int) -> DataFrame:
    y, x = ("line", "pos") if axis == 0 else ("pos", "line")
    return df.select(*MATRIX, "extreme_type", F.col(y).alias("y"), F.col(x).alias("x"))


def upper_envelopes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper envelope of each line in ``flat``.

    Lines without a strict maximum are their own envelope; with 1 to 3 it is 0 throughout; with more, it is
    linear between maxima and goes on with the first and last segment beyond them.
    """
    knot = np.zeros(len(flat), dtype=bool)
    knot[1:-1] = (flat[1:-1] > flat[:-2]) & (flat[1:-1] > flat[2:])
    there = sizes > 0
    knot[starts[there]] = knot[(starts + sizes - 1)[there]] = False
    before = np.concatenate([[0], np.cumsum(knot)])
    counts = before[starts + sizes] - before[starts]
    out = np.where(np.repeat(counts == 0, sizes), flat, 0.0)
    many = counts >= LEAST_KNOTS
    if many.any():
        # A segment goes from a knot to the next one and is drawn behind the one before: the first from the line's start, the last to its end.
        own = np.repeat(np.arange(len(sizes)), counts)
        at, rank = np.flatnonzero(knot), np.arange(len(own)) - before[starts][own]
        right = np.flatnonzero(many[own] & (rank > 0))
        own, rank, a, b = own[right], rank[right], at[right - 1], at[right]
        first = np.where(rank == 1, starts[own], a + 1)
        last = np.where(rank == counts[own] - 1, starts[own] + sizes[own] - 1, b)
        length = last - first + 1
        slope = (flat[b] - flat[a]) / (b - a).astype(float)
        drawn = slice(None) if many.all() else np.repeat(many, sizes)
        place = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length) - a, length)
        out[drawn] = np.repeat(slope, length) * place.astype(float) + np.repeat(flat[a], length)
    return out


def peak_positions(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, position) of the peaks: middles of runs of equal values with smaller values on both sides."""
    if not len(flat):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.zeros(len(flat) + 1, dtype=bool)
    start[starts] = start[-1] = True
    new = start.copy()
    new[1:-1] |= flat[1:] != flat[:-1]
    begins = np.flatnonzero(new)
    begins, after = begins[:-1], begins[1:]
    peak = ~start[begins] & ~start[after] & (flat[begins - 1] < flat[begins])
    begins, after = begins[peak], after[peak]
    peak = flat[after] < flat[begins]
    begins, after = begins[peak], after[peak]
    own = np.searchsorted(starts, begins, side="right") - 1
    return own, (begins + after - 1 - 2 * starts[own]) // 2


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(batch.column("c").offsets.to_numpy()).astype(np.int64)
    return batch.column("c").flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes


def envelopes(lines: DataFrame, upper: bool = True) -> DataFrame:
    """``lines`` (any keys, c) with ``env`` in the place of ``c``: the upper or lower envelope; a map."""
    keys = [c for c in lines.columns if c != "c"]
    sign = 1.0 if upper else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, sizes = _flat(batch)
            env = sign * upper_envelopes(sign * flat, starts, sizes)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(env))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), arrays], names=[*keys, "env"])

    schema = lines.select(*keys, F.col("c").alias("env")).schema
    return lines.where("c is not null").mapInArrow(run, schema)


def peak_points(coefs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(matrix keys, extreme_type, y, x): peaks of the envelopes of each matrix; only asked-for types are worked out.

    ``coefs`` should be rounded. A type of maxima takes peaks of the upper envelope, one of minima those
    of the lower one upside down.
    """
    out = None
    for axis in (0, 1):
        own = [t for t in types or TYPES if TYPES[t][0] == axis]
        if not own:
            continue

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, starts, sizes = _flat(batch)
                for name in own:
                    sign = float(TYPES[name][1])
                    line, pos = peak_positions(upper_envelopes(sign * flat, starts, sizes), starts, sizes)
                    some = batch.take(pa.array(line))
                    yield pa.RecordBatch.from_arrays([*(some.column(k) for k in MATRIX), pa.array([name] * len(line), pa.string()), some.column("line"), pa.array(pos, pa.int32())], names=[*MATRIX, "extreme_type", "line", "pos"])

        lines = matrix_lines(coefs, axis).where("c is not null")
        part = _as_points(lines.mapInArrow(run, "image_id long, direction int, channel int, scale double, extreme_type string, line int, pos int"), axis)
        out = part if out is None else out.unionByName(part)
    return out


def numbered(points: DataFrame) -> DataFrame:
    """Points with point_idx from 0 within (matrix, type): row types by (y, x), column types by (x, y).

    A group holds the points of one type of one matrix, no more than an image has pixels.
    """
    by_row = F.col("extreme_type").endswith("row")
    order = Window.partitionBy(*MATRIX, "extreme_type").orderBy(F.when(by_row, F.col("y")).otherwise(F.col("x")), F.when(by_row, F.col("x")).otherwise(F.col("y")))
    return points.select(*MATRIX, "extreme_type", (F.row_number().over(order) - 1).alias("point_idx"), "x", "y")


def point_counts(points: DataFrame) -> DataFrame:
    """(matrix keys, extreme_type, n_points)."""
    return points.groupBy(*MATRIX, "extreme_type").agg(F.count("*").alias("n_points"))


def largest_coefficients(coefs: DataFrame) -> DataFrame:
    """(matrix keys, y, x, c) of every cell that holds its matrix's largest coefficient; ties all stay."""
    from linewave.operators.transform import cells

    top = coefs.groupBy(*MATRIX).agg(F.max(F.array_max("c")).alias("top"))
    near = coefs.join(top, MATRIX).where(F.array_max("c") == F.col("top"))
    return cells(near.drop("top")).join(top, MATRIX).where("c = top").drop("top")
