"""Multi-scale Morlet transform of lines.

coef[s, j] = 1/sqrt(s) * sum over k in -pad .. n+pad-1 of d[reflect(k)] * 0.75 * exp(-t*t/2) * cos(2*pi*t), with
t = (k-j)/s and pad = int(7 * largest scale) div 2 + 1; reflect mirrors once at either end, repeating the edge.

Terms with |t| > 8.3 are below 1.1e-15 of the largest one, so a coefficient takes only the points within 8.3 scales of its place.
Lines are cut into runs of places; a run with its surroundings, times one banded matrix a scale, gives the run's
coefficients. The matrix depends on the scale alone, so memory is the same for lines of any length.

Kernels of more than :data:`WIDE` points to a side go by overlap-save instead: runs of some six such sides, multiplied in the frequency
domain, take time n log r. Rounding errors of that are below 4e-16 * log2(run) * |values| * |weights| (Euclidean norms, of a run and of the
kernel): under 1e-10 for values up to 255 and scales up to 1,000, far from the third decimal that results are rounded to.

Borders: ``mirrored`` takes the pad of the largest scale for all, ``mirrored_each`` each scale's own, ``none`` no pad.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewave.functions.scalars import round_half_even

KEYS = ["image_id", "direction", "channel", "scale", "line"]
#: Scales on either side of a place that count, and values of lines worked at a time.
REACH = 8.3
VALUES = 1 << 19
#: Points on either side of a kernel beyond which it is applied in the frequency domain.
WIDE = 256
COEFS = "image_id long, direction int, channel int, scale double, line int, c array<double>"


def padding(scales: list[float]) -> int:
    """Points by which a line is continued on either side."""
    return int(7 * max(scales)) // 2 + 1


def reflected(k: Column, n: Column) -> Column:
    """Index within 0..n-1 that ``k`` is mirrored to."""
    return F.when(k < 0, -k - 1).when(k >= n, 2 * n - k - 1).otherwise(k)


def paddings(scales: list[float], border: str = "mirrored") -> list[int]:
    """The pad of each scale."""
    if border not in ("mirrored", "mirrored_each", "none"):
        raise ValueError(f"no such border: {border}")
    return [0 if border == "none" else padding([s] if border == "mirrored_each" else scales) for s in scales]


def taps(scale: float) -> np.ndarray:
    """Weights of the points from -r to r around a place, r the last within :data:`REACH` scales."""
    t = np.arange(-int(REACH * scale), int(REACH * scale) + 1) / scale
    return 0.75 * np.exp(-t * t / 2) * np.cos(2 * np.pi * t) / np.sqrt(scale)


@lru_cache(maxsize=64)
def band(scale: float) -> np.ndarray:
    """(run + 2r, run) matrix from a run of places and the r points on either side to the run's coefficients."""
    own = taps(scale)
    r = len(own) // 2
    run = min(512, max(64, r))
    out = np.zeros((run + 2 * r, run))
    for j in range(run):
        out[j : j + 2 * r + 1, j] = own
    return out


@lru_cache(maxsize=64)
def spectrum(scale: float) -> tuple[np.ndarray, int, int]:
    """The kernel's spectrum for runs with their surroundings of a power of two points; that number and the run's length."""
    own = taps(scale)
    r = len(own) // 2
    size = 1 << (8 * r - 1).bit_length()
    return np.fft.rfft(own, size), size, size - 2 * r


def coefficients(flat: np.ndarray, sizes: np.ndarray, scale: float, pad: int, most_bytes: int = 8 << 20) -> np.ndarray:
    """The coefficients of lines that lie one behind the other in ``flat``, in the same layout."""
    wide = int(REACH * scale) > WIDE
    if wide:
        waves, width, run = spectrum(scale)
    else:
        matrix = band(scale)
        width, run = matrix.shape
    r = (width - run) // 2
    runs = -(-sizes // run)
    line = np.repeat(np.arange(len(sizes)), runs)
    first = (np.arange(len(line)) - np.repeat(np.cumsum(runs) - runs, runs)) * run
    starts = np.cumsum(sizes) - sizes
    out, each = [np.zeros(0)], max(1, most_bytes // (8 * width))
    for lo in range(0, len(line), each):
        own = line[lo : lo + each]
        n = sizes[own][:, None]
        k = first[lo : lo + each, None] + np.arange(-r, run + r)
        inside = (k >= -pad) & (k < n + pad)
        at = np.where(k < 0, -k - 1, np.where(k >= n, 2 * n - k - 1, k))
        around = np.where(inside, flat[starts[own][:, None] + np.where(inside, at, 0)], 0.0)
        here = first[lo : lo + each, None] + np.arange(run) < n
        # The kernel is the same both ways, so that its place in the product needs no turning; the first 2r points are none of the run.
        own_run = np.fft.irfft(np.fft.rfft(around, axis=1) * waves, width, axis=1)[:, 2 * r :] if wide else around @ matrix
        out.append(own_run[here])
    return np.concatenate(out)


def kernel_frame(spark: SparkSession, lengths: DataFrame, scales: list[float]) -> DataFrame:
    """(n, scale, j, m, w) weights for each of ``lengths`` (n), by SQL functions alone."""
    pad = padding(scales)
    n, s = F.col("n"), F.col("scale")
    grid = lengths.select("n").distinct().select("n", F.explode(F.array(*map(F.lit, map(float, scales)))).alias("scale"))
    grid = grid.select("n", "scale", F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    grid = grid.select("n", "scale", "j", F.explode(F.sequence(F.lit(-pad), n + pad - 1)).alias("k"))
    t = (F.col("k") - F.col("j")) / s
    wave = 0.75 * F.exp(-t * t / 2) * F.cos(2 * F.pi() * t)
    return grid.groupBy("n", "scale", "j", reflected(F.col("k"), n).cast("int").alias("m")).agg(F.sum(wave).alias("w")).withColumn("w", F.col("w") / F.sqrt("scale"))


def _checked(scales: list[float]) -> tuple[float, ...]:
    scales = tuple(float(s) for s in scales)
    if not scales or min(scales) <= 0:
        raise ValueError("at least one scale is needed, and all must be positive")
    return scales


def morlet(lines: DataFrame, scales: list[float], border: str = "mirrored") -> DataFrame:
    """(image_id, direction, channel, scale, line, c): the coefficients of every line at every scale.

    ``lines`` should be centred. Lines go through as they lie: no shuffle. A line shorter than the padding
    and a scale of 0 or less raise an error; null lines are left out; repeated scales count once.
    """
    scales = tuple(dict.fromkeys(_checked(scales)))
    pads = paddings(list(scales), border)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)
            if len(every) and every.min() < max(pads):
                raise ValueError(f"a line of {every.min()} points is too short for scale {max(scales)}: it must have {max(pads)}")
            part = np.cumsum(every) // VALUES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(every)]
            for lo, hi in zip(cuts, cuts[1:]):
                some, sizes = batch.slice(lo, hi - lo), every[lo:hi]
                flat = some.column("v").flatten().to_numpy()
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                for s, pad in zip(scales, pads):
                    values = pa.ListArray.from_arrays(ends, pa.array(coefficients(flat, sizes, s, pad)))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("image_id", "direction", "channel")), pa.array(np.full(len(sizes), s)), some.column("line"), values], names=[*KEYS, "c"])

    return lines.where("v is not null and size(v) > 0").select("image_id", "direction", "channel", "line", "v").mapInArrow(run, COEFS)


def morlet_each(lines: DataFrame, scales: str = "scales") -> DataFrame:
    """:func:`morlet` with mirrored borders where every line has its own scales, an array column; kernels are chosen by row.

    A line is padded for the largest of its scales; repeated scales of a line count once. Null and empty lines and lines of no scales
    give nothing; a scale of 0 or less and a line shorter than its padding raise an error. A map: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)
            sets = [tuple(dict.fromkeys(s)) for s in batch.column("scales").to_pylist()]
            of_scale: dict[tuple[float, int], list[int]] = {}
            for i, own in enumerate(sets):
                pad = padding(list(_checked(own)))
                if sizes[i] < pad:
                    raise ValueError(f"a line of {sizes[i]} points is too short for scale {max(own)}: it must have {pad}")
                for s in own:
                    of_scale.setdefault((s, pad), []).append(i)
            for (s, pad), rows in of_scale.items():
                some, n = batch.take(pa.array(rows)), sizes[rows]
                part = np.cumsum(n) // VALUES
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
                for lo, hi in zip(cuts, cuts[1:]):
                    own = some.slice(lo, hi - lo)
                    flat, ends = own.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(n[lo:hi])])
                    values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(coefficients(flat, n[lo:hi], s, pad)))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("image_id", "direction", "channel")), pa.array(np.full(hi - lo, s)), own.column("line"), values], names=[*KEYS, "c"])

    ready = lines.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size(scales) > 0))
    return ready.select("image_id", "direction", "channel", "line", "v", F.col(scales).cast("array<double>").alias("scales")).mapInArrow(run, COEFS)


def morlet_native(lines: DataFrame, scales: list[float], check: bool = True) -> DataFrame:
    """:func:`morlet` by SQL functions alone: at every place, a slice of the points around it times an array of constant weights.

    A map without shuffle or broadcast; the plan has one array a scale, whatever its length. ``check`` looks at the lines' lengths
    before anything else; without it, a line that is too short raises the error when its turn comes.
    """
    scales = list(dict.fromkeys(_checked(scales)))
    pad = padding(scales)
    lines = lines.where("v is not null and size(v) > 0")
    v, n = F.col("v"), F.size("v")
    message = f"a line of %d points is too short for scale {max(scales)}: it must have {pad}"
    if check and (found := lines.agg(F.max(F.when(n < pad, n)).alias("n")).first().n) is not None:
        raise ValueError(message % found)
    own = [taps(s) for s in scales]
    edge = max(0, max(len(w) // 2 for w in own) - pad)  # zeros beyond the mirrored points
    zeros = F.array_repeat(F.lit(0.0), edge)
    wide = F.concat(zeros, F.reverse(F.slice(v, 1, pad)), v, F.reverse(F.slice(v, n - pad + 1, F.lit(pad))), zeros)
    short = F.raise_error(F.format_string(message, n)).cast("array<double>")
    ready = lines.select("image_id", "direction", "channel", "line", n.alias("n"), F.when(n < pad, short).otherwise(wide).alias("e"))

    def all_places(weights: np.ndarray) -> Column:
        first = edge + pad - len(weights) // 2
        own = F.array(*(F.lit(float(w)) for w in weights))  # one literal, slid along the line
        at = lambda j: F.aggregate(F.zip_with(F.slice("e", j + (first + 1), F.lit(len(weights))), own, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), at)

    each = [F.struct(F.lit(s).alias("scale"), all_places(w).alias("c")) for s, w in zip(scales, own)]
    return ready.select("image_id", "direction", "channel", "line", F.explode(F.array(*each)).alias("s")).select("image_id", "direction", "channel", "s.scale", "line", "s.c")


def rounded(coefs: DataFrame, digits: int = 3) -> DataFrame:
    """Coefficients rounded half to even, as extrema are sought on them."""
    return coefs.withColumn("c", F.transform("c", lambda c: round_half_even(c, digits)))


def rounded_values(values: np.ndarray, digits: int = 3) -> np.ndarray:
    """:func:`rounded` of an array."""
    return np.rint(values * float(10**digits)) / float(10**digits) + 0.0


def cells(coefs: DataFrame) -> DataFrame:
    """(image_id, direction, channel, scale, y, x, c): one row a coefficient, whichever way lines run."""
    flat = coefs.select("image_id", "direction", "channel", "scale", "line", F.posexplode("c").alias("pos", "c"))
    along = F.col("direction") == 0
    return flat.select("image_id", "direction", "channel", "scale", F.when(along, F.col("line")).otherwise(F.col("pos")).alias("y"), F.when(along, F.col("pos")).otherwise(F.col("line")).alias("x"), "c")
