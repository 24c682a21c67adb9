"""Exact k nearest neighbours within groups of points: small groups by all their distances, large ones by a grid that widens where it must.

A group of up to :data:`SMALL` points becomes one row, and a map finds its neighbours, some groups at a time: one shuffle of the points.
Larger groups never meet in one row; a point's candidates are those of the 3 x 3 cells around it. Cells follow each group's density and are small enough
that none is crowded, so in the first round every cell gets the list of its block, and a point looks through its
cell's list: no pair is ever a row. The answer is final if the k-th distance stays below that to anything outside the
block; the few other points try again, by an equi-join on cells of twice the side. Of points at one place only the
k+1 with the smallest indices can be neighbours of any point, so no more are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewave.operators.extrema import MATRIX
from linewave.storage import written

GROUP = [*MATRIX, "extreme_type"]
#: A cell holds about this share of k+1 points at first, and at most this many times k+1, unless it is one place.
SHARE, CROWD = 0.5, 8
_BOX = ["n", "x0", "x1", "y0", "y1"]
_NEAR = "array<struct<d:bigint,i:int,x:bigint,y:bigint>>"
#: Points of a group whose distances are all worked out at most, the side of its box, and distances worked out at a time.
SMALL, WIDEST, PAIRS = 2048, 1 << 24, 1 << 16
#: Of a point: the size of its group and its neighbours, nearest first, with their squared distances.
LISTS = f"point_idx int, x bigint, y bigint, n bigint, nn {_NEAR}"
#: Of a point: the size of its group and its neighbours as text, nearest first, and their distances with two decimals.
TEXTS = "point_idx int, x bigint, y bigint, n bigint, ids string, far string"
#: A neighbour a row.
RANKED = "point_idx int, nbr_rank int, nbr_idx int, distance double"
NEIGHBOURS = [*GROUP, "point_idx", "nbr_rank", "nbr_idx", "distance"]
_LISTED = pa.list_(pa.struct([("d", pa.int64()), ("i", pa.int32()), ("x", pa.int64()), ("y", pa.int64())]))


def nearest(points: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys, point_idx, nbr_rank, nbr_idx, distance) for points (keys, point_idx, x, y) at whole coordinates.

    Ranked by distance, then nbr_idx; a point is no neighbour of itself. Groups of n <= k points have n-1
    neighbours each; groups of one point and k = 0 have none. Null keys form groups like any other value.
    """
    keys = GROUP if keys is None else keys
    return _searched(points, k, keys, RANKED)


def ranked(graph: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """:func:`nearest` of a :func:`graph`."""
    keys = GROUP if keys is None else keys
    near = graph.select(*keys, "point_idx", F.posexplode("nn").alias("r", "s"))
    return near.select(*keys, "point_idx", (F.col("r") + 1).alias("nbr_rank"), F.col("s.i").alias("nbr_idx"), F.sqrt(F.col("s.d").cast("double")).alias("distance"))


def graph(points: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """:func:`nearest` with one row a point: (keys, point_idx, x, y, n, nn), for all points of groups of two or more; none if k is 0.

    ``n`` is the number of points of the group, ``nn`` its neighbours (d, i, x, y), nearest first, d being the squared distance.
    """
    return _searched(points, k, keys, LISTS)


def texts(points: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """:func:`listed_texts` of :func:`graph`; of small groups no lists are made, their texts leave the map."""
    return _searched(points, k, keys, TEXTS)


def listed_texts(graph: DataFrame) -> DataFrame:
    """``graph`` with ``nn`` as two texts: ``ids``, the neighbours' numbers, and ``far``, their distances with two decimals, each comma-separated."""
    ids = F.array_join(F.transform("nn", lambda s: s["i"].cast("string")), ", ")
    # Whole hundredths, so that no format is parsed for each distance.
    cents = F.transform("nn", lambda s: F.rint(F.sqrt(s["d"].cast("double")) * 100.0).cast("long"))
    far = F.array_join(F.transform(cents, lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))), ", ")
    return graph.withColumns({"ids": ids, "far": far}).drop("nn")


def _searched(points: DataFrame, k: int, keys: list[str] | None, form: str) -> DataFrame:
    """:func:`graph`, :func:`texts` or :func:`nearest`, by ``form`` (:data:`LISTS`, :data:`TEXTS`, :data:`RANKED`)."""
    if k < 0:
        raise ValueError("k must not be negative")
    keys = GROUP if keys is None else keys
    own = points.select(*keys, F.col("point_idx").cast("int").alias("point_idx"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    small = (F.col("n") <= SMALL) & (F.col("x1") - F.col("x0") < WIDEST) & (F.col("y1") - F.col("y0") < WIDEST)
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if k == 0:
        return _small_groups(own.limit(0), k, keys, form)
    large = written(sizes.where(~small).select(*keys), "large")
    if not large.take(1):
        return _small_groups(own, k, keys, form)
    names = large.select(*(F.col(c).alias(f"_lw_{c}") for c in keys))
    same = [F.col(c).eqNullSafe(F.col(f"_lw_{c}")) for c in keys]
    near = _large_groups(own.join(names, same, "left_semi"), k, keys)
    near = {LISTS: lambda: near, TEXTS: lambda: listed_texts(near), RANKED: lambda: ranked(near, keys)}[form]()
    return _small_groups(own.join(names, same, "left_anti"), k, keys, form).unionByName(near)


def near_lists(x: np.ndarray, y: np.ndarray, idx: np.ndarray, sizes: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, at, d) of groups of points that lie one behind the other, each with a ``k`` of its own.

    The nearest ``counts`` neighbours of each point are the points ``at``, d their squared distances; equal ones go by ``idx``. Groups of about
    one size are worked out together, :data:`PAIRS` distances at a time.
    """
    starts = np.cumsum(sizes) - sizes
    many = np.minimum(np.maximum(k, 0), np.maximum(sizes - 1, 0))
    counts = np.repeat(many, sizes)
    begin = np.cumsum(counts) - counts
    at, far = np.zeros(counts.sum(), dtype=np.int64), np.zeros(counts.sum(), dtype=np.int64)
    groups = np.argsort(sizes, kind="stable")
    groups = groups[many[groups] > 0]
    lo = 0
    while lo < len(groups):
        # As many groups as PAIRS allows, padded to the largest one; a group by itself goes by some of its points at a time.
        m, hi = int(sizes[groups[lo]]), lo + 1
        while hi < len(groups) and int(sizes[groups[hi]]) ** 2 * (hi + 1 - lo) <= PAIRS:
            m, hi = int(sizes[groups[hi]]), hi + 1
        some = groups[lo:hi]
        lo = hi
        place = np.arange(m)
        there = place < sizes[some][:, None]
        points = starts[some][:, None] + np.where(there, place, 0)
        order = np.argsort(np.where(there, idx[points], np.iinfo(np.int64).max), axis=1, kind="stable")
        points = np.take_along_axis(points, order, 1)
        u, v = x[points] - x[points[:, :1]], y[points] - y[points[:, :1]]
        most = int(many[some].max())
        largest = (int(u.max() - u.min()) ** 2 + int(v.max() - v.min()) ** 2 + 1) * m
        kind = np.int32 if largest < 1 << 30 else np.int64
        none = np.iinfo(kind).max // 2 + 1
        # Beside the place in the order of idx, a number above all distances for places that are not there.
        u, v, rest = u.astype(kind), v.astype(kind), np.where(there, place, none).astype(kind)[:, None, :]
        step = max(1, PAIRS // (m * len(some)))
        for first in range(0, m, step):
            rows = place[first : first + step]
            # One number for the distance and the place; in place, as the array is the work.
            key, other = u[:, rows, None] - u[:, None, :], v[:, rows, None] - v[:, None, :]
            key *= key
            other *= other
            key += other
            key *= kind(m)
            key += rest
            key[:, np.arange(len(rows)), rows] = none
            if most < m:
                key = np.partition(key, most - 1, axis=2)[:, :, :most]
            key = np.sort(key, axis=2)[:, :, :most]
            rank = np.arange(key.shape[2])
            g, r, c = np.nonzero(there[:, rows, None] & (rank < many[some][:, None, None]))
            found = key[g, r, c].astype(np.int64)
            to = begin[points[g, rows[r]]] + c
            at[to], far[to] = points[g, found % m], found // m
    return counts, at, far


def list_array(counts: np.ndarray, at: np.ndarray, far: np.ndarray, x: np.ndarray, y: np.ndarray, idx: np.ndarray) -> pa.ListArray:
    """The ``nn`` of :data:`LISTS` of what :func:`near_lists` gives."""
    own = pa.StructArray.from_arrays([pa.array(far), pa.array(idx[at], pa.int32()), pa.array(x[at]), pa.array(y[at])], fields=list(_LISTED.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), own)


def text_arrays(counts: np.ndarray, at: np.ndarray, far: np.ndarray, idx: np.ndarray) -> list[pa.Array]:
    """``ids`` and ``far`` of :data:`TEXTS` of what :func:`near_lists` gives. Each number and distance is printed once."""
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    numbers, which = np.unique(idx[at], return_inverse=True)
    squares, of = np.unique(far, return_inverse=True)
    cents = np.rint(np.sqrt(squares.astype(float)) * 100.0).astype(np.int64).tolist()
    printed = (pa.array(map(str, numbers.tolist()), pa.string()), which), (pa.array((f"{c // 100}.{c % 100:02d}" for c in cents), pa.string()), of)
    return [pc.binary_join(pa.ListArray.from_arrays(ends, text.take(pa.array(place))), ", ") for text, place in printed]


def _small_groups(points: DataFrame, k: int, keys: list[str], form: str = LISTS) -> DataFrame:
    """The ``form`` of :func:`_searched` of groups of at most :data:`SMALL` points, a row a group and a map; only :data:`LISTS` makes lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.diff(batch.column("_lw_p").offsets.to_numpy()).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(every) // (8 * SMALL))) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(every)]):
                sizes, points = every[lo:hi], batch.column("_lw_p").slice(lo, hi - lo).flatten()
                idx, x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                counts, at, far = near_lists(x, y, idx, sizes, np.full(len(sizes), k))
                group = np.repeat(np.arange(lo, hi), sizes)
                if form == RANKED:
                    group, own_idx = np.repeat(group, counts), np.repeat(idx, counts)
                    rank = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                    found = [*(pa.array(v, pa.int32()) for v in (own_idx, rank, idx[at])), pa.array(np.sqrt(far.astype(float)))]
                else:
                    near = [list_array(counts, at, far, x, y, idx)] if form == LISTS else text_arrays(counts, at, far, idx)
                    found = [pa.array(idx, pa.int32()), pa.array(x), pa.array(y), pa.array(np.repeat(sizes, sizes)), *near]
                own = [batch.column(c).take(pa.array(group)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, *found], names=[*keys, *names])

    names = ["point_idx", "x", "y", "n", "nn"] if form == LISTS else [c.split()[0] for c in form.split(", ")]
    groups = points.groupBy(*keys).agg(F.collect_list(F.struct("point_idx", "x", "y")).alias("_lw_p")).where(F.size("_lw_p") > 1)
    types = [f.dataType.simpleString() for f in points.select(*keys).schema]
    return groups.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in zip(keys, types)), form]))


def _large_groups(named: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """:func:`graph` by the grid."""
    # One text column names the group, nulls included; a number written with it stands for it in all joins.
    named = named.withColumn("_lw_name", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    groups = named.groupBy("_lw_name").agg(*(F.first(c).alias(c) for c in keys), F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    area = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(area * SHARE * (k + 1) / F.col("n"))).cast("long"))
    groups = written(groups.withColumns({"side": side, "_lw_g": F.monotonically_increasing_id()}), "groups")
    rank = F.row_number().over(Window.partitionBy("_lw_g", "x", "y").orderBy("point_idx"))
    flat = named.join(groups.where("n > 1").select("_lw_name", "_lw_g"), "_lw_name").select("_lw_g", "point_idx", "x", "y")
    flat = written(flat.withColumn("listed", rank <= k + 1), "points")
    boxes = groups.where("n > 1").select("_lw_g", *_BOX, "side")
    # Uneven groups start with a smaller side, until no cell is crowded; only groups that still are get looked at again.
    waiting = boxes
    while True:
        sides = waiting.select("_lw_g", "side")
        crowd = flat.where("listed").join(sides, "_lw_g").groupBy("_lw_g", "side", _cell("x"), _cell("y")).agg(F.count("*").alias("m"))
        full = written(crowd.where((F.col("m") > CROWD * (k + 1)) & (F.col("side") > 1)).select("_lw_g", F.ceil(F.col("side") / 2).alias("less")).distinct(), "crowded")
        if not full.take(1):
            break
        boxes = written(boxes.join(full, "_lw_g", "left").withColumn("side", F.coalesce("less", "side")).drop("less"), "boxes")
        waiting = boxes.join(full.select("_lw_g"), "_lw_g", "left_semi")
    placed = written(flat.join(boxes, "_lw_g"), "placed")
    found = written(_first_round(placed, k), "found")
    grow, parts = 1, []
    while True:
        parts.append(found.where("final").select("_lw_g", "point_idx", "x", "y", "nn"))
        left = found.where("not final")
        if not left.take(1):
            break
        grow *= 2
        found = written(_round(left.select("_lw_g", "point_idx", "x", "y", *_BOX, "side"), placed.where("listed"), k, grow), "found")
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    return near.join(groups.select("_lw_g", *keys, "n"), "_lw_g").select(*keys, "point_idx", "x", "y", "n", "nn")


def _cell(axis: str, grow: int = 1) -> Column:
    return F.floor(F.col(axis) / (F.col("side") * grow)).cast("long")


def _around() -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))


def _final(found: DataFrame, k: int, grow: int) -> DataFrame:
    """``found`` with ``final``: whether nothing outside the block of 3 x 3 cells can be nearer than what ``nn`` holds."""
    # Distance to the nearest coordinate beyond the block on each side; none where the group ends before.
    side, far = F.col("side") * grow, F.lit(1 << 30)
    right, left = (_cell("x", grow) + 2) * side, (_cell("x", grow) - 1) * side - 1
    below, above = (_cell("y", grow) + 2) * side, (_cell("y", grow) - 1) * side - 1
    gap = F.least(
        F.when(right <= F.col("x1"), right - F.col("x")).otherwise(far),
        F.when(left >= F.col("x0"), F.col("x") - left).otherwise(far),
        F.when(below <= F.col("y1"), below - F.col("y")).otherwise(far),
        F.when(above >= F.col("y0"), F.col("y") - above).otherwise(far),
    )
    enough = F.size("nn") == F.least(F.lit(k), F.col("n") - 1)
    last = F.coalesce(F.get("nn", F.size("nn") - 1)["d"], F.lit(0))
    return found.withColumn("final", (gap == far) | (enough & (last < gap * gap)))


def _first_round(placed: DataFrame, k: int) -> DataFrame:
    """Each point against the list of its block: (placed's columns, nn, final). Lists are bounded, since no cell is crowded."""
    own = placed.withColumns({"cx": _cell("x"), "cy": _cell("y")})
    lists = own.where("listed").groupBy("_lw_g", "cx", "cy").agg(F.collect_list(F.struct("x", "y", F.col("point_idx").alias("i"))).alias("l"))
    dealt = lists.select("_lw_g", "cx", "cy", "l", _around().alias("o")).select("_lw_g", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), "l")
    blocks = dealt.groupBy("_lw_g", "cx", "cy").agg(F.flatten(F.collect_list("l")).alias("block"))
    square = lambda p, c: (p[c] - F.col(c)) * (p[c] - F.col(c))
    others = F.filter("block", lambda p: p["i"] != F.col("point_idx"))
    nn = F.slice(F.sort_array(F.transform(others, lambda p: F.struct((square(p, "x") + square(p, "y")).alias("d"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y")))), 1, k)
    return _final(own.join(blocks, ["_lw_g", "cx", "cy"]).withColumn("nn", nn.cast(_NEAR)).select(*placed.columns, "nn"), k, 1)


def _round(waiting: DataFrame, listed: DataFrame, k: int, grow: int) -> DataFrame:
    """One more try with cells of ``grow`` times each group's side: (waiting's columns, nn, final)."""
    seek = waiting.withColumns({"cx": _cell("x", grow), "cy": _cell("y", grow)}).withColumn("o", _around())
    seek = seek.select("_lw_g", "point_idx", "x", "y", (F.col("cx") + F.col("o.i")).alias("bx"), (F.col("cy") + F.col("o.j")).alias("by"))
    there = listed.select("_lw_g", _cell("x", grow).alias("bx"), _cell("y", grow).alias("by"), F.col("point_idx").alias("i"), F.col("x").alias("u"), F.col("y").alias("w"))
    d = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("w")) * (F.col("y") - F.col("w"))
    pairs = seek.join(there, ["_lw_g", "bx", "by"]).where("i != point_idx").withColumn("d", d)
    best = Window.partitionBy("_lw_g", "point_idx").orderBy("d", "i")
    # row_number <= k is cut down within each map task before the shuffle.
    kept = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    lists = kept.groupBy("_lw_g", "point_idx").agg(F.sort_array(F.collect_list(F.struct("d", "i", F.col("u").alias("x"), F.col("w").alias("y")))).alias("nn"))
    return _final(waiting.join(lists, ["_lw_g", "point_idx"], "left").withColumn("nn", F.coalesce("nn", F.array().cast(_NEAR))), k, grow)


def edges(neighbours: DataFrame, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Segments point -> neighbour with both ends' coordinates."""
    keys = GROUP if keys is None else keys
    at = lambda idx, x, y: points.select(*keys, F.col("point_idx").alias(idx), F.col("x").alias(x), F.col("y").alias(y))
    return neighbours.join(at("point_idx", "x", "y"), [*keys, "point_idx"]).join(at("nbr_idx", "nbr_x", "nbr_y"), [*keys, "nbr_idx"]).select(*keys, "point_idx", "nbr_rank", "nbr_idx", "x", "y", "nbr_x", "nbr_y", "distance")


def graph_edges(graph: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """:func:`edges` of a :func:`graph`, which has all coordinates: no join."""
    keys = GROUP if keys is None else keys
    each = graph.select(*keys, "point_idx", "x", "y", F.posexplode("nn").alias("r", "s"))
    whole = lambda c, name: F.col(c).cast("int").alias(name)
    return each.select(*keys, "point_idx", (F.col("r") + 1).alias("nbr_rank"), F.col("s.i").alias("nbr_idx"), whole("x", "x"), whole("y", "y"), whole("s.x", "nbr_x"), whole("s.y", "nbr_y"), F.sqrt(F.col("s.d").cast("double")).alias("distance"))


def degrees(neighbours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_connections, n_points) of the neighbour graph."""
    keys = GROUP if keys is None else keys
    return neighbours.groupBy(*keys).agg(F.count("*").alias("n_connections"), F.sum((F.col("nbr_rank") == 1).cast("long")).alias("n_points"))
