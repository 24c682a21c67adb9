"""Density clusters of points, their centroids, and a greedy tree over centroids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewave.operators.components import connected_components
from linewave.operators.neighbors import GROUP
from linewave.storage import written


#: Side of the tiles that clusters are first sought in.
TILE = 64


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. n-1 reaches over the links a - b: roots are hooked to smaller ones, paths halved."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _tile_clusters(eps: float, least: int, tile: int):
    """Clusters within each tile of a table of tiles, all of them at once."""
    r = int(eps)
    halo = 2 * r
    side = tile + 2 * halo + 2 * r
    around = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= eps * eps]

    def run(table: pa.Table) -> pa.Table:
        g, tx, ty, x, y, n, idx = (table.column(c).to_numpy() for c in ("_lw_g", "tx", "ty", "x", "y", "n", "idx"))
        by = np.lexsort((y, x, ty, tx, g))
        g, tx, ty, x, y, n, idx = (v[by] for v in (g, tx, ty, x, y, n, idx))
        own_tile = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])]))
        u, w = x - tx * tile, y - ty * tile
        place = (own_tile * side + u + halo + r) * side + w + halo + r  # in order; a margin keeps tiles apart

        def beside(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            there = place + i * side + j
            at = np.minimum(np.searchsorted(place, there), len(place) - 1)
            hit = np.flatnonzero(place[at] == there)
            return hit, at[hit]

        near = np.zeros(len(place), dtype=np.int64)
        for o in around:
            hit, at = beside(*o)
            near[hit] += n[at]
        # What lies up to eps beyond the tile has all its neighbours here too.
        core = (near >= least) & (u >= -r) & (u < tile + r) & (w >= -r) & (w < tile + r)
        links = [(hit[ok], at[ok]) for o in around if o > (0, 0) for hit, at in [beside(*o)] for ok in [core[hit] & core[at]]]
        order = np.argsort(idx, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        a, b = (rank[np.concatenate([p[i] for p in links])] if links else np.zeros(0, np.int64) for i in (0, 1))
        head = idx[order[_united(len(place), a, b)[rank]]].astype(np.int64)
        # Others join the smallest core place beside them.
        best, at_best = np.full(len(place), np.iinfo(np.int64).max), np.zeros(len(place), dtype=np.int64)
        for o in around:
            hit, at = beside(*o)
            ok = core[at] & (idx[at] < best[hit])
            best[hit[ok]], at_best[hit[ok]] = idx[at[ok]], at[ok]
        joined = ~core & (best < np.iinfo(np.int64).max)
        head[joined] = head[at_best[joined]]
        own = (u >= 0) & (u < tile) & (w >= 0) & (w < tile)
        seen_twice = core & (~own | (u < r) | (u >= tile - r) | (w < r) | (w >= tile - r))
        rows = np.concatenate([np.flatnonzero(own), np.flatnonzero(seen_twice)])
        kind = np.arange(len(rows)) < own.sum()
        none = kind & ~(core | joined)[rows]
        return pa.table([pa.array(g[rows]), pa.array(x[rows]), pa.array(y[rows]), pa.array(idx[rows].astype(np.int64)), pa.array(head[rows], mask=none), pa.array(kind)], names=["_lw_g", "x", "y", "idx", "head", "own"])

    return run


def density_clusters(points: DataFrame, eps: float, least: int = 5, keys: list[str] | None = None, tile: int = TILE, tasks_rows: int = 200_000) -> DataFrame:
    """(keys, point_idx, x, y, label) for points (keys, point_idx, x, y) at whole coordinates; label -1 is noise.

    A core point has ``least`` points within ``eps``, itself counted. Core points within eps share a cluster;
    another point within eps of a core point joins the cluster of the one with the smallest point_idx.
    Labels count from 0 in the order of the clusters' smallest core point_idx. Null keys form groups like any other value.

    Groups are cut into tiles, each with the places up to twice eps beyond it: that is all it takes to know which are core, and to
    find the clusters within a tile. Only core places near a border, which two tiles know, are exchanged: they link the parts
    of clusters, and these links are all that the search for components sees. A tile holds no more than its places, points at one place
    being counted first; some ``tasks_rows`` places share a task, whatever groups they belong to.
    """
    if eps <= 0 or least < 1:
        raise ValueError("eps must be positive and least at least 1")
    keys = GROUP if keys is None else keys
    r = int(eps)
    tile = max(tile, 8 * r)
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y")]
    named = points.select(*keys, "point_idx", *whole, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_lw_name"))
    named = written(named, "named")
    groups = written(named.groupBy("_lw_name").agg(*(F.first(c).alias(c) for c in keys), F.count("*").alias("_lw_n")).withColumn("_lw_g", F.monotonically_increasing_id()), "groups")
    flat = named.join(groups.select("_lw_name", "_lw_g"), "_lw_name").select("_lw_g", "point_idx", "x", "y")
    places = flat.groupBy("_lw_g", "x", "y").agg(F.count("*").alias("n"), F.min("point_idx").alias("idx"))
    for axis in ("x", "y"):
        low, high = (F.floor((F.col(axis) + d) / tile) for d in (-2 * r, 2 * r))
        places = places.withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
    total = groups.agg(F.sum("_lw_n").alias("n")).first().n or 0
    tasks = max(1, math.ceil(total / tasks_rows))
    dealt = places.groupBy(F.pmod(F.xxhash64("_lw_g", "tx", "ty"), F.lit(tasks)).alias("task"))
    found = written(dealt.applyInArrow(_tile_clusters(eps, least, tile), "_lw_g long, x long, y long, idx long, head long, own boolean"), "tiles")
    # Parts of clusters are named by their smallest core point, so that names sort as those do within a group.
    node = lambda c: F.format_string("%012d|%d", F.col(c), F.col("_lw_g"))
    known = found.where("not own").groupBy("_lw_g", "idx").agg(F.min("head").alias("low"), F.collect_set("head").alias("heads"))
    links = known.where(F.size("heads") > 1).select("_lw_g", "low", F.explode("heads").alias("head")).where("head != low")
    linked = connected_components(links.select(node("head").alias("a"), node("low").alias("b")).distinct())
    parts = found.where("own and head is not null").select("_lw_g", "head").distinct().withColumn("node", node("head"))
    whole_of = parts.join(linked, "node", "left").select("_lw_g", "head", F.coalesce("component", "node").alias("cluster"))
    labels = whole_of.select("_lw_g", "head", (F.dense_rank().over(Window.partitionBy("_lw_g").orderBy("cluster")) - 1).alias("label"))
    of_place = found.where("own").join(labels, ["_lw_g", "head"], "left").select("_lw_g", "x", "y", F.coalesce("label", F.lit(-1)).alias("label"))
    out = flat.join(of_place, ["_lw_g", "x", "y"]).join(groups.select("_lw_g", *keys), "_lw_g")
    return out.select(*keys, "point_idx", "x", "y", "label")


def cluster_counts(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_clusters): the largest label plus one; 0 where all is noise."""
    keys = GROUP if keys is None else keys
    return clusters.groupBy(*keys).agg((F.max("label") + 1).alias("n_clusters"))


def centroids(clusters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, x, y, n_points): means of the clusters, noise left out."""
    keys = GROUP if keys is None else keys
    return clusters.where("label >= 0").groupBy(*keys, "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n_points"))


def _distance(origin: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt((origin[0] - at[:, 0]) ** 2 + (origin[1] - at[:, 1]) ** 2)


def _walk(at: np.ndarray, root: tuple[float, float]) -> np.ndarray:
    """(n, 4) segments from_x, from_y, to_x, to_y of the tree over the centroids ``at``, given in the order of labels.

    The root takes its 3 nearest centroids; then passes go over 3 leaves, each of which takes up to 2 nearest free ones.
    Each centroid taken puts the oldest leaf out, so the last 3 of a pass are the leaves of the next. Equal distances
    go by the distance to the origin before, and so on back to the root, then by label: what sorting the free
    centroids anew from every origin gives, in one look at them.
    """
    at, free = np.asarray(at, dtype=float).reshape(-1, 2), np.arange(len(at))
    origins: list[np.ndarray] = []
    out: list[np.ndarray] = []

    def take(origin: np.ndarray, n: int) -> list[np.ndarray]:
        nonlocal free
        got, d = [], _distance(origin, at[free])
        for _ in range(min(n, len(free))):
            near = np.flatnonzero(d == d.min())
            for earlier in reversed(origins):
                if (at[free[near]] == at[free[near[0]]]).all():
                    break
                back = _distance(earlier, at[free[near]])
                near = near[back == back.min()]
            to = at[free[near[0]]]
            free, d = np.delete(free, near[0]), np.delete(d, near[0])
            out.append(np.concatenate([origin, to]))
            got.append(to)
        origins.append(origin)
        return got

    leaves = take(np.asarray(root, dtype=float), 3)
    while len(free):
        for leaf in leaves:
            leaves = [*leaves, *take(leaf, 2)][-3:]
    return np.array(out).reshape(-1, 4)


def greedy_trees(centres: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, step, from_x, from_y, to_x, to_y): a tree over the centroids (keys, label, x, y) of every group.

    ``roots`` has one (x, y) for each value of those of the keys that it has as columns; a group without a root raises an error.
    Steps depend on one another, so a task holds the centroids of one group, no more than an image has pixels.
    """
    keys = GROUP if keys is None else keys
    on = [k for k in keys if k in roots.columns]
    ends = roots.select(*(F.col(k).alias(f"_lw_{k}") for k in on), F.col("x").cast("double").alias("root_x"), F.col("y").cast("double").alias("root_y"))
    same = [F.col(k).eqNullSafe(F.col(f"_lw_{k}")) for k in on]
    rooted = centres.select(*keys, "label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(ends, same, "left")
    rooted = rooted.select(*keys, "label", "x", "y", "root_x", "root_y")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        root = (table.column("root_x")[0].as_py(), table.column("root_y")[0].as_py())
        if None in root:
            raise ValueError(f"no root for the group {[table.column(k)[0].as_py() for k in keys]}")
        found = _walk(np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()]), root)
        return pa.table([*(table.column(k) for k in keys), pa.array(np.arange(len(found)), pa.int32()), *map(pa.array, found.T)], names=[*keys, "step", "from_x", "from_y", "to_x", "to_y"])

    empty = rooted.select(*keys, F.lit(0).alias("step"), *(F.col("x").alias(c) for c in ("from_x", "from_y", "to_x", "to_y")))
    return rooted.groupBy(*keys).applyInArrow(run, empty.schema)
