"""Near-duplicate documents by an LSH forest over MinHash signatures (operator 4).

1. Each text becomes its set of k-word shingles; equal sets form one class, named by its smallest id.
2. Each class's signature is laid out in several orders ("trees"). In every tree the labels are sorted,
   and classes that share a prefix of at least ``min_depth`` hashes are a region. Neighbours in the sorted
   order have the longest common prefixes: in a sparse region a short prefix is enough, in a crowded one
   only deeper prefixes stand next to each other, so the depth adapts to the region.
3. Neighbours whose labels agree widely are joined into families (loose components).
4. Inside a family the full sets decide: a prefix-filtered inverted index compares every pair that could
   reach the threshold, and skips only pairs that are already connected. A large family is dealt out in salts and first
   compared with a few of its members, the pivots; what they connect, mostly all copies of a text, need not be compared
   again. The rest, in blocks, meets every salt of the family.
5. The components of the confirmed links are the groups; the smallest id of each is kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewave.llm.common import mix64, shingle_sets, slices
from linewave.operators.components import connected_components
from linewave.storage import written

HASHES = 64
TREES = 16
LABEL = 12  # hashes of a label: the region's prefix and nine more
_rng = np.random.RandomState(20240607)
_MULTIPLY = _rng.randint(0, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 1 << 62, HASHES).astype(np.uint64)


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32 MinHash values; rows of empty sets hold no meaning."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        for p in range(HASHES):
            out[full, p] = np.minimum.reduceat(((flat * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _set_rows(k: int):
    """Rows (doc_id, text) -> (doc_id, n_shingles, key, signature); key names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            flat, bounds = shingle_sets(batch.column("text").to_pylist(), k)
            n = np.diff(bounds)
            sums = np.zeros((2, len(n)), dtype=np.uint64)
            full = np.flatnonzero(n)
            if len(full):  # two sums of different mixes of the members name the set in 128 bits
                sums[0, full] = np.add.reduceat(mix64(flat), bounds[:-1][full])
                sums[1, full] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
            sign = signatures(flat, bounds).astype(">u4")
            key = np.ascontiguousarray(sums.T).astype(">u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([r.tobytes() for r in key], pa.binary()), pa.array([r.tobytes() for r in sign], pa.binary())],
                names=["doc_id", "n_shingles", "key", "signature"],
            )

    return run


def _forest_rows(min_depth: int):
    """Rows (rep, signature) -> a row for each tree: (tree, region, label, rep)."""
    orders = np.array([[(t * (HASHES // TREES) + j) % HASHES for j in range(LABEL)] for t in range(TREES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            if not len(rep):
                continue
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(len(rep), HASHES)
            for t in range(TREES):
                label = np.ascontiguousarray(sign[:, orders[t]])
                region = np.full(len(rep), t + 1, dtype=np.uint64)
                for j in range(min_depth):
                    region = mix64(region * np.uint64(0xFF51AFD7ED558CCD) + label[:, j].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rep), t), pa.int32()), pa.array(region.view(np.int64)), pa.array([r.tobytes() for r in label], pa.binary()), pa.array(rep)],
                    names=["tree", "region", "label", "rep"],
                )

    return run


def _neighbours(min_depth: int, window: int, agree: int):
    """Sorted rows of regions -> pairs (a, b) of longest-common-prefix neighbours with agreeing labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=">u4").reshape(-1, LABEL).astype(np.uint32)
            region, rep = batch.column("region").to_numpy(), batch.column("rep").to_numpy()
            if held is not None:
                label, region, rep = (np.concatenate(x) for x in zip(held, (label, region, rep)))
            found = []
            for d in range(1, min(window, len(rep) - 1) + 1):
                same = np.flatnonzero((region[d:] == region[:-d]) & (rep[d:] != rep[:-d]))
                equal = label[same] == label[same + d]
                keep = same[equal[:, :min_depth].all(axis=1) & (equal.sum(axis=1) >= min_depth + agree)]
                found.append(np.stack([rep[keep], rep[keep + d]]))
            held = (label[-window:], region[-window:], rep[-window:])
            if found:
                pair = np.concatenate(found, axis=1)
                pair = np.unique(np.stack([pair.min(axis=0), pair.max(axis=0)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    shared = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed_links(members: list[tuple[int, int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (id, id) that connect what is linked within (id, block, component, sorted set) members.

    Pairs are compared when their sets share one of each other's rarest members (a set of n has
    n - ceil(percent*n/100) + 1 of them, so no pair that reaches the threshold is missed). A pair
    already connected, by ``component`` from the start, is skipped. Between blocks 0 and 1 only pairs across them count,
    within any other block all pairs.
    """
    blocks = {b for _, b, _, _ in members}
    if blocks < {0, 1}:
        return []
    two = len(blocks) > 1
    members = sorted(members, key=lambda m: (len(m[3]), m[0]))
    first: dict[int, int] = {}
    parent = [first.setdefault(c, i) for i, (_, _, c, _) in enumerate(members)]
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flat = np.concatenate([m[3] for m in members])
    values, rank, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(values), dtype=np.int64)
    order[np.lexsort((values, count))] = np.arange(len(values))  # rarest first
    ranked = order[rank]
    postings: dict[int, list[int]] = defaultdict(list)
    sets: list[frozenset] = []
    at = 0
    for i, (_, block, _, own) in enumerate(members):
        n = len(own)
        mine = np.sort(ranked[at : at + n])
        at += n
        sets.append(frozenset(mine.tolist()))
        head = mine[: n - -(-percent * n // 100) + 1].tolist()
        seen: set[int] = set()
        for value in head:
            for j in postings[value]:
                if j in seen:
                    continue
                seen.add(j)
                other = sets[j]
                if 100 * len(other) < percent * n or (two and members[j][1] == block):
                    continue
                ri, rj = root(i), root(j)
                if ri == rj:
                    continue
                shared = len(sets[i] & other)
                if 100 * shared >= percent * (n + len(other) - shared):
                    parent[max(ri, rj)] = min(ri, rj)
                    links.append((members[i][0], members[j][0]))
        for value in head:
            postings[value].append(i)
    return links


def _pivot_links(percent: int):
    """Rows sorted by (family, salt, role), pivots (role 0) first -> links of members and pivots with pivots.

    Pivots that are linked form a class; one link with a class is enough. A salt's pivots are held, its members pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, classes = None, []  # a class: its pivots (rep, set)
        for batch in batches:
            a, b = [], []
            for family, salt, role, rep, own in zip(*(batch.column(c).to_pylist() for c in ("family", "salt", "role", "rep", "members"))):
                if (family, salt) != now:
                    now, classes = (family, salt), []
                own = np.frombuffer(own, dtype=np.uint64)
                met = []
                for c in classes:
                    for pivot, other in c:
                        if similar(own, other, percent):
                            met.append(c)
                            a.append(rep)
                            b.append(pivot)
                            break
                if role == 0:
                    classes = [c for c in classes if not any(c is m for m in met)] + [[p for c in met for p in c] + [(rep, own)]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _family_rows(k: int):
    """Rows with a text -> the same rows with the text's shingle set in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            flat, bounds = shingle_sets(batch.column("text").to_pylist(), k)
            sets = [flat[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "rep", "salts")), pa.array(sets, pa.binary())], names=["family", "rep", "salts", "members"])

    return run


def _confirm(percent: int):
    """Rows sorted by (family, one, two) -> confirmed links; one bounded group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, a, b = None, {}, [], []

        def flush() -> None:
            if len(group) > 1:
                for x, y in confirmed_links([(rep, block, c, s) for (rep, block, _), (c, s) in group.items()], percent):
                    a.append(x)
                    b.append(y)
            group.clear()

        for batch in batches:
            for family, one, two, rep, block, known, own in zip(*(batch.column(c).to_pylist() for c in ("family", "one", "two", "rep", "block", "known", "members"))):
                if (family, one, two) != now:
                    flush()
                    now = (family, one, two)
                group[rep, block, own] = (known, np.frombuffer(own, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """Links within each (family, one, two)."""
    return dealt.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two").mapInArrow(_confirm(percent), "a long, b long")


def _parts(block_shingles: int, block_rows: int) -> Column:
    """Into how many parts rows of ``n`` shingles are dealt out."""
    return F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_rows)).cast("int")


def _large_family_links(sets: DataFrame, percent: int, block_shingles: int, block_rows: int, pivots: int) -> DataFrame:
    """Links of families of more than one salt, given as (family, rep, salts, members).

    All members meet the first pivots, and those that these leave outside the family's largest component meet four times
    as many others. Copies of a text are then done; what is still left meets every member.
    """
    own = sets.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    placed = sets.select("family", "rep").distinct().withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("rep", F.lit(1)), "rep"))).where(F.col("place") <= 5 * pivots)
    placed = written(placed.select("rep", "place"), "pivots")
    columns = ["family", "salt", "role", "rep", "members"]
    seeking, met, rest = own, None, None
    for low, high in ((0, pivots), (pivots, 5 * pivots)):
        chosen = placed.where((F.col("place") > low) & (F.col("place") <= high)).select("rep")
        first = sets.join(chosen, "rep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        both = seeking.withColumn("role", F.lit(1)).select(*columns).unionByName(first.withColumn("role", F.lit(0)).select(*columns))
        found = both.repartition("family", "salt").sortWithinPartitions("family", "salt", "role", "rep").mapInArrow(_pivot_links(percent), "a long, b long")
        found = found.where("a <> b").distinct()
        met = written(found if met is None else met.unionByName(found).distinct(), "pivot_links")
        known = connected_components(met)
        sized = sets.select("family", "rep", (F.length("members") / 8).alias("n")).join(known, sets.rep == known.node, "left").select("family", "rep", "n", F.coalesce("component", "rep").alias("known"))
        sized = written(sized, "known")
        largest = sized.groupBy("family", "known").agg(F.sum("n").alias("n")).groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
        rest = written(sized.join(largest, "family").where("known <> largest").select("family", "rep", "n"), "rest")
        seeking = own.join(rest.select("rep").distinct(), "rep", "left_semi")
    blocks = rest.groupBy("family").agg(_parts(block_shingles, block_rows).alias("blocks"))
    more = own.join(blocks, "family").join(sized.select("rep", "known").distinct(), "rep")
    every = more.withColumn("two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", F.col("salt").alias("one"), "two", "rep", F.lit(0).alias("block"), "known", "members")
    left = more.join(rest.select("rep").distinct(), "rep", "left_semi").withColumn("two", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))
    left = left.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("family", "one", "two", "rep", F.lit(1).alias("block"), "known", "members")
    return met.unionByName(_links(every.unionByName(left), percent))


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 80,
    min_depth: int = 3,
    window: int = 4,
    agree: int = 4,
    block_shingles: int = 30_000,
    block_rows: int = 200,
    pivots: int = 16,
    broadcast_members: int = 2_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| over their sets of distinct
    k-word shingles; component_id is the smallest doc_id reachable, and the row that carries it is kept.
    Texts that are null, empty or only white space have an empty set and stand alone. Rows that repeat a
    doc_id count as one node. A null doc_id takes no part: its component_id is null and it is kept.
    Extra columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(docs.mapInArrow(_set_rows(k), "doc_id long, n_shingles long, key binary, signature binary"), "sets")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # Equal sets have equal signatures: any one of a class serves.
    classes = written(rows.where(linkable).groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")

    trees = classes.select("rep", "signature").mapInArrow(_forest_rows(min_depth), "tree int, region long, label binary, rep long")
    pairs = (
        trees.repartition("tree", "region")
        .sortWithinPartitions("tree", "region", "label", "rep")
        .select("region", "label", "rep")
        .mapInArrow(_neighbours(min_depth, window, agree), "a long, b long")
        .distinct()
    )
    families = connected_components(pairs).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = written(families.join(classes.select("rep", "n"), "rep"), "families")
    salts = members.groupBy("family").agg(_parts(block_shingles, block_rows).alias("salts"))
    members = members.join(salts, "family").select("rep", "family", "salts").distinct()
    if members.count() <= broadcast_members:
        members = F.broadcast(members)
    sets = docs.join(members, docs.doc_id == members.rep).select("family", "rep", "salts", "text").mapInArrow(_family_rows(k), "family long, rep long, salts int, members binary")
    sets = written(sets, "family_sets")
    whole = ["family", F.lit(0).alias("one"), F.lit(0).alias("two"), "rep", F.lit(2).alias("block"), F.col("rep").alias("known"), "members"]
    links = _links(sets.where("salts = 1").select(*whole), percent)
    if sets.where("salts > 1").take(1):
        links = links.unionByName(_large_family_links(sets.where("salts > 1"), percent, block_shingles, block_rows, pivots))
    groups = connected_components(links)
    # Classes that hold one doc_id twice (repeated ids with unlike texts) meet in that node.
    named = classes.select("key", "rep").join(groups, classes.rep == groups.node, "left").select("key", F.coalesce("component", "rep").alias("least"))
    return (
        rows.select("doc_id", "n_shingles", "key")
        .join(named, "key", "left")
        .select("doc_id", "n_shingles", F.when(linkable, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stay: one document of each near-duplicate group.

    Rows with a null doc_id stay; of rows that repeat a kept doc_id, all stay.
    """
    gone = near_duplicates(df, doc_id, text, **how).where("not kept").select(F.col("doc_id").alias("_lw_gone")).distinct()
    return df.join(gone, df[doc_id] == gone["_lw_gone"], "left_anti")
