"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2).

Test items are short and documents long, so a document's own signature says nothing about an item. Items
are therefore partitioned by size: class g holds the items of g/2+1 to g shingles. For each class that has
items, documents are laid out in windows of 2g shingles, each g apart: a passage of g shingles lies whole in
one of them, whatever the document's length, and its Jaccard similarity with the window is 0.19 or more. A
window's minima are the smaller of those of two neighbouring blocks, and a class's blocks are pairs of the
class below, so every shingle is hashed once for all classes. With 64 single-hash bands an item of
containment 0.8 is missed with a probability below 2e-6, also if its shingles are spread over the document.

Each candidate is verified by exact containment: shingles of the item found in the whole document, divided
by the item's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import shingle_sequences, shingle_sets, slices

BANDS = 64
#: Shingles of a text whose windows are laid out at a time, and the size of the blocks that are kept of them for larger classes.
STRETCH, KEPT = 1 << 15, 1 << 12
_rng = np.random.RandomState(20240608)
_MULTIPLY = _rng.randint(0, 1 << 62, BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 1 << 62, BANDS).astype(np.uint64)


def _minima(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(len(at), BANDS) uint32 minima of the runs of ``flat`` that begin at ``at``."""
    out = np.empty((len(at), BANDS), dtype=np.uint32)
    for p in range(BANDS):
        out[:, p] = np.minimum.reduceat(((flat * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32), at)
    return out


@dataclass
class ItemIndex:
    """A block of test items: shingle sets, and for each size class the bands' values and a filter."""

    ids: list
    sets: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]

    @classmethod
    def of(cls, rows: list[tuple], k: int) -> "ItemIndex":
        """Index (id, text) rows; items without words have no shingles and match nothing."""
        flat, bounds = shingle_sets([t for _, t in rows], k)
        keep = np.flatnonzero(np.diff(bounds))
        ids, sets = [rows[i][0] for i in keep], [flat[bounds[i] : bounds[i + 1]] for i in keep]
        of_class: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            of_class.setdefault(1 << max(0, len(s) - 1).bit_length(), []).append(i)
        classes = {}
        for g, members in sorted(of_class.items()):
            sign = np.concatenate([_minima(sets[i], np.zeros(1, dtype=np.int64)) for i in members])
            filters, bands, order = np.zeros((BANDS, 1 << 16), dtype=bool), [], np.asarray(members)
            for p in range(BANDS):
                by = np.argsort(sign[:, p], kind="stable")
                bands.append((sign[by, p], order[by]))
                filters[p, sign[:, p] >> np.uint32(16)] = True
            classes[g] = (filters, bands)
        return cls(ids, sets, classes)

    def candidates(self, flat: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """Text -> items that share a band with one of its windows.

        Texts are worked in stretches of whole blocks, each with the block that follows. Of a stretch no more is kept than its
        minima for the classes of the larger items, so memory grows neither with the text nor with small items.
        """
        found: dict[int, set[int]] = {}
        small = [g for g in self.classes if g <= KEPT]
        large = [g for g in self.classes if g > KEPT]
        size = min(small, default=KEPT)
        parts = [(i, lo, min(lo + STRETCH + KEPT, hi)) for i, (first, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) for lo in range(first, hi, STRETCH)]
        kept: dict[int, list[np.ndarray]] = {}
        while parts:
            total, n = 0, 0
            while n < len(parts) and (not n or total + parts[n][2] - parts[n][1] <= STRETCH + KEPT):
                total, n = total + parts[n][2] - parts[n][1], n + 1
            now, parts = parts[:n], parts[n:]
            owner, at, ends = [], [], []
            for j, (_, lo, hi) in enumerate(now):
                starts = np.arange(lo, hi, size)
                owner.append(np.full(len(starts), j))
                at.append(starts - lo + sum(ends))
                ends.append(hi - lo)
            minima = _minima(np.concatenate([flat[lo:hi] for _, lo, hi in now]), np.concatenate(at))
            texts = np.array([i for i, _, _ in now])
            blocks, owner = self._climb(minima, np.concatenate(owner), size, small, KEPT if large else 0, texts, found)
            if large:
                for j, i in enumerate(texts.tolist()):
                    kept.setdefault(i, []).append(blocks[owner == j][: STRETCH // KEPT])
        if large and kept:
            each = [np.concatenate(kept[i]) for i in kept]
            self._climb(np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each]), KEPT, large, 0, np.array(list(kept)), found)
        return found

    def _climb(self, blocks: np.ndarray, owner: np.ndarray, size: int, sizes: list[int], up_to: int, texts: np.ndarray, found: dict[int, set[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Look windows up in the classes of ``sizes``, from blocks of ``size`` on; the blocks of the last size, or of ``up_to``."""
        while True:
            if size in sizes:
                filters, bands = self.classes[size]
                windows = blocks.copy()
                inner = np.flatnonzero(owner[1:] == owner[:-1])
                windows[inner] = np.minimum(blocks[inner], blocks[inner + 1])
                for p in range(BANDS):
                    own = windows[:, p]
                    hit = np.flatnonzero(filters[p][own >> np.uint32(16)])
                    if len(hit):
                        values, members = bands[p]
                        lo, hi = np.searchsorted(values, own[hit]), np.searchsorted(values, own[hit], side="right")
                        for w, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo]):
                            found.setdefault(int(texts[owner[w]]), set()).update(members[a:b].tolist())
            if size >= max([*sizes, up_to]):
                return blocks, owner
            # Blocks of twice the size: within each text, 0 with 1, 2 with 3, ...
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            place = np.arange(len(owner)) - first[:-1][owner]
            even = np.flatnonzero(place % 2 == 0)
            paired = even[(even + 1 < len(owner)) & (owner[np.minimum(even + 1, len(owner) - 1)] == owner[even])]
            blocks[paired] = np.minimum(blocks[paired], blocks[paired + 1])
            blocks, owner, size = blocks[even], owner[even], 2 * size

    def search(self, texts: list[str | None], k: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of each pair with 100 * shared >= percent * the item's shingles."""
        flat, bounds = shingle_sequences(texts, k)
        for i, items in sorted(self.candidates(flat, bounds).items()):
            own = np.sort(flat[bounds[i] : bounds[i + 1]])
            for j in sorted(items):
                item = self.sets[j]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int(np.count_nonzero(own[at] == item))
                if 100 * shared >= percent * len(item):
                    yield i, j, shared


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, k: int, block_items: int, block_bytes: int = 64 << 20) -> Iterator[ItemIndex]:
    """The test items in blocks of about ``block_items`` and an index of ``block_bytes`` at most; one block is on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    # An item takes 12 bytes a band and 8 a shingle; a shingle is two characters at least.
    size = items.agg(F.count("*").alias("n"), F.sum(12 * BANDS + 4 * F.coalesce(F.length("t"), F.lit(0))).alias("most")).first()
    blocks = max(1, -(-size.n // block_items), -(-(size.most or 0) // block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        yield ItemIndex.of([(r.i, r.t) for r in own.collect()], k)


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    percent: int = 80,
    block_items: int = 50_000,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each document and test item found in it.

    Shingles are k words, A-Z lower-cased; a text of fewer words is one shingle, so a shorter item matches
    only documents of just its words. Null and empty texts on either side match nothing; null ids are
    reported as null; every row counts, repeated ones too. Extra columns are left out. An empty table on
    either side gives an empty result. Items are broadcast in blocks of about ``block_items`` or 64 MB: the documents
    are scanned once a block and never shuffled.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _indexes(benchmark, item_id, item_text, k, block_items):
        shared_index = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            own = shared_index.value
            for batch in slices(batches, "text", 1 << 20):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], own.ids[j], len(own.sets[j]), n) for i, j, n in own.search(batch.column("text").to_pylist(), k, percent)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        part = docs.mapInArrow(find, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", k: int = 5, percent: int = 80, block_items: int = 50_000) -> DataFrame:
    """The rows of ``df`` whose text holds no test item, with all their columns; one scan, no shuffle."""
    names, schema = df.columns, df.schema
    inner = [f"c{i}" for i in range(len(names))]  # names may repeat or clash
    at = names.index(text)
    out = df.toDF(*inner)
    for index in _indexes(benchmark, item_id, item_text, k, block_items):
        shared_index = df.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, inner[at], 1 << 20):
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, _, _ in shared_index.value.search(batch.column(inner[at]).to_pylist(), k, percent):
                    keep[i] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*schema.names)
