"""Quality scores by histogram gradient-boosted trees over document statistics (operator 9).

Statistics of a whole text (shares of byte kinds, word and line shapes, repetition) are binned by quantiles;
trees grow level by level on histograms of the logistic loss's gradients. The fitted trees are flattened
into arrays, and a batch of documents walks all of them at once by index arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import hash_sample, held_out, mix64, slices, word_hashes

NAMES = (
    "bytes", "words", "word_bytes", "upper", "digit", "space", "line_breaks", "full_stops", "commas", "loud", "bars", "signs", "beyond_ascii",
    "distinct_words", "repeated_words", "distinct_triples", "capital_words", "most_common_pair",
)
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\v\f", "line_breaks": b"\n", "full_stops": b".", "commas": b",;:", "loud": b"!?", "bars": b"|", "signs": b"#$%&*+/<=>@[\\]^_`{}~"}


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, len(NAMES)) statistics; all 0 for a null or empty text."""
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(data), len(NAMES)))
    if not data:
        return out
    joined = b"\n".join(data) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = np.maximum(sizes, 1)
    col = {name: i for i, name in enumerate(NAMES)}
    out[:, col["bytes"]] = np.log1p(sizes)
    for name, chars in _KINDS.items():
        kind = np.zeros(256, dtype=np.uint8)
        kind[list(chars)] = 1
        count = np.add.reduceat(kind[raw], first[:-1], dtype=np.int64)
        out[:, col[name]] = (count - (name == "line_breaks")) / n  # without the break that joins texts
    out[:, col["beyond_ascii"]] = np.add.reduceat(raw >> 7, first[:-1], dtype=np.int64) / n
    hashes, starts = word_hashes(joined)
    bound = np.searchsorted(starts, first)
    words = np.diff(bound)
    owner = np.repeat(np.arange(len(data)), words)
    m = np.maximum(words, 1)
    per = lambda values, at: np.bincount(at, weights=values, minlength=len(data))
    out[:, col["words"]] = np.log1p(words)
    blank = out[:, col["space"]] + out[:, col["line_breaks"]]
    out[:, col["word_bytes"]] = np.log1p((1 - blank) * sizes / m)
    if len(hashes):
        mark = mix64(owner.astype(np.uint64) + np.uint64(1))
        distinct = lambda h, o: np.bincount(o[np.unique(h, return_index=True)[1]], minlength=len(data))
        out[:, col["distinct_words"]] = distinct(hashes ^ mark, owner) / m
        same = owner[1:] == owner[:-1]
        out[:, col["repeated_words"]] = per((hashes[1:] == hashes[:-1]) & same, owner[1:]) / m
        capital = (raw[starts] >= 65) & (raw[starts] <= 90)
        out[:, col["capital_words"]] = per(capital, owner) / m
        if len(hashes) > 2:
            inside = np.flatnonzero(owner[2:] == owner[:-2])
            triple = mix64(mix64(hashes[:-2] * np.uint64(3) + hashes[1:-1]) + hashes[2:])[inside] ^ mark[inside]
            out[:, col["distinct_triples"]] = distinct(triple, owner[inside]) / np.maximum(words - 2, 1)
        at = np.flatnonzero(same)
        if len(at):
            _, where, count = np.unique(mix64(hashes[:-1] * np.uint64(5) + hashes[1:])[at] ^ mark[at], return_index=True, return_counts=True)
            top = np.zeros(len(data))
            np.maximum.at(top, owner[at][where], count)
            out[:, col["most_common_pair"]] = top / m
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: (trees, inner nodes) and (trees, leaves)."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        tree = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(tree)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        depth = self.leaf.shape[1].bit_length() - 1
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.bound[tree, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Boosted trees for labels 0/1. Without rows the score is 0.5; with one label only it is near it."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, bound, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    ones = float(y.sum()) if len(y) else 0.0
    start = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if ones in (0, len(y)):
        return Trees(feature[:0], bound[:0], leaf[:0], start)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # code > b: value > cuts[b]
    raw = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            low, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            for f, c in enumerate(cuts):
                size = len(c) + 1
                key = (node - low) * size + codes[:, f]
                hg = np.bincount(key, g, width * size).reshape(width, size).cumsum(axis=1)
                hh = np.bincount(key, h, width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, gt, ht = hg[:, :-1], hh[:, :-1], hg[:, -1:], hh[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[t, low + k], bound[t, low + k] = top[k], f, c[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > bound[t, node])
        own = node - inner
        leaf[t] = -rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + ridge)
        raw += leaf[t][own]
    return Trees(feature, bound, leaf, start)


def fit_quality(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", sample: int = 20_000, most: int = 40_000, **how) -> Trees:
    """Fit on about ``sample`` (``most`` at most) labelled rows outside the held-out ids, chosen by id hash.

    Statistics of the sample are worked out in tasks; the driver gets ``sample`` rows of numbers. Null
    labels and labels of absent documents are ignored; repeated labels of a document all count. Where repeats lead beyond
    ``most``, those of the smallest id hashes are taken, so reruns agree.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id))).select(F.col(label_id).cast("long").alias("i"), F.col(label).cast("int").alias("y"))
    usable = hash_sample(usable, "i", sample).orderBy(F.xxhash64("i"), "i", "y").limit(most)
    rows = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("text")).join(F.broadcast(usable), "i").select("i", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "y", "x"])

    got = rows.mapInArrow(run, "i long, y int, x array<double>").orderBy(F.xxhash64("i"), "i", "y", "x").limit(most).toArrow().sort_by([("i", "ascending"), ("y", "ascending")])
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)))
    return fit_trees(x, got["y"].to_numpy().astype(float), **how)


def quality(df: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``df``; predicted is 1 from a score of ``least``.

    Null and empty texts have the score of all-zero statistics. Repeated rows, null ids and extra columns
    are allowed; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = shared.value.score(statistics(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
