"""Importance resampling of documents towards a target corpus (operator 12).

Features are runs of one or two words, hashed into buckets; a bucket's gain is the logarithm of how much more often the
target has it. Postings are inverted: a map over the documents turns each block of texts into lists by bucket, (document,
count) each, and buckets are dealt out in groups, so a task has the postings of some buckets. The corpora's counts of a bucket
meet there: each group is joined with the sums of its buckets in both corpora, works out the gains and emits what they
add to each document; the parts are summed by document. A common bucket is in every block, so groups are salted by
block until a salt holds a bounded number of bytes.

Drawing: scores are whole numbers with random parts drawn from an extreme-value distribution, so the highest ones are a
sample without replacement in proportion to the weights' exponentials. A rank is the number of documents of higher scores, from
counts by score, and the place within the score; no task sorts all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from linewave.llm.common import slices
from linewave.storage import written

#: Groups that the buckets are dealt out in.
GROUPS = 16
_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True
_POSTED = "block long, grp int, doc_id array<long>, n_words array<long>, n_features array<long>, sums array<long>, postings binary"


def _zeros_after(n: int) -> np.ndarray:
    """(4, 256) tables that carry a crc32 over ``n`` bytes that follow: crc(a + b) = carried crc(a) ^ crc(b)."""

    def square(m: list[int]) -> list[int]:
        return [times(m, x) for x in m]

    def times(m: list[int], x: int) -> int:
        out, i = 0, 0
        while x:
            if x & 1:
                out ^= m[i]
            x, i = x >> 1, i + 1
        return out

    power = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        power = square(power)
    total = [1 << i for i in range(32)]
    while n:
        if n & 1:
            total = [times(power, x) for x in total]
        power, n = square(power), n >> 1
    return np.array([[times(total, b << 8 * i) for b in range(256)] for i in range(4)], dtype=np.uint32)


_carry: dict[int, np.ndarray] = {}


def _carried(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty(len(crcs), dtype=np.uint32)
    by = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[by], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
        n, some = int(lengths[by[lo]]), by[lo:hi]
        table = _carry.get(n)
        if table is None:
            if len(_carry) > 4096:
                _carry.clear()
            table = _carry[n] = _zeros_after(n)
        x = crcs[some]
        out[some] = table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]
    return out


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word of lower-cased text, its crc32, and that of a space and the word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.empty(2 * len(starts) + 1, dtype=np.int64)
    offsets[0], offsets[1::2], offsets[2::2] = (starts[0] if len(starts) else 0), ends, np.append(starts[1:], len(data))[: len(starts)]
    # Words and what lies between them, in turn; only the words are looked up.
    cut = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = cut.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    own = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    alone = np.array([zlib.crc32(w) for w in own], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in own], dtype=np.uint32)
    lengths = np.array([len(w) + 1 for w in own], dtype=np.int64)
    return starts, alone[at], _carried(alone[at[:-1]], lengths[at[1:]]) ^ spaced[at[1:]] if len(at) > 1 else np.zeros(0, np.uint32)


def features(texts: list[bytes], buckets: int, piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and (text, bucket, count) of its features: runs of one and two words, by crc32.

    Texts beyond ``piece`` bytes are worked in pieces that end between words and begin with the last word of the one before.
    """
    n_words, found = np.zeros(len(texts), dtype=np.int64), []

    def add(own: list[int], data: list[bytes]) -> None:
        first = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum([len(d) + 1 for d in data], out=first[1:])
        starts, one, two = _words(b" ".join(data).lower())
        if not len(starts):
            return
        of = np.searchsorted(first, starts, side="right") - 1
        same = of[1:] == of[:-1]
        at = np.asarray(own, dtype=np.int64)
        np.add.at(n_words, at, np.bincount(of, minlength=len(data)))
        key = np.concatenate([at[of], at[of[1:][same]]]) * buckets + np.concatenate([one, two[same]]) % buckets
        found.append(np.unique(key, return_counts=True))

    short = [i for i, t in enumerate(texts) if len(t) <= piece]
    if short:
        add(short, [texts[i] for i in short])
    for i in set(range(len(texts))) - set(short):
        lo, before = 0, b""
        while lo < len(texts[i]):
            hi = min(lo + piece, len(texts[i]))
            some = texts[i][lo:hi].lower()
            if hi < len(texts[i]) and _WORD[some[-1]]:  # go back to the end of the last whole word, or on to it
                back = np.flatnonzero(~_WORD[np.frombuffer(some, dtype=np.uint8)])
                if len(back):
                    hi = lo + int(back[-1]) + 1
                else:
                    ahead = np.frombuffer(texts[i][hi:].lower(), dtype=np.uint8)
                    stop = np.flatnonzero(~_WORD[ahead])
                    hi = hi + int(stop[0]) if len(stop) else len(texts[i])
                some = texts[i][lo:hi].lower()
            add([i], [before + b" " + some])
            if before:  # counted in the piece before
                n_words[i] -= 1
                found.append((np.array([i * buckets + zlib.crc32(before) % buckets]), np.array([-1])))
            edge = np.diff(np.concatenate([[False], _WORD[np.frombuffer(some, dtype=np.uint8)], [False]]).astype(np.int8))
            if (edge == 1).any():
                before = some[np.flatnonzero(edge == 1)[-1] : np.flatnonzero(edge == -1)[-1]]
            lo = hi
    if not found:
        return n_words, *(np.zeros(0, np.int64),) * 3
    key, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    if len(found) > 1:
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at.ravel(), weights=n).astype(np.int64)
        key, n = key[n > 0], n[n > 0]
    return n_words, key // buckets, key % buckets, n


def _pack(doc: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> bytes:
    """Postings of a group: the number of each bucket's, low and high bytes of the documents' places, and counts of 255 at most."""
    place = doc.astype("<u2").view(np.uint8).reshape(-1, 2)
    return sizes.astype("<u4").tobytes() + place[:, 0].tobytes() + place[:, 1].tobytes() + count.astype(np.uint8).tobytes()


def _unpack(data: bytes, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket's place in the group, document's place, count) of each posting."""
    sizes = np.frombuffer(data, dtype="<u4", count=n_buckets)
    rest = np.frombuffer(data, dtype=np.uint8, offset=4 * n_buckets).reshape(3, -1)
    return np.repeat(np.arange(n_buckets), sizes), rest[0] + rest[1].astype(np.int64) * 256, rest[2].astype(np.int64)


def _inverted(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "grp", "doc_id", "n_words", "n_features", "sums", "postings"]
        longs = pa.list_(pa.int64())
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 16):  # places take two bytes
                for batch in slices(iter([whole.slice(lo, 1 << 16)]), "text", block_bytes):
                    texts = batch.column("text").cast(pa.large_binary()).to_pylist()
                    n_words, doc, bucket, n = features(texts, buckets)
                    n_features = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
                    rows = [(block, -1, batch.column("doc_id").to_pylist(), n_words, n_features, None, None)]
                    full, rest = np.divmod(n, 255)  # larger counts are several postings
                    doc, bucket = np.concatenate([np.repeat(doc, full), doc[rest > 0]]), np.concatenate([np.repeat(bucket, full), bucket[rest > 0]])
                    n = np.concatenate([np.full(full.sum(), 255), rest[rest > 0]])
                    by = np.lexsort((doc, bucket // GROUPS, bucket % GROUPS))
                    doc, bucket, n = doc[by], bucket[by], n[by]
                    cuts = np.searchsorted(bucket % GROUPS, np.arange(GROUPS + 1))
                    for g in range(GROUPS):
                        own = slice(cuts[g], cuts[g + 1])
                        place, width = bucket[own] // GROUPS, -(-(buckets - g) // GROUPS)
                        if len(place):
                            rows.append((block, g, None, None, None, np.bincount(place, weights=n[own], minlength=width).astype(np.int64), _pack(doc[own], n[own], np.bincount(place, minlength=width))))
                    block += 1
                    kinds = [pa.int64(), pa.int32(), longs, longs, longs, longs, pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _contributions(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Postings of a group and salt, beside its buckets' sums in both corpora: what the gains add to each document."""
        blocks, docs, parts = [], [], []
        if len(left):
            g = left.column("grp")[0].as_py()
            width = -(-(buckets - g) // GROUPS)
            at = right.column("bucket").to_numpy() // GROUPS
            gain = np.zeros(width, dtype=np.int64)
            gain[at] = right.column("gain").to_numpy()
            for block, data in zip(left.column("block").to_pylist(), left.column("postings")):
                bucket, doc, n = _unpack(data.as_py(), width)
                some, own = np.unique(doc, return_inverse=True)
                part = np.zeros(len(some), dtype=np.int64)
                np.add.at(part, own, n * gain[bucket])
                blocks.append(np.full(len(some), block)), docs.append(some.astype(np.int32)), parts.append(part)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table([pa.array(join(blocks, np.int64)), pa.array(join(docs, np.int32)), pa.array(join(parts, np.int64))], names=["block", "place", "part"])

    return run


def _bucket_sums(posted: DataFrame, name: str) -> DataFrame:
    each = posted.where("grp >= 0").select("grp", F.posexplode("sums").alias("i", "n")).where("n > 0")
    return each.groupBy((F.col("i") * GROUPS + F.col("grp")).alias("bucket")).agg(F.sum("n").alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grp, gain) of the buckets of both corpora's inverted blocks, which meet by bucket."""
    both = _bucket_sums(documents, "s").join(_bucket_sums(target, "t"), "bucket", "full_outer").na.fill(0, ["s", "t"])
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(totals)).select("bucket", (F.col("bucket") % GROUPS).cast("int").alias("grp"), F.floor(1000 * F.log(ratio)).alias("gain"))  # the totals are one row


def weighed(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, block_bytes: int = 4 << 20, salt_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; the weight is the floored mean gain of its features, 0 without any.

    Words are runs of 0-9, letters (A-Z lower-cased) and anything beyond ASCII; features are one or two words in a row, by
    crc32 modulo ``buckets``. Null and empty texts have no features. Every row counts, repeated ones and those of a null id too.
    Texts go whole, long ones in pieces. Other columns are left out. An empty target has all gains from the documents alone; no
    documents give an empty result. Inverted blocks are written to the shared folder once and read for the sums and the postings.
    """
    invert = lambda frame, i, t, name: written(frame.select(i.cast("long").alias("doc_id"), F.coalesce(F.col(t), F.lit("")).alias("text")).mapInArrow(_inverted(buckets, block_bytes), _POSTED), name)
    posted = invert(df, F.col(doc_id), text, "postings")
    aimed = invert(target, F.lit(None), target_text, "target")
    # Blocks of a group go to as many salts as their bytes ask for; a group's gains go to each.
    most = posted.groupBy("grp").agg(F.sum(F.octet_length("postings")).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    salts = max(1, math.ceil(most / salt_bytes))
    gain = gains(posted, aimed, buckets).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    postings = posted.where("grp >= 0").select("block", "grp", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "postings")
    parts = postings.groupBy("grp", "salt").cogroup(gain.groupBy("grp", "salt")).applyInArrow(_contributions(buckets), "block long, place int, part long")
    rows = posted.where("grp < 0").select("block", F.posexplode(F.arrays_zip("doc_id", "n_words", "n_features")).alias("place", "d")).select("block", "place", "d.*", F.lit(0).cast("long").alias("part"))
    none = lambda c: F.lit(None).cast("long").alias(c)
    both = rows.unionByName(parts.select("block", "place", none("doc_id"), none("n_words"), none("n_features"), "part"))
    each = both.groupBy("block", "place").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")), F.sum("part").alias("sum"))
    n, total = F.col("n_features"), F.col("sum")
    weight = F.when(n > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return each.select("doc_id", "n_words", "n_features", weight.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold draw from the extreme-value distribution, floored, by the first eight hexadecimal digits of sha256('seed:id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(df: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000) -> DataFrame:
    """:func:`weighed` with score and rank: 1, 2, ... of the drawn documents, null of the others.

    Of the N rows of ``least_words`` words or more, the floor(percent * N / 100) highest scores are drawn; ties go to the smaller
    id, a null one first. Rows of one id have the same random part; rows that agree in all are ranked one after another.
    """
    scored = written(weighed(df, target, doc_id, text, target_text, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    # Scores are whole numbers of a bounded range (gains of 64-bit counts, draws of 32 bits): some 10,000 rows, however many documents.
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("score"))
    above = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = counts.select("score", above.alias("above"), F.floor(F.sum("n").over(everywhere) * percent / 100).alias("drawn"))
    # Each score is put in order on its own: the random parts spread the scores.
    own = F.row_number().over(Window.partitionBy("score", able).orderBy(F.asc_nulls_first("doc_id"), "n_features"))
    ranked = scored.withColumn("own", own).join(levels, "score", "left").withColumn("rank", F.when(able, F.col("above") + F.col("own")))
    return ranked.select(*scored.columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank"))
