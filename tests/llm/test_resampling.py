"""Importance resampling against a plain version, long texts in pieces, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from linewave.llm.resample import features, resampled


def runs(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucketed(text, buckets):
    return Counter(zlib.crc32(f.encode()) % buckets for f in runs(text)[1])


def plain(rows, target, percent, least_words, seed, buckets):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucketed(text, buckets))
    for text in target:
        t.update(bucketed(text, buckets))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        own = bucketed(text, buckets)
        weight = sum(n * gain[b] for b, n in own.items()) // own.total() if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(runs(text)[0])])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(-1 if v is None else v for v in r[:5]) for r in out), key=str)


def answered(df):
    return sorted((tuple(-1 if v is None else v for v in (r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("buckets", [7, 100, 10_000])
def test_weights_and_ranks_equal_the_plain_version(spark, buckets):
    rnd = random.Random(buckets)
    words = ["Ab", "cd", "é1", "x", "yy", "zzz", "die", "2nd"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 1, 3, 30, 300]))) for i in range(60)]
    rows += [(None, text(9)), (7, None), (61, ""), rows[3], rows[3], (5, text(40)), (62, "x " * 2000)]
    target = [text(20) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame([(*r, r[0], "s") for r in rows], "doc_id long, text string, score long, block string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert answered(resampled(docs, aim, 40, 3, 11, buckets=buckets)) == plain(rows, target, 40, 3, 11, buckets)


def test_salts_and_small_blocks_change_nothing(spark):
    from linewave.llm.resample import weighed

    rows = [(i, f"the cat {i} sat on the mat {i % 7}") for i in range(50)]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the cat",)], "text string")
    one, many = (sorted(map(tuple, weighed(docs, aim, buckets=50, **k).collect())) for k in ({}, {"block_bytes": 60, "salt_bytes": 100}))
    assert one == many and len(one) == 50


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resampled(none, some).count() == 0
    assert answered(resampled(some, none, 100, 2)) == plain([(1, "a b c"), (2, None)], [], 100, 2, 7, 10_000)


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 20])
def test_long_texts_go_in_pieces(piece):
    rnd = random.Random(piece)
    texts = ["".join(rnd.choice("aB é1.,  ") for _ in range(n)) for n in (0, 1, 40, 700)] + ["x" * 500, "a b " * 300, " . ", "é" * 99]
    n_words, doc, bucket, n = features([t.encode() for t in texts], 100, piece)
    for i, t in enumerate(texts):
        assert n_words[i] == len(runs(t)[0])
        assert dict(zip(bucket[doc == i].tolist(), n[doc == i].tolist())) == bucketed(t, 100)
