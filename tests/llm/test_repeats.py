"""Removal of repeated strings against a comparison of all of them."""

import random

import numpy as np
import pytest

from linewave.llm.repeats import merged, runs_of, without_repeats

LOW = -(1 << 63)


def plain(rows, least):
    known, first, out = [(LOW if i is None else i, (t or "").encode()) for i, t in rows], {}, []
    for i, t in known:
        for p in range(len(t) - least + 1):
            s = t[p : p + least]
            first[s] = min(first.get(s, (i, p)), (i, p))
    for i, t in known:
        gone = [False] * len(t)
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < (i, p):
                gone[p : p + least] = [True] * least
        spans = [p for p in range(len(t) + 1) if (p < len(t) and gone[p]) != (p > 0 and gone[p - 1])]
        out.append((i, len(t), sum(gone), tuple(zip(spans[::2], spans[1::2])), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def answered(df):
    return sorted((LOW if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("least, hot", [(4, 3), (7, 1 << 17), (20, 2), (33, 1 << 17), (100, 3), (100, 1 << 17)])
def test_equals_the_comparison_of_all_strings(spark, least, hot):
    rnd = random.Random(least + hot)
    base = ["".join(rnd.choice("ab c"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 400))) for _ in range(20)]
    rows = []
    for i in range(80):
        t = rnd.choice(base)
        a, b = sorted((rnd.randint(0, len(t)), rnd.randint(0, len(t))))
        t = "".join(rnd.choice("xyé ") for _ in range(rnd.randint(0, 30))) + t[a:b] + rnd.choice(base)[: rnd.randint(0, 200)]
        rows.append((rnd.choice([None, *range(60)]) if least % 2 else i, rnd.choice([t] * 9 + [None])))
    rows += rows[:5] + [(900, "a" * 700), (901, "a" * 300 + "b" + "a" * 200), (902, ""), (903, "é" * 60)]
    docs = spark.createDataFrame([(*r, 1, b"s") for r in rows], "doc_id long, text string, block long, s binary")
    assert answered(without_repeats(docs, least=least, block_bytes=3000, hot=hot)) == plain(rows, least)


def test_edges_of_spans(spark):
    passage = "".join(chr(33 + (i * i + 7 * i) % 90) for i in range(130))
    rows = [(3, "before " + passage + " after"), (5, passage[:99] + "?"), (8, passage[15:115]), (2, "x" * 99), (1, "x" * 99), (9, passage + passage)]
    got = {r[0]: r for r in answered(without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[3][2] == got[5][2] == got[1][2] == got[2][2] == 0  # first of their kind, or too short
    assert got[8][2:4] == (100, ((0, 100),)) and got[9][2:4] == (260, ((0, 260),))
    assert answered(without_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_pieces_find_every_window(monkeypatch):
    monkeypatch.setattr("linewave.llm.repeats.PIECE", 50)
    texts = [bytes(np.random.RandomState(i).randint(0, 3, n, dtype=np.uint8)) for i, n in enumerate((200, 5, 12, 0, 333))]
    bounds = np.cumsum([0, *map(len, texts)])
    found = [p for a, n, _, _ in runs_of(b"".join(texts), bounds, 12) for x, m in zip(a, n) for p in range(x, x + m)]
    assert found == [p for lo, hi in zip(bounds, bounds[1:]) for p in range(lo, hi - 11)]


def test_merged_spans_touch():
    doc, start, end = merged(np.array([1, 1, 0, 1, 0]), np.array([5, 0, 0, 20, 90]), np.array([9, 5, 4, 30, 95]))
    assert list(zip(doc, start, end)) == [(0, 0, 4), (0, 90, 95), (1, 0, 9), (1, 20, 30)]
