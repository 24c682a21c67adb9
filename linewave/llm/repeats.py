"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 13).

A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a document of a smaller id, or
before in the same one. Only the first ``least`` bytes of a suffix matter, so suffixes are ordered by passes over
digits, the most significant first, and a suffix that is alone after a pass takes no part in the next:

1. The first digit is the gram of the suffix's window with the smallest hash (its anchor). Equal windows have the
   same anchor at the same place, and windows that follow one another mostly share it, so a run of them is one entry.
   Documents lie in blocks; a block deals the hashes of its anchors out by their leading bits, once each, and gets
   back those that occur twice.
2. Runs of such anchors are cut out as strings. Equal strings of a block become one; the rest are dealt out by the
   leading bits again. Equal strings have equal windows.
3. The next digits are the bytes to the left of the anchor, one a pass, and those to the right. Windows whose left
   and right groups are both equal are equal: bytes are compared, hashes only choose what is compared.

Each group keeps its earliest place; all the others are removed. Texts are shuffled once: all three steps read the
same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewave.llm.common import mix64

#: Positions whose anchors are worked out at a time.
PIECE = 1 << 17
_NULL_ID = -(1 << 63)
_FOUND = "block long, hashes binary"
_ENTRIES = "g long, block long, doc int, start long, end long, id long, at int, s binary"
_SPANS = "block long, doc int, start long, end long"


def gram_length(least: int) -> int:
    """Bytes of an anchor: the largest power of two that is no more than half of ``least``."""
    return 1 << (least // 2).bit_length() - 1


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes (a power of two) from each place on."""
    x, d = data.astype(np.uint64), 1
    while d < k:
        x = x[:-d] * np.uint64(0x9E3779B97F4A7C15) + x[d:]
        x ^= x >> np.uint64(29)
        d *= 2
    return mix64(x)


def _anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``least`` bytes: the place of its anchor, the leftmost gram of the smallest hash; and all hashes.

    Hashes are compared by their upper 56 bits. Windows reach over two blocks of w grams at most, so a window's minimum is
    the smaller one of a block's minimum from there on and the next one's up to there.
    """
    k = gram_length(least)
    w = least - k + 1
    hashes = _gram_hashes(data, k)
    n = len(hashes) - w + 1
    kind = np.uint16 if w < 1 << 16 else np.uint64
    values = np.full(-(-len(hashes) // w) * w, ~np.uint64(0))
    values[: len(hashes)] = hashes >> np.uint64(8)
    values = values.reshape(-1, w)
    place = np.arange(w, dtype=kind)
    before, after = np.minimum.accumulate(values, axis=1), np.minimum.accumulate(values[:, ::-1], axis=1)[:, ::-1]
    # The places of those minima, of equals the leftmost.
    fresh = np.zeros(values.shape, dtype=bool)
    fresh[:, 0] = True
    fresh[:, 1:] = before[:, 1:] < before[:, :-1]
    at_before = np.maximum.accumulate(np.where(fresh, place, 0).astype(kind), axis=1)
    fresh[:, -1] = True
    fresh[:, :-1] = values[:, :-1] <= after[:, 1:]
    at_after = np.minimum.accumulate(np.where(fresh, place, w - 1).astype(kind)[:, ::-1], axis=1)[:, ::-1]
    p = np.arange(n)
    last = p + w - 1
    left, right = after.ravel()[:n], before.ravel()[w - 1 : w - 1 + n]
    own = np.where(left <= right, p // w * w + at_after.ravel()[:n], last // w * w + at_before.ravel()[w - 1 : w - 1 + n])
    return own, hashes


def runs_of(flat: bytes, bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, windows, anchor, hash) of the runs of windows that share an anchor, for texts one behind the other in ``flat``.

    Places are those in ``flat``. Texts are worked in pieces, which may cut a run in two.
    """
    data = np.frombuffer(flat, dtype=np.uint8)
    for lo in range(0, len(data) - least + 1, PIECE):
        hi = min(lo + PIECE, len(data) - least + 1)
        place = np.arange(lo, hi)
        inside = np.flatnonzero(place + least <= bounds[np.searchsorted(bounds, place, side="right")])
        if not len(inside):
            continue
        anchors, hashes = _anchors(data[lo : hi + least - 1], least)
        own = anchors[inside]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]))
        yield inside[first] + lo, np.diff(np.append(first, len(own))), own[first] + lo, mix64(hashes[own[first]])  # mixed anew: the smallest ones all begin alike


def _digit(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Leading bits as a number below ``groups``; it grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _rank(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Dense rank by id, then place; equal pairs have equal ranks."""
    by = np.lexsort((place, ids))
    fresh = np.ones(len(by), dtype=np.int64)
    fresh[1:] = (ids[by][1:] != ids[by][:-1]) | (place[by][1:] != place[by][:-1])
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.cumsum(fresh) - 1
    return out


class _Block:
    """The distinct (id, text) rows of a block in order, as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
        order = sorted(set(zip([_NULL_ID if i is None else i for i in ids], texts)))
        self.ids = np.array([i for i, _ in order], dtype=np.int64)
        self.texts = [t for _, t in order]
        self.bounds = np.zeros(len(order) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in self.texts], out=self.bounds[1:])
        self.flat = b"".join(self.texts)
        at = {row: i for i, row in enumerate(order)}
        self.rows = [(i, at[_NULL_ID if i is None else i, t]) for i, t in zip(ids, texts)]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each document in order, those that touch or overlap made one."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    # A running maximum within each document: documents are set apart by more than any end.
    far = int(end.max()) + 2
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * far
    reach = np.maximum.accumulate(end + shift)
    first = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return doc[at], start[at], (reach - shift)[np.append(at[1:], len(doc)) - 1]


def _first_digit(least: int, groups: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's anchors: their hashes by the leading bits, with the number of runs of each (at most ``hot``)."""
        own = _Block(table)
        found = [h for _, _, _, h in runs_of(own.flat, own.bounds, least)]
        hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        digit = _digit(hashes, groups)
        cuts = np.flatnonzero(np.diff(digit, prepend=-1))
        n = np.minimum(n, hot).astype("<u4")
        parts = [(int(digit[a]), hashes[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(hashes)))]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([p[0] for p in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["g", "block", "hashes", "n"])

    return run


def _twice(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Of each block's hashes, those that occur twice in all; those of ``hot`` runs or more stand twice in the list."""
        lists = [np.frombuffer(b, dtype=np.uint64) for b in table.column("hashes").to_pylist()]
        n = np.concatenate([np.frombuffer(b, dtype="<u4") for b in table.column("n").to_pylist()])
        values, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, weights=n)[at]
        out, lo = [], 0
        for own in lists:
            some = total[lo : lo + len(own)]
            out.append(np.concatenate([own[some > 1], own[some >= hot]]).tobytes())
            lo += len(own)
        keep = [i for i, o in enumerate(out) if o]
        return pa.table([table.column("block").take(pa.array(keep, pa.int64())), pa.array([out[i] for i in keep], pa.binary())], names=["block", "hashes"])

    return run


def _strings(least: int, groups: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs of repeated anchors as strings, the earliest of equal ones; and the spans of the others."""
        out = {c: [] for c in ("g", "doc", "start", "end", "at", "s")}
        names = ["g", "block", "doc", "start", "end", "id", "at", "s"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        own, block = _Block(left), left.column("block")[0].as_py()
        listed = np.sort(np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in right.column("hashes").to_pylist()]))
        codes: dict[bytes, int] = {}
        start, n, anchor, hashes, code = [], [], [], [], []
        for a, m, x, h in runs_of(own.flat, own.bounds, least):
            times = np.searchsorted(listed, h, side="right") - np.searchsorted(listed, h)
            some = np.flatnonzero(times)
            a, m, x, h, times = a[some], m[some], x[some], h[some], times[some]
            if (times > 1).any():  # a hot anchor: each window on its own
                each = np.where(times > 1, m, 1)
                within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                a, m, x, h = np.repeat(a, each) + within, np.where(np.repeat(times, each) > 1, 1, np.repeat(m, each)), np.repeat(x, each), np.repeat(h, each)
                single = np.repeat(times, each) > 1
            else:
                single = np.zeros(len(a), dtype=bool)
            got = [own.flat[i:j] for i, j in zip(a.tolist(), (a + m + least - 1).tolist())]
            code.append(np.array([codes.setdefault(s, len(codes)) for s in got], dtype=np.int64))
            for i in np.flatnonzero(single).tolist():  # equal windows meet, whatever else there is of the anchor
                h[i] = int.from_bytes(blake2b(got[i], digest_size=8).digest(), "little")
            start.append(a), n.append(m), anchor.append(x), hashes.append(h)
        if not start:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        start, n, anchor, hashes, code = map(np.concatenate, (start, n, anchor, hashes, code))
        doc = own.doc_of(start)
        at = start - own.bounds[doc]
        rank = _rank(own.ids[doc], at)
        least_rank = np.full(len(codes), len(rank) + 1)
        np.minimum.at(least_rank, code, rank)
        first = np.flatnonzero(rank == least_rank[code])
        later = np.flatnonzero(rank > least_rank[code])
        d, a, e = merged(doc[later], at[later], at[later] + n[later] + least - 1)
        strings = list(codes)
        g = np.concatenate([_digit(hashes[first], groups), np.full(len(d), groups + block)])
        columns = [
            pa.array(g),
            pa.array(np.full(len(g), block)),
            pa.array(np.concatenate([doc[first], d]).astype(np.int32)),
            pa.array(np.concatenate([at[first], a])),
            pa.array(np.concatenate([at[first] + n[first] + least - 1, e])),
            pa.array(np.concatenate([own.ids[doc[first]], np.zeros(len(d), np.int64)])),
            pa.array(np.concatenate([anchor[first] - start[first], np.zeros(len(d), np.int64)]).astype(np.int32)),
            pa.array([strings[c] for c in code[first].tolist()] + [None] * len(d), pa.binary()),
        ]
        return pa.table(columns, names=names)

    return run


def _passes(strings: list[bytes], at: np.ndarray, group: np.ndarray, depth: int, step: int) -> Iterator[np.ndarray]:
    """Groups of equal bytes, by the number of bytes from ``at`` on (step 1) or before it (step -1): 0, 1, ... ``depth``.

    A pass takes one byte; strings that end there, and those that are alone, have the group -1 and take part no more.
    """
    now = group.astype(np.int32)
    yield now
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    live = np.arange(len(strings))
    for i in range(1, depth + 1):
        place = at[live] + (-i if step < 0 else i - 1)
        there = (place >= 0) & (place < sizes[live])
        before, live, place = live, live[there], place[there]
        _, own, n = np.unique(now[live].astype(np.int64) * 256 + flat[begin[live] + place], return_inverse=True, return_counts=True)
        own = own.ravel()
        live, own = live[n[own] > 1], own[n[own] > 1]
        now = now.copy()
        now[before] = -1
        now[live] = own
        yield now


def _earliest(least: int):
    def run(table: pa.Table) -> pa.Table:
        """Strings of common leading bits -> the spans of windows that occur earlier; spans pass as they are."""
        if table.column("s").null_count:
            return table.select(["block", "doc", "start", "end"])
        k = gram_length(least)
        column = table.column("s").combine_chunks()
        coded = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        code, strings = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        block, doc, start, end, ids, at = (table.column(c).to_numpy() for c in ("block", "doc", "start", "end", "id", "at"))
        rank = _rank(ids, start + at)  # by the place of the anchor: windows of equal bytes lie alike around it
        best = np.full(len(strings), len(rank) + 1)
        np.minimum.at(best, code, rank)
        later = rank > best[code]
        spans = [(block[later], doc[later], start[later], end[later])]
        # Of each string its earliest entries go on, if others have the same anchor.
        where = np.zeros(len(strings), dtype=np.int64)
        where[code] = at
        grams = pa.array([s[a : a + k] for s, a in zip(strings, where.tolist())], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        shared = np.flatnonzero(np.bincount(grams)[grams] > 1) if len(grams) else grams
        if len(shared):
            some, place, group, top = [strings[i] for i in shared], where[shared], grams[shared], best[shared]
            right = list(_passes(some, place + k, group, least - k, 1))
            nearest, farthest = np.full(len(shared), least), np.full(len(shared), -1)  # removed windows by the bytes before the anchor
            for o, l in enumerate(_passes(some, place, group, least - k, -1)):
                r = right.pop()
                live = np.flatnonzero((l >= 0) & (r >= 0))
                if len(live) < 2:
                    continue
                _, own = np.unique(l[live].astype(np.int64) * (len(some) + 1) + r[live], return_inverse=True)
                own = own.ravel()
                low = np.full(own.max() + 1, top.max() + 1)
                np.minimum.at(low, own, top[live])
                gone = live[top[live] > low[own]]
                nearest[gone], farthest[gone] = np.minimum(nearest[gone], o), o
            # The windows of a string all hold its anchor, so they overlap: one span. Its earliest entries get it: one, but for repeated ids.
            member = np.full(len(strings), -1)
            member[shared[farthest >= 0]] = np.flatnonzero(farthest >= 0)
            pick = np.flatnonzero(~later & (member[code] >= 0))
            own = member[code[pick]]
            spans.append((block[pick], doc[pick], start[pick] + place[own] - farthest[own], start[pick] + place[own] - nearest[own] + least))
        return pa.table([pa.array(np.concatenate([s[i] for s in spans])) for i in range(4)], names=["block", "doc", "start", "end"])

    return run


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's rows with their removed spans and what stays."""
    names, span = ["doc_id", "n_bytes", "n_removed", "spans", "kept"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    if not len(left):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())], names=names)
    own = _Block(left)
    doc, start, end = merged(*(right.column(c).to_numpy() for c in ("doc", "start", "end"))) if len(right) else (np.zeros(0, np.int64),) * 3
    bounds = np.searchsorted(doc, np.arange(len(own.texts) + 1))
    kept = []
    for i, text in enumerate(own.texts):
        lo, hi = bounds[i], bounds[i + 1]
        edges = [0, *np.stack([start[lo:hi], end[lo:hi]], axis=1).ravel().tolist(), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
    at = np.array([i for _, i in own.rows])
    n = np.diff(bounds)[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    each = np.arange(ends[-1]) + np.repeat(bounds[at] - ends[:-1], n)
    spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(start[each], pa.int64()), pa.array(end[each], pa.int64())], names=["start", "end"]))
    sizes = np.array([len(t) for t in own.texts], dtype=np.int64)
    left_over = np.array([len(t) for t in kept], dtype=np.int64)
    return pa.table([pa.array([i for i, _ in own.rows], pa.int64()), pa.array(sizes[at]), pa.array((sizes - left_over)[at]), spans, pa.array([kept[i] for i in at], pa.binary())], names=names)


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 100, block_bytes: int = 4 << 20, hot: int = 1 << 17) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: the removed spans in UTF-8 bytes and the bytes that stay.

    A byte is removed if a string of ``least`` bytes that covers it also starts in a document of a smaller id or earlier in the
    same one. Strings never cross documents and are judged on the texts as they came. A null text is empty; texts of
    fewer than ``least`` bytes lose nothing; a null id counts as the smallest. Rows of one id are one document laid over itself: equal
    places in them are not earlier than each other, so repeated rows get equal results. Long texts are worked in pieces, to the end.
    Other columns are left out; an empty table gives an empty result.

    Blocks take about ``block_bytes`` of text (one row at least). Of an anchor no block shows more than one of equal
    strings; an anchor of ``hot`` runs or more is dealt out window by window, so no task holds all of its surroundings.
    """
    if least < 4:
        raise ValueError("strings must have four bytes at least")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    blocks = max(1, math.ceil(total / block_bytes))
    k = gram_length(least)
    expected = 2 * total / (least - k + 2)  # anchors
    few, many = max(1, math.ceil(expected / (1 << 19))), max(1, math.ceil(expected * 1.5 * least / (24 << 20)))
    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")
    texts = placed.groupBy("block")
    digits = texts.applyInArrow(_first_digit(least, few, hot), "g long, block long, hashes binary, n binary")
    repeated = digits.groupBy("g").applyInArrow(_twice(hot), _FOUND)
    entries = texts.cogroup(repeated.groupBy("block")).applyInArrow(_strings(least, many), _ENTRIES)
    spans = entries.groupBy("g").applyInArrow(_earliest(least), _SPANS)
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return texts.cogroup(spans.groupBy("block")).applyInArrow(_cut, out)
