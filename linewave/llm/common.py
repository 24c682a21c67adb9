"""Helpers shared by the operators: held-out ids, samples, batch slices, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and the bytes 9 to 13.
SPACES = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id counts as the text 'null'."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def hash_sample(df: DataFrame, doc_id: str, about: int) -> DataFrame:
    """About ``about`` rows of ``df`` (all, if it has no more), chosen by a hash of the id: reruns agree."""
    n = df.count()
    if n <= about:
        return df
    bound = -(-about * (1 << 31) // n)
    return df.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 31)) < bound)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(lengths):
            continue
        part = np.cumsum(lengths, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


# --- hashes of words and shingles -------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``data``.

    Words of up to 8 bytes are one number and its mixture, so unlike ones of a length never collide; a second number is mixed in
    for words of up to 16. Longer ones, few in number, are hashed by BLAKE2: no algebra makes two of them alike.
    """
    size = ends - starts
    eights = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))
    kept = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    first = eights[starts] & kept[np.minimum(size, 8)]
    out = mix64(first + np.uint64(0xA0761D6478BD642F))
    more = np.flatnonzero(size > 8)
    second = eights[starts[more] + 8] & kept[np.minimum(size[more], 16) - 8]
    out[more] = mix64(out[more] * np.uint64(0xE7037ED1A0B428DB) ^ (second + np.uint64(0x8EBC6AF09C88C6E3)))
    out = mix64(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def hash_of_word(word: bytes) -> int:
    """The hash that :func:`word_hashes` gives this word."""
    return int(_hash_words(word, np.array([0]), np.array([len(word)]))[0])


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    return _hash_words(data, starts, ends), starts


def word_hashes(data: bytes, piece: int = 1 << 20, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start offset of every word of ``data``, with A-Z lower-cased if asked for, worked in pieces that end at white space."""
    if len(data) <= piece:
        return _hash_piece(data.lower() if lower else data)
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + piece, len(data))
        if hi < len(data):
            cut = max(data.rfind(bytes([c]), lo, hi) for c in SPACES)
            if cut <= lo:  # one word longer than a piece
                later = [x for c in SPACES if (x := data.find(bytes([c]), hi)) >= 0]
                cut = min(later, default=len(data) - 1)
            hi = cut + 1
        h, s = _hash_piece(data[lo:hi].lower() if lower else data[lo:hi])
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    every = np.concatenate(hashes)
    hashes.clear()
    return every, np.concatenate(starts)


def _combine(parts: list[np.ndarray], n: int) -> np.ndarray:
    acc = np.full(len(parts[0]), n * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    for p in parts:
        acc = mix64(acc * np.uint64(0xFF51AFD7ED558CCD) + p)
    return acc


def shingle_sequences(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text in order, and the bounds of each text in that array.

    Words are runs of anything but white space, with A-Z lower-cased. A text of fewer than ``k`` words
    has its whole word sequence as one shingle; a text without words (or null) has none.
    """
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    first = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in data], out=first[1:])
    data = data[0] if len(data) == 1 else b"\n".join(data)
    words, starts = word_hashes(data, lower=True)
    del data
    bound = np.searchsorted(starts, first)
    del starts
    n_words = np.diff(bound)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    out = np.empty(bounds[-1], dtype=np.uint64)
    if len(words) >= k:
        every = np.empty(len(words) - k + 1, dtype=np.uint64)
        for lo in range(0, len(every), 1 << 18):  # in parts, for the sake of what lies between the steps
            hi = min(lo + (1 << 18), len(every))
            every[lo:hi] = _combine([words[lo + j : hi + j] for j in range(k)], k)
        for i in np.flatnonzero(n_words >= k):
            out[bounds[i] : bounds[i + 1]] = every[bound[i] : bound[i] + counts[i]]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        own = words[bound[i] : bound[i + 1]]
        out[bounds[i]] = _combine([own[j : j + 1] for j in range(len(own))], len(own))[0]
    return out, bounds


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_sequences`, but each text's hashes sorted and distinct."""
    flat, bounds = shingle_sequences(texts, k)
    sets = []
    for lo, hi in zip(bounds, bounds[1:]):
        own = np.sort(flat[lo:hi])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    sizes = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=sizes[1:])
    return (np.concatenate(sets) if sets else flat), sizes
