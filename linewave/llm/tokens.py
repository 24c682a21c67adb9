"""Token counts by a map-side two-tier lookup of pre-token lengths (operator 1).

A pre-token is a maximal run of word boundary marks with the characters that follow it, cut at line
breaks: the vocabulary has no piece that crosses such a cut, so a text's token count is the sum of its
pre-tokens' counts. Tier one is a compact broadcast table of the corpus' most frequent pre-tokens; tier
two is a cache in each Python worker, filled by the tokenizer library on a miss. Pre-tokens are never
shuffled: each task hands over at most ``per_task`` counters for the frequency table.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from sys import getsizeof

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Bytes of a worker's cache for each of its two tables, and what an entry takes besides its text.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 130
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_models: dict[str, object] = {}
_caches: dict[tuple[str, str], dict] = {}


def load_piece_model(path: str):
    """The sentencepiece processor of ``path``, loaded once a worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


class PieceLengths(dict):
    """Pre-token -> number of pieces. Keys are what stands between single spaces of one line.

    A miss is encoded by the library and kept, at most ``bound`` entries and :data:`CACHE_BYTES` beside the frequent ones.
    """

    def __init__(self, path: str, frequent: dict[str, int], bound: int, leading: bool):
        super().__init__(frequent)
        self.model, self.frequent, self.bound, self.leading = load_piece_model(path), frequent, bound, leading
        self.held = 0

    def __missing__(self, word: str) -> int:
        # The library puts one mark before a text; a word that follows a space has exactly that mark.
        n = (len(self.model.encode(word)) if word else 1) if self.leading else count_unmarked(self.model, word)
        size = getsizeof(word) + ENTRY_BYTES
        if len(self) >= self.bound + len(self.frequent) or self.held + size > CACHE_BYTES:
            self.clear()
            self.update(self.frequent)
            self.held = 0
        if size <= CACHE_BYTES:
            self[word] = n
            self.held += size
        return n


def count_unmarked(model, segment: str) -> int:
    """Pieces of text that begins right after a line break, so without the mark before it.

    A line break is one byte piece; the mark that the library adds before it is one piece too.
    """
    return len(model.encode("\n" + segment)) - 2 if segment else 0


def count_pieces(text: str | None, after_space: PieceLengths, after_break: PieceLengths) -> int:
    """Pieces of a whole text, from its pre-tokens' lengths."""
    if not text:
        return 0
    total, first = 0, True
    for line in text.split("\n"):
        if "  " in line or MARK in line or line[:1] == " " or line[-1:] == " ":
            marked = line.replace(" ", MARK)
            for run in _RUN.findall(MARK + marked if first else marked):
                # A run that holds marks is given to the library without its first mark, which it adds.
                total += after_space[run[1:]] if run[0] == MARK else after_break[run]
        elif line:
            words = line.split(" ")
            if first:
                total += sum(map(after_space.__getitem__, words))
            else:
                total += after_break[words[0]] + sum(map(after_space.__getitem__, words[1:]))
        elif first:
            total += 1  # the mark alone, before a leading break
        total += 1  # the line break
        first = False
    return total - 1


def frequent_pretokens(df: DataFrame, text: str, size: int = 20_000, per_task: int = 4_000, live: int = 200_000) -> list[str]:
    """The ``size`` most frequent words between spaces over all rows, by per-task heavy hitters.

    Each task counts its own rows, pruning its counter to the larger half at ``live`` entries, and emits
    its ``per_task`` largest counts; only these bounded summaries are shuffled. The table decides what is
    looked up first, never a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t.split(" "))
                if len(seen) > live:
                    seen = Counter(dict(seen.most_common(live // 2)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    rows = (
        df.select(text)
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(size)
        .collect()
    )
    return [r.word for r in rows if "\n" not in r.word and MARK not in r.word]


def piece_counter(df: DataFrame, text: str, model_path: str, table_size: int = 20_000, cache_size: int = 400_000):
    """A function Column -> Column that counts the pieces of a text column of ``df``.

    ``model_path`` must be readable on every worker (an installed vocabulary file).
    """
    spark = df.sparkSession
    model = load_piece_model(model_path)
    words = frequent_pretokens(df, text, table_size)
    table = spark.sparkContext.broadcast({w: len(model.encode(w)) for w in words if w})

    stamp = uuid.uuid4().hex

    def lengths() -> tuple[PieceLengths, PieceLengths]:
        if (model_path, stamp) not in _caches:  # a worker serves many tasks of one query
            _caches.clear()
            _caches[model_path, stamp] = (PieceLengths(model_path, table.value, cache_size, True), PieceLengths(model_path, {}, cache_size // 4, False))
        return _caches[model_path, stamp]

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            spaced, broken = lengths()
            yield pd.Series([count_pieces(t, spaced, broken) for t in batch], dtype="int64")

    return pieces


def token_counts(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, table_size: int = 20_000, cache_size: int = 400_000) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay; a column of ``df`` that already
    has one of the three names is replaced. An empty table gives an empty table with these columns.
    """
    pieces = piece_counter(df, text, model_path, table_size, cache_size)
    col: Column = F.col(text)
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(col), F.lit(0)).cast("long"))
        .withColumn("n_tokens", pieces(col))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
