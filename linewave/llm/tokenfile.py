"""Token ids in a binary format with a shared compression dictionary (operator 10).

Layout, below one folder:

* ``dictionary``: one row (dictionary, sha256, id_bytes, vocabulary): the zstandard dictionary trained on
  serialized id arrays of a bounded sample of documents.
* ``packs``: rows of at most about ``pack_bytes`` of compressed documents in ascending doc_id order. A pack
  has its shard, its place in it, the ids before it in the shard, the dictionary's sha256, and arrays
  doc_ids, offsets and counts: the offset index. ``blob`` holds one zstandard frame a document, so one short
  document is read by slicing and decompressing its own frame.

Ids are serialized little-endian in 2 bytes where the vocabulary fits, else in 4.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewave.llm.common import hash_sample, slices
from linewave.storage import scratch_path

#: Where one of these stands, or a space ends the text, white space may join into one pre-token: such texts go to the library whole.
_WIDE = tuple(" " + chr(c) for c in range(0x3001) if chr(c).isspace())
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PACKS = "shard int, place long, before long, sha256 string, n_docs long, n_ids long, doc_ids array<long>, offsets array<long>, counts array<long>, blob binary"
_encoders: dict[tuple, "TextEncoder"] = {}


#: Bytes of a worker's cache of parts, and what an entry takes besides its text and ids.
CACHE_BYTES, ENTRY_BYTES = 160 << 20, 180


class _Parts(dict):
    """What stands after a single space -> its id bytes, worked out when first asked for."""

    def __init__(self, encoder: "TextEncoder"):
        super().__init__()
        self.encoder, self.tails, self.held = encoder, {"": b""}, 0

    def __missing__(self, part: str) -> bytes:
        stem = part.rstrip(_MARKS)
        if not (self.encoder.direct and stem.isalpha()):
            ids = self.encoder.library([" " + part])[0]
        elif len(stem) == len(part):
            ids = self.encoder.word(part)
        else:
            tail = part[len(stem) :]
            if tail not in self.tails:
                self.tails[tail] = self.encoder.library([tail])[0]
                self.held += len(tail) + len(self.tails[tail]) + ENTRY_BYTES
            ids = self[stem] + self.tails[tail]
        self[part] = ids
        self.held += 2 * len(part) + len(ids) + ENTRY_BYTES
        return ids


class TextEncoder:
    """Whole texts -> id bytes. What stands between single spaces is encoded by the library once and kept.

    Byte-level pre-tokens never reach over a space that stands between other characters than white space,
    so a text's ids are those of its parts; nor do letters join with the signs after them, so a part's ids
    are those of its stem and its tail. A stem of letters is one pre-token and goes straight to the
    library's model. Texts with wider white space or with a special token's string are encoded as they are.
    """

    def __init__(self, path: str, id_bytes: int, bound: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.bound = Tokenizer.from_file(path), f"<u{id_bytes}", bound
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = [i.to_bytes(id_bytes, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        # The byte alphabet of the model's vocabulary: printable bytes stand for themselves, the others follow 255.
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model = self.tokenizer.model
        probe = ["the", "naïve", "Straße", "éèquech"]
        # Whether the model alone is enough for a word: nothing but a byte-level step stands before it.
        self.direct = self.tokenizer.normalizer is None and [self.word(w) for w in probe] == self.library([" " + w for w in probe])
        self.parts = _Parts(self)

    def word(self, letters: str) -> bytes:
        """Ids of letters that follow a space."""
        text = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(self.alphabet[32] + text)])

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not (t[-1:] == " " or any(s in t for s in _WIDE) or any(s in t for s in self.special)) for t in texts]
        if len(self.parts) + len(self.parts.tails) > self.bound or self.parts.held > CACHE_BYTES:
            self.parts = _Parts(self)
        split = [t.split(" ") if p and t else None for t, p in zip(texts, plain)]
        heads = iter(self.library([s.pop(0) for s in split if s]))
        wholes = iter(self.library([t for t, p in zip(texts, plain) if not p]))
        look = self.parts.__getitem__
        return [next(wholes) if not p else (b"" if s is None else next(heads) + b"".join(map(look, s))) for s, p in zip(split, plain)]


def _encoder(path: str, id_bytes: int, bound: int) -> TextEncoder:
    key = (path, id_bytes, bound)
    if key not in _encoders:  # a worker serves many tasks
        _encoders.clear()
        _encoders[key] = TextEncoder(*key)
    return _encoders[key]


def vocabulary_size(tokenizer: str) -> int:
    """Ids of a tokenizer file, special ones included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def trained_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary for ``samples``; empty where they are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int):
    import zstandard

    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=kept, write_checksum=True, write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_token_file(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    level: int = 3,
    sample_docs: int = 1_000,
    sample_bytes: int = 32 << 10,
    cache_size: int = 800_000,
    pack_bytes: int = 2 << 20,
) -> None:
    """Encode every text of ``df`` and write the token file to ``path``.

    ``end_id`` follows each document. Null texts count as empty: their only id is ``end_id``. Documents
    stand in ascending doc_id order, null ids first; rows that repeat an id (or have none) all stay, ordered by their
    text, in one shard. An empty table gives files without packs. The dictionary serves short documents: it is
    trained on the texts of up to ``sample_bytes`` among about ``sample_docs`` documents, chosen by id hash. ``tokenizer`` must be readable on every worker.
    """
    spark = df.sparkSession
    id_bytes = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    end = int(end_id).to_bytes(id_bytes, "little")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    sample = hash_sample(docs, "doc_id", sample_docs).where(F.octet_length("text") <= sample_bytes)
    dictionary = trained_dictionary([b + end for b in _encoder(tokenizer, id_bytes, cache_size).encode([r.text for r in sample.collect()])])
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dictionary, sha, id_bytes, os.path.basename(tokenizer))], "dictionary binary, sha256 string, id_bytes int, vocabulary string").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, press = _encoder(tokenizer, id_bytes, cache_size), _compressor(dictionary, level)
        shard, place, before, n_ids = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, offsets, counts, frames = [], [0], [], []

        def done() -> pa.RecordBatch:
            row = [shard, place, before, sha, len(doc_ids), n_ids, doc_ids, offsets, counts, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=_NAMES)

        for batch in slices(batches, "text"):
            for d, raw in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("text").to_pylist())):
                frame = press.compress(raw + end)
                if doc_ids and offsets[-1] + len(frame) > pack_bytes:
                    yield done()
                    place, before, n_ids = place + 1, before + n_ids, 0
                    doc_ids, offsets, counts, frames = [], [0], [], []
                doc_ids.append(d)
                counts.append(len(raw) // id_bytes + 1)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                n_ids += counts[-1]
        if doc_ids:
            yield done()

    # Equal ids share a shard. Texts are dealt out, not ids: nothing is encoded twice, nor kept twice.
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, _PACKS).write.option("compression", "none").parquet(f"{path}/packs")


_NAMES = [f.split()[0] for f in _PACKS.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[f.split()[1]] for f in _PACKS.split(", ")]


def _dictionary(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have its own hash")
    return row


def _frames(blob: bytes, offsets: list[int], tool) -> Iterator[bytes]:
    for lo, hi in zip(offsets, offsets[1:]):
        yield tool.decompress(blob[lo:hi])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file, from its bytes.

    ``start`` is the number of ids of all documents before it. A pack that names another dictionary, and a
    frame that breaks its checksum or its count, raise an error.
    """
    head = _dictionary(spark, path)
    packs = spark.read.schema(_PACKS).parquet(f"{path}/packs")
    # One row a shard: their number is that of the shuffle's partitions, whatever the input.
    totals = sorted((r.shard, r.n) for r in packs.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    first, at = {}, 0
    for shard, n in totals:
        first[shard], at = at, at + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _decompressor(head.dictionary)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("shard", "before", "sha256", "doc_ids", "offsets", "counts", "blob")}
                if r["sha256"] != head.sha256:
                    raise ValueError(f"a pack of shard {r['shard']} was written with another dictionary")
                crcs, start, starts = [], first[r["shard"]] + r["before"], []
                for n, raw in zip(r["counts"], _frames(r["blob"], r["offsets"], tool)):
                    if len(raw) != n * head.id_bytes:
                        raise ValueError(f"a document of shard {r['shard']} does not have {n} ids")
                    crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{head.id_bytes}").astype("<u4").tobytes()))
                    starts.append(start)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return packs.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document (the first of that doc_id), by the offset index; None if it is not there."""
    head = _dictionary(spark, path)
    packs = spark.read.schema(_PACKS).parquet(f"{path}/packs").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    lo, hi = F.element_at("offsets", at), F.element_at("offsets", at + 1)
    row = packs.orderBy("shard", "place").select(F.substring("blob", lo.cast("int") + 1, (hi - lo).cast("int")).alias("frame")).first()
    return None if row is None else np.frombuffer(_decompressor(head.dictionary).decompress(row.frame), f"<u{head.id_bytes}").tolist()


def stored_tokens(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df`` as a token file in the shared folder and read its documents back."""
    path = scratch_path(df.sparkSession, "tokens")
    write_token_file(df, path, tokenizer, end_id, doc_id, text)
    return read_token_file(df.sparkSession, path)
