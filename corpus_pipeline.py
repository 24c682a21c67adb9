"""From raw documents to a token file: language, near duplicates, benchmark leaks, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last
return the columns of ``documents``; between stages the rows are written as Parquet and read again. What a stage and its
predecessor wrote to the shared folder is deleted as soon as the stage's rows are written.

Null, empty and letterless texts go in the first stage. Rows with a null doc_id are never near duplicates; rows that
repeat a kept doc_id all stay. A null source is a source of its own. Further columns of ``documents`` are kept up to the
last stage, which returns doc_id, start, n_tokens and ids_crc32. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linewave.storage import Scratch, written
from linewave.llm.decontam import decontaminated
from linewave.llm.language import fit_languages, in_known_language
from linewave.llm.mixing import mixed
from linewave.llm.neardup import one_of_each
from linewave.llm.tokenfile import stored_tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in one of the corpus' languages; the others go."""
    return in_known_language(docs, fit_languages(docs, public_tokenizers.path("piece_bpe_32k.model")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token file of all rows, and what is read back from it: doc_id, start, n_tokens, ids_crc32."""
    return stored_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Models, signatures and random offsets are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as inner:
            kept = stage(spark, docs, sf_dir)
        with Scratch(spark) as outer:
            docs = written(kept, name)
        inner.clear()
        if before:
            before.clear()
        before = outer
    return STAGES[-1][1](spark, docs, sf_dir)
