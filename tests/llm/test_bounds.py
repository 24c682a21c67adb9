"""Damage in sound pages, caches bounded by bytes, slots, repeated labels."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linewave.llm import media, mixing, quality, tokenfile, tokens
from tests.llm.fixtures import documents, frame, plain, prose


def stream(audio, text=((b"text    ", 0), (b"n_bytes=0", 0))):
    return b"".join([*media._paged(list(audio), 1), *media._paged(list(text), 2)])


HEAD = (media._PCM.pack(b"PCM     ", 1, 1, media.RATE, 8, 1, 0), 0)


@pytest.mark.parametrize(
    "bad",
    [
        stream([HEAD]),  # no samples
        stream([(b"PCM     ", 0), (b"x" * 64, 64)]),  # a short header
        stream([(media._PCM.pack(b"PCM     ", 1, 1, 0, 8, 1, 0), 0), (b"x" * 64, 64)]),  # no rate
        stream([HEAD, (b"x" * 64, 64)], [(b"text    ", 0)]),  # no comment
        stream([HEAD, (b"x" * 64, 64)], [(b"text    ", 0), (b"n_bytes=x", 0)]),
        stream([HEAD, (b"x" * 64, 64)], [(b"text    ", 0), (b"n_bytes=65", 0)]),
        stream([HEAD, (b"x" * 64, 64)], [(b"text    ", 0), (b"\xff", 0)]),
        stream([HEAD, (b"x" * 64, 63)]),
        stream([HEAD, (b"", 0)]),
    ],
)
def test_sound_pages_of_other_streams_are_damage_too(bad):
    with pytest.raises(media.OggError):
        media.read_ogg(bad)
    assert media.read_ogg(stream([HEAD, (b"x" * 64, 64)]))[:2] == (b"x" * 64, 0)


def long_texts():
    rng = random.Random(4)
    blob = lambda n: "".join(rng.choice("abcdefgh0123+/") for _ in range(n))
    return [blob(5000), " ".join(blob(300) for _ in range(40)), prose(3, 400), "a\n" + blob(700) + " b", None, ""]


def test_token_caches_are_bounded_by_bytes_and_change_nothing(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = tokens.load_piece_model(path)
    want = [len(model.encode(t or "")) for t in long_texts()]
    for most in (1, 3000, 1 << 26):
        monkeypatch.setattr(tokens, "CACHE_BYTES", most)
        spaced, broken = tokens.PieceLengths(path, {"the": 1}, 400, True), tokens.PieceLengths(path, {}, 100, False)
        assert [tokens.count_pieces(t, spaced, broken) for t in long_texts() * 2] == want * 2
        assert spaced.held <= most and broken.held <= most


def test_id_caches_are_bounded_by_bytes_and_change_nothing(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for t in long_texts()]
    whole = tokenfile.TextEncoder(path, 2, 800_000)
    want = whole.library(texts)
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 500)
    small = tokenfile.TextEncoder(path, 2, 800_000)
    assert whole.encode(texts) == want and [small.encode([t])[0] for t in texts * 2] == want * 2
    assert small.parts.held < whole.parts.held


def test_slots_of_a_mix_change_nothing_and_ids_may_be_missing(spark):
    rows = documents() + [(None, prose(i, 12), None, "s1") for i in range(30)] + [(5, prose(i, 12), None, "s1") for i in range(30)]
    few, many = (mixing.mix_counts(frame(spark, rows, extra=True), slot_rows=n) for n in (50_000, 2))
    assert plain(few) == plain(many) and few.count() == len(rows)


def test_repeated_labels_beyond_the_bound_are_chosen_alike(spark):
    rows = [(i, prose(i, 10 + i % 7), None, None) for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)] * 4
    fits = [quality.fit_quality(frame(spark, rows), spark.createDataFrame(labels[::step], "doc_id long, quality int, toxic int").repartition(3), most=40, trees=5) for step in (1, -1)]
    texts = [r[1] for r in rows]
    assert (fits[0].score(quality.statistics(texts)) == fits[1].score(quality.statistics(texts))).all()


def test_outputs_named_like_extra_columns(spark):
    docs = frame(spark, extra=True)
    assert {"n_tokens", "lang_pred", "score", "spans", "start"} <= set(docs.columns)
    counted = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(counted.columns) == sorted({*docs.columns, "n_bytes", "n_tokens", "over_limit"})
    assert counted.where(F.col("n_tokens").isNull()).count() == 0
