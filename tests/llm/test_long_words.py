"""Language models on words of any length, against a plain recursion in logarithms."""

import random

import numpy as np
import public_tokenizers
import pytest

from linewave.llm import language
from tests.llm.fixtures import documents, frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_log(word, chance):
    """log of the sum over all segmentations, by positions."""
    best = [0.0]
    for end in range(1, len(word) + 1):
        terms = [best[end - n] + np.log(p) for n in range(1, min(end, 16) + 1) if (p := chance.get(word[end - n : end], 1e-7 if n == 1 else 0.0)) > 0]
        best.append(np.logaddexp.reduce(terms))
    return best[-1]


@pytest.fixture(scope="module")
def model():
    pieces = language._pieces(PIECES)
    rng = np.random.RandomState(0)
    chance = rng.rand(pieces.size + 2, 2) ** 8 / 1000
    chance[-2], chance[-1] = 0, 1e-7
    return pieces, chance, [{p: chance[i, k] for i, p in enumerate(pieces.names)} for k in range(2)]


def words():
    rng = random.Random(3)
    letters = "etaoinshrdluñßéж日本語"
    return ["▁" + "".join(rng.choice(letters) for _ in range(n)) for n in (1, 23, 24, 31, 40, 40, 41, 64, 300, 2500)] + ["▁" + "international" * 9]


@pytest.mark.parametrize("stretch", [1 << 14, 64])
def test_words_of_any_length_are_summed_over_all_segmentations(model, stretch, monkeypatch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    pieces, chance, tables = model
    got = pieces.forward(words(), chance)
    for k in range(2):
        assert np.allclose(got[:, k], [plain_log(w, tables[k]) for w in words()], rtol=1e-9)


@pytest.mark.parametrize("stretch", [1 << 14, 64])
def test_expected_counts_of_long_words_are_derivatives(model, stretch, monkeypatch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    pieces, chance, _ = model
    own = words()
    which = np.arange(len(own)) % 2
    log, counts = pieces.expectations(own, np.ones(len(own)), which, chance)
    assert np.allclose(log, pieces.forward(own, chance)[np.arange(len(own)), which], rtol=1e-9)
    sizes = np.array([*map(len, pieces.names), 0, 1])
    for k in range(2):
        assert abs(sizes @ counts[:, k] - sum(len(w) for w, j in zip(own, which) if j == k)) < 1e-6
    for piece in ("t", "in", "inter", "er"):
        i = pieces.names.index(piece)
        more = chance.copy()
        more[i, 0] *= 1 + 1e-6
        slope = (pieces.forward(own[::2], more)[:, 0].sum() - pieces.forward(own[::2], chance)[:, 0].sum()) / 1e-6
        assert abs(slope - counts[i, 0]) < 1e-3 * max(1, counts[i, 0])


def test_a_long_word_is_not_the_product_of_its_parts(model):
    pieces, chance, _ = model
    word = "▁" + "international" * 5
    assert abs(pieces.forward([word], chance)[0, 0] - pieces.forward([word[:31], word[31:]], chance)[:, 0].sum()) > 1


def test_cache_is_bounded_by_bytes_and_changes_nothing(model):
    _, chance, _ = model
    texts = [" ".join(words()[:8]), "x" * 5000 + " the", None, "of the " * 50] * 3
    whole = language.Scorer(PIECES, chance, 1 << 26).score(texts)
    small = language.Scorer(PIECES, chance, 2000)
    assert all(np.allclose(small.score([t])[0], w) for t, w in zip(texts, whole)) and len(small.rows) < 20


def test_number_signs_are_no_letters(spark):
    found = language.fit_languages(frame(spark), PIECES)
    rows = [(i, t, None, None) for i, t in enumerate(["½", "²", "Ⅷ", "①", "٣", "_", "à", "語"])]
    got = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows), found).collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 6 + [False] * 2


def test_rounds_end_when_words_left_out_are_no_likelier(spark):
    one = language.fit_languages(frame(spark), PIECES, most_rounds=1)
    some = language.fit_languages(frame(spark), PIECES, most_rounds=4)
    many = language.fit_languages(frame(spark), PIECES, most_rounds=50)
    assert not np.allclose(one.chance, some.chance) and many.languages == ["de", "en", "fr"]
    assert many.chance.shape == one.chance.shape and len(documents()) > 0


def test_texts_of_other_languages_and_junk_go_and_short_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for left_out in ("es", "fr"):
        found = language.fit_languages(docs.where(f"lang <> '{left_out}'"), PIECES)
        kept = {r.doc_id for r in language.in_known_language(docs, found).select("doc_id").collect()}
        rows = docs.where("text rlike '[a-z]'").select("doc_id", "lang").collect()
        own = [r.doc_id in kept for r in rows if r.lang != left_out and (left_out, r.lang) != ("fr", "es")]
        other = [r.doc_id in kept for r in rows if r.lang == left_out]
        assert sum(own) == len(own) > 100 and sum(other) < 0.03 * len(other)
    found = language.fit_languages(docs, PIECES)
    texts = ["xqzjk wvkqx zzqjx kkwqz", "the", "de", "an", "Pachque çaneux et.", None, "", "½ 12"]
    kept = language.in_known_language(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)], extra=True), found)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
