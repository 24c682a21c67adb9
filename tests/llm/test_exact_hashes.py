"""Unlike words have unlike hashes, and every word counts for its language."""

from pyspark.sql import functions as F

from linewave.llm.common import hash_of_word, shingle_sets, word_hashes
from linewave.llm.decontam import leaks
from linewave.llm.neardup import near_duplicates


def opposite_words():
    """The Thue-Morse word of 2,048 letters and its complement: alike under every polynomial modulo 2**64 of an odd base."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_opposite_words_are_told_apart(spark):
    one, other = opposite_words()
    flat, _ = shingle_sets([one, other], 2)
    assert flat[0] != flat[1]
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} end"), (4, f"{other} end"), (5, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, k=2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert sorted(r.doc_id for r in leaks(docs, items).collect()) == [1, 5]


def test_word_hashes_are_those_of_the_words():
    data = "  One twö one\tthree \n x".encode()
    hashes, starts = word_hashes(data)
    assert [data[s:].split()[0] for s in starts.tolist()] == data.split()
    assert hashes.tolist() == [hash_of_word(w) for w in data.split()]
    assert word_hashes(b"")[0].tolist() == word_hashes(b" \n ")[0].tolist() == []


def test_words_left_out_of_the_rounds_are_learnt_in_the_end(spark):
    import public_tokenizers

    from linewave.llm.language import fit_languages

    left_out = [w for w, in spark.createDataFrame([(w,) for w in "and der de des les una pour mit haus casa maison house road tree lake wood".split()], "w string").where(F.pmod(F.xxhash64(F.concat(F.lit("▁"), "w")), F.lit(10)) == 0).collect()]
    assert left_out
    word = left_out[0]
    rows = [(i, f"{word} " * 20 + "alpha", "aa") for i in range(40)] + [(100 + i, "omega " * 21, "bb") for i in range(40)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    assert model.predict([word]) [0] == ["aa"]
    assert model.predict([word])[1][0] > 0.99
