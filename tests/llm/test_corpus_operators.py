"""Operators over the whole corpus against brute force: duplicates, leaks, language, quality, mixing, pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linewave.llm import decontam, language, mixing, neardup, quality
from linewave.llm.common import held_out, shingle_sets, word_hashes
from linewave.operators.components import connected_components
from tests.llm.fixtures import WORDS, changed, documents, frame, plain, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else ({tuple(words)} if words else set())


def in_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


# --- near duplicates ------------------------------------------------------------------------------


def brute_groups(rows, k, percent=80):
    """doc_id -> smallest reachable id, over every pair."""
    sets = [(d, shingles(t, k)) for d, t, *_ in rows if d is not None]
    head = {d: d for d, _ in sets}

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return {d: root(d) for d in head}


def copies():
    """Chains of ever more changed copies, large groups, and texts that share most but not enough."""
    rows, rng = [], random.Random(9)
    for g in range(12):
        text = prose(1000 + g, rng.choice([6, 30, 90, 400]))
        for c in range(rng.choice([2, 5, 30])):
            rows.append((len(rows) + 1000, text, "en", "x"))
            words = text.split(" ")
            for _ in range(max(1, len(words) // rng.choice([12, 30, 60]))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            if c % 3:
                text = " ".join(words)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = documents() + copies()
    got = neardup.near_duplicates(frame(spark, rows, extra=True), k=k).collect()
    assert len(got) == len(rows)
    want, sizes = brute_groups(rows, k), defaultdict(set)
    for d, t, *_ in rows:
        sizes[d].add(len(shingles(t, k)))
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.n_shingles in sizes[r.doc_id]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_blocks_of_a_large_family_lose_no_link(spark):
    rows = copies()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), k=2, block_shingles=300, broadcast_members=0).collect()}
    assert got == brute_groups(rows, 2)


def test_one_of_each_keeps_all_columns_and_every_group(spark):
    df = frame(spark, documents() + copies(), extra=True)
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    heads = set(brute_groups(documents() + copies(), 5).values())
    assert {r.doc_id for r in kept.collect()} - {None} == heads
    assert kept.where("doc_id is null").count() == 2
    assert neardup.one_of_each(frame(spark, [])).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, None), (2, 1), (1, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_hashed_alike_in_pieces():
    data = (" ".join(prose(i, 50) for i in range(20)) + " " + "y" * 300 + " end").encode()
    whole, starts = word_hashes(data)
    for piece in (7, 64, 1000):
        hashes, at = word_hashes(data, piece)
        assert hashes.tolist() == whole.tolist() and at.tolist() == starts.tolist()
    flat, bounds = shingle_sets(["a b a b a", "", None, "A", "a"], 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1] and flat[2] == flat[3]


# --- benchmark leaks -----------------------------------------------------------------------------------


def leak_case():
    items = [(i, prose(500 + i, n)) for i, n in enumerate([5, 6, 9, 14, 20, 33, 36, 60, 150, 700])]
    items += [(50, None), (51, ""), (52, "two words"), (53, items[4][1]), (None, prose(900, 30))]
    rows = [(1, prose(1, 400) + " " + items[3][1] + "\n" + prose(2, 400), "en", "x"), (2, prose(3, 9000) + " " + " ".join(t for _, t in items[:10]) + " " + prose(4, 9000), "en", "x")]
    rows += [(10 + i, prose(20 + i, 50) + " " + changed(t, 40) + " " + prose(40 + i, 50), "en", "x") for i, (_, t) in enumerate(items[:10])]
    words = items[7][1].split(" ")
    rows += [(60, " ".join(words[:30]) + " " + prose(7, 3000) + " " + " ".join(words[25:]), "en", "x"), (61, " ".join(words[:40]), "en", "x"), (62, "two words", "en", "x"), (63, "see two words here", "en", "x")]
    return items, rows + [(80 + i, r[1], r[2], r[3]) for i, r in enumerate(documents())] + [(None, items[5][1], "en", "x"), (1, items[5][1], "en", "x")]


def brute_leaks(items, rows):
    out = []
    for d, t, *_ in rows:
        own = shingles(t, 5)
        for i, b in items:
            item = shingles(b, 5)
            if item and 100 * len(item & own) >= 80 * len(item):
                out.append((d, i, len(item), len(item & own)))
    return out


@pytest.mark.parametrize("block", [10_000, 4])
def test_leaks_equal_all_containments(spark, block):
    items, rows = leak_case()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.leaks(frame(spark, rows, extra=True), bench, block_items=block)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    want = sorted(brute_leaks(items, rows), key=key)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()), key=key) == want and want
    clean = decontam.decontaminated(frame(spark, rows, extra=True), bench, block_items=block)
    held = {(d, t) for d, t, *_ in rows if not brute_leaks(items, [(d, t)])}
    assert clean.columns == frame(spark, rows, extra=True).columns
    assert {(r.doc_id, r.text) for r in clean.collect()} == held


def test_leaks_of_nothing(spark):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark), bench.limit(0)).count() == 0
    assert decontam.decontaminated(frame(spark), bench.limit(0)).count() == len(documents())


# --- language ----------------------------------------------------------------------------------------------


def brute_chance(word, chance):
    """Sum over all segmentations, by recursion on the first piece."""
    if not word:
        return 1.0
    return sum(chance.get(word[:n], 1e-7 if n == 1 else 0.0) * brute_chance(word[n:], chance) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations_and_expectations_are_their_derivative():
    pieces = language._pieces(PIECES)
    rng = np.random.RandomState(0)
    chance = rng.rand(pieces.size + 2, 2)
    chance[-2], chance[-1] = 0, 1e-7
    words = ["▁the", "▁straße", "▁a", "▁日本", "▁ñandú", "▁international"]
    got = pieces.forward(words, chance)
    for k in range(2):
        table = {p: chance[i, k] for i, p in enumerate(pieces.names)}
        assert np.allclose(got[:, k], [math.log(brute_chance(w, table)) for w in words])
    # d log P / d log p(piece) is the piece's expected count.
    counts = pieces.expected(words, np.ones(len(words)), np.zeros(len(words), dtype=np.int64), chance)
    for piece in ("▁the", "in", "t"):
        i = pieces.names.index(piece)
        more = chance.copy()
        more[i] *= 1 + 1e-6
        slope = (pieces.forward(words, more)[:, 0].sum() - got[:, 0].sum()) / 1e-6
        assert abs(slope - counts[i, 0]) < 1e-4
    lengths = sum(n * counts[:-2][[len(p) == n for p in pieces.names], 0].sum() for n in range(1, 17)) + counts[-1, 0]
    assert abs(lengths - sum(map(len, words))) < 1e-6


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit_languages(docs, PIECES)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: in_fold(r.doc_id) for r in got}
    own = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(own) >= 0.97 * len(own) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    model = language.fit_languages(frame(spark, extra=True), PIECES)
    got = {}
    for r in language.identify(frame(spark, extra=True), model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(got[d] == [("und", 0.0)] for d in (6, 7, 8)) and len(got[2]) == 2 and got[2][0] == got[2][1] == got[1][0]
    assert ("und", 0.0) in got[None]
    kept = language.in_known_language(frame(spark, extra=True), model)
    assert kept.columns == frame(spark, extra=True).columns
    assert not {6, 7, 8} & {r.doc_id for r in kept.collect()}
    none = language.fit_languages(frame(spark, []), PIECES)
    assert {r.lang_pred for r in language.identify(frame(spark), none).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


# --- quality -----------------------------------------------------------------------------------------------------


def brute_statistics(text):
    data, words = text.encode(), WORD.findall(text)
    pairs, triples = list(zip(words, words[1:])), list(zip(words, words[1:], words[2:]))
    return {
        "distinct_words": len(set(words)) / max(1, len(words)),
        "repeated_words": sum(a == b for a, b in pairs) / max(1, len(words)),
        "distinct_triples": len(set(triples)) / max(1, len(words) - 2),
        "most_common_pair": max(Counter(pairs).values(), default=0) / max(1, len(words)),
        "capital_words": sum(w[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for w in words) / max(1, len(words)),
        "line_breaks": data.count(b"\n") / max(1, len(data)),
        "bars": data.count(b"|") / max(1, len(data)),
        "words": math.log1p(len(words)),
        "bytes": math.log1p(len(data)),
    }


def test_statistics_equal_brute_force():
    texts = ["", None, "a", "Ab ab | x\n\nAb ab | ###", prose(1, 200), "w w w w w", "é É 日本 " * 5, "\n \n"]
    got = quality.statistics(texts)
    for t, row in zip(texts, got):
        own = brute_statistics(t or "")
        assert all(abs(row[quality.NAMES.index(k)] - v) < 1e-12 for k, v in own.items()), t
    assert not got[0].any() and not got[1].any() and np.isfinite(got).all()


def test_trees_walk_as_their_nodes_say_and_learn():
    rng = np.random.RandomState(1)
    x = rng.rand(3000, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit_trees(x[:2000], y[:2000], trees=30, depth=3)
    got = trees.score(x[2000:])
    assert ((got > 0.5) == y[2000:]).mean() > 0.97
    for row, s in zip(x[2000:2050], got):
        raw = trees.start
        for f, b, leaf in zip(trees.feature, trees.bound, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > b[node])
            raw += leaf[node - len(f)]
        assert abs(s - 1 / (1 + math.exp(-raw))) < 1e-12
    assert quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit_trees(x[:50], np.ones(50)).score(x[:2]) > 0.9).all()


def test_quality_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = quality.quality(docs, model).join(labels, "doc_id").collect()
    own = [r.predicted == r.quality for r in got if r.held_out]
    assert len(own) > 50 and sum(own) >= 0.95 * len(own)
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(d, i % 2) for i, d in enumerate([1, 2, 4, 5, 9, 14, 14])] + [(None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit_quality(frame(spark, extra=True), labels)
    got = quality.quality(frame(spark, extra=True), model).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(frame(spark, []), quality.fit_quality(frame(spark), labels.limit(0))).count() == 0


def test_fold_of_ids(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == in_fold(r.id) for r in got)


# --- mixing -------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    aim, left, opened = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and opened:
        total = sum(weight[s] for s in opened)
        for s in opened:
            aim[s] += left * weight[s] / total
        left = sum(max(0, aim[s] - 2 * sizes[s]) for s in names)
        for s in names:
            if aim[s] >= 2 * sizes[s]:
                aim[s] = float(2 * sizes[s])
                opened.discard(s)
    return aim


def test_targets_equal_step_by_step_sharing():
    rng = random.Random(5)
    for _ in range(200):
        sizes = {rng.choice([None, *"abcdefghij"]): rng.choice([0, 1, 5, 100, 10_000]) for _ in range(rng.randrange(1, 8))}
        got, want = mixing.targets(sizes), brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


@pytest.mark.parametrize("slot_rows", [50_000, 3])
def test_mix_is_a_systematic_sample(spark, slot_rows):
    rows = documents() + [(2000 + i, prose(i, 5 + i % 40), "en", "hot") for i in range(300)]
    got = mixing.mix_counts(frame(spark, rows, extra=True), slot_rows=slot_rows).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sums = Counter()
    for _, t, _, s in rows:
        sums[s] += size(t)
    aim = mixing.targets({s: sums[s] for _, _, _, s in rows})
    groups = defaultdict(list)
    for r in got:
        assert r.source_size == sums[r.source] and r.target == aim[r.source]
        expected = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(expected), math.ceil(expected)) and r.taken == r.copies * r.size <= 2 * r.size
        groups[r.source].append(r)
    for s, own in groups.items():
        if sums[s]:
            assert abs(sum(r.copies for r in own) - aim[s] / sums[s] * len(own)) < 1
            assert abs(sum(r.taken for r in own) - aim[s]) <= max(r.size for r in own)
    again = mixing.mix_counts(frame(spark, rows).repartition(7), slot_rows=slot_rows)
    assert plain(again) == sorted((tuple(r) for r in got), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def test_mixed_rows_are_repeated_as_counted(spark):
    df = frame(spark, extra=True)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want, got = Counter(), Counter(r.doc_id for r in out.collect())
    for r in mixing.mix_counts(df).collect():
        want[r.doc_id] += r.copies
    assert +want == got
    assert mixing.mixed(frame(spark, [])).count() == 0 and mixing.mix_counts(frame(spark, [])).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------------


def test_stages_of_the_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    before, after = map(texts, seen["language"])
    assert after <= before and not [t for _, t in before - after if re.search(r"[^\W\d_]{3}", t or "")]
    before, after = map(texts, seen["near_duplicates"])
    assert {d for d, _ in after} == set(brute_groups(sorted(before), 5).values())
    before, after = map(texts, seen["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert after == {(d, t) for d, t in before if not brute_leaks(items, [(d, t)])}
    before, after = seen["mixing"]
    want = Counter({r.doc_id: r.copies for r in mixing.mix_counts(before).collect()})
    assert Counter(r.doc_id for r in after.collect()) == +want
    before, after = seen["tokens"]
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect())
    assert plain(corpus_pipeline.run(spark, sf_dir)) == plain(after)


def test_registered_queries(spark, sf_dir):
    from linewave.llm.queries import QUERIES, SQL

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    assert WORDS
