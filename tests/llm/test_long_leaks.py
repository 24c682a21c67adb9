"""Leaks in very long texts: stretches change nothing but the memory."""

import tracemalloc

import numpy as np
import pytest

from linewave.llm import decontam
from linewave.llm.common import shingle_sequences
from tests.llm.fixtures import prose


def items():
    """(id, text) of all sizes, some larger than a stretch."""
    return [(i, prose(700 + i, n)) for i, n in enumerate([2, 5, 9, 30, 90, 300, 900, 2500])]


def texts():
    own = [t for _, t in items()]
    return [prose(1, 3000) + " " + own[6] + " " + prose(2, 500), " ".join([prose(3, 700), *own[1:6], prose(4, 100)]), own[0], own[7], None, "", prose(5, 2600) + " " + own[7] + " " + own[3], prose(6, 10)]


@pytest.mark.parametrize("stretch, kept", [(1 << 15, 1 << 12), (64, 64), (256, 32), (512, 512)])
def test_stretches_find_the_same(stretch, kept, monkeypatch):
    index = decontam.ItemIndex.of(items(), 5)
    want = [(0, 6), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (3, 7), (6, 3), (6, 7)]
    monkeypatch.setattr(decontam, "STRETCH", stretch)
    monkeypatch.setattr(decontam, "KEPT", kept)
    assert sorted((i, j) for i, j, _ in index.search(texts(), 5, 80)) == want
    flat, bounds = shingle_sequences(texts(), 5)
    assert {(i, j) for i, js in index.candidates(flat, bounds).items() for j in js} >= set(want)


def test_memory_does_not_grow_with_the_windows_of_small_items():
    index = decontam.ItemIndex.of([(0, "two words"), (1, prose(9, 60))], 5)
    text = " ".join(prose(i, 20_000) for i in range(20)) + " " + prose(9, 60)
    tracemalloc.start()
    assert [(i, j) for i, j, _ in index.search([text], 5, 80)] == [(0, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)  # windows of one shingle alone would take 256 bytes each


def test_shingles_of_many_texts_are_those_of_each():
    flat, bounds = shingle_sequences(texts(), 5)
    for i, t in enumerate(texts()):
        assert np.array_equal(flat[bounds[i] : bounds[i + 1]], shingle_sequences([t], 5)[0])


def test_blocks_of_items_are_bounded_by_bytes(spark):
    bench = spark.createDataFrame(items() + [(None, None), (20, "")], "item_id long, text string")
    assert len([*decontam._indexes(bench, "item_id", "text", 5, 1000)]) == 1
    many = [*decontam._indexes(bench, "item_id", "text", 5, 1000, block_bytes=20_000)]
    assert len(many) > 2 and sorted(i for x in many for i in x.ids) == list(range(8))
    assert [*decontam._indexes(bench.limit(0), "item_id", "text", 5, 1000)][0].ids == []
