"""Large families of near duplicates: pivots and blocks lose no link."""

import random

import numpy as np
import pytest

from linewave.llm import neardup
from tests.llm.fixtures import frame, prose
from tests.llm.test_corpus_operators import brute_groups, copies


def chain_and_crowd():
    """A crowd of copies of one text, a chain that leads away from it, and a second crowd at the chain's end."""
    rng, rows = random.Random(5), []
    text = prose(77, 120)

    def changed(t, n):
        words = t.split(" ")
        for _ in range(n):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        return " ".join(words)

    rows += [(i, changed(text, rng.choice([0, 1, 2, 6])), None, None) for i in range(150)]
    for i in range(8):
        text = changed(text, 7)
        rows.append((500 + i, text, None, None))
    return rows + [(700 + i, changed(text, rng.choice([0, 2, 6])), None, None) for i in range(60)]


@pytest.mark.parametrize("pivots, block, rows_each", [(16, 3000, 200), (1, 3000, 200), (2, 400, 1000), (1, 100_000, 20)])
def test_pivots_and_blocks_lose_no_link(spark, pivots, block, rows_each):
    rows = chain_and_crowd() + [(d + 10_000, *r) for d, *r in copies()]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), k=2, block_shingles=block, block_rows=rows_each, pivots=pivots).collect()}
    assert got == brute_groups(rows, 2)


def test_pivot_links_of_one_salt():
    import pyarrow as pa

    base = np.arange(100, dtype=np.uint64)
    sets = [(0, 1, base), (0, 2, base + np.uint64(1)), (0, 3, base + np.uint64(1000)), (1, 4, base + np.uint64(2)), (1, 5, base + np.uint64(1001)), (1, 6, base + np.uint64(5000)), (1, 1, base)]
    batch = pa.RecordBatch.from_pylist([{"family": 9, "salt": 0, "role": r, "rep": i, "members": s.tobytes()} for r, i, s in sets])
    got = [tuple(x.values()) for b in neardup._pivot_links(80)(iter([batch])) for x in b.to_pylist()]
    assert got == [(2, 1), (4, 1), (5, 3), (1, 1)]


def test_confirmed_links_across_and_within_blocks():
    base = np.arange(100, dtype=np.uint64)
    near = [(i, base + np.uint64(i)) for i in range(4)]
    within = neardup.confirmed_links([(i, 2, i, s) for i, s in near], 80)
    assert len(within) == 3
    assert neardup.confirmed_links([(i, 0, i, s) for i, s in near], 80) == []
    across = neardup.confirmed_links([(i, int(i == 3), i, s) for i, s in near], 80)
    assert {frozenset(x) for x in across} == {frozenset((3, i)) for i in range(3)}
    assert neardup.confirmed_links([(i, 2, 0, s) for i, s in near], 80) == []
