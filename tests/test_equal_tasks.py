"""Tasks of equal colours meeting one block of coefficients: worked out once, the results of each as if alone."""

import numpy as np
import pyarrow as pa

from linewave.operators import extrema, neighbors
from linewave.plans import tasks as plan

OWN = pa.struct([("task_id", pa.int64()), ("k", pa.int32()), ("asked", pa.list_(pa.bool_())), ("basis", pa.list_(pa.float64())), ("note", pa.string())])
FIRST, SECOND = [0.6, 0.8, 0.0, -0.8, 0.6, 0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0]


def block(own, channel=-1):
    """One row of lines 0 to 11 of 40 values along rows, for these (task_id, k, types, basis)."""
    n = 3 if channel < 0 else 1
    c = np.random.RandomState(3).randn(n, 12 * 40).ravel()
    columns = {
        "axis": pa.array([0], pa.int32()), "direction": pa.array([1], pa.int32()), "scale": pa.array([2.0]), "channel": pa.array([channel], pa.int32()),
        "lines": pa.array([list(range(12)) * n], pa.list_(pa.int32())), "sizes": pa.array([[40] * 12 * n], pa.list_(pa.int32())), "c": pa.array([c.tolist()]),
        "own": pa.array([[{"task_id": t, "k": k, "asked": asked, "basis": basis, "note": f"n{t}"} for t, k, asked, basis in own]], pa.list_(OWN)),
    }
    return pa.RecordBatch.from_pydict(columns)


def rows(run, batch):
    return sorted(str(r) for out in run(iter([batch])) for r in out.to_pylist())


ALL, HIGH = [True] * 4, [True, True, False, False]
CHANGED = [(1, 3, ALL, FIRST), (2, 2, ALL, SECOND), (3, 5, HIGH, FIRST), (4, 0, ALL, FIRST), (5, 1, ALL, SECOND)]
PLAIN = [(t, k, asked, None) for t, k, asked, _ in CHANGED]


def test_equal_tasks_give_what_each_gives_alone():
    for own, channel in ((CHANGED, -1), (PLAIN, 1)):
        for run in (plan._neighbours, plan._graphs, plan._points, plan._coefficients(3), plan._coefficients(None)):
            want = sorted(r for t in own for r in rows(run, block([t], channel)))
            assert rows(run, block(own, channel)) == want and len(want) > 0


def test_neighbours_come_as_rows_equal_to_the_graphs():
    flat = sorted(tuple(r.values()) for out in plan._neighbours(iter([block(CHANGED)])) for r in out.to_pylist())
    lists = [r for out in plan._graphs(iter([block(CHANGED)])) for r in out.to_pylist()]
    want = sorted((*(r[c] for c in neighbors.GROUP), r["point_idx"], at + 1, s["i"], float(s["d"]) ** 0.5) for r in lists for at, s in enumerate(r["nn"]))
    assert flat == want and {r[0] for r in flat} == {1, 2, 3, 5}


def test_equal_tasks_are_searched_once(monkeypatch):
    """60 tasks of one basis cost the neighbours of one."""
    sought = []
    near = neighbors.near_lists
    monkeypatch.setattr(neighbors, "near_lists", lambda x, *more: sought.append(len(x)) or near(x, *more))
    costs = []
    for n in (1, 60):
        sought.clear()
        for own, channel in (([(t, 3, ALL, FIRST) for t in range(n)], -1), ([(t, 3, ALL, None) for t in range(n)], 1)):
            rows(plan._graphs, block(own, channel))
        costs.append(sum(sought))
    assert costs[0] == costs[1] > 0


def test_peaks_of_equal_tasks_are_sought_once(monkeypatch):
    sought = []
    envelopes = extrema.upper_envelopes
    monkeypatch.setattr(extrema, "upper_envelopes", lambda flat, *more: sought.append(len(flat)) or envelopes(flat, *more))
    costs = []
    for n in (1, 60):
        sought.clear()
        found = rows(plan._points, block([(t, 3, ALL, FIRST) for t in range(n)]))
        costs.append((sum(sought), len(found) // n))
    assert costs[0] == costs[1] and costs[0][0] == 2 * 3 * 12 * 40
