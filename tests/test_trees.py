"""The greedy tree over every group, against a walk that sorts anew at every step."""

import numpy as np
import pytest

from linewave.operators import cluster
from linewave.operators.extrema import MATRIX
from linewave.operators.neighbors import GROUP
from linewave.plans.queries import EPS, QUERIES
from tests.test_operators import brute_clusters


def brute_tree(centres, root):
    """Segments in order, centres in the order of labels."""
    far = lambda p: lambda q: np.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
    left, out = sorted(centres, key=far(root)), []
    leaves = left[:3]
    out += [(*root, *p) for p in leaves]
    left = left[3:]
    while left:
        for p in leaves:
            for _ in range(2):
                if left:
                    left = sorted(left, key=far(p))
                    out.append((*p, *left[0]))
                    leaves = leaves[1:] + [left[0]]
                    left = left[1:]
    return [tuple(map(float, s)) for s in out]


def test_trees_of_all_groups_equal_brute_force(spark):
    rng = np.random.RandomState(3)
    groups = {("a", "p"): 40, ("a", "q"): 10, ("b", "p"): 3, ("b", "q"): 1, (None, "p"): 60}
    own = {g: [(float(x) / 2, float(y)) for x, y in rng.randint(0, 12, (n, 2))] for g, n in groups.items()}  # ties and repeated places
    roots = {"a": (3, 4), "b": (0, 0), None: (9, 1)}
    centres = spark.createDataFrame([(*g, i, *p) for g, ps in own.items() for i, p in enumerate(ps)], "g string, t string, label int, x double, y double")
    found = cluster.greedy_trees(centres, spark.createDataFrame([(g, *p) for g, p in roots.items()], "g string, x int, y int"), ["g", "t"]).collect()
    for g, ps in own.items():
        got = sorted((r.step, r.from_x, r.from_y, r.to_x, r.to_y) for r in found if (r.g, r.t) == g)
        assert [r[0] for r in got] == list(range(len(ps)))
        assert [r[1:] for r in got] == brute_tree(ps, roots[g[0]])
    assert len(found) == sum(groups.values())
    with pytest.raises(Exception, match="no root"):
        cluster.greedy_trees(centres, spark.createDataFrame([("a", 1, 1)], "g string, x int, y int"), ["g", "t"]).collect()


def test_the_tree_query_has_every_matrix_and_type(spark, sf_dir):
    points, want, roots = {}, {}, {}
    for name in ("peaks_max_rows", "peaks_min_rows", "peaks_max_cols", "peaks_min_cols"):
        for r in QUERIES[name](spark, sf_dir).collect():
            points.setdefault(tuple(r[k] for k in GROUP), {})[r.point_idx] = (r.x, r.y)
    for r in QUERIES["argmax"](spark, sf_dir).collect():
        key = tuple(r[k] for k in MATRIX)
        roots[key] = min(roots.get(key, (r.y, r.x)), (r.y, r.x))
    for g, own in points.items():
        labels = brute_clusters(own, EPS, 5)
        members = [[own[i] for i in own if labels[i] == n] for n in range(max(labels.values()) + 1)]
        centres = [(sum(p[0] for p in m) / len(m), sum(p[1] for p in m) / len(m)) for m in members]
        if centres:
            want[g] = brute_tree(centres, roots[g[:-1]][::-1])
    got = {}
    for r in QUERIES["greedy_tree"](spark, sf_dir).orderBy("step").collect():
        got.setdefault(tuple(r[k] for k in GROUP), []).append((r.from_x, r.from_y, r.to_x, r.to_y))
    assert {g[-1] for g in got} == {"max_by_row", "max_by_column", "min_by_row", "min_by_column"}
    assert got == want
