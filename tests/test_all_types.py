"""Clusters are found for the points of every type."""

from linewave.operators.extrema import TYPES
from linewave.operators.neighbors import GROUP
from linewave.plans.queries import EPS, QUERIES
from tests.test_operators import brute_clusters


def test_clusters_of_all_types_equal_brute_force(spark, sf_dir):
    points, got = {}, {}
    for name in ("peaks_max_rows", "peaks_min_rows", "peaks_max_cols", "peaks_min_cols"):
        for r in QUERIES[name](spark, sf_dir).collect():
            points.setdefault(tuple(r[k] for k in GROUP), {})[r.point_idx] = (r.x, r.y)
    for r in QUERIES["dbscan"](spark, sf_dir).collect():
        got.setdefault(tuple(r[k] for k in GROUP), {})[r.point_idx] = r.label
    assert {g[-1] for g in got} == set(TYPES)
    assert got == {g: brute_clusters(own, EPS, 5) for g, own in points.items()}
