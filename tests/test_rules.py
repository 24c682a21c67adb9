"""Rules of names, folders and scales, scratch tables, and long lines."""

import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewave import storage
from linewave.functions.scalars import cropped_name, is_image_name
from linewave.operators import transform
from linewave.sources import images, scales, sinks
from tests.test_operators import brute_transform


def test_cropped_copies_stay_in_their_folder(spark):
    names = {
        "/a/b/c.png": "/a/b/c_cropped.png", "c.png": "c_cropped.png", "/a.b/c": "/a.b/c_cropped", "/a/.hidden": "/a/.hidden_cropped", "/a/..x.JPG": "/a/..x_cropped.JPG",
        "/a/Cropped1.png": "/a/Cropped1.png", "/cropped/b.png": "/cropped/b_cropped.png", "/a/b.cropped": "/a/b_cropped.cropped", "/a/b.c.d": "/a/b.c_cropped.d",
        "": "_cropped", "/a/": "/a/_cropped", "/a/b.": "/a/b_cropped.", "https://h.org/x/y": "https://h.org/x/y_cropped",
    }
    got = spark.createDataFrame([(p,) for p in names], "p string").select("p", cropped_name(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == names


def test_summary_of_scales_in_no_order(spark):
    own = {1: [90, 10, 45, 2, 30, 60], 2: [5, 3], 3: [7, 7, 1, 1, 9, 9]}
    df = spark.createDataFrame([(t, i, float(s), str(s)) for t, ss in own.items() for i, s in enumerate(ss)], "t int, scale_idx int, scale double, scale_label string")
    assert {r.t: (r.n_scales, r.summary) for r in scales.scale_summary(df, "t").collect()} == {1: (6, "2..90"), 2: (2, "5, 3"), 3: (6, "1..9")}


def test_images_are_known_by_name_in_any_case(spark, tmp_path):
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + b"\x01\x02\x03\x00"
    names = ["a.bmp", "b.BMP", "c.Bmp", "d.bMp"]
    for n in [*names, "e.txt", "f.bmpx"]:
        (tmp_path / n).write_bytes(bmp)
    found = images.read_images(spark, str(tmp_path))
    assert sorted(r.origin.rsplit("/", 1)[1] for r in found.collect()) == names
    assert {(r.r[0], r.g[0], r.b[0]) for r in images.image_rows(found).collect()} == {(3.0, 2.0, 1.0)}
    df = spark.createDataFrame([(n,) for n in ["x.Png", "x.jpeg", "x.gif", "png", "x.png/y"]], "n string")
    assert [r.k for r in df.select(is_image_name(F.col("n")).alias("k")).collect()] == [True, True, False, False, False]


def test_folder_of_results(spark):
    got = spark.sql("SELECT timestamp_ntz'2024-03-05 07:08:09' AS t").select(sinks.result_folder(F.lit("Задача 1"), F.col("t"), F.lit("3")).alias("f")).first().f
    assert got == "ВП_05_03_2024_07_08/Задача 1 05_03_2024_07_08/Scale_3"


@pytest.mark.parametrize("border", ["mirrored", "mirrored_each", "none"])
def test_long_lines_equal_the_whole_sum(spark, border):
    rng = np.random.RandomState(5)
    scale = [1.0, 3.0, 10.0]
    own = [(1, 0, 0, i, rng.randint(0, 256, n).astype(float).tolist()) for i, n in enumerate((4000, 64, 65, 511))]
    pads = dict(zip(scale, transform.paddings(scale, border)))
    df = spark.createDataFrame(own, images.LINES)
    for r in transform.rounded(transform.morlet(df, scale, border)).collect():
        d, pad = np.array(own[r.line][4]), pads[r.scale]
        n = len(d)
        k = np.arange(-pad, n + pad)
        wide = d[np.where(k < 0, -k - 1, np.where(k >= n, 2 * n - k - 1, k))]
        for j in sorted({0, 1, 7, 63, 64, n // 2, n - 2, n - 1} & set(range(n))):
            t = (k - j) / r.scale
            assert r.c[j] == pytest.approx(np.round((wide * 0.75 * np.exp(-t * t / 2) * np.cos(2 * np.pi * t)).sum() / np.sqrt(r.scale), 3), abs=1e-9)
    if border == "mirrored":
        some = transform.morlet_native(df.where("line in (1, 2)"), scale, check=False).collect()
        assert all(np.allclose(r.c, brute_transform(own[r.line][4], r.scale, pads[r.scale]), atol=1e-9) for r in some)


def test_memory_of_the_transform_does_not_depend_on_the_length():
    import tracemalloc

    flat = np.random.RandomState(6).rand(200_000)
    tracemalloc.start()
    transform.coefficients(flat, np.array([len(flat)]), 10.0, 36)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_a_short_line_without_a_check_raises_when_its_turn_comes(spark):
    short = spark.createDataFrame([(1, 0, 0, 0, [1.0] * 14)], images.LINES)
    with pytest.raises(Exception, match="too short"):
        transform.morlet_native(short, [4.0], check=False).collect()


def test_scratch_of_a_block_is_deleted_and_the_rest_stays(spark):
    kept = storage.written(spark.range(3), "kept")
    with storage.Scratch(spark) as own:
        gone = storage.written(spark.range(4), "gone")
    assert gone.count() == 4 and len(own.paths) == 1
    own.clear()
    assert kept.count() == 3 and not os.path.exists(re.sub("^file:", "", gone.inputFiles()[0]))


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, k, d=None):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_path(Session(), "x")


@pytest.mark.parametrize("eps, least, width", [(2.0, 5, 30), (1.0, 3, 14), (7.5, 5, 60), (40.0, 5, 60), (3.0, 1, 40), (9.0, 40, 60)])
def test_clusters_by_cells_equal_brute_force(spark, eps, least, width):
    from linewave.operators import cluster
    from tests.test_operators import POINTS, brute_clusters

    rng = np.random.RandomState(int(10 * eps) + least)
    lumps = np.concatenate([rng.randint(0, width, (80, 2)), rng.randint(0, 6, (60, 2)), rng.randint(0, 6, (40, 2)) + [width // 2, -9]])
    own = {g: {i: (int(x), int(y)) for i, (x, y) in enumerate(rng.permutation(lumps))} for g in ("a", None)}
    df = spark.createDataFrame([(g, i, x, y) for g, ps in own.items() for i, (x, y) in ps.items()], POINTS)
    got = {}
    for r in cluster.density_clusters(df, eps, least, ["g"]).collect():
        got.setdefault(r.g, {})[r.point_idx] = r.label
    assert got == {g: brute_clusters(ps, eps, least) for g, ps in own.items()}


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_components_by_rounds_or_in_one_task(spark, few):
    from linewave.operators.components import connected_components

    edges = [(i, i + 1) for i in range(90)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000), (7, None), (2, 1), (1, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == {i: 0 for i in range(91)} | {1000 + i: 1000 for i in range(60)}
    words = {r.node: r.component for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "é"), ("é", "日")], "a string, b string"), few=few).collect()}
    assert words == {"a": "a", "b": "a", "c": "c", "é": "c", "日": "c"}


def test_nearest_with_many_points_at_one_place(spark):
    from linewave.operators import neighbors
    from tests.test_operators import POINTS, brute_nearest

    points = [("a", i, 5, 5) for i in range(40)] + [("a", 40 + i, 5 + i, 5) for i in range(1, 9)] + [("a", 60, 300, 300), ("a", 61, 300, 301)]
    got = neighbors.nearest(spark.createDataFrame(points, POINTS), 3, ["g"])
    assert sorted(((r.g, r.point_idx, r.nbr_rank, r.nbr_idx, r.distance) for r in got.collect()), key=str) == brute_nearest(points, 3)


@pytest.mark.parametrize("scale", [31.0, 45.0, 90.0])
def test_wide_kernels_equal_the_direct_sum(scale):
    rng = np.random.RandomState(int(scale))
    pad = transform.padding([scale])
    sizes = np.array([100_000, pad, 7000])
    flat = rng.randint(0, 256, sizes.sum()).astype(float) - 127
    got, lo = transform.coefficients(flat, sizes, scale, pad), 0
    for n in sizes:
        own = flat[lo : lo + n]
        wide = np.concatenate([own[:pad][::-1], own, own[-pad:][::-1]])
        w = transform.taps(scale)
        r = len(w) // 2
        edge = max(0, r - pad)
        direct = np.convolve(np.pad(wide, edge), w, "valid")[max(0, pad - r) :][:n]
        assert np.abs(got[lo : lo + n] - direct).max() < 1e-10
        lo += n


def test_wide_kernels_take_less_time_than_their_width():
    flat, sizes = np.random.RandomState(1).rand(400_000), np.array([400_000])

    def took(scale):
        transform.coefficients(flat, sizes, scale, 0)
        began = time.perf_counter()
        transform.coefficients(flat, sizes, scale, 0)
        return time.perf_counter() - began

    assert took(800.0) < 6 * took(50.0) + 0.5  # 16 times as wide
