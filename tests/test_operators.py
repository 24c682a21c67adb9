"""Edge rules on small hand-made inputs."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewave.functions.scalars import clamp, duration_text, round_half_even
from linewave.operators import cluster, color, extrema, geometry, lines, neighbors, transform
from linewave.plans.pipeline import Options, analyse
from linewave.sources import images, scales, sinks

ROWS = images.ROWS
COEFS = transform.COEFS


def image(spark, values, image_id=1):
    """``rows`` of one image whose three channels all hold ``values``."""
    return spark.createDataFrame([(image_id, y, *[[float(v) for v in row]] * 3) for y, row in enumerate(values)], ROWS)


def one_line(spark, values, direction=0):
    return spark.createDataFrame([(1, direction, 0, 1.0, 0, [float(v) for v in values])], COEFS)


def png(path, pixels):
    """Write (h, w, 3) or (h, w, 4) bytes as a PNG."""
    h, w, n = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


# --- images ------------------------------------------------------------------------------------


@pytest.mark.parametrize("channels", [3, 4])
def test_images_are_read_as_red_green_blue(spark, tmp_path, channels):
    pixels = np.random.RandomState(1).randint(0, 256, (5, 7, channels)).astype(np.uint8)
    if channels == 4:
        pixels[..., 3] = 255
    png(tmp_path / "a.png", pixels)
    (tmp_path / "b.txt").write_text("no image")
    found = images.read_images(spark, str(tmp_path))
    got = {(r.channel, r.y, r.x): r.v for r in images.pixels(images.image_rows(found)).collect()}
    assert got == {(c, y, x): float(pixels[y, x, c]) for c in range(3) for y in range(5) for x in range(7)}
    for direction in (0, 1):
        own = {(r.channel, r.line): r.v for r in images.image_lines(found, direction).collect()}
        want = pixels.transpose(2, 1, 0) if direction else pixels.transpose(2, 0, 1)
        assert own == {(c, i): want[c, i].astype(float).tolist() for c in range(3) for i in range(want.shape[1])}


def test_arriving_images_are_analysed_once(spark, tmp_path):
    from linewave.streaming.watch import watch_images

    source = tmp_path / "in"
    source.mkdir()
    options = Options(scales=(1.0,), types=("max_by_row",))
    for name in ("a", "b"):
        png(source / f"{name}.png", np.random.RandomState(ord(name)).randint(0, 256, (20, 20, 3)).astype(np.uint8))
        watch_images(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), options).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    whole = analyse(images.image_rows(images.read_images(spark, str(source))), options).points
    assert streamed.exceptAll(whole).count() == whole.exceptAll(streamed).count() == 0
    assert streamed.select("image_id").distinct().count() == 2


def test_embedding_view_has_whole_pixel_values(spark, sf_dir):
    v = images.pixels(images.embedding_rows(spark, sf_dir)).agg(F.min("v"), F.max("v"), F.max(F.col("v") % 1)).first()
    assert 0 <= v[0] <= v[1] <= 255 and v[2] == 0


def test_lookup_leaves_out_places_beyond_the_image(spark):
    places = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 0), (1, -1, 0), (1, 0, 2), (2, 0, 0)], "image_id long, y int, x int")
    got = images.pixel_lookup(image(spark, [[1, 2], [3, 4]]), places).collect()
    assert sorted((r.y, r.x, r.r) for r in got) == [(0, 1, 2), (1, 0, 3)]


# --- geometry and colours ------------------------------------------------------------------------


def test_rectangles_are_clamped_ordered_and_checked(spark):
    rows = image(spark, [[y * 100 + x for x in range(20)] for y in range(15)])
    got = {(r.y, r.x): r.v for r in images.pixels(geometry.crop_rectangle(rows, 30, 12, 8, -3)).where("channel = 0").collect()}
    assert got == {(y, x - 8): y * 100 + x for y in range(12) for x in range(8, 20)}
    with pytest.raises(ValueError):
        geometry.crop_rectangle(rows, 0, 0, 10, 30)
    assert geometry.crop_rectangle(rows, 50, 50, 70, 70).count() == 0


def test_polygons_follow_the_even_odd_rule(spark):
    rows = image(spark, np.ones((12, 12)))
    square = [(2, 2), (8, 2), (8, 8), (2, 8)]
    inside = {(r.y, r.x) for r in images.pixels(geometry.mask_polygon(rows, square, 0.0)).where("channel = 1 and v = 1").collect()}
    assert inside == {(y, x) for y in range(2, 8) for x in range(2, 8)}
    cut = images.pixels(geometry.crop_polygon(rows, square)).where("channel = 0")
    assert cut.count() == 36 and cut.agg(F.min("v")).first()[0] == 1
    with pytest.raises(ValueError):
        geometry.crop_polygon(rows, square[:2])


def test_basis_is_orthonormal_and_rejects_what_spans_no_plane(spark):
    basis = np.array(color.orthonormal_basis((73, 47, 110), (162, 115, 135)))
    assert np.allclose(basis @ basis.T, np.eye(3))
    for pair in (((0, 0, 0), (1, 2, 3)), ((1, 2, 3), (2, 4, 6)), ((1, 2, 3), (0, 0, 0))):
        with pytest.raises(ValueError):
            color.orthonormal_basis(*pair)
    rows = spark.createDataFrame([(1, 0, [1.0], [2.0], [3.0])], ROWS)
    new = color.change_basis(rows, (73, 47, 110), (162, 115, 135)).first()
    assert np.allclose([new.r[0], new.g[0], new.b[0]], basis.T @ [1, 2, 3])
    assert not color.basis_applied(rows, rows).first().applied


# --- scales and scalars -----------------------------------------------------------------------------


def test_scales(spark, tmp_path):
    of = lambda df: [(r.scale_idx, r.scale, r.scale_label) for r in df.orderBy("scale_idx").collect()]
    assert of(scales.scales_from_range(spark, 1, 8, 3)) == [(0, 1.0, "1"), (1, 4.0, "4"), (2, 7.0, "7")]
    assert of(scales.scales_from_range(spark, 3, 2, 1)) == []
    with pytest.raises(ValueError):
        scales.scales_from_range(spark, 1, 5, 0)
    (tmp_path / "s.txt").write_text("\n 10 2.5\n\n10\n")
    assert of(scales.scales_from_file(spark, str(tmp_path / "s.txt"))) == [(0, 10.0, "10.0"), (1, 2.5, "2.5"), (2, 10.0, "10.0")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        scales.parse_scales(spark.createDataFrame([(0, "1 x")], "line_no int, value string")).collect()


def test_rounding_clamping_and_durations(spark):
    row = spark.range(1).select(round_half_even(F.lit(0.0005), 3).alias("a"), round_half_even(F.lit(-0.0001), 3).alias("b"), clamp(F.lit(7), 0, 5).alias("c"), clamp(F.lit(None).cast("int"), 0, 5).alias("d"), duration_text(F.lit(3723.9)).alias("e")).first()
    assert (row.a, row.c, row.d, row.e) == (0.0, 5, None, "1 ч 02 м 03 с") and math.copysign(1, row.b) == 1


# --- transform ------------------------------------------------------------------------------------


def brute_transform(d, scale, pad):
    n = len(d)
    at = lambda k: -k - 1 if k < 0 else (2 * n - k - 1 if k >= n else k)
    wave = lambda t: 0.75 * math.exp(-t * t / 2) * math.cos(2 * math.pi * t)
    return [sum(d[at(k)] * wave((k - j) / scale) for k in range(-pad, n + pad)) / math.sqrt(scale) for j in range(n)]


def test_transform_equals_its_definition_for_lines_of_several_lengths(spark):
    rng = np.random.RandomState(3)
    own = [(1, 0, 0, i, rng.randint(0, 256, n).astype(float).tolist()) for i, n in enumerate((15, 20, 15, 33))]
    df = spark.createDataFrame([*own, (1, 0, 1, 9, None), (1, 0, 1, 10, [])], images.LINES)
    for run in (transform.morlet, transform.morlet_native):
        got = {(r.line, r.scale): r.c for r in run(df, [1.0, 4.0, 4.0]).collect()}
        assert len(got) == 8
        for *_, line, d in own:
            for s in (1.0, 4.0):
                assert np.allclose(got[line, s], brute_transform(d, s, 15), atol=1e-9)


def test_borders(spark):
    d = np.random.RandomState(4).randint(0, 256, 18).astype(float).tolist()
    df = spark.createDataFrame([(1, 0, 0, 0, d)], images.LINES)
    for border, pads in (("mirrored_each", {1.0: 4, 4.0: 15}), ("none", {1.0: 0, 4.0: 0})):
        for r in transform.morlet(df, [1.0, 4.0], border).collect():
            assert np.allclose(r.c, brute_transform(d, r.scale, pads[r.scale]), atol=1e-9)
    with pytest.raises(ValueError):
        transform.morlet(df, [1.0], "open")


def test_transform_rejects_what_it_cannot_reflect(spark):
    short = spark.createDataFrame([(1, 0, 0, 0, [1.0] * 14)], images.LINES)
    with pytest.raises(ValueError):
        transform.morlet_native(short, [4.0])
    with pytest.raises(Exception, match="too short"):
        transform.morlet(short, [4.0]).collect()
    for bad in ([], [0.0], [1.0, -2.0]):
        with pytest.raises(ValueError):
            transform.morlet(short, bad)


def test_a_constant_line_gives_no_points_and_turning_an_image_swaps_directions(spark):
    flat = analyse(image(spark, np.full((10, 10), 7)), Options(scales=(1.0,)))
    assert flat.points.count() == 0 and flat.neighbours().count() == 0
    values = np.random.RandomState(5).randint(0, 256, (16, 16))
    swap = {"max_by_row": "max_by_column", "max_by_column": "max_by_row", "min_by_row": "min_by_column", "min_by_column": "min_by_row"}
    a = {(r.direction, r.channel, r.extreme_type, r.point_idx, r.x, r.y) for r in analyse(image(spark, values), Options(scales=(1.0, 2.0))).points.where("scale = 2").collect()}
    b = {(1 - r.direction, r.channel, swap[r.extreme_type], r.point_idx, r.y, r.x) for r in analyse(image(spark, values.T), Options(scales=(1.0, 2.0))).points.where("scale = 2").collect()}
    assert a == b and a


# --- extrema ----------------------------------------------------------------------------------------

LINES = {
    "constant": ([5, 5, 5, 5, 5, 5], [], []),
    "plateau_only": ([0, 2, 2, 2, 0, 0], [], [2]),
    "three_knots": ([0, 3, 0, 5, 0, 4, 0], [1, 3, 5], []),
    "four_knots": ([0, 1, 0, 5, 0, 3, 0, 2, 0], [1, 3, 5, 7], [3]),
    "equal_tops": ([0, 1, 0, 4, 0, 4, 0, 2, 0], [1, 3, 5, 7], [4]),
    "monotone": ([0, 1, 2, 3, 4, 5], [], []),
    "border_max": ([9, 1, 2, 1, 0, 8], [2], []),
    "two_wide": ([1, 2], [], []),
    "one_wide": ([1], [], []),
}


@pytest.mark.parametrize("name", LINES)
@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("direction", [0, 1])
def test_extrema_and_peaks_of_one_line(spark, name, sign, direction):
    values, knots, peaks = LINES[name]
    df = one_line(spark, [sign * v for v in values], direction)
    kind = ("max" if sign > 0 else "min") + ("_by_row" if direction == 0 else "_by_column")
    along = "x" if direction == 0 else "y"
    assert sorted(r[along] for r in extrema.raw_points(df, [kind]).collect()) == knots
    assert sorted(r[along] for r in extrema.peak_points(df, [kind]).collect()) == peaks


def test_envelope_goes_on_beyond_its_knots(spark):
    lines_ = one_line(spark, LINES["four_knots"][0]).select("line", "c")
    assert extrema.envelopes(lines_).first().env == [-1, 1, 3, 5, 4, 3, 2.5, 2, 1.5]
    assert extrema.envelopes(one_line(spark, LINES["three_knots"][0]).select("line", "c")).first().env == [0] * 7
    assert extrema.envelopes(lines_.limit(0)).count() == 0


def test_largest_coefficients_keep_ties(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 0, [1.0, 4.0]), (1, 0, 0, 1.0, 1, [4.0, 0.0])], COEFS)
    assert sorted((r.y, r.x) for r in extrema.largest_coefficients(df).collect()) == [(0, 1), (1, 0)]


# --- neighbours and clusters -------------------------------------------------------------------------

POINTS = "g string, point_idx int, x int, y int"


def brute_nearest(points, k):
    out = []
    for g, i, x, y in points:
        near = sorted(((x - u) ** 2 + (y - w) ** 2, j) for h, j, u, w in points if h == g and j != i)[:k]
        out += [(g, i, r + 1, j, d**0.5) for r, (d, j) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [0, 1, 5, 50])
def test_nearest_equals_brute_force(spark, k):
    rng = np.random.RandomState(k)
    points = [("even", i, int(x), int(y)) for i, (x, y) in enumerate(rng.randint(0, 60, (150, 2)))]
    points += [("lumps", i, int(x), int(y)) for i, (x, y) in enumerate(np.concatenate([rng.randint(0, 4, (30, 2)), rng.randint(5000, 5004, (4, 2)), [[-900, 40000]]]))]
    points += [("dense", i, i % 20, i // 20) for i in range(400)] + [("dense", 400, 3000, 3000)]
    points += [("row", i, i, 0) for i in range(12)] + [("two", 0, 3, 3), ("two", 1, 9, 9), ("one", 0, 1, 1), (None, 0, 0, 0), (None, 1, 5, 5)]
    df = spark.createDataFrame(points, POINTS)
    got = neighbors.nearest(df, k, ["g"])
    rows = sorted(((r.g, r.point_idx, r.nbr_rank, r.nbr_idx, r.distance) for r in got.collect()), key=str)
    assert rows == brute_nearest(points, k)


def test_nearest_of_nothing(spark):
    assert neighbors.nearest(spark.createDataFrame([], POINTS), 5, ["g"]).count() == 0
    with pytest.raises(ValueError):
        neighbors.nearest(spark.createDataFrame([], POINTS), -1, ["g"])


def brute_clusters(points, eps, least):
    close = {i: [j for j, q in points.items() if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in points.items()}
    core = sorted(i for i in points if len(close[i]) >= least)
    label, n = {}, 0
    for i in core:
        if i in label:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = n
                stack += [m for m in close[j] if m in core]
        n += 1
    border = {i: label[min(j for j in close[i] if j in core)] for i in points if i not in label and any(j in core for j in close[i])}
    return {i: ({**label, **border}).get(i, -1) for i in points}


def test_clusters_equal_brute_force(spark):
    rng = np.random.RandomState(2)
    own = {i: (int(x), int(y)) for i, (x, y) in enumerate(rng.randint(0, 22, (140, 2)))}  # repeated places too
    df = spark.createDataFrame([("a", i, x, y) for i, (x, y) in own.items()] + [("b", 0, 1, 1)], POINTS)
    got = cluster.density_clusters(df, 2.0, 5, ["g"])
    assert {r.point_idx: r.label for r in got.where("g = 'a'").collect()} == brute_clusters(own, 2.0, 5)
    assert got.where("g = 'b'").first().label == -1
    assert {r.g: r.n_clusters for r in cluster.cluster_counts(got, ["g"]).collect()}["b"] == 0


@pytest.mark.parametrize("eps, least, tile", [(2.0, 5, 16), (1.0, 3, 8), (3.5, 9, 28), (0.5, 2, 4), (1.5, 1, 64)])
def test_clusters_across_tiles_equal_brute_force(spark, eps, least, tile):
    rng = np.random.RandomState(int(eps * 10))
    groups = {g: {i: (int(x), int(y)) for i, (x, y) in enumerate(rng.randint(-30, 30, (n, 2)))} for g, n in (("a", 700), (None, 300), ("b", 2))}
    groups["snake"] = {i: (i // 2 if i % 4 < 2 else i // 2, 3 + (i // 40) % 2) for i in range(0, 200)}  # one long cluster over many tiles
    df = spark.createDataFrame([(g, i, x, y, 7) for g, own in groups.items() for i, (x, y) in own.items()], "g string, point_idx int, x int, y int, head int")
    got = {}
    for r in cluster.density_clusters(df, eps, least, ["g"], tile=tile, tasks_rows=100).collect():
        assert (r.x, r.y) == groups[r.g][r.point_idx]
        got.setdefault(r.g, {})[r.point_idx] = r.label
    assert got == {g: brute_clusters(own, eps, least) for g, own in groups.items()}
    assert cluster.density_clusters(df.limit(0), eps, least, ["g"]).count() == 0


def test_greedy_tree_takes_three_then_two(spark):
    centres = spark.createDataFrame([("g", i, float(i), 0.0) for i in range(1, 8)], "g string, label int, x double, y double")
    root = spark.createDataFrame([("g", 0, 0)], "g string, x int, y int")
    tree = [(r.from_x, r.to_x) for r in cluster.greedy_trees(centres, root, ["g"]).orderBy("step").collect()]
    assert tree == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (2, 6), (2, 7)]
    assert cluster.greedy_trees(centres.limit(0), root, ["g"]).count() == 0
    with pytest.raises(Exception, match="no root"):
        cluster.greedy_trees(centres, root.limit(0), ["g"]).collect()


# --- text ------------------------------------------------------------------------------------------------


def test_text_is_saved_in_order(spark, tmp_path):
    rows = image(spark, [[1, 2], [3, 4]])
    sinks.save_text(sinks.channel_text(lines.row_lines(rows)), str(tmp_path / "out"), ["image_id", "file"])
    (red,) = (tmp_path / "out" / "image_id=1").glob("*Red/part-*.txt")
    assert red.read_text() == "1,2\n3,4\n"


def test_scratch_tables_are_cleared(spark):
    from pathlib import Path

    from linewave.storage import clear_scratch, scratch_path, written

    kept = written(spark.range(3), "numbers")
    assert kept.count() == 3
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert any(p.name.startswith("numbers-") for p in folder.iterdir())
    clear_scratch(spark)
    assert not folder.exists()
