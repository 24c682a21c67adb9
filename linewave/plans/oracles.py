"""DuckDB SQL with the rows of the queries, built from shared parts."""

from __future__ import annotations

_PIXELS = """
numbered AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY label) // 64) - 1 AS z FROM embeddings),
ranked AS (SELECT CAST(label + 10 * least(r // 64, z) AS BIGINT) AS image_id, CAST(r - 64 * least(r // 64, z) AS INTEGER) AS y, embedding FROM numbered),
pixels AS (SELECT image_id, CAST(p // 21 AS INTEGER) AS channel, y, CAST(p % 21 AS INTEGER) AS x,
  least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(128 + 256 * CAST(embedding[p + 1] AS DOUBLE)))) AS v
  FROM ranked, (SELECT CAST(range AS INTEGER) AS p FROM range(63)))"""
_WIDE = """
wide AS (SELECT image_id, y, x, max(v) FILTER (channel = 0) AS r, max(v) FILTER (channel = 1) AS g, max(v) FILTER (channel = 2) AS b FROM pixels GROUP BY ALL)"""
_PAIR = """1.0::DOUBLE + n * 37 % 255 AS a0, CAST(n * 91 % 256 AS DOUBLE) AS a1, 0.0::DOUBLE AS a2, CAST(n * 13 % 256 AS DOUBLE) AS b0, CAST(n * 29 % 256 AS DOUBLE) AS b1, 1.0::DOUBLE + n * 71 % 255 AS b2"""


def _bases(pairs: str) -> str:
    """bases(n, u0..2, w0..2, c0..2): the orthonormal basis of each pair of colours (n, a0..2, b0..2)."""
    return f"""
n1 AS (SELECT *, a0 / sqrt(a0*a0 + a1*a1 + a2*a2) AS u0, a1 / sqrt(a0*a0 + a1*a1 + a2*a2) AS u1, a2 / sqrt(a0*a0 + a1*a1 + a2*a2) AS u2 FROM {pairs}),
o2 AS (SELECT n, u0, u1, u2, b0 - (b0*u0 + b1*u1 + b2*u2) * u0 AS o0, b1 - (b0*u0 + b1*u1 + b2*u2) * u1 AS o1, b2 - (b0*u0 + b1*u1 + b2*u2) * u2 AS o2 FROM n1),
n2 AS (SELECT n, u0, u1, u2, o0 / sqrt(o0*o0 + o1*o1 + o2*o2) AS w0, o1 / sqrt(o0*o0 + o1*o1 + o2*o2) AS w1, o2 / sqrt(o0*o0 + o1*o1 + o2*o2) AS w2 FROM o2),
n3 AS (SELECT *, u1*w2 - u2*w1 AS c0, u2*w0 - u0*w2 AS c1, u0*w1 - u1*w0 AS c2 FROM n2),
bases AS (SELECT n, u0, u1, u2, w0, w1, w2, c0 / sqrt(c0*c0 + c1*c1 + c2*c2) AS c0, c1 / sqrt(c0*c0 + c1*c1 + c2*c2) AS c1, c2 / sqrt(c0*c0 + c1*c1 + c2*c2) AS c2 FROM n3)"""


_BASIS = f"""
colours AS (SELECT 0 AS n, 73.0::DOUBLE AS a0, 47.0::DOUBLE AS a1, 110.0::DOUBLE AS a2, 162.0::DOUBLE AS b0, 115.0::DOUBLE AS b1, 135.0::DOUBLE AS b2),{_bases("colours")},
basis AS (SELECT * EXCLUDE (n) FROM bases)"""
_CHANGED = """
changed AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS channel, unnest([r*u0 + g*w0 + b*c0, r*u1 + g*w1 + b*c1, r*u2 + g*w2 + b*c2]) AS v FROM wide, basis)"""


def _round(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


def _signals(table: str = "pixels") -> str:
    """cells(image_id, direction, channel, line, pos, v) and their means and centred values."""
    return f"""
cells AS (SELECT image_id, 0 AS direction, channel, y AS line, x AS pos, v FROM {table} UNION ALL SELECT image_id, 1, channel, x, y, v FROM {table}),
centred AS (SELECT *, v - avg(v) OVER (PARTITION BY image_id, direction, channel, line) AS d FROM cells)"""


def _kernel(taps: str = "range(-15, n + 15)") -> str:
    return f"""
lengths AS (SELECT DISTINCT count(*) AS n FROM cells GROUP BY image_id, direction, channel, line),
taps AS (SELECT n, s AS scale, j, k, CASE WHEN k < 0 THEN -k - 1 WHEN k >= n THEN 2*n - k - 1 ELSE k END AS m, (k - j) / s AS t
  FROM lengths, (SELECT unnest([1.0::DOUBLE, 2.0, 4.0]) AS s), LATERAL (SELECT unnest(range(0, n)) AS j), LATERAL (SELECT unnest({taps}) AS k)),
kernel AS (SELECT n, scale, j, m, sum(0.75 * exp(-t*t/2) * cos(2 * pi() * t)) / sqrt(scale) AS w FROM taps GROUP BY n, scale, j, m)"""


_COEFS = f"""
krow AS (SELECT n, scale, j, list(w ORDER BY m) AS w FROM kernel GROUP BY ALL),
signal AS (SELECT image_id, direction, channel, line, count(*) AS n, list(d ORDER BY pos) AS d FROM centred GROUP BY ALL),
plain AS (SELECT image_id, direction, channel, scale, line, j AS pos, list_dot_product(d, w) AS raw FROM signal JOIN krow USING (n)),
coefs AS (SELECT image_id, direction, channel, scale, CAST(CASE direction WHEN 0 THEN line ELSE pos END AS INTEGER) AS y, CAST(CASE direction WHEN 0 THEN pos ELSE line END AS INTEGER) AS x, {_round("raw", 3)} AS c FROM plain)"""
_M = "image_id, direction, channel, scale"
_TYPES = {"max_by_row": (0, 1), "max_by_column": (1, 1), "min_by_row": (0, -1), "min_by_column": (1, -1)}


def _base(table: str = "pixels", taps: str = "range(-15, n + 15)") -> str:
    more = f",{_WIDE},{_BASIS},{_CHANGED}" if table == "changed" else ""
    return f"{_PIXELS}{more},{_signals(table)},{_kernel(taps)},{_COEFS}"


def _axes(table: str = "pixels", base: str = "") -> str:
    """along: each coefficient on its lines, axis 0 and 1, sign 1 and -1, with its strict maxima."""
    return f"""{base or _base(table)},
along AS (SELECT {_M}, axis, sign, CASE axis WHEN 0 THEN y ELSE x END AS line, CASE axis WHEN 0 THEN x ELSE y END AS pos, sign * c AS c
  FROM coefs, (SELECT unnest([0, 1]) AS axis), (SELECT unnest([1, -1]) AS sign)),
near AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM along WINDOW w AS (PARTITION BY {_M}, axis, sign, line ORDER BY pos)),
marked AS (SELECT {_M}, axis, sign, line, pos, c, coalesce(c > before AND c > after, false) AS knot FROM near)"""


def _peaks(table: str = "pixels", base: str = "", asked: str = "true") -> str:
    key = f"{_M}, axis, sign, line"
    own = ", ".join(f"q.{k}" for k in key.split(", "))
    on = lambda t: " AND ".join(f"q.{k} = {t}.{k}" for k in key.split(", "))
    right = "greatest(1, least(q.earlier, q.knots - 1))"
    return f"""{_axes(table, base)},
counted AS (SELECT *, count(*) FILTER (knot) OVER (PARTITION BY {key}) AS knots,
  count(*) FILTER (knot) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM marked),
knots AS (SELECT {key}, pos, c, earlier AS idx FROM counted WHERE knot),
enveloped AS (SELECT {own}, q.pos,
  CASE WHEN q.knots = 0 THEN q.c WHEN q.knots < 4 THEN 0.0 ELSE (b.c - a.c) / CAST(b.pos - a.pos AS DOUBLE) * CAST(q.pos - a.pos AS DOUBLE) + a.c END AS env
  FROM counted q LEFT JOIN knots b ON q.knots >= 4 AND b.idx = {right} AND {on("b")} LEFT JOIN knots a ON q.knots >= 4 AND a.idx = {right} - 1 AND {on("a")}),
steps AS (SELECT *, CASE WHEN env = lag(env) OVER w THEN 0 ELSE 1 END AS fresh FROM enveloped WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY pos) AS run FROM steps),
flats AS (SELECT {key}, run, min(pos) AS a, max(pos) AS z, any_value(env) AS env FROM runs GROUP BY {key}, run),
sides AS (SELECT *, lag(env) OVER w AS l, lead(env) OVER w AS r FROM flats WINDOW w AS (PARTITION BY {key} ORDER BY run)),
peaks AS (SELECT {_M}, axis, CASE WHEN sign = 1 THEN 'max' ELSE 'min' END || CASE WHEN axis = 0 THEN '_by_row' ELSE '_by_column' END AS extreme_type, line, (a + z) // 2 AS pos FROM sides WHERE l < env AND r < env AND {asked}),
points AS (SELECT {_M}, extreme_type, CAST(row_number() OVER (PARTITION BY {_M}, extreme_type ORDER BY line, pos) - 1 AS INTEGER) AS point_idx,
  CAST(CASE axis WHEN 0 THEN pos ELSE line END AS INTEGER) AS x, CAST(CASE axis WHEN 0 THEN line ELSE pos END AS INTEGER) AS y FROM peaks)"""


_G = f"{_M}, extreme_type"
_NEAR = f""",
pairs AS (SELECT {", ".join("a." + k for k in _G.split(", "))}, a.point_idx, b.point_idx AS nbr_idx, a.x, a.y, b.x AS nbr_x, b.y AS nbr_y,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM points a JOIN points b USING ({_G}) WHERE a.point_idx <> b.point_idx),
neighbours AS (SELECT *, row_number() OVER (PARTITION BY {_G}, point_idx ORDER BY d2, nbr_idx) AS nbr_rank FROM pairs QUALIFY nbr_rank <= 5)"""
_CLUSTERS = f""",
own AS (SELECT *, concat_ws('|', {_G}) AS g FROM points),
close AS (SELECT a.g, a.point_idx AS a, b.point_idx AS b FROM own a JOIN own b ON a.g = b.g AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
core AS (SELECT g, a FROM close GROUP BY ALL HAVING count(*) >= 5),
edge AS (SELECT c.g, c.a, c.b FROM close c JOIN core p ON c.g = p.g AND c.a = p.a JOIN core q ON c.g = q.g AND c.b = q.a),
reach(g, a, b) AS (SELECT g, a, a FROM core UNION SELECT r.g, r.a, e.b FROM reach r JOIN edge e ON r.g = e.g AND r.b = e.a),
named AS (SELECT g, a, min(b) AS head FROM reach GROUP BY ALL),
border AS (SELECT c.g, c.a, arg_min(n.head, c.b) AS head FROM close c JOIN named n ON c.g = n.g AND c.b = n.a WHERE NOT EXISTS (SELECT 1 FROM core p WHERE p.g = c.g AND p.a = c.a) GROUP BY ALL),
label AS (SELECT g, head, row_number() OVER (PARTITION BY g ORDER BY head) - 1 AS label FROM (SELECT DISTINCT g, head FROM named)),
clusters AS (SELECT {_G}, o.point_idx, x, y, CAST(coalesce(label, -1) AS INTEGER) AS label FROM own o
  LEFT JOIN (SELECT * FROM named UNION ALL SELECT * FROM border) m ON o.g = m.g AND o.point_idx = m.a LEFT JOIN label l ON m.g = l.g AND m.head = l.head)"""

#: Tasks of the suppliers: images by task, changed where both colours are there, at each task's scales. ``own`` has the settings.
_TASK_COEFS = f"""{_PIXELS},{_WIDE},
own AS (SELECT s_suppkey AS n, s_name, s_suppkey % 10 AS image, s_suppkey % 4 <> 0 AS changed, [[1.0, 2.0], [4.0, 1.5], [3.0, 1.0]][s_suppkey % 3 + 1]::DOUBLE[] AS scales, [15, 11, 8][CASE s_suppkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END] AS pad,
  CASE WHEN s_suppkey % 6 = 0 THEN 5 ELSE s_suppkey % 6 END AS k, s_suppkey % 5 <> 0 AS by_rows, s_suppkey % 7 <> 0 AS by_cols, NOT (s_suppkey % 2 = 0 AND s_suppkey % 11 = 0) AS of_max FROM supplier WHERE s_suppkey % 9 <> 0),
chosen AS (SELECT n, {_PAIR} FROM own),{_bases("chosen")},
changed AS (SELECT n AS image_id, y, x, unnest([0, 1, 2]) AS channel, unnest(CASE WHEN changed THEN [r*u0 + g*w0 + b*c0, r*u1 + g*w1 + b*c1, r*u2 + g*w2 + b*c2] ELSE [r, g, b] END) AS v FROM wide JOIN own ON image_id = image JOIN bases USING (n)),{_signals("changed")},
signal AS (SELECT image_id, direction, channel, line, count(*) AS n, list(d ORDER BY pos) AS d FROM centred GROUP BY ALL),
lengths AS (SELECT DISTINCT signal.n, pad, unnest(scales) AS scale FROM signal JOIN own ON image_id = own.n),
taps AS (SELECT n, pad, scale, j, CASE WHEN k < 0 THEN -k - 1 WHEN k >= n THEN 2*n - k - 1 ELSE k END AS m, (k - j) / scale AS t FROM (SELECT *, unnest(range(-pad, n + pad)) AS k FROM (SELECT *, unnest(range(0, n)) AS j FROM lengths))),
kernel AS (SELECT n, pad, scale, j, m, sum(0.75 * exp(-t*t/2) * cos(2 * pi() * t)) / sqrt(scale) AS w FROM taps GROUP BY n, pad, scale, j, m),
krow AS (SELECT n, pad, scale, j, list(w ORDER BY m) AS w FROM kernel GROUP BY ALL),
plain AS (SELECT image_id, direction, channel, scale, line, j AS pos, list_dot_product(d, w) AS raw FROM signal JOIN own ON image_id = own.n JOIN krow ON krow.n = signal.n AND krow.pad = own.pad AND list_contains(scales, scale)),
coefs AS (SELECT image_id, direction, channel, scale, CAST(CASE direction WHEN 0 THEN line ELSE pos END AS INTEGER) AS y, CAST(CASE direction WHEN 0 THEN pos ELSE line END AS INTEGER) AS x, {_round("raw", 3)} AS c FROM plain)"""
_TASK_POINTS = _peaks(base=_TASK_COEFS, asked="(SELECT CASE axis WHEN 0 THEN by_rows ELSE by_cols END AND (sign = -1 OR of_max) FROM own WHERE own.n = image_id)")
_TASK_NEAR = _NEAR.replace("neighbours AS", "closest AS") + f""",
neighbours AS (SELECT closest.* FROM closest JOIN own ON image_id = own.n WHERE nbr_rank <= k)"""


def _graph_text(k: str) -> str:
    """texts: the head and a line a point of every group of more than one point."""
    return f""",
sized AS (SELECT {_G}, count(*) AS n FROM points GROUP BY ALL HAVING count(*) > 1),
body AS (SELECT {_G}, point_idx + 7 AS line, point_idx || ' ' || any_value(x) || ' ' || any_value(y) || ' ' || string_agg(CAST(nbr_idx AS VARCHAR), ', ' ORDER BY nbr_rank) || ' ' || string_agg(printf('%.2f', {_round('sqrt(d2)', 2)}), ', ' ORDER BY nbr_rank) AS text FROM neighbours GROUP BY {_G}, point_idx),
texts AS (SELECT {_G}, CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS line, unnest(['Масштаб: ' || scale, 'Канал: ' || ['Red', 'Green', 'Blue'][channel + 1], 'Тип экстремумов: ' || extreme_type, 'Количество соседей (k): ' || {k}, 'Всего точек: ' || n, '', 'Индекс точки, X координата, Y координата, Индексы соседей, Расстояния до соседей']) AS text FROM sized
  UNION ALL SELECT * FROM body)"""


#: seen: every pixel of each contour's image, with the contour's box and whether an odd number of edges lie to the right of it.
_CONTOURS = """
vertices AS (SELECT o_orderkey // 500 AS contour_id, o_orderkey % 500 AS place, 10 + (2 + o_totalprice % 1000 / 100) * cos(2 * pi() * (o_orderkey % 500) / 500) AS x, 25 + 2 * (2 + o_totalprice % 1000 / 100) * sin(2 * pi() * (o_orderkey % 500) / 500) AS y FROM orders),
edges AS (SELECT contour_id, x AS xa, y AS ya, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY contour_id ORDER BY place)) AS xb, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY contour_id ORDER BY place)) AS yb FROM vertices WINDOW w AS (PARTITION BY contour_id ORDER BY place)),
box AS (SELECT contour_id, contour_id % 10 AS image_id, greatest(0, round_even(min(x), 0)) AS x1, greatest(0, round_even(min(y), 0)) AS y1, greatest(0, round_even(max(x), 0)) AS x2, greatest(0, round_even(max(y), 0)) AS y2 FROM vertices GROUP BY ALL HAVING count(*) >= 3),
crossed AS (SELECT contour_id, yy AS y, list((xb - xa) * (yy - ya) / (yb - ya) + xa) AS cuts FROM edges, (SELECT unnest(range(0, 128)) AS yy) WHERE (ya > yy) <> (yb > yy) GROUP BY ALL),
seen AS (SELECT b.*, p.channel, p.y, p.x, p.v, coalesce(len(list_filter(cuts, lambda c: c > p.x)) % 2 = 1, false) AS inside FROM box b JOIN pixels p USING (image_id) LEFT JOIN crossed c ON c.contour_id = b.contour_id AND c.y = p.y)"""


def _with(parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts.strip()}\n{select}"


def _inside(x: str = "x", y: str = "y") -> str:
    """Even-odd rule for the triangle (2,2) (18,6) (6,30)."""
    points = [(2.0, 2.0), (18.0, 6.0), (6.0, 30.0)]
    each = [f"CAST((({ya} > {y}) <> ({yb} > {y})) AND {x} < ({xb} - {xa}) * ({y} - {ya}) / ({yb} - {ya}) + {xa} AS INTEGER)" for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]])]
    return f"({' + '.join(each)}) % 2 = 1"


def _raw(axis: int, sign: int) -> str:
    y, x = ("line", "pos") if axis == 0 else ("pos", "line")
    return _with(_axes(), f"SELECT {_M}, {y} AS y, {x} AS x FROM marked WHERE knot AND axis = {axis} AND sign = {sign}")


def _env(axis: int, sign: int) -> str:
    """Envelopes of one axis and sign; a line's knots are a list, so that nothing is joined but lines."""
    line, pos = ("y", "x") if axis == 0 else ("x", "y")
    key, right = f"{_M}, line", "CAST(greatest(1, least(earlier, len(k) - 1)) AS BIGINT)"
    return _with(
        f"""{_base()},
own AS (SELECT {_M}, {line} AS line, {pos} AS pos, {sign} * c AS c FROM coefs),
near AS (SELECT *, coalesce(c > lag(c) OVER w AND c > lead(c) OVER w, false) AS knot FROM own WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
counted AS (SELECT *, count(*) FILTER (knot) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM near),
knots AS (SELECT {key}, coalesce(list({{'p': pos, 'c': c}} ORDER BY pos) FILTER (knot), []) AS k FROM near GROUP BY {key}),
placed AS (SELECT {key}, pos, c, len(k) AS n, k[{right}] AS a, k[{right} + 1] AS b FROM counted JOIN knots USING ({key}))""",
        f"""SELECT {key}, pos, {_round(f"{sign} * CASE WHEN n = 0 THEN c WHEN n < 4 THEN 0.0 ELSE (b.c - a.c) / CAST(b.p - a.p AS DOUBLE) * CAST(pos - a.p AS DOUBLE) + a.c END", 6)} AS env FROM placed""",
    )


_LONG = f"{_PIXELS},{_signals()}"
_TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_orderkey % 5 <> 0 AS has_image, CASE WHEN o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 7 END AS n, o_orderkey % 4 = 0 AS colours FROM orders)"""

SQL: dict[str, str] = {
    "pixels": _with(_PIXELS, "SELECT * FROM pixels"),
    "pixel_lookup": _with(_PIXELS + "," + _WIDE, "SELECT image_id, y, x, CAST(r AS SMALLINT) AS r, CAST(g AS SMALLINT) AS g, CAST(b AS SMALLINT) AS b, format('#{:02x}{:02x}{:02x}', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS colour FROM wide JOIN (SELECT event_id % 30 AS image_id, event_id // 30 % 80 - 3 AS y, event_id // 7 % 26 - 2 AS x FROM events) USING (image_id, y, x)"),
    "crop_rect": _with(_PIXELS, "SELECT image_id, channel, y - 3 AS y, x - 2 AS x, v FROM pixels WHERE y >= 3 AND y < 20 AND x >= 2 AND x < 14"),
    "crop_polygon": _with(_PIXELS, f"SELECT image_id, channel, y - 2 AS y, x - 2 AS x, CASE WHEN {_inside()} THEN v ELSE 0.0 END AS v FROM pixels WHERE y >= 2 AND y < 30 AND x >= 2 AND x < 18"),
    "mask_polygon_white": _with(_PIXELS, f"SELECT image_id, channel, y, x, CASE WHEN {_inside()} THEN v ELSE 255.0 END AS v FROM pixels"),
    "gs_basis": f"WITH pairs AS (SELECT p_partkey AS n, {_PAIR} FROM part),{_bases('pairs')} SELECT n AS p_partkey, channel, axis, {_round('weight', 9)} AS weight FROM (SELECT n, unnest([0,0,0,1,1,1,2,2,2]) AS channel, unnest([0,1,2,0,1,2,0,1,2]) AS axis, unnest([u0, w0, c0, u1, w1, c1, u2, w2, c2]) AS weight FROM bases)",
    "gs_apply": _with(f"{_PIXELS},{_WIDE},{_BASIS},{_CHANGED}", f"SELECT image_id, channel, y, x, {_round('v', 6)} AS v FROM changed"),
    "basis_applied": _with(f"{_PIXELS},{_WIDE},{_BASIS},{_CHANGED}", "SELECT image_id, bool_or(p.v <> c.v) AS applied FROM pixels p JOIN changed c USING (image_id, channel, y, x) GROUP BY 1"),
    "scale_range": """WITH ranges AS (SELECT o_orderkey, 1 + o_orderkey % 4 AS a, o_orderkey % 13 - 1 AS b, CASE WHEN o_orderkey % 5 = 0 THEN -2 ELSE 1 + o_orderkey % 3 END AS d FROM orders)
SELECT o_orderkey, CAST((v - a) // d AS INTEGER) AS scale_idx, CAST(v AS DOUBLE) AS scale, CAST(v AS VARCHAR) AS scale_label FROM (SELECT *, unnest(range(a, b + 1, d)) AS v FROM ranges)""",
    "scale_text": """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, i) - 1 AS INTEGER) AS scale_idx, scale, CAST(scale AS VARCHAR) AS scale_label
FROM (SELECT o_custkey, o_orderkey, unnest([0, 1]) AS i, unnest([CAST(o_orderkey % 90 + 1 AS DOUBLE), (o_orderkey % 7 + 1) / 2]) AS scale FROM orders WHERE o_orderkey % 4 <> 0)""",
    "row_means": _with(_LONG, f"SELECT image_id, direction, channel, line, {_round('avg(v)', 9)} AS mean FROM cells WHERE direction = 0 GROUP BY ALL"),
    "col_means": _with(_LONG, f"SELECT image_id, direction, channel, line, {_round('avg(v)', 9)} AS mean FROM cells WHERE direction = 1 GROUP BY ALL"),
    "center_rows": _with(_LONG, f"SELECT image_id, direction, channel, line, pos, {_round('d', 6)} AS v FROM centred WHERE direction = 0"),
    "center_cols": _with(_LONG, f"SELECT image_id, direction, channel, line, pos, {_round('d', 6)} AS v FROM centred WHERE direction = 1"),
    "kernel": _with(f"{_PIXELS},{_signals()},{_kernel()}", f"SELECT CAST(n AS INTEGER) AS n, scale, CAST(j AS INTEGER) AS j, CAST(m AS INTEGER) AS m, {_round('w', 9)} AS w FROM kernel"),
    "morlet_rows": _with(_base(), "SELECT * FROM coefs WHERE direction = 0"),
    "morlet_cols": _with(_base(), "SELECT * FROM coefs WHERE direction = 1"),
    "reflect_index": _with(_LONG, "SELECT image_id, direction, channel, line, CAST(unnest(range(-15, n + 15)) AS INTEGER) AS k, CAST(unnest(list_transform(range(-15, n + 15), lambda k: CASE WHEN k < 0 THEN -k - 1 WHEN k >= n THEN 2*n - k - 1 ELSE k END)) AS INTEGER) AS m FROM (SELECT image_id, direction, channel, line, count(*) AS n FROM cells GROUP BY ALL)"),
    "morlet_sql": _with(_base(), "SELECT * FROM coefs"),
    "morlet_mirrored_each": _with(_base(taps="range(-CAST(7 * s // 2 + 1 AS BIGINT), n + CAST(7 * s // 2 + 1 AS BIGINT))"), "SELECT * FROM coefs"),
    "morlet_unpadded": _with(_base(taps="range(0, n)"), "SELECT * FROM coefs"),
    "means_text": _with(_LONG, "SELECT image_id, 'mean_to_' || CASE direction WHEN 0 THEN 'rows' ELSE 'cols' END || '_by_channel_' || channel AS file, line, CAST(avg(v) AS VARCHAR) AS text FROM cells GROUP BY image_id, direction, channel, line"),
    "coef_text": _with(_base(), f"SELECT {_M}, CAST(CASE direction WHEN 0 THEN line ELSE pos END AS INTEGER) AS line, string_agg(printf('%.3f', raw), ',' ORDER BY CASE direction WHEN 0 THEN pos ELSE line END) AS text FROM plain GROUP BY {_M}, CASE direction WHEN 0 THEN line ELSE pos END"),
    "row_max": _raw(0, 1),
    "row_min": _raw(0, -1),
    "col_max": _raw(1, 1),
    "col_min": _raw(1, -1),
    "extreme_counts": _with(_axes(), f"SELECT {_M}, CASE WHEN sign = 1 THEN 'max' ELSE 'min' END || CASE WHEN axis = 0 THEN '_by_row' ELSE '_by_column' END AS extreme_type, count(*) AS n_points FROM marked WHERE knot GROUP BY ALL"),
    "env_upper_rows": _env(0, 1),
    "env_lower_rows": _env(0, -1),
    "env_upper_cols": _env(1, 1),
    "env_lower_cols": _env(1, -1),
    "peaks_max_rows": _with(_peaks(), "SELECT * FROM points WHERE extreme_type = 'max_by_row'"),
    "peaks_min_rows": _with(_peaks(), "SELECT * FROM points WHERE extreme_type = 'min_by_row'"),
    "peaks_max_cols": _with(_peaks(), "SELECT * FROM points WHERE extreme_type = 'max_by_column'"),
    "peaks_min_cols": _with(_peaks(), "SELECT * FROM points WHERE extreme_type = 'min_by_column'"),
    "point_total": _with(_peaks(), "SELECT image_id, count(*) AS n_points FROM points GROUP BY ROLLUP (image_id)"),
    "knn": _with(_peaks() + _NEAR, f"SELECT {_G}, point_idx, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_idx, {_round('sqrt(d2)', 6)} AS distance FROM neighbours"),
    "knn_edges": _with(_peaks() + _NEAR, f"SELECT {_G}, point_idx, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_idx, x, y, nbr_x, nbr_y, {_round('sqrt(d2)', 6)} AS distance FROM neighbours"),
    "knn_degree": _with(_peaks() + _NEAR, f"SELECT {_G}, count(*) AS n_connections, count(DISTINCT point_idx) AS n_points FROM neighbours GROUP BY ALL"),
    "channel_text": _with(_PIXELS, "SELECT image_id, 'Исходный_цветовой_канал_' || ['Red', 'Green', 'Blue'][channel + 1] AS file, y AS line, string_agg(CAST(CAST(v AS INTEGER) AS VARCHAR), ',' ORDER BY x) AS text FROM pixels GROUP BY image_id, channel, y"),
    "points_text": _with(_peaks(), f"SELECT {_G}, point_idx AS line, x || ', ' || y AS text FROM points"),
    "knn_text": _with(_peaks() + _NEAR + _graph_text("5"), "SELECT * FROM texts"),
    "task_coefs": _with(_TASK_COEFS, "SELECT image_id AS task_id, * EXCLUDE (image_id) FROM coefs"),
    "task_points": _with(_TASK_POINTS, "SELECT image_id AS task_id, * EXCLUDE (image_id) FROM points"),
    "task_neighbours": _with(_TASK_POINTS + _TASK_NEAR, f"SELECT image_id AS task_id, {_G.removeprefix('image_id, ')}, point_idx, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_idx, {_round('sqrt(d2)', 6)} AS distance FROM neighbours"),
    "task_files": _with(
        _TASK_POINTS + _TASK_NEAR + _graph_text("(SELECT k FROM own WHERE own.n = image_id)"),
        f"""SELECT 'ВП_' || stamp || '/' || s_name || ' ' || stamp || '/Scale_' || scale AS folder, file, line, text FROM (
  SELECT image_id, scale, 'Расчет_вейвлетов_' || ['Str', 'Tr'][direction + 1] || '_Масштаб_' || scale || '_' || ['Красный', 'Зелёный', 'Синий'][channel + 1] AS file, CAST(CASE direction WHEN 0 THEN line ELSE pos END AS INTEGER) AS line, string_agg(printf('%.3f', raw), ',' ORDER BY CASE direction WHEN 0 THEN pos ELSE line END) AS text
    FROM plain GROUP BY {_M}, CASE direction WHEN 0 THEN line ELSE pos END
  UNION ALL SELECT image_id, scale, ['Str', 'Tr'][direction + 1] || CASE extreme_type WHEN 'max_by_row' THEN '_Точки_максимума_по_строкам' WHEN 'max_by_column' THEN '_Точки_максимума_по_cтолбцам' WHEN 'min_by_row' THEN '_Точки_минимума_по_строкам' ELSE '_Точки_минимума_по_cтолбцам' END || '_масштаб_' || scale || '_' || ['Красный', 'Зелёный', 'Синий'][channel + 1], point_idx, x || ', ' || y FROM points
  UNION ALL SELECT image_id, scale, 'KNN_' || ['Str', 'Tr'][direction + 1] || '_Info_Scale_' || scale || '_Channel_' || ['Red', 'Green', 'Blue'][channel + 1] || '_' || extreme_type, line, text FROM texts)
JOIN (SELECT n, s_name, printf('01_%02d_2024_%02d_30', n % 12 + 1, n % 24) AS stamp FROM own) ON image_id = n""",
    ),
    "crop_contours": _with(f"{_PIXELS},{_CONTOURS}", "SELECT contour_id, channel, CAST(y - y1 AS INTEGER) AS y, CAST(x - x1 AS INTEGER) AS x, CASE WHEN inside THEN v ELSE 0.0 END AS v FROM seen WHERE y >= y1 AND y < y2 AND x >= x1 AND x < x2"),
    "mask_contours": _with(f"{_PIXELS},{_CONTOURS}", "SELECT contour_id, channel, y, x, CASE WHEN inside THEN v ELSE 255.0 END AS v FROM seen"),
    "output_codes": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 10 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS code FROM orders",
    "duration_fmt": "SELECT o_orderkey, printf('%d ч %02d м %02d с', s // 3600, s % 3600 // 60, s % 60) AS duration FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)",
    "clamp_values": "SELECT o_orderkey, greatest(50000.0::DOUBLE, least(150000.0::DOUBLE, o_totalprice)) AS v FROM orders",
    "cropped_names": r"""SELECT page_id, CASE WHEN lower(regexp_extract(stem, '([^/\\]*)$', 1)) LIKE '%cropped%' THEN url ELSE stem || '_cropped' || suffix END AS name
FROM (SELECT *, url[:len(url) - len(suffix)] AS stem FROM (SELECT page_id, url, regexp_extract(url, '[^/\\.][^/\\]*(\.[^./\\]*)$', 1) AS suffix FROM pages))""",
    "image_scan": _with(_PIXELS, "SELECT * FROM pixels WHERE image_id % 4 <> 3"),
    "channel_choice": _with(_LONG, f"SELECT image_id, direction, channel, line, pos, {_round('v', 6)} AS v FROM cells WHERE channel IN (0, 2)"),
    "result_folders": f"""WITH {_TASKS} SELECT task_id, CAST(s AS DOUBLE) AS scale, 'ВП_' || stamp || '/Задача ' || task_id || ' ' || stamp || '/Scale_' || s AS folder
FROM (SELECT task_id, unnest(range(1, n + 1)) AS s, strftime(o_orderdate, '%d_%m_%Y_%H_%M') AS stamp FROM tasks JOIN orders ON task_id = o_orderkey WHERE n IS NOT NULL)""",
    "scale_summary": f"""WITH {_TASKS} SELECT task_id, n AS n_scales, CASE WHEN n <= 5 THEN array_to_string(s, ', ') ELSE list_min(s) || '..' || list_max(s) END AS summary
FROM (SELECT task_id, n, list_transform(range(1, n + 1), lambda i: i * 5 % 8) AS s FROM tasks WHERE n IS NOT NULL)""",
    "task_states": f"WITH {_TASKS} SELECT task_id, colours, CASE WHEN NOT has_image THEN 'waiting image' WHEN n IS NULL THEN 'waiting scales' WHEN colours THEN 'ready to compute' ELSE 'ready to configure' END AS status FROM tasks",
    "ready_tasks": f"WITH {_TASKS} SELECT count(*) AS n_tasks, count(*) FILTER (has_image AND n IS NOT NULL) AS n_ready, bool_and(has_image AND n IS NOT NULL) AS all_ready FROM tasks",
    "dbscan": _with(_peaks() + _CLUSTERS, "SELECT * FROM clusters", recursive=True),
    "cluster_counts": _with(_peaks() + _CLUSTERS, f"SELECT {_G}, CAST(max(label) + 1 AS INTEGER) AS n_clusters FROM clusters GROUP BY ALL", recursive=True),
    "centroids": _with(_peaks() + _CLUSTERS, f"SELECT {_G}, label, {_round('avg(x)', 6)} AS x, {_round('avg(y)', 6)} AS y, count(*) AS n_points FROM clusters WHERE label >= 0 GROUP BY {_G}, label", recursive=True),
    "argmax": _with(_base(), f"SELECT * FROM coefs QUALIFY c = max(c) OVER (PARTITION BY {_M})"),
    "pipeline_points": _with(_peaks("changed"), "SELECT * FROM points"),
}
