"""DuckDB SQL that the registered raster queries are held against, written independently of them."""

from __future__ import annotations

import re

from rasterel.functions.color import FROM_LAB, FROM_LMS, TO_LAB, TO_LMS

from .fixtures import COLORS, REGIONS, SQL

_PRIMES = (3, 5, 7, 11, 13, 17, 19)


def _sum(*names: str) -> str:
    return "CAST(sum(" + " + ".join(f"CAST({n} AS BIGINT) * {p}" for n, p in zip(names, _PRIMES)) + ") AS BIGINT) AS checksum"


def _r(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def _row(row, names) -> str:
    return " + ".join(f"({c!r}) * {n}" for c, n in zip(row, names))


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, CAST(2.4 AS DOUBLE)) END)"


def _srgb(x: str) -> str:
    clamped = f"greatest(least({x}, CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE))"
    return f"CAST(round((CASE WHEN {clamped} <= 0.0031308 THEN {clamped} * 12.92 ELSE 1.055 * power({clamped}, CAST(1 AS DOUBLE) / 2.4) - 0.055 END) * 255) AS BIGINT)"


def _lab_ctes(source: str, keep: str = "*", prefix: str = "ok_") -> str:
    """CTEs lab_lin, lab_lms and lab: source with Oklab columns."""
    lms = ", ".join(f"cbrt({_row(m, ('lr', 'lg', 'lb'))}) AS c{k}" for k, m in enumerate(TO_LMS))
    lab = ", ".join(f"{_row(m, ('c0', 'c1', 'c2'))} AS {prefix}{n}" for n, m in zip("lab", TO_LAB))
    return f"""lab_lin AS (SELECT {keep}, CAST({_linear('r')} AS DOUBLE) AS lr, CAST({_linear('g')} AS DOUBLE) AS lg, CAST({_linear('b')} AS DOUBLE) AS lb FROM {source}),
lab_lms AS (SELECT *, {lms} FROM lab_lin),
lab AS (SELECT *, {lab} FROM lab_lms)"""


def _back(l: str, a: str, b: str) -> list[str]:  # noqa: E741
    """8-bit channels of an Oklab colour."""
    cubes = [f"power({_row(m, (l, a, b))}, 3)" for m in FROM_LAB]
    return [_srgb(f"({_row(m, cubes)})") for m in FROM_LMS]


def _with(ctes: str, body: str, source: str = SQL) -> str:
    return f"WITH RECURSIVE {source}{', ' + ctes if ctes else ''}\n{body}"


SHEETS = "sheets AS (SELECT CAST(floor(image_id / 4.0) AS BIGINT) AS image_id, x + 24 * (image_id % 2) AS x, y + 24 * CAST(floor((image_id % 4) / 2.0) AS BIGINT) AS y, r, g, b, a FROM sprites)"
REGION_ROWS = "regions AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {x0}, {y0}, {x1}, {y1}, CAST({c} AS DOUBLE))" for k, x0, y0, x1, y1, c in REGIONS) + ") v(kind, x0, y0, x1, y1, confidence))"
WEIGHTED = REGION_ROWS + """, weighted AS (
  SELECT s.*, coalesce(max(q.confidence), CAST(0 AS DOUBLE)) AS weight, coalesce(bool_or(q.kind IN ('face', 'eye', 'sunglasses')), false) AS critical
  FROM sprites s LEFT JOIN regions q ON s.x >= q.x0 AND s.x < q.x1 AND s.y >= q.y0 AND s.y < q.y1 GROUP BY ALL)"""
PALETTE = "pal_rgb AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(COLORS)) + ") v(idx, r, g, b))"


def _boxes(side: int) -> str:
    return f"""bx AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM src WHERE a >= 96 GROUP BY image_id),
fit AS (SELECT *, greatest(least(round((x1 - x0) * least({side}.0 / (x1 - x0), {side}.0 / (y1 - y0))), {side}), 1) AS fw,
               greatest(least(round((y1 - y0) * least({side}.0 / (x1 - x0), {side}.0 / (y1 - y0))), {side}), 1) AS fh FROM bx),
cell AS (SELECT f.image_id, tx.i AS tx, ty.i AS ty, CAST(fw AS BIGINT) AS fw, CAST(fh AS BIGINT) AS fh,
    x0 + tx.i * (x1 - x0) // CAST(fw AS BIGINT) AS rx0, greatest(x0 + (tx.i + 1) * (x1 - x0) // CAST(fw AS BIGINT), x0 + tx.i * (x1 - x0) // CAST(fw AS BIGINT) + 1) AS rx1,
    y0 + ty.i * (y1 - y0) // CAST(fh AS BIGINT) AS ry0, greatest(y0 + (ty.i + 1) * (y1 - y0) // CAST(fh AS BIGINT), y0 + ty.i * (y1 - y0) // CAST(fh AS BIGINT) + 1) AS ry1
  FROM fit f, (SELECT unnest(range(0, {side})) AS i) tx, (SELECT unnest(range(0, {side})) AS i) ty WHERE tx.i < fw AND ty.i < fh),
celled AS (SELECT c.image_id, c.tx, c.ty, s.* EXCLUDE (image_id), s.a >= 96 AS fg FROM cell c JOIN src s ON s.image_id = c.image_id AND s.x >= c.rx0 AND s.x < c.rx1 AND s.y >= c.ry0 AND s.y < c.ry1)"""


def _mode(weight: str = "a / 255.0") -> str:
    return f"""cov AS (SELECT image_id, tx, ty, avg(CAST(fg AS DOUBLE)) AS coverage FROM celled GROUP BY ALL),
votes AS (SELECT image_id, tx, ty, r, g, b, round(sum({weight}), 9) AS w FROM celled WHERE fg AND a > 0 GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY image_id, tx, ty ORDER BY w DESC, r, g, b) = 1),
mode AS (SELECT cov.image_id, cov.tx, cov.ty, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a, coverage
  FROM cov LEFT JOIN best USING (image_id, tx, ty))"""


def _frame(op: str, value: str, axis: str, source: str, radius: int, name: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"SELECT *, {op}({value}) OVER (PARTITION BY image_id, {other} ORDER BY {axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS {name} FROM {source}"


EIGHT = "nb8 AS (SELECT * FROM (VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) v(dx, dy))"
BODY = "body AS (SELECT image_id, x, y FROM sprites WHERE a >= 96)"


def _ball(shape: str) -> str:
    return f"ball AS (SELECT dx.i AS dx, dy.i AS dy FROM (SELECT unnest(range(-2, 3)) AS i) dx, (SELECT unnest(range(-2, 3)) AS i) dy WHERE {shape})"


GROWN = "grown AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM body, ball WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23)"
RING = EIGHT + ", " + BODY + """, ring AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM body, nb8 WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23
  EXCEPT SELECT image_id, x, y FROM body)"""
RULED = RING + """, touch AS (SELECT r.image_id, r.x, r.y, count(*) FILTER (WHERE dx * dy = 0) AS sides, count(*) FILTER (WHERE dx * dy <> 0) AS corners
  FROM ring r, nb8 JOIN body b ON b.image_id = r.image_id AND b.x = r.x + dx AND b.y = r.y + dy GROUP BY ALL),
ruled AS (SELECT image_id, x, y FROM touch WHERE sides > 0 OR corners <> 1)"""
_SUM_XY = "SELECT image_id, count(*) AS pixels, " + _sum("x", "y")


def _flood(points: str, eight: bool) -> str:
    """CTEs up to flood (image_id, x, y, label): rounds over runs of pixels that keep the smallest label a run has seen."""
    k = int(eight)
    return f"""pts AS ({points}),
isl AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS i FROM pts),
runs AS (SELECT image_id, y, i, min(x) AS b, max(x) AS e FROM isl GROUP BY image_id, y, i),
near AS (SELECT f.image_id, f.y, f.b, n.y AS ny, n.b AS nb FROM runs f JOIN runs n ON f.image_id = n.image_id AND n.y IN (f.y - 1, f.y + 1) AND n.b <= f.e + {k} AND n.e >= f.b - {k}),
spread(image_id, y, b, label) USING KEY (image_id, y, b) AS (
  SELECT image_id, y, b, y * 4294967296 + b FROM runs
  UNION
  SELECT c.image_id, c.ny, c.nb, min(f.label) FROM spread f JOIN near c ON c.image_id = f.image_id AND c.y = f.y AND c.b = f.b
    JOIN recurring.spread o ON o.image_id = c.image_id AND o.y = c.ny AND o.b = c.nb
  WHERE f.label < o.label GROUP BY c.image_id, c.ny, c.nb),
flood AS (SELECT p.image_id, p.x, p.y, s.label FROM isl p JOIN runs u USING (image_id, y, i) JOIN spread s ON s.image_id = u.image_id AND s.y = u.y AND s.b = u.b)"""


FG_POINTS = "SELECT image_id, x, y FROM sprites WHERE a >= 96"


def _orphans() -> str:
    return f"""{EIGHT}, own AS (SELECT *, (r * 65536 + g * 256 + b) * 256 + a AS c, a >= 96 AS m FROM sprites),
seen AS (SELECT o.image_id, o.x, o.y, n.c FROM own o, nb8 JOIN own n ON n.image_id = o.image_id AND n.x = o.x + dx AND n.y = o.y + dy AND n.m WHERE o.m),
tops AS (SELECT image_id, x, y, c FROM (SELECT image_id, x, y, c, count(*) AS k FROM seen GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY k DESC, c) = 1),
fixed AS (SELECT o.*, CASE WHEN o.m AND (o.x + o.y) % 5 <> 0 AND t.c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.image_id = o.image_id AND s.x = o.x AND s.y = o.y AND s.c = o.c) THEN t.c ELSE o.c END AS f
  FROM own o LEFT JOIN tops t USING (image_id, x, y))"""


JAGGY = """bars AS (SELECT image_id, x, y, CASE WHEN y < 12 OR (y = 12 AND (x * 7 + image_id) % 5 = 0) THEN 10 ELSE 200 END AS r FROM sprites),
near AS (SELECT *, lag(r) OVER h AS w, lead(r) OVER h AS e, lag(r) OVER v AS n, lead(r) OVER v AS s FROM bars
  WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)),
near2 AS (SELECT *, lag(n) OVER h AS nw, lead(n) OVER h AS ne, lag(s) OVER h AS sw, lead(s) OVER h AS se FROM near WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
judged AS (SELECT *, coalesce((n = r)::INT, 0) + coalesce((s = r)::INT, 0) + coalesce((w = r)::INT, 0) + coalesce((e = r)::INT, 0) AS same,
  coalesce((n <> r)::INT, 0) + coalesce((s <> r)::INT, 0) + coalesce((w <> r)::INT, 0) + coalesce((e <> r)::INT, 0) AS other,
  coalesce(n = r AND nw = r AND ne = r, false) OR coalesce(s = r AND sw = r AND se = r, false) OR coalesce(w = r AND nw = r AND sw = r, false) OR coalesce(e = r AND ne = r AND se = r, false) AS flat FROM near2),
done AS (SELECT image_id, x, y, CASE WHEN same = 1 AND flat AND other >= 3 THEN 210 - r ELSE r END AS r FROM judged)"""


def _cleanup(rounds: int) -> str:
    """CTEs px0 to px<2 * rounds> (image_id, x, y, m, c): the rule for lone pixels and the one for jagged edges in turn."""
    ctes = [EIGHT, "px0 AS (SELECT image_id, x, y, a >= 96 AS m, (r * 65536 + g * 256 + b) * 256 + a AS c FROM sprites)"]
    for k in range(rounds):
        p, q, r = f"px{2 * k}", f"px{2 * k + 1}", f"px{2 * k + 2}"
        ctes.append(f"""n{p} AS MATERIALIZED (SELECT o.image_id, o.x, o.y, o.c, n.c AS d, count(*) AS k FROM {p} o, nb8 JOIN {p} n ON n.image_id = o.image_id AND n.x = o.x + dx AND n.y = o.y + dy AND n.m WHERE o.m GROUP BY ALL),
t{p} AS (SELECT image_id, x, y, arg_min(d, struct_pack(k := -k, d := d)) AS d FROM n{p} GROUP BY image_id, x, y HAVING NOT bool_or(c = d)),
{q} AS MATERIALIZED (SELECT o.image_id, o.x, o.y, o.m, coalesce(t.d, o.c) AS c FROM {p} o LEFT JOIN t{p} t ON t.image_id = o.image_id AND t.x = o.x AND t.y = o.y)""")
        ctes.append(f"""v{q} AS (SELECT *, CASE WHEN m THEN c END AS v FROM {q}),
h{q} AS (SELECT *, lag(v) OVER h AS w, lead(v) OVER h AS e, lag(v) OVER u AS n, lead(v) OVER u AS s FROM v{q} WINDOW h AS (PARTITION BY image_id, y ORDER BY x), u AS (PARTITION BY image_id, x ORDER BY y)),
d{q} AS (SELECT *, lag(n) OVER h AS nw, lead(n) OVER h AS ne, lag(s) OVER h AS sw, lead(s) OVER h AS se FROM h{q} WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
j{q} AS (SELECT *, coalesce((n = v)::INT, 0) + coalesce((s = v)::INT, 0) + coalesce((w = v)::INT, 0) + coalesce((e = v)::INT, 0) AS same, list_sort(list_filter([n, s, w, e], lambda z: z IS NOT NULL AND z <> v)) AS o,
  coalesce(n = v AND nw = v AND ne = v, false) OR coalesce(s = v AND sw = v AND se = v, false) OR coalesce(w = v AND nw = v AND sw = v, false) OR coalesce(e = v AND ne = v AND se = v, false) AS flat FROM d{q}),
{r} AS MATERIALIZED (SELECT image_id, x, y, m, CASE WHEN m AND same = 1 AND flat AND len(o) = 3 AND o[1] = o[3] THEN o[1] ELSE c END AS c FROM j{q})""")
    return ", ".join(ctes)


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["raster_allocation"] = """
SELECT p_partkey AS image_id, count(*) AS pixels, CAST(sum(gx.i) AS BIGINT) AS sum_x, CAST(sum(gy.i) AS BIGINT) AS sum_y, CAST(0 AS BIGINT) AS max_a
FROM part, (SELECT unnest(range(0, 7)) AS i) gx, (SELECT unnest(range(0, 5)) AS i) gy WHERE gx.i < p_size % 7 AND gy.i < p_size % 5 GROUP BY p_partkey"""
    q["pixel_limit_guard"] = """
SELECT p_partkey, CAST(p_size AS BIGINT) * 997 AS width, p_partkey % 3000 AS height, CAST(p_size AS BIGINT) * 997 * (p_partkey % 3000) > 67108864 AS too_large FROM part"""
    q["task_list_parse"] = """
SELECT c_custkey AS line_no, c_name AS id, c_mktsegment || '.png' AS input, CASE WHEN c_custkey % 3 = 0 THEN '48x32' END AS size,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS BIGINT) END AS max_colors FROM customer WHERE c_custkey % 10 <> 0"""
    q["resume_join"] = """
SELECT c_custkey AS line_no, coalesce(s_suppkey % 2 = 0, false) AS cached FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"""
    base = "'out/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.v1' ELSE '' END"
    ending = "CASE WHEN p_partkey % 3 = 2 THEN '' ELSE '.png' END"
    q["artifact_names"] = f"""
SELECT p_partkey, {base} || {ending} AS final_png, {base} || '.body.png' AS body, {base} || '.body-mask.png' AS body_mask, {base} || '.outline-mask.png' AS outline_mask,
  {base} || '.preview.png' AS preview, {base} || '.report.json' AS report, {base} || '.gpl' AS palette,
  {base} || '_r' || (p_partkey % 4) || 'c' || (p_partkey % 6) || '.png' AS cell FROM part"""
    q["palette_file_text"] = _with("c AS (SELECT DISTINCT image_id, r, g, b FROM sprites WHERE a > 0)", """
SELECT image_id, 'GIMP Palette' || chr(10) || 'Name: rasterel character-48 s' || image_id || chr(10) || 'Columns: 8' || chr(10) || '#' || chr(10) ||
  string_agg(lpad(CAST(r AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(g AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(b AS VARCHAR), 3, ' ') || chr(9) || '#' || lower(printf('%02x%02x%02x', r, g, b)) || chr(10), '' ORDER BY r, g, b) AS content
FROM c GROUP BY image_id""")
    q["mask_from_sprite"] = _with("", """
SELECT image_id, count(*) FILTER (WHERE a = 255 AND r + g + b > 0) AS mask_pixels, count(*) FILTER (WHERE a = 255 AND NOT (r = 30 AND g = 25 AND b = 20)) AS body_pixels FROM sprites GROUP BY image_id""")
    q["hex_colors"] = """
WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 7919 % 16777216 WHEN 1 THEN p_partkey * 104729 % 4294967296 WHEN 4 THEN p_partkey * 31 % 16777216 END AS v, p_partkey % 5 = 1 AS long FROM part),
c AS (SELECT p_partkey, CASE WHEN long THEN v // 256 ELSE v END AS rgb, CASE WHEN v IS NULL THEN NULL WHEN long THEN v % 256 ELSE 255 END AS a FROM t)
SELECT p_partkey, rgb // 65536 AS r, rgb // 256 % 256 AS g, rgb % 256 AS b, a, CASE WHEN rgb IS NOT NULL THEN '#' || upper(printf('%06x', rgb)) END AS text FROM c"""
    q["size_texts"] = """
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 70 WHEN 1 THEN p_partkey % 31 END AS a, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 9 WHEN 1 THEN p_partkey % 11 END AS b FROM part)
SELECT p_partkey, CASE WHEN a > 0 AND b > 0 THEN a END AS first, CASE WHEN a > 0 AND b > 0 THEN b END AS second FROM t"""
    little = " || ".join(f"unhex(printf('%02x', (p_partkey * 7) // {256**k} % 256))" for k in range(8))
    texts = " || ".join(f"encode({c}) || unhex('00')" for c in ("p_name", "p_brand", "p_type", "'a'", "''"))
    q["content_hashes"] = f"""
SELECT p_partkey, sha256(p_name) AS content, sha256(sha256(p_name) || '#r' || (p_partkey % 5) || 'c' || (p_partkey % 3)) AS cell, sha256({texts} || {little}) AS key FROM part"""
    q["target_arithmetic"] = """
SELECT p_partkey, greatest(256 // greatest(p_partkey % 300, p_size, 1), 1) AS preview, greatest(p_partkey % 60 - 2 * (p_size % 3 + 1), 0) AS body_w,
  CAST(greatest(p_size - 2 * (p_size % 3 + 1), 0) AS BIGINT) AS body_h, greatest(p_partkey % 16 - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END, 1) AS budget FROM part"""
    q["status_merge"] = """
WITH s AS (SELECT p_type, max(CASE WHEN p_partkey % 11 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS s FROM part GROUP BY p_type)
SELECT p_type, CASE s WHEN 2 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS status, CAST(CASE s WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS exit_code FROM s"""
    colors = "colors AS (SELECT DISTINCT r, g, b FROM sprites)"
    grey = [sum(m * (((128 / 255 + 0.055) / 1.055) ** 2.4 * sum(row)) ** (1 / 3) for m, row in zip(lab, TO_LMS)) for lab in TO_LAB]
    q["oklab_projection"] = _with(f"{colors}, {_lab_ctes('colors')}", f"""
SELECT r, g, b, {_r('ok_l')} AS ok_l, {_r('ok_a')} AS ok_a, {_r('ok_b')} AS ok_b, {_r(' + '.join(f'power(ok_{n} - ({v!r}), 2)' for n, v in zip('lab', grey)))} AS d2 FROM lab""")
    one, two = _back("ok_l", "ok_a", "ok_b"), _back("l2", "ok_a", "ok_b")
    q["oklab_roundtrip"] = _with(f"{colors}, {_lab_ctes('colors')}, lit AS (SELECT *, least(ok_l * 0.5 + 0.6, CAST(1 AS DOUBLE)) AS l2 FROM lab)", f"""
SELECT r, g, b, {one[0]} AS r1, {one[1]} AS g1, {one[2]} AS b1, {two[0]} AS r2, {two[1]} AS g2, {two[2]} AS b2 FROM lit""")
    step = _back("l4", "ok_a", "ok_b")
    stepped = f"""{_lab_ctes('fgpx')}, lit AS (SELECT *, round(ok_l * 3) / 3 AS l4 FROM lab), post AS (SELECT image_id, x, y, {step[0]} AS r, {step[1]} AS g, {step[2]} AS b FROM lit)"""
    q["posterize_bands"] = _with(f"fgpx AS (SELECT * FROM sprites WHERE a >= 96), {stepped}", f"""
SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS colors, {_sum('r', 'g', 'b', 'x', 'y')} FROM post GROUP BY image_id""")
    again = _lab_ctes("post").replace("lab_lin", "lin2").replace("lab_lms", "lms2").replace("lab AS", "lab2 AS")
    flat = _back("ok_l", "ma", "mb")
    q["flat_bands"] = _with(f"""fgpx AS (SELECT * FROM sprites WHERE a >= 96), {stepped}, {again},
banded AS (SELECT *, avg(ok_a) OVER w AS ma, avg(ok_b) OVER w AS mb FROM (SELECT *, CAST(least(greatest(round(ok_l * 3), 0), 3) AS INT) AS band FROM lab2) z WINDOW w AS (PARTITION BY image_id, band)),
out AS (SELECT image_id, {flat[0]} AS r2, {flat[1]} AS g2, {flat[2]} AS b2 FROM banded)""", f"""
SELECT image_id, count(DISTINCT r2 * 65536 + g2 * 256 + b2) AS colors, {_sum('r2', 'g2', 'b2')} FROM out GROUP BY image_id""")
    q["fg_mask_count"] = _with("", "SELECT image_id, count(*) AS fg_pixels FROM sprites WHERE a >= 96 GROUP BY image_id")
    q["alpha_coverage"] = _with("c AS (SELECT image_id, avg(CAST(a < 255 AS DOUBLE)) AS v FROM sprites GROUP BY image_id)", f"""
SELECT image_id, {_r('v')} AS alpha_coverage, CASE WHEN v > 0.01 THEN 'alpha' ELSE 'corner-background' END AS mask_source FROM c""")
    q["fg_bbox"] = _with("", "SELECT image_id, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) + 1 AS BIGINT) AS x1, CAST(max(y) + 1 AS BIGINT) AS y1 FROM sprites WHERE a >= 96 GROUP BY image_id")
    q["corner_background_mask"] = _with("""bg AS (SELECT image_id, list_sort(list(r))[3] AS bg_r, list_sort(list(g))[3] AS bg_g, list_sort(list(b))[3] AS bg_b FROM sprites WHERE x IN (0, 23) AND y IN (0, 23) GROUP BY image_id)""", """
SELECT image_id, CAST(bg_r AS BIGINT) AS bg_r, CAST(bg_g AS BIGINT) AS bg_g, CAST(bg_b AS BIGINT) AS bg_b, count(*) FILTER (WHERE abs(r - bg_r) + abs(g - bg_g) + abs(b - bg_b) > 72) AS fg_pixels, 'corner-background' AS mask_source
FROM sprites JOIN bg USING (image_id) GROUP BY image_id, bg_r, bg_g, bg_b""")
    q["alpha_binary"] = _with("", "SELECT image_id, bool_and(a IN (0, 255)) AS is_binary, bool_and(a = 0) AS is_empty FROM sprites GROUP BY image_id")
    q["line_occupancy"] = _with("", "SELECT image_id, CAST(x AS BIGINT) AS x, bool_or(a <> 0) AS occupied FROM sprites GROUP BY image_id, x")
    edge = "(y = 0)::INT + (y = 23)::INT + (x = 0)::INT + (x = 23)::INT"
    q["reserved_border"] = _with("", f"""
SELECT image_id, count(*) FILTER (WHERE a >= 96 AND (x < 4 OR y < 4 OR x >= 20 OR y >= 20)) AS border_pixels, CAST(coalesce(sum({edge}) FILTER (WHERE a >= 96), 0) AS BIGINT) AS edge_pixels,
  {_r('avg(CAST(a >= 96 AS DOUBLE))')} AS foreground_ratio, {_r(f'coalesce(sum({edge}) FILTER (WHERE a >= 96), 0) / CAST(96 AS DOUBLE)')} AS edge_ratio FROM sprites GROUP BY image_id""")
    q["distinct_colors"] = _with("", "SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS palette_colors FROM sprites WHERE a >= 96 GROUP BY image_id")
    q["final_color_union"] = _with(SHEETS + ", c AS (SELECT DISTINCT image_id, r, g, b FROM sheets WHERE a > 0)", """
SELECT image_id, count(*) AS colors, min(r * 65536 + g * 256 + b) // 65536 AS r, min(r * 65536 + g * 256 + b) // 256 % 256 AS g, min(r * 65536 + g * 256 + b) % 256 AS b FROM c GROUP BY image_id""")
    q["dominant_color"] = _with("c AS (SELECT image_id, r, g, b, a, count(*) AS n FROM sprites WHERE a > 0 GROUP BY ALL)", """
SELECT image_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a, n FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b, a) = 1""")
    mean = _back("ml", "ma", "mb")
    q["oklab_means"] = _with(f"""vis AS (SELECT * FROM sprites WHERE a > 0), {_lab_ctes('vis')},
agg AS (SELECT image_id, {', '.join(f'max(ok_{c}) - min(ok_{c}) AS s{c}, sum(a / CAST(255 AS DOUBLE) * ok_{c}) / sum(a / CAST(255 AS DOUBLE)) AS m{c}' for c in 'lab')} FROM lab GROUP BY image_id)""", f"""
SELECT image_id, CASE WHEN sl >= sa AND sl >= sb THEN 'l' WHEN sa >= sb THEN 'a' ELSE 'b' END AS channel, {_r('greatest(sl, sa, sb)')} AS span, {mean[0]} AS r, {mean[1]} AS g, {mean[2]} AS b FROM agg""")
    q["color_histogram"] = _with(WEIGHTED + ", h AS (SELECT image_id, critical, r, g, b, a / CAST(255 AS DOUBLE) * (1 + 3 * weight) AS w, count(*) AS n FROM weighted WHERE a >= 96 GROUP BY ALL)", f"""
SELECT image_id, critical, count(*) AS entries, CAST(sum(n) AS BIGINT) AS pixels, {_r('sum(w * n)')} AS weight FROM h GROUP BY image_id, critical""")
    q["sheet_histogram"] = _with(SHEETS, f"""
SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS colors, count(*) AS pixels, {_r('sum(a / CAST(255 AS DOUBLE))')} AS weight FROM sheets WHERE a >= 96 GROUP BY image_id""")
    plain = "src AS (SELECT * FROM sprites)"
    cells = "CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a"
    q["mode_sample_cells"] = _with(f"{WEIGHTED}, src AS (SELECT * FROM weighted), {_boxes(9)}, {_mode('a / CAST(255 AS DOUBLE) * (1 + 3 * weight)')}", f"SELECT image_id, {cells}, {_r('coverage')} AS coverage FROM mode")
    q["mode_sample_upscaled"] = _with(f"{plain}, {_boxes(30)}, {_mode()}", f"SELECT image_id, count(*) AS cells, count(*) FILTER (WHERE coverage >= 0.5) AS solid, {_sum('r', 'g', 'b', 'a', 'tx', 'ty')} FROM mode GROUP BY image_id")
    light = ", ".join(f"sum(a / CAST(255 AS DOUBLE) * {_linear(c)}) FILTER (WHERE fg) / nullif(sum(a / CAST(255 AS DOUBLE)) FILTER (WHERE fg), 0) AS l{c}" for c in "rgb")
    q["area_sample_cells"] = _with(f"{plain}, {_boxes(8)}, m AS (SELECT image_id, tx, ty, avg(CAST(fg AS DOUBLE)) AS coverage, {light} FROM celled GROUP BY ALL)", f"""
SELECT image_id, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, {', '.join(f"CASE WHEN l{c} IS NULL THEN 0 ELSE {_srgb('l' + c)} END AS {c}" for c in 'rgb')}, CAST(CASE WHEN lr IS NULL THEN 0 ELSE 255 END AS BIGINT) AS a, {_r('coverage')} AS coverage FROM m""")
    q["reconstructed_body"] = _with(f"""{plain}, {_boxes(20)}, {_mode()}, p AS (SELECT m.image_id, 2 + (20 - CAST(fw AS BIGINT)) // 2 + tx AS x, 2 + 20 - CAST(fh AS BIGINT) + ty AS y, r, g, b FROM mode m JOIN fit USING (image_id) WHERE coverage >= 0.5)""", f"""
SELECT image_id, count(*) AS body_pixels, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(y) AS BIGINT) AS y1, {_sum('r', 'g', 'b', 'x', 'y')} FROM p GROUP BY image_id""")
    q["mode_sample_summary"] = _with(f"{plain}, {_boxes(16)}, {_mode()}, n AS (SELECT image_id, r, g, b, a, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id) AS body_pixels FROM mode WHERE coverage >= 0.5 GROUP BY image_id, r, g, b, a)", """
SELECT image_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a, n, CAST(body_pixels AS BIGINT) AS body_pixels FROM n QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b, a) = 1""")
    q["feature_weights"] = _with(WEIGHTED, f"SELECT image_id, count(*) FILTER (WHERE critical) AS critical, {_r('sum(weight)')} AS weight FROM weighted GROUP BY image_id")
    q["critical_cells"] = _with("", "SELECT DISTINCT image_id, CAST(x // 5 AS BIGINT) AS tx, CAST(y // 5 AS BIGINT) AS ty FROM sprites WHERE (x // 5 * 5 < 18 AND x // 5 * 5 + 5 > 6 AND y // 5 * 5 < 18 AND y // 5 * 5 + 5 > 6)")

    def sliced(row: str, col: str, x0: str, y0: str) -> str:
        return _with(f"{SHEETS}, c AS (SELECT image_id, {row} AS cell_row, {col} AS cell_col, x, y, r, g, b, a FROM sheets), d AS (SELECT * REPLACE (x - {x0} AS x, y - {y0} AS y) FROM c)", f"""
SELECT image_id, CAST(cell_row AS BIGINT) AS cell_row, CAST(cell_col AS BIGINT) AS cell_col, count(*) AS pixels, CAST(max(x) AS BIGINT) AS max_x, CAST(max(y) AS BIGINT) AS max_y, {_sum('r', 'g', 'b', 'a', 'x', 'y')} FROM d GROUP BY image_id, cell_row, cell_col HAVING max(a) > 0""")

    q["sheet_slice_grid"] = sliced("((y + 1) * 5 - 1) // 48", "((x + 1) * 7 - 1) // 48", "cell_col * 48 // 7", "cell_row * 48 // 5")
    q["sheet_slice_cell"] = sliced("y // 20", "x // 13", "cell_col * 13", "cell_row * 20")

    def bands(axis: str) -> str:
        return f"SELECT image_id, 1 + count(*) FILTER (WHERE gap >= 1) AS n FROM (SELECT image_id, p - lag(p) OVER (PARTITION BY image_id ORDER BY p) - 1 AS gap FROM (SELECT DISTINCT image_id, {axis} AS p FROM clean) z) z2 GROUP BY image_id"

    q["detect_grid"] = _with(f"{SHEETS}, clean AS (SELECT * FROM sheets WHERE a = 255 AND r <> 30 AND (x % 24 - 12) * (x % 24 - 12) + (y % 24 - 12) * (y % 24 - 12) <= 49), br AS ({bands('y')}), bc AS ({bands('x')})", """
SELECT image_id, br.n AS rows, bc.n AS cols FROM br JOIN bc USING (image_id) WHERE br.n * bc.n >= 2 AND br.n <= 16 AND bc.n <= 16""")
    q["crop_region"] = _with("c AS (SELECT image_id, x - 15 AS x, y - 7 AS y, r, g, b, a FROM sprites WHERE x >= 15 AND y BETWEEN 7 AND 12)", f"SELECT image_id, count(*) AS pixels, {_sum('r', 'g', 'b', 'a', 'x', 'y')} FROM c GROUP BY image_id")
    q["upscale_preview"] = _with("u AS (SELECT image_id, x * 3 + dx.i AS x, y * 3 + dy.i AS y, r, g, b, a FROM sprites, (SELECT unnest(range(0, 3)) AS i) dx, (SELECT unnest(range(0, 3)) AS i) dy WHERE a > 0)", f"SELECT image_id, count(*) AS pixels, {_sum('r', 'g', 'b', 'a', 'x', 'y')} FROM u GROUP BY image_id")
    q["row_major_order"] = _with("n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS n FROM sprites WHERE a = 255)", "SELECT image_id, max(n) AS pixels, CAST(sum(n * (x + 31 * y)) AS BIGINT) AS checksum FROM n GROUP BY image_id")
    steps = [("min", "r", "x", "sprites", 2, "l1"), ("min", "l1", "y", "w1", 2, "low"), ("max", "r", "x", "w2", 2, "h1"), ("max", "h1", "y", "w3", 2, "high"), ("max", "g", "x", "w4", 3, "g1"), ("max", "g1", "y", "w5", 3, "grown")]
    q["window_min_max"] = _with(", ".join(f"w{k + 1} AS ({_frame(*s)})" for k, s in enumerate(steps)), """
SELECT image_id, CAST(sum(low) AS BIGINT) AS low, CAST(sum(high) AS BIGINT) AS high, CAST(sum(grown) AS BIGINT) AS grown, CAST(sum(low * x + high * y) AS BIGINT) AS checksum FROM w6 GROUP BY image_id""")
    median = """m1 AS (SELECT *, list(CAST(round(greatest(least(ok_l, CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)) * 255) AS INT)) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS line FROM lab),
m2 AS (SELECT *, list_sort(flatten(list(line) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))) AS every FROM m1),
m3 AS (SELECT * EXCLUDE (line, every), every[len(every) // 2 + 1] AS bin FROM m2)"""
    q["window_median"] = _with(f"{_lab_ctes('sprites')}, {median}", "SELECT image_id, CAST(sum(bin) AS BIGINT) AS bins, CAST(sum(bin * (x + 3 * y)) AS BIGINT) AS checksum FROM m3 GROUP BY image_id")
    ext = [("min", "ok_l", "x", "m3", 2, "l1"), ("min", "l1", "y", "e1", 2, "lo"), ("max", "ok_l", "x", "e2", 2, "h1"), ("max", "h1", "y", "e3", 2, "hi")]
    detail = _back("nl", "ok_a", "ok_b")
    q["preserve_details"] = _with(f"""{_lab_ctes('sprites')}, {median}, {', '.join(f'e{k + 1} AS ({_frame(*s)})' for k, s in enumerate(ext))},
wt AS (SELECT *, 1 / (1 + exp(-4 * ((1 - bin / CAST(255 AS DOUBLE)) + greatest(hi - bin / CAST(255 AS DOUBLE), 0) - greatest(bin / CAST(255 AS DOUBLE) - lo, 0)))) AS w FROM e4),
nl AS (SELECT *, greatest(least(lo + (hi - lo) * w, CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)) AS nl FROM wt WHERE a >= 96), out AS (SELECT image_id, x, y, {detail[0]} AS r2, {detail[1]} AS g2, {detail[2]} AS b2 FROM nl)""", f"""
SELECT image_id, count(*) AS pixels, {_sum('r2', 'g2', 'b2', 'x', 'y')} FROM out GROUP BY image_id""")
    q["weighted_median_split"] = _with("""k AS (SELECT image_id, a, row_number() OVER o AS k, sum(a) OVER (o ROWS UNBOUNDED PRECEDING) AS acc, sum(a) OVER (PARTITION BY image_id) AS total, count(*) OVER (PARTITION BY image_id) AS n
  FROM sprites WHERE a > 0 WINDOW o AS (PARTITION BY image_id ORDER BY g, r, b, a, y, x))""", "SELECT image_id, greatest(least(min(k) FILTER (WHERE 2 * acc >= total), max(n) - 1), 1) AS cut, max(n) AS n FROM k GROUP BY image_id")
    q["dilate8"] = _with(f"{BODY}, {_ball('true')}, {GROWN}", f"{_SUM_XY} FROM grown GROUP BY image_id")
    q["dilate4"] = _with(f"{BODY}, {_ball('abs(dx.i) + abs(dy.i) <= 2')}, {GROWN}", f"{_SUM_XY} FROM grown GROUP BY image_id")
    q["outline_ring"] = _with(RING, f"{_SUM_XY} FROM ring GROUP BY image_id")
    q["outline_corner_rule"] = _with(RULED, f"{_SUM_XY} FROM ruled GROUP BY image_id")
    q["internal_outline"] = _with(f"""fgpx AS (SELECT * FROM sprites WHERE a >= 96), {_lab_ctes('fgpx')},
pair AS (SELECT a.image_id, a.x, a.y, a.ok_l, b.x AS x2, b.y AS y2, b.ok_l AS l2 FROM lab a JOIN lab b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))
  WHERE power(a.ok_l - b.ok_l, 2) + power(a.ok_a - b.ok_a, 2) + power(a.ok_b - b.ok_b, 2) > 0.15 * 0.15),
edge AS (SELECT DISTINCT image_id, CASE WHEN ok_l <= l2 THEN x ELSE x2 END AS x, CASE WHEN ok_l <= l2 THEN y ELSE y2 END AS y FROM pair)""", f"{_SUM_XY} FROM edge GROUP BY image_id")
    q["orphan_merge"] = _with(_orphans(), f"SELECT image_id, {_sum('f // 16777216', 'f // 65536 % 256', 'f // 256 % 256', 'f % 256', 'x', 'y')} FROM fixed GROUP BY image_id")
    q["jaggy_cleanup"] = _with(JAGGY, f"SELECT image_id, {_sum('r', '50', '60', '255', 'x', 'y')}, count(*) FILTER (WHERE r = 10) AS dark FROM done GROUP BY image_id")
    q["cleanup_converged"] = _with(_cleanup(4), f"SELECT image_id, {_sum('c // 16777216', 'c // 65536 % 256', 'c // 256 % 256', 'c % 256', 'x', 'y')} FROM px8 GROUP BY image_id")
    q["neighbour_pairs"] = _with(f"{EIGHT}, soft AS (SELECT image_id, x, y FROM sprites WHERE a > 0 AND a < 255)", f"""
SELECT s.image_id, count(*) AS pairs, {_sum('s.x', 's.y', 'n.x', 'n.y')} FROM soft s, nb8 JOIN soft n ON n.image_id = s.image_id AND n.x = s.x + dx AND n.y = s.y + dy GROUP BY s.image_id""")
    q["outline_compare"] = _with(f"{RULED}, actual AS (SELECT * FROM sprites WHERE a > 0 AND a < 96)", """
SELECT image_id, count(*) FILTER (WHERE e.x IS NULL) AS extra, count(*) FILTER (WHERE t.a IS NULL) AS missing, count(*) FILTER (WHERE e.x IS NOT NULL AND t.a IS NOT NULL AND NOT (t.r = 30 AND t.g = 25 AND t.b = 20 AND t.a = 255)) AS mismatch
FROM actual t FULL JOIN ruled e USING (image_id, x, y) GROUP BY image_id""").replace("e.x IS", "e.image_id IS")
    q["compose_overlay"] = _with(f"""{RULED}, c AS (SELECT s.image_id, s.x, s.y, CASE WHEN u.x IS NOT NULL THEN 43 WHEN s.a >= 96 THEN s.r ELSE 0 END AS r, CASE WHEN u.x IS NOT NULL THEN 16 WHEN s.a >= 96 THEN s.g ELSE 0 END AS g,
  CASE WHEN u.x IS NOT NULL THEN 9 WHEN s.a >= 96 THEN s.b ELSE 0 END AS b, CASE WHEN u.x IS NOT NULL THEN 255 WHEN s.a >= 96 THEN s.a ELSE 0 END AS a FROM sprites s LEFT JOIN ruled u ON u.image_id = s.image_id AND u.x = s.x AND u.y = s.y)""", f"""
SELECT image_id, count(*) FILTER (WHERE a > 0) AS pixels, {_sum('r', 'g', 'b', 'a', 'x', 'y')} FROM c GROUP BY image_id""")
    q["component_count"] = _with(_flood(FG_POINTS, True), "SELECT image_id, count(DISTINCT label) AS components FROM flood GROUP BY image_id")
    q["component_count_by_runs"] = q["component_count"]
    q["small_component_filter"] = _with(_flood(FG_POINTS, True) + ", n AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM flood)", f"{_SUM_XY} FROM n WHERE n >= 3 GROUP BY image_id")
    skin = f"{_lab_ctes('sprites')}, skin AS (SELECT image_id, x, y FROM lab WHERE a >= 96 AND ok_l > 0.5 AND ok_l < 0.92 AND ok_a > 0.035 AND ok_b > 0.05 AND ok_b < 0.2), {_flood('SELECT * FROM skin', False)}"
    q["skin_face_bbox"] = _with(skin + ", c AS (SELECT image_id, label, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM flood GROUP BY image_id, label)", """
SELECT image_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM c WHERE (x1 - x0) * (y1 - y0) <= 192 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY size DESC, label) = 1""")
    dark = f"{_lab_ctes('sprites')}, dark AS (SELECT image_id, x, y FROM lab WHERE a >= 96 AND ok_l < 0.45 AND x BETWEEN 4 AND 19 AND y BETWEEN 4 AND 19), {_flood('SELECT * FROM dark', False)}"
    q["eye_blobs"] = _with(dark + ", c AS (SELECT image_id, label, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM flood GROUP BY image_id, label)", """
SELECT image_id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM c WHERE size >= 2 AND x1 - x0 <= 8""")
    second = re.sub(r"\b(pts|isl|runs|near|spread|flood)\b", r"\g<1>2", _flood("SELECT image_id, x, y FROM dark", False))
    q["heuristic_features"] = q["provider_features"] = _with(f"""{skin}, c AS (SELECT image_id, label, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM flood GROUP BY image_id, label),
face AS (SELECT image_id, x0, y0, x1, y1 FROM c WHERE (x1 - x0) * (y1 - y0) <= 192 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY size DESC, label) = 1),
dark AS (SELECT l.image_id, l.x, l.y FROM lab l JOIN face f ON f.image_id = l.image_id AND l.x >= f.x0 AND l.x < f.x1 AND l.y >= f.y0 AND l.y < f.y1 WHERE l.a >= 96 AND l.ok_l < 0.45), {second},
e AS (SELECT image_id, label, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM flood2 GROUP BY image_id, label),
found AS (SELECT image_id, 'face' AS kind, x0, y0, x1, y1, CAST(0.6 AS DOUBLE) AS confidence FROM face UNION ALL
  SELECT e.image_id, 'eye', e.x0, e.y0, e.x1, e.y1, CAST(0.5 AS DOUBLE) FROM e JOIN face f USING (image_id) WHERE e.size >= 2 AND e.x1 - e.x0 <= (f.x1 - f.x0) // 2)""", """
SELECT image_id, kind, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, confidence FROM found""")
    pal = _lab_ctes("pal_rgb", prefix="p").replace("lab_lin", "plin").replace("lab_lms", "plms").replace("lab AS", "pal AS")
    near = "power(c.ok_l - p.pl, 2) + power(c.ok_a - p.pa, 2) + power(c.ok_b - p.pb, 2)"
    q["nearest_palette_remap"] = _with(f"""{PALETTE}, {pal}, colors AS (SELECT DISTINCT r, g, b FROM sprites), {_lab_ctes('colors')},
best AS (SELECT c.r, c.g, c.b, p.r AS r2, p.g AS g2, p.b AS b2 FROM lab c, pal p QUALIFY row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY {near}, p.idx) = 1)""", """
SELECT image_id, CAST(r2 AS BIGINT) AS r, CAST(g2 AS BIGINT) AS g, CAST(b2 AS BIGINT) AS b, CAST(255 AS BIGINT) AS a, count(*) AS pixels FROM sprites JOIN best USING (r, g, b) WHERE sprites.a >= 96 GROUP BY image_id, r2, g2, b2""")
    q["exact_palette"] = _with("c AS (SELECT DISTINCT image_id, r, g, b FROM sprites WHERE a >= 96)", "SELECT image_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM c QUALIFY count(*) OVER (PARTITION BY image_id) <= 8")
    q["lloyd_round"] = _with(f"""{PALETTE}, {pal}, colors AS (SELECT image_id, r, g, b, count(*) AS n FROM sprites WHERE a >= 96 GROUP BY ALL), {_lab_ctes('colors')},
best AS (SELECT c.image_id, c.n, c.ok_l, c.ok_a, c.ok_b, p.idx FROM lab c, pal p QUALIFY row_number() OVER (PARTITION BY c.image_id, c.r, c.g, c.b ORDER BY {near}, p.idx) = 1),
moved AS (SELECT image_id, idx, sum(n * ok_l) / sum(n) AS l, sum(n * ok_a) / sum(n) AS a, sum(n * ok_b) / sum(n) AS b FROM best GROUP BY image_id, idx), ids AS (SELECT DISTINCT image_id FROM colors)""", f"""
SELECT ids.image_id, CAST(p.idx AS BIGINT) AS idx, {_r('coalesce(m.l, p.pl)')} AS l, {_r('coalesce(m.a, p.pa)')} AS a, {_r('coalesce(m.b, p.pb)')} AS b FROM ids CROSS JOIN pal p LEFT JOIN moved m ON m.image_id = ids.image_id AND m.idx = p.idx""")
    rounds = "c0 AS (SELECT ids.image_id, p.idx, p.pl AS l, p.pa AS a, p.pb AS b FROM ids CROSS JOIN pal p)"
    for k in range(3):
        far = "power(c.ok_l - p.l, 2) + power(c.ok_a - p.a, 2) + power(c.ok_b - p.b, 2)"
        rounds += f""",
b{k} AS (SELECT c.image_id, c.n, c.ok_l, c.ok_a, c.ok_b, p.idx FROM lab c JOIN c{k} p ON p.image_id = c.image_id QUALIFY row_number() OVER (PARTITION BY c.image_id, c.r, c.g, c.b ORDER BY {far}, p.idx) = 1),
m{k} AS (SELECT image_id, idx, sum(n * ok_l) / sum(n) AS l, sum(n * ok_a) / sum(n) AS a, sum(n * ok_b) / sum(n) AS b FROM b{k} GROUP BY image_id, idx),
c{k + 1} AS (SELECT p.image_id, p.idx, coalesce(m.l, p.l) AS l, coalesce(m.a, p.a) AS a, coalesce(m.b, p.b) AS b FROM c{k} p LEFT JOIN m{k} m ON m.image_id = p.image_id AND m.idx = p.idx)"""
    last = _back("l", "a", "b")
    q["lloyd_refine"] = _with(f"""{PALETTE}, {pal}, colors AS (SELECT image_id, r, g, b, count(*) AS n FROM sprites WHERE a >= 96 GROUP BY ALL), {_lab_ctes('colors')}, ids AS (SELECT DISTINCT image_id FROM colors), {rounds}""", f"""
SELECT DISTINCT image_id, {last[0]} AS r, {last[1]} AS g, {last[2]} AS b FROM c3""")
    q["qa_gate"] = _with("""p AS (SELECT image_id, x, y, r, g, b, CASE WHEN image_id % 3 = 0 THEN a WHEN a >= 96 THEN 255 ELSE 0 END AS a, a >= 96 AND image_id % 10 <> 0 AS body FROM sprites),
m AS (SELECT image_id, bool_and(a IN (0, 255)) AS is_binary, count(*) FILTER (WHERE body) AS body_pixels, count(DISTINCT CASE WHEN body THEN r * 65536 + g * 256 + b END) AS palette_colors,
  count(*) FILTER (WHERE body AND (x < 1 OR y < 1 OR x >= 23 OR y >= 23)) AS border FROM p GROUP BY image_id),
f AS (SELECT *, list_filter([CASE WHEN NOT is_binary THEN 'ALPHA_NOT_BINARY' END, CASE WHEN body_pixels = 0 THEN 'BODY_EMPTY' END, CASE WHEN border > 0 THEN 'BODY_IN_RESERVED_BORDER' END, CASE WHEN palette_colors > 9 THEN 'PALETTE_LIMIT_EXCEEDED' END,
  CASE WHEN image_id % 2 * (image_id % 7) > 0 THEN 'OUTLINE_EXTRA_PIXELS' END, CASE WHEN image_id % 5 = 0 THEN 'OUTLINE_MISSING_PIXELS' END], lambda v: v IS NOT NULL) AS fails,
  CASE WHEN image_id % 9 > 6 THEN 'BODY_COMPONENTS_EXCEEDED' WHEN image_id % 4 = 0 THEN 'SEMANTIC_CONFIDENCE_LOW' END AS review FROM m)""", """
SELECT image_id, body_pixels, palette_colors, border AS body_pixels_in_reserved_border, CASE WHEN len(fails) > 0 THEN 'fail' WHEN review IS NOT NULL THEN 'review' ELSE 'pass' END AS status,
  CASE WHEN len(fails) > 0 THEN array_to_string(fails, ',') ELSE coalesce(review, '') END AS reasons FROM f""")
    q["inspect_sprites"] = _with(f"""{_flood(FG_POINTS, True)}, k AS (SELECT image_id, count(DISTINCT label) AS n FROM flood GROUP BY image_id),
clean AS (SELECT * FROM sprites WHERE a <> 0), br AS ({bands('y')}), bc AS ({bands('x')}), g AS (SELECT image_id FROM br JOIN bc USING (image_id) WHERE br.n * bc.n >= 2 AND br.n <= 16 AND bc.n <= 16),
m AS (SELECT image_id, avg(CAST(a < 255 AS DOUBLE)) AS cov, avg(CAST(a >= 96 AS DOUBLE)) AS fg, coalesce(sum({edge}) FILTER (WHERE a >= 96), 0) AS edge FROM sprites GROUP BY image_id)""", f"""
SELECT m.image_id, {_r('cov')} AS alpha_coverage, {_r('fg')} AS foreground_ratio, {_r('edge / CAST(96 AS DOUBLE)')} AS edge_ratio, coalesce(k.n, 0) AS component_estimate, edge > 0 AS touches_border, (g.image_id IS NOT NULL OR coalesce(k.n, 0) >= 6) AS is_sprite_sheet,
  CASE WHEN cov > 0.01 THEN 'flat-reconstruct' ELSE 'semantic' END AS suggested_mode, CAST(CASE WHEN cov <= 0.01 THEN 0.4 WHEN edge / 96.0 > 0.1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence,
  CAST((edge > 0)::INT + (g.image_id IS NOT NULL OR coalesce(k.n, 0) > 4)::INT AS BIGINT) AS warnings FROM m LEFT JOIN k USING (image_id) LEFT JOIN g USING (image_id)""")
    q["tiles_roundtrip"] = _with("", f"SELECT image_id, count(*) AS pixels, {_sum('r', 'g', 'b', 'a', 'x', 'y')} FROM sprites GROUP BY image_id")
    return q
