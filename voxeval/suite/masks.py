"""Thresholds, morphology, components: R4-R11."""

from __future__ import annotations

from voxeval import fixtures as fx
from voxeval.operators import masks as K
from voxeval.session import stage
from voxeval.suite.base import query
from voxeval.suite.rasters import MASK16, mask16

OFFS = "(VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx)"
IN16 = "z BETWEEN 0 AND 15 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7"


def erode_sql(src: str) -> str:
    return f"SELECT uid, z, y, x FROM (SELECT uid, z + dz AS z, y + dy AS y, x + dx AS x FROM {src}, {OFFS}) GROUP BY uid, z, y, x HAVING count(*) = 7"


def dilate_sql(src: str) -> str:
    return f"SELECT DISTINCT uid, z, y, x FROM (SELECT uid, z + dz AS z, y + dy AS y, x + dx AS x FROM {src}, {OFFS}) WHERE {IN16}"


def otsu_sql(src: str) -> str:
    """Threshold table of ``src`` (uid, v)."""
    return f"""SELECT uid, CASE WHEN hi > lo THEN c ELSE lo END AS thr FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY b DESC, bin) AS r FROM (
        SELECT *, coalesce(w0 * (w - w0) * power(m0 / w0 - (m - m0) / nullif(w - w0, 0), 2e0), 0e0) AS b FROM (
        SELECT uid, lo, hi, bin, c, sum(n) OVER u AS w0, sum(n) OVER t AS w, sum(n * c) OVER u AS m0, sum(n * c) OVER t AS m FROM (
        SELECT uid, lo, hi, bin, lo + (bin + 5e-1) * (hi - lo) / 256e0 AS c, count(*)::DOUBLE AS n FROM (
        SELECT uid, lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 256e0), 255)::INTEGER ELSE 0 END AS bin FROM (
        SELECT uid, v, min(v) OVER (PARTITION BY uid) AS lo, max(v) OVER (PARTITION BY uid) AS hi FROM {src})) GROUP BY uid, lo, hi, bin)
        WINDOW u AS (PARTITION BY uid ORDER BY bin ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY uid)))) WHERE r = 1"""


@query("r4_otsu", "uid:i thr:d6", otsu_sql("stack16"), ["stack16"])
def r4(spark, sf):
    return K.otsu(fx.stack16(spark, sf))


_CAP = """SELECT uid, z, y, x, v, least(v, hi) AS c, hi, p60 FROM (SELECT *, quantile_cont(v, 995e-3) OVER (PARTITION BY uid) AS hi,
    quantile_cont(v, 6e-1) OVER (PARTITION BY uid) AS p60 FROM stack16)"""


@query("r5_foreground_mask", "uid:i z:i y:i x:i", """SELECT uid, z, y, x FROM (SELECT *, count(*) FILTER (c > t) OVER (PARTITION BY uid) AS n FROM (
    SELECT cap.*, greatest(thr, hi * 8e-2) AS t FROM cap JOIN th ON cap.uid = th.uid)) WHERE CASE WHEN n < 300 THEN v > p60 ELSE c > t END""", ["stack16"],
       [("cap", _CAP), ("th", otsu_sql("(SELECT uid, c AS v FROM cap)"))])
def r5(spark, sf):
    return K.foreground_mask(fx.stack16(spark, sf), 300)


@query("r5_fallback_after_open", "uid:i z:i y:i x:i", """SELECT uid, z, y, x FROM (SELECT cap.*, o.uid IS NOT NULL AS inn, count(o.uid) OVER (PARTITION BY cap.uid) AS n
    FROM cap LEFT JOIN o ON o.uid = cap.uid AND o.z = cap.z AND o.y = cap.y AND o.x = cap.x) WHERE CASE WHEN n < 20 THEN v > p60 ELSE inn END""", ["stack16"], [
    ("cap", _CAP), ("th", otsu_sql("(SELECT uid, c AS v FROM cap)")),
    ("m", "SELECT cap.uid, z, y, x FROM cap JOIN th ON cap.uid = th.uid WHERE c > greatest(thr, hi * 8e-2)"), ("e", erode_sql("m")), ("o", dilate_sql("e"))])
def r5o(spark, sf):
    """The threshold mask opened first; then volumes with little left fall back."""
    vox = stage(fx.stack16(spark, sf))
    return K.with_fallback(K.open_(stage(K.foreground_mask(vox, 0)), 1, fx.STACK16), vox, 20)


@query("r6_erode", "uid:i z:i y:i x:i", erode_sql("m"), ["stack16"], [("m", MASK16)])
def r6(spark, sf):
    return K.erode(mask16(spark, sf))


@query("r7_dilate", "uid:i z:i y:i x:i", dilate_sql("d1"), ["stack16"], [("m", "SELECT * FROM stack16 WHERE v > 17e-1"), ("d1", dilate_sql("m"))])
def r7(spark, sf):
    return K.dilate(mask16(spark, sf, 1.7), 2, fx.STACK16)


@query("r8_open", "uid:i z:i y:i x:i", dilate_sql("e"), ["stack16"], [("m", MASK16), ("e", erode_sql("m"))])
def r8o(spark, sf):
    return K.open_(mask16(spark, sf), 1, fx.STACK16)


@query("r8_close", "uid:i z:i y:i x:i", erode_sql("d"), ["stack16"], [("m", MASK16), ("d", dilate_sql("m"))])
def r8c(spark, sf):
    return K.close_(mask16(spark, sf), 1, fx.STACK16)


_NEAR = f"SELECT r.uid, r.z + dz AS z, r.y + dy AS y, r.x + dx AS x, r.lab FROM reach r, {OFFS}"


@query("r9_largest_component", "uid:i z:i y:i x:i", """SELECT l.uid, z, y, x FROM labs l JOIN (SELECT uid, lab FROM (SELECT uid, lab, row_number() OVER (
    PARTITION BY uid ORDER BY count(*) DESC, lab) AS r FROM labs GROUP BY uid, lab) WHERE r = 1) b ON l.uid = b.uid AND l.lab = b.lab""", ["stack16"], [
    ("m", "SELECT uid, z, y, x FROM stack16 WHERE v > 14e-1"),
    ("reach", f"""SELECT uid, z, y, x, (z * 8 + y) * 8 + x AS lab FROM m UNION SELECT n.uid, n.z, n.y, n.x, n.lab FROM ({_NEAR}) n
        JOIN m ON m.uid = n.uid AND m.z = n.z AND m.y = n.y AND m.x = n.x"""),
    ("labs", "SELECT uid, z, y, x, min(lab) AS lab FROM reach GROUP BY uid, z, y, x"),
], recursive=True)
def r9(spark, sf):
    return K.largest_component(mask16(spark, sf, 1.4), fx.STACK16)


@query("r10_fill_holes", "uid:i z:i y:i x:i", "SELECT uid, z, y, x FROM stack16 s WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.uid = s.uid AND r.z = s.z AND r.y = s.y AND r.x = s.x)",
       ["stack16"], [
    ("b", "SELECT uid, z, y, x FROM stack16 WHERE NOT v > 8e-1"),
    ("reach", f"""SELECT uid, z, y, x, 0 AS lab FROM b WHERE z IN (0, 15) OR y IN (0, 7) OR x IN (0, 7) UNION SELECT n.uid, n.z, n.y, n.x, n.lab FROM ({_NEAR}) n
        JOIN b ON b.uid = n.uid AND b.z = n.z AND b.y = n.y AND b.x = n.x"""),
], recursive=True)
def r10(spark, sf):
    return K.fill_holes(mask16(spark, sf, 0.8), fx.stack16(spark, sf), fx.STACK16)


@query("r11_extent", "uid:i first_z:i last_z:i first_y:i last_y:i first_x:i last_x:i n:i vertex:i", """SELECT uid, min(z) AS first_z, max(z) AS last_z, min(y) AS first_y,
    max(y) AS last_y, min(x) AS first_x, max(x) AS last_x, count(*) AS n, max(z) AS vertex FROM stack16 WHERE v > 17e-1 GROUP BY uid""", ["stack16"])
def r11(spark, sf):
    return K.extent(mask16(spark, sf, 1.7))


@query("r11_vertex_band", "uid:i z:i y:i x:i note:i", """SELECT uid, z, y, x, CASE WHEN n < 50 THEN 1 ELSE 0 END AS note FROM (SELECT *, count(*) FILTER (b) OVER (PARTITION BY uid) AS n
    FROM (SELECT *, z BETWEEN lo AND greatest(round_even(t - 25e0 / 10e0, 0), lo + 1) AS b FROM (SELECT *, greatest(round_even(t - 125e0 / 10e0, 0), 0e0) AS lo FROM (
    SELECT uid, z, y, x, max(z) OVER (PARTITION BY uid) AS t FROM stack16 WHERE v > 16e-1)))) WHERE b OR n < 50""", ["stack16"])
def r11b(spark, sf):
    return K.vertex_band(mask16(spark, sf, 1.6), 10.0)
