"""The chain from scans to crops and metadata: R2 to R17 composed."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.operators import preprocess as P
from voxeval.operators import rasters as R
from voxeval.session import stage
from voxeval.suite.base import clip, query
from voxeval.suite.masks import OFFS, erode_sql, otsu_sql
from voxeval.suite.rasters import by_scanner, full_sql, kernel_rows, scanned, spaced_sql

LIMITS = P.Limits(tiny=175, band=120, near=38, midline=340, slab=380, reach_y=8.0, reach_x=8.0)
OUT = (14, 12, 12)
#: Spacing in mm along z, y, x of three kinds of scanner, by uid.
SCANNERS = ((4.0, 4.0, 4.0), (3.0, 5.0, 4.0), (4.5, 1.5, 6.0))
COARSE = [R.coarse_shape(fx.CUBE16, s, R.COARSE) for s in SCANNERS]
CELLS = tuple(max(c[i] for c in COARSE) for i in range(3))


def bumped(spark, sf):
    """Volumes with a bright middle of four kinds, none among them; every seventh volume has no signal."""
    z, y, x = (F.col(c) for c in "zyx")
    amp = F.element_at(F.array(F.lit(0.0), F.lit(3.0), F.lit(6.0), F.lit(2.0)), (F.col("uid") % 4).cast("int") + 1)
    bump = amp * F.exp(-((z - 7) * (z - 7) / 16.0 + (y - 8) * (y - 8) / 12.0 + (x - 7) * (x - 7) / 12.0))
    return fx.cube16(spark, sf).withColumn("v", F.when(F.col("uid") % 7 == 3, 0.0).otherwise(F.col("v") * 0.3 + bump))


_SRC = """SELECT f.uid, f.z, f.y, f.x, CASE WHEN s.uid IS NULL OR f.uid % 7 = 3 THEN 0e0 ELSE f.v * 3e-1 + (CASE f.uid % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 3e0 WHEN 2 THEN 6e0 ELSE 2e0 END)
    * exp(-((f.z - 7) * (f.z - 7) / 16e0 + (f.y - 8) * (f.y - 8) / 12e0 + (f.x - 7) * (f.x - 7) / 12e0)) END AS v
    FROM full16 f LEFT JOIN cube16 s ON s.uid = f.uid AND s.z = f.z AND s.y = f.y AND s.x = f.x"""


def _coarse_blur(sigma: float) -> list:
    return [(axis, " UNION ALL ".join(f"SELECT {c} AS c, o, i, w FROM {kernel_rows(sigma, shape[i], 'reflect')}" for c, shape in enumerate(COARSE))) for i, axis in enumerate("zyx")]


def _grow(src: str) -> str:
    return f"SELECT DISTINCT d.uid, d.z, d.y, d.x FROM (SELECT uid, z + dz AS z, y + dy AS y, x + dx AS x FROM {src}, {OFFS}) d JOIN sm ON sm.uid = d.uid AND sm.z = d.z AND sm.y = d.y AND sm.x = d.x"


def _same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("uid", "z", "y", "x"))


def _reach(src: str, start: str, name: str) -> str:
    near = f"SELECT r.uid, r.z + dz AS z, r.y + dy AS y, r.x + dx AS x, r.lab FROM {name} r, {OFFS}"
    return f"{start} UNION SELECT n.uid, n.z, n.y, n.x, n.lab FROM ({near}) n JOIN {src} m ON {_same('m', 'n')}"


def _per_scanner(values: list) -> str:
    return "CASE uid % 3 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_BORDER = " OR ".join(f"{axis} IN (0, {_per_scanner([s[i] - 1 for s in COARSE])})" for i, axis in enumerate("zyx"))
CHAIN = [
    ("full16", full_sql("cube16", fx.CUBE16)), ("src", _SRC), ("small", spaced_sql("src", SCANNERS, fx.CUBE16)), ("sm0", by_scanner("small", _coarse_blur(1.0))), ("sm2", by_scanner("small", _coarse_blur(1.5))),
    ("sm", """SELECT s.uid, z, y, x, v, least(v, hi) AS c, hi, p60 FROM sm0 s JOIN (SELECT uid, quantile_cont(v, 995e-3) AS hi, quantile_cont(v, 6e-1) AS p60 FROM sm0 GROUP BY uid) q
        ON q.uid = s.uid WHERE hi > 0"""),
    ("th", otsu_sql("(SELECT uid, c AS v FROM sm)")), ("m0", "SELECT sm.uid, z, y, x FROM sm JOIN th ON th.uid = sm.uid WHERE c > greatest(thr, hi * 8e-2)"),
    ("e1", erode_sql("m0")), ("o1", _grow("e1")), ("reach1", _reach("o1", "SELECT uid, z, y, x, (z * 100 + y) * 100 + x AS lab FROM o1", "reach1")),
    ("labs", "SELECT uid, z, y, x, min(lab) AS lab FROM reach1 GROUP BY uid, z, y, x"),
    ("big", """SELECT l.uid, z, y, x FROM labs l JOIN (SELECT uid, lab FROM (SELECT uid, lab, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, lab) AS r
        FROM labs GROUP BY uid, lab) WHERE r = 1) b ON l.uid = b.uid AND l.lab = b.lab"""),
    ("d1", _grow("big")), ("d2", _grow("d1")), ("c1", erode_sql("d2")), ("c2", erode_sql("c1")),
    ("back", f"SELECT uid, z, y, x FROM sm WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE {_same('c2', 'sm')})"),
    ("reach2", _reach("back", f"SELECT uid, z, y, x, 0 AS lab FROM back WHERE {_BORDER}", "reach2")),
    ("filled", f"SELECT uid, z, y, x FROM c2 UNION ALL SELECT uid, z, y, x FROM back WHERE NOT EXISTS (SELECT 1 FROM reach2 r WHERE {_same('r', 'back')})"),
    ("m", f"""SELECT uid, z, y, x, v, n < {LIMITS.tiny} AS fell FROM (SELECT sm.*, f.uid IS NOT NULL AS inn, count(f.uid) OVER (PARTITION BY sm.uid) AS n FROM sm LEFT JOIN filled f ON {_same('f', 'sm')})
        WHERE CASE WHEN n < {LIMITS.tiny} THEN v > p60 ELSE inn END"""),
    ("band", f"""SELECT uid, z, y, x, CASE WHEN n < {LIMITS.band} THEN 1 ELSE 0 END AS note, t FROM (SELECT *, count(*) FILTER (b) OVER (PARTITION BY uid) AS n FROM (
        SELECT *, z BETWEEN lo AND greatest(round_even(t - 25e0 / 4e0, 0), lo + 1) AS b FROM (SELECT *, greatest(round_even(t - 125e0 / 4e0, 0), 0e0) AS lo FROM (
        SELECT *, max(z) OVER (PARTITION BY uid) AS t FROM m)))) WHERE b OR n < {LIMITS.band}"""),
    ("mid", "SELECT uid, avg(y) AS cy, avg(x) AS cx, max(t) AS top, max(note) AS note FROM band GROUP BY uid"),
    ("near", f"""SELECT m.uid, m.z, m.y, m.x, s.v, c.cx, c.top, c.note, b.uid IS NOT NULL AND abs(m.x - c.cx) * 4e0 <= 8e0 AND abs(m.y - c.cy) * 4e0 <= 8e0 AS near
        FROM m JOIN sm2 s ON {_same('s', 'm')} JOIN mid c ON c.uid = m.uid LEFT JOIN band b ON {_same('b', 'm')}"""),
    ("peak", f"""SELECT uid, z AS pz, y AS py, x AS px, v AS peak, cx, top, CASE WHEN k >= {LIMITS.near} THEN note ELSE 2 END AS note FROM (SELECT *,
        row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN k >= {LIMITS.near} AND NOT near THEN 1 ELSE 0 END, v DESC, x, y, z) AS r FROM (
        SELECT *, count(*) FILTER (near) OVER (PARTITION BY uid) AS k FROM near)) WHERE r = 1"""),
    ("lev", f"""SELECT *, count(*) FILTER (slab) OVER (PARTITION BY uid) > {LIMITS.slab} AS wide FROM (SELECT m.uid, m.z, m.x, m.v, m.z BETWEEN greatest(pz - 5, 0) AND pz + 5 AS mid,
        m.z BETWEEN greatest(pz - 12, 0) AND pz + 12 AS slab FROM m JOIN peak p ON p.uid = m.uid)"""),
    ("ml", f"SELECT uid, CASE WHEN count(*) FILTER (mid) > {LIMITS.midline} THEN avg(x) FILTER (mid) END AS mx FROM lev GROUP BY uid"),
    ("vals", "SELECT uid, v FROM lev WHERE slab OR NOT wide"),
    ("bgs", """SELECT uid, CASE WHEN b <= 1e-6 THEN a + 1e-6 ELSE b END AS bg FROM (SELECT v.uid, coalesce(avg(v) FILTER (v BETWEEN lo AND hi), any_value(med)) AS b, avg(v) AS a
        FROM vals v JOIN (SELECT uid, quantile_cont(v, 25e-2) AS lo, quantile_cont(v, 85e-2) AS hi, quantile_cont(v, 5e-1) AS med FROM vals GROUP BY uid) q ON q.uid = v.uid GROUP BY v.uid)"""),
    ("found", "SELECT p.uid, top, pz, py, px, peak, note, coalesce(mx, cx) AS cx, bg FROM peak p JOIN ml ON ml.uid = p.uid JOIN bgs ON bgs.uid = p.uid"),
]


@query("r_preprocess_meta", "uid:i ok:i err:s sz:d6 nz:i peak_bg:d5 top_to_peak_mm:d5 peak_off_x_mm:d5 loc_note:i", f"""SELECT u.uid, (bg IS NOT NULL)::INTEGER AS ok,
    CASE WHEN bg IS NULL THEN 'empty volume' END AS err, {_per_scanner([f'{s[0]}::DOUBLE' for s in SCANNERS]).replace('uid', 'u.uid')} AS sz, 16 AS nz, peak / (bg + 1e-6) AS peak_bg,
    (top - pz) * 4e0 AS top_to_peak_mm, (px - cx) * 4e0 AS peak_off_x_mm, note AS loc_note FROM (SELECT DISTINCT uid FROM cube16) u LEFT JOIN found f ON f.uid = u.uid""",
       ["cube16"], CHAIN, recursive=True)
def r_meta(spark, sf):
    """Localisation of volumes of three spacings: masks that hold and masks that fall back, near and far peaks, volumes without signal."""
    return P.preprocess(stage(bumped(spark, sf)), scanned(fx.cube16(spark, sf), SCANNERS, fx.CUBE16), CELLS, OUT, LIMITS)[1]


def _place(i: int) -> str:
    """Source place of output cell o along an axis, as SQL."""
    centre = ("pz", "py", "cx")[i]
    scale = [(n - 1) / max(c[i] - 1, 1) for c, n in ((c, fx.CUBE16[i]) for c in COARSE)]
    step = [2.0 / s[i] for s in SCANNERS]
    scale, step = (_per_scanner([f"{v!r}::DOUBLE" for v in values]) for values in (scale, step))
    return f"{centre} * {scale} - {step} * {(OUT[i] - 1) / 2.0!r}::DOUBLE + {step} * o{'zyx'[i]}"


_SHARP = [(axis, " UNION ALL ".join(
    f"SELECT {c} AS c, o, i, w FROM {kernel_rows(max(0.0, 1.0 / s[i] - 0.35), fx.CUBE16[i], 'reflect')}" if min(s) < 1.6 and 1.0 / s[i] > 0.35
    else f"SELECT {c} AS c, o, o AS i, 1e0 AS w FROM range({fx.CUBE16[i]}) t(o)" for c, s in enumerate(SCANNERS))) for i, axis in enumerate("zyx")]
_CROPS = [
    *CHAIN, ("sharp", by_scanner("src", _SHARP)),
    ("spot", f"SELECT uid, bg, oz, oy, ox, {', '.join(f'{_place(i)} AS s{a}' for i, a in enumerate('zyx'))} FROM found, range({OUT[0]}) a(oz), range({OUT[1]}) b(oy), range({OUT[2]}) c(ox)"),
    ("inn", "SELECT * FROM spot WHERE sz BETWEEN 0 AND 15 AND sy BETWEEN 0 AND 15 AND sx BETWEEN 0 AND 15"),
    ("got", """SELECT p.uid, oz, oy, ox, sum(v * abs(1e0 - a - (sz - floor(sz))) * abs(1e0 - b - (sy - floor(sy))) * abs(1e0 - k - (sx - floor(sx)))) AS v
        FROM inn p, (VALUES (0), (1)) ka(a), (VALUES (0), (1)) kb(b), (VALUES (0), (1)) kc(k), sharp s WHERE s.uid = p.uid AND s.z = floor(sz) + a AND s.y = floor(sy) + b
        AND s.x = floor(sx) + k GROUP BY p.uid, oz, oy, ox"""),
]


@query("r_preprocess", "uid:i z:i y:i x:i v:d5", f"""SELECT s.uid, s.oz AS z, s.oy AS y, s.ox AS x, {clip('coalesce(g.v, 0e0) / bg', '0e0', '40e0')} AS v
    FROM spot s LEFT JOIN got g ON g.uid = s.uid AND g.oz = s.oz AND g.oy = s.oy AND g.ox = s.ox""", ["cube16"], _CROPS, recursive=True)
def r_preprocess(spark, sf):
    """Crops of 2 mm about midline and peak, in background units; the border beyond a scan is 0."""
    return P.preprocess(stage(bumped(spark, sf)), scanned(fx.cube16(spark, sf), SCANNERS, fx.CUBE16), CELLS, OUT, LIMITS)[0]
