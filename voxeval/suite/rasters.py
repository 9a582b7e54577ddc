"""Voxel operators: R1-R3, R12-R17, R26-R30."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import uniform
from voxeval.operators import rasters as R
from voxeval.plans.volumes import volume_tasks
from voxeval.suite.base import clip, query, u

MASK16 = "SELECT uid, z, y, x, v FROM stack16 WHERE v > 6e-1"


def mask16(spark, sf, level=0.6):
    return fx.stack16(spark, sf).where(F.col("v") > level)


def kernel_rows(sigma: float, n: int, edge: str) -> str:
    """(o, i, w) of one axis from the gather definition."""
    r = math.ceil(2.5 * sigma) if edge == "replicate" else int(4 * sigma + 0.5)
    ks = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    rows = []
    for o in range(n):
        for k in range(-r, r + 1):
            i = o + k
            if edge == "replicate":
                i = 0 if i < 0 else n - 1 if i >= n else i
            else:
                while i < 0 or i >= n:
                    i = -1 - i if i < 0 else 2 * n - 1 - i
            rows.append(f"({o}, {i}, {ks[k + r] / sum(ks)!r}::DOUBLE)")
    return "(VALUES " + ", ".join(rows) + ") k(o, i, w)"


def blur_sql(src: str, sigmas, grid, edge: str, keys=("uid",), val: str = "v") -> str:
    """Three nested passes."""
    sql, ks = f"SELECT {''.join(k + ', ' for k in keys)}z, y, x, {val} AS v FROM {src}", "".join(k + ", " for k in keys)
    for axis, s, n in zip("zyx", sigmas, grid):
        if s > 0.05:
            rest = [a for a in "zyx" if a != axis]
            sql = (f"SELECT {ks}{', '.join(rest)}, o AS {axis}, sum(v * w) AS v FROM ({sql}) JOIN {kernel_rows(s, n, edge)} ON {axis} = i "
                   f"GROUP BY {ks}{', '.join(rest)}, o")
    return sql


@query("r1_frame_mean", "uid:i z:i y:i x:i v:d6", """SELECT uid, z, y, x, CASE WHEN isnan(m) OR isinf(m) THEN 0e0 ELSE greatest(m, 0e0) END AS v FROM (
    SELECT uid, z, y, x, CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE WHEN bool_or(isinf(v)) THEN 'Infinity'::DOUBLE
    ELSE avg(CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END) END AS m FROM frames GROUP BY uid, z, y, x)""", ["frames"])
def r1(spark, sf):
    return R.frame_mean(fx.frames(spark, sf))


@query("r2_downsample", "uid:i z:i y:i x:i v:d6", """SELECT uid, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM stack16
    GROUP BY uid, z // 2, y // 2, x // 2""", ["stack16"])
def r2(spark, sf):
    return R.downsample(fx.stack16(spark, sf), 2)


def _tasks(spark, sf, grid):
    return volume_tasks(fx.table(spark, sf, "embeddings"), grid)


@query("r3_gaussian_blur", "uid:i z:i y:i x:i v:d6", blur_sql("voxels", (0.7, 1.0, 1.3), (4, 4, 4), "replicate"), ["voxels"])
def r3(spark, sf):
    """Different sigma per axis, edges replicated."""
    return R.gaussian_blur(fx.voxels(spark, sf), (0.7, 1.0, 1.3), fx.GRID4, "replicate", tasks=_tasks(spark, sf, fx.GRID4))


@query("r3_gaussian_blur_reflect", "uid:i z:i y:i x:i v:d6", blur_sql("planes", (0, 1.0, 1.0), (1, 8, 8), "reflect"), ["planes"])
def r3r(spark, sf):
    return R.gaussian_blur(fx.planes(spark, sf), (0.0, 1.0, 1.0), fx.PLANE8, "reflect", tasks=_tasks(spark, sf, fx.PLANE8))


@query("r12_center_of_mass", "uid:i cz:d6 cy:d6 cx:d6 wz:d6 wy:d6 wx:d6", """SELECT uid, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, sum(v * z) / sum(v) AS wz,
    sum(v * y) / sum(v) AS wy, sum(v * x) / sum(v) AS wx FROM m GROUP BY uid""", ["stack16"], [("m", MASK16)])
def r12(spark, sf):
    m = mask16(spark, sf)
    w = R.center_of_mass(m, "v").select("uid", F.col("cz").alias("wz"), F.col("cy").alias("wy"), F.col("cx").alias("wx"))
    return R.center_of_mass(m).join(w, "uid")


_NEAR = "abs(y - cy) * 4e0 <= 4e0 AND abs(x - cx) * 4e0 <= 4e0"


@query("r13_constrained_peak", "uid:i z:i y:i x:i peak:d6 note:i", f"""SELECT uid, z, y, x, v AS peak, CASE WHEN k >= 10 THEN 0 ELSE 2 END AS note FROM (
    SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN k >= 10 AND NOT near THEN 1 ELSE 0 END, v DESC, x, y, z) AS r FROM (
    SELECT *, count(*) FILTER (near) OVER (PARTITION BY uid) AS k FROM (SELECT m.*, {_NEAR} AS near FROM m JOIN (
    SELECT uid, avg(y) AS cy, avg(x) AS cx FROM m GROUP BY uid) c ON m.uid = c.uid))) WHERE r = 1""", ["stack16"],
       [("m", "SELECT uid, z, y, x, v FROM stack16 WHERE v > 14e-1")])
def r13(spark, sf):
    m = mask16(spark, sf, 1.4)
    return R.constrained_peak(fx.stack16(spark, sf), m, R.center_of_mass(m), (4.0, 4.0))


_BG = """SELECT uid, CASE WHEN b <= 1e-6 THEN a + 1e-6 ELSE b END AS bg FROM (SELECT uid, coalesce(avg(v) FILTER (v BETWEEN lo AND hi), any_value(med)) AS b,
    avg(v) AS a FROM (SELECT s.uid, v, lo, hi, med FROM stack16 s JOIN (SELECT uid, quantile_cont(v, 25e-2) AS lo, quantile_cont(v, 85e-2) AS hi,
    quantile_cont(v, 5e-1) AS med FROM stack16 GROUP BY uid) q ON s.uid = q.uid) GROUP BY uid)"""


@query("r14_trimmed_mean", "uid:i bg:d6", _BG, ["stack16"])
def r14(spark, sf):
    return R.trimmed_mean(fx.stack16(spark, sf))


@query("r15_normalize", "uid:i z:i y:i x:i v:d6", f"SELECT uid, z, y, x, {clip('v / bg', '0e0', '40e0')} AS v FROM stack16 JOIN ({_BG}) USING (uid)", ["stack16"])
def r15(spark, sf):
    vox = fx.stack16(spark, sf)
    return R.normalize(vox, R.trimmed_mean(vox))


def _resample_sql(src: str) -> str:
    """Gather from 8 corners; ``src`` has uid, oz, oy, ox, sz, sy, sx."""
    return f"""SELECT p.uid, oz AS z, oy AS y, ox AS x, coalesce(sum(v * (CASE WHEN a = 1 THEN sz - floor(sz) ELSE 1e0 - (sz - floor(sz)) END)
        * (CASE WHEN b = 1 THEN sy - floor(sy) ELSE 1e0 - (sy - floor(sy)) END) * (CASE WHEN c = 1 THEN sx - floor(sx) ELSE 1e0 - (sx - floor(sx)) END)), 0e0) AS v
        FROM ({src}) p CROSS JOIN (VALUES (0), (1)) ka(a) CROSS JOIN (VALUES (0), (1)) kb(b) CROSS JOIN (VALUES (0), (1)) kc(c)
        LEFT JOIN voxels s ON s.uid = p.uid AND s.z = floor(sz) + a AND s.y = floor(sy) + b AND s.x = floor(sx) + c GROUP BY p.uid, oz, oy, ox"""


_M, _T = R.rotation(15.0, (1, 2), fx.GRID4)
_ROT = "SELECT uid, z AS oz, y AS oy, x AS ox, " + ", ".join(
    f"{_M[i][0]!r}::DOUBLE * z + {_M[i][1]!r}::DOUBLE * y + {_M[i][2]!r}::DOUBLE * x + {_T[i]!r}::DOUBLE AS s{a}" for i, a in enumerate("zyx")) + " FROM voxels"


@query("r16_affine_resample", "uid:i z:i y:i x:i v:d6", _resample_sql(_ROT), ["voxels"])
def r16(spark, sf):
    """A turn of 15 degrees about the grid centre."""
    return R.affine_resample(fx.voxels(spark, sf), _M, _T, fx.GRID4, fx.GRID4)


_EACH = f"""SELECT uid, z AS oz, y AS oy, x AS ox, z * 1e0 + s AS sz, y * 9e-1 + s AS sy, x * -1e0 + 3e0 AS sx FROM (
    SELECT *, {u("uid::VARCHAR", "'shift'")} - 5e-1 AS s FROM voxels)"""


@query("r16_affine_resample_each", "uid:i z:i y:i x:i v:d6", _resample_sql(_EACH), ["voxels"])
def r16e(spark, sf):
    """One transform per volume: a mirrored x, a scaled y and a hashed shift."""
    vox = fx.voxels(spark, sf)
    s = uniform(F.col("uid").cast("string"), "shift") - 0.5
    m = {"m00": F.lit(1.0), "m11": F.lit(0.9), "m22": F.lit(-1.0), "t0": s, "t1": s, "t2": F.lit(3.0)}
    names = [f"m{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    thetas = vox.select("uid").distinct().select("uid", *[m.get(n, F.lit(0.0)).alias(n) for n in names])
    return R.affine_resample_each(vox, thetas, fx.GRID4, fx.GRID4)


def _edge_sql(src: str, nearest: bool) -> str:
    """As ``_resample_sql``, but places beyond the border take it (nearest), or count 0 altogether."""
    pull = ", ".join(f"least(greatest(s{a}, 0e0), 3e0) AS s{a}" for a in "zyx")
    inside = " AND ".join(f"s{a} BETWEEN 0 AND 3" for a in "zyx")
    body = _resample_sql(f"SELECT uid, oz, oy, ox, {pull} FROM ({src})")
    if nearest:
        return body
    return f"SELECT q.uid, z, y, x, CASE WHEN {inside} THEN v ELSE 0e0 END AS v FROM ({body}) q JOIN ({src}) p ON p.uid = q.uid AND oz = z AND oy = y AND ox = x"


@query("r16_edge_nearest", "uid:i z:i y:i x:i v:d6", _edge_sql(_ROT, True), ["voxels"])
def r16n(spark, sf):
    """The turn of r16 with the border going on beyond the grid."""
    return R.affine_resample(fx.voxels(spark, sf), _M, _T, fx.GRID4, fx.GRID4, "nearest")


@query("r16_edge_outside", "uid:i z:i y:i x:i v:d6", _edge_sql(_ROT, False), ["voxels"])
def r16o(spark, sf):
    """The turn of r16 where places outside the grid are 0 and those inside never mix with it."""
    return R.affine_resample(fx.voxels(spark, sf), _M, _T, fx.GRID4, fx.GRID4, "outside_zero")


_CROP = "SELECT uid, z AS oz, y AS oy, x AS ox, 8e-1 * z + 7e-1 AS sz, -75e-2 * x + 3e0 AS sy, 9e-1 * y - 4e-1 AS sx FROM voxels"


@query("r16_separable", "uid:i z:i y:i x:i v:d6", _edge_sql(_CROP, True), ["voxels"])
def r16s(spark, sf):
    """Zoom, shift, mirror and swapped axes: three one-dimensional passes."""
    m = ((0.8, 0.0, 0.0), (0.0, 0.0, -0.75), (0.0, 0.9, 0.0))
    return R.affine_resample(fx.voxels(spark, sf), m, (0.7, 3.0, -0.4), fx.GRID4, fx.GRID4, "nearest")


#: Spacing in mm along z, y, x of three kinds of scanner, by uid.
SCANNERS = ((2.0, 2.0, 2.0), (1.0, 3.0, 2.5), (4.5, 1.5, 6.0))


def scanned(voxels, spacings: tuple, grid: tuple):
    """uid with the spacing and shape of its scanner."""
    kind = F.col("uid") % len(spacings)
    cols = [F.element_at(F.array(*[F.lit(s[i]) for s in spacings]), kind.cast("int") + 1).alias(c) for i, c in enumerate(R.SPACINGS)]
    return voxels.select("uid").distinct().select("uid", *cols, *[F.lit(n).alias(c) for n, c in zip(grid, R.SHAPE)])


def scanners(spark, sf):
    return scanned(fx.stack16(spark, sf), SCANNERS, fx.STACK16)


def _axis_rows(axis: int, kind: str, scanners: tuple, grid: tuple) -> str:
    """(scanner, o, i, w) of one axis: the blur, or the interpolation to 4 mm."""
    rows, n = [], grid[axis]
    for c, spacing in enumerate(scanners):
        sigmas = [max(0.0, 2.0 / s - 0.35) for s in spacing]
        m = max(1, round(n * spacing[axis] / 4.0))
        if kind == "blur" and sigmas[axis] > 0 and max(sigmas) > 0.05:
            values = kernel_rows(sigmas[axis], n, "reflect")
            rows.append(f"SELECT {c} AS c, o, i, w FROM {values}")
        elif kind == "blur":
            rows.append(f"SELECT {c} AS c, o, o AS i, 1e0 AS w FROM range({n}) t(o)")
        else:
            step = (n - 1) / (m - 1) if m > 1 else 1.0
            at = f"(SELECT o, least(greatest(o * {step!r}::DOUBLE, 0e0), {n - 1}e0) AS s FROM range({m}) t(o))"
            rows.append(f"SELECT {c} AS c, o, floor(s)::BIGINT AS i, 1e0 - (s - floor(s)) AS w FROM {at} UNION ALL SELECT {c}, o, floor(s)::BIGINT + 1, s - floor(s) FROM {at} WHERE floor(s) + 1 < {n}")
    return " UNION ALL ".join(rows)


def full_sql(src: str, grid: tuple) -> str:
    """Volumes whose missing cells are 0."""
    return f"""SELECT u.uid, g.z, g.y, g.x, coalesce(v, 0e0) AS v FROM (SELECT DISTINCT uid FROM {src}) u CROSS JOIN (
    SELECT a.z, b.y, c.x FROM range({grid[0]}) a(z), range({grid[1]}) b(y), range({grid[2]}) c(x)) g LEFT JOIN {src} s ON s.uid = u.uid AND s.z = g.z AND s.y = g.y AND s.x = g.x"""


_FULL = [("full16", full_sql("stack16", fx.STACK16))]


def by_scanner(src: str, tables: list) -> str:
    """``src`` (uid, z, y, x, v) through one-dimensional passes; ``tables`` holds, per pass, its axis and rows (c, o, i, w) by scanner."""
    sql = f"SELECT uid, uid % {len(SCANNERS)} AS c, z, y, x, v FROM {src}"
    for axis, rows in tables:
        rest = ", ".join(f"s.{a}" for a in "zyx" if a != axis)
        sql = f"SELECT s.uid, s.c, {rest}, k.o AS {axis}, sum(s.v * k.w) AS v FROM ({sql}) s JOIN ({rows}) k ON k.c = s.c AND k.i = s.{axis} GROUP BY s.uid, s.c, {rest}, k.o"
    return f"SELECT uid, z, y, x, v FROM ({sql})"


def spaced_sql(src: str, scanners: tuple = SCANNERS, grid: tuple = fx.STACK16) -> str:
    return by_scanner(src, [(axis, _axis_rows(i, kind, scanners, grid)) for kind in ("blur", "step") for i, axis in enumerate("zyx")])


@query("r2_real_spacing", "uid:i z:i y:i x:i v:d6", spaced_sql("full16"), ["stack16"], _FULL)
def r2s(spark, sf):
    """Volumes of three spacings in one table, each blurred and sampled by its own, to 4 mm."""
    return R.downsample_each(fx.stack16(spark, sf), scanners(spark, sf))


_BLURS = [(axis, " UNION ALL ".join(f"SELECT {c} AS c, o, i, w FROM {kernel_rows(0.4 * spacing[i], fx.STACK16[i], 'replicate')}" for c, spacing in enumerate(SCANNERS)))
          for i, axis in enumerate("zyx")]


@query("r3_blur_each", "uid:i z:i y:i x:i v:d6", by_scanner("full16", _BLURS), ["stack16"], _FULL)
def r3e(spark, sf):
    """Deviations of 0.4 spacings, each volume's own, edges replicated; the last, short volume is filled with zeros."""
    sigmas = scanners(spark, sf).select("uid", *[(F.lit(0.4) * F.col(c)).alias(c) for c in R.SPACINGS])
    return R.gaussian_blur_each(fx.stack16(spark, sf), sigmas, fx.STACK16, "replicate")


@query("r17_center_crop", "uid:i z:i y:i x:i v:d6", """SELECT uid, z - 4 AS z, y - 2 AS y, x - 1 AS x, v FROM stack16
    WHERE z BETWEEN 4 AND 11 AND y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 5""", ["stack16"])
def r17(spark, sf):
    return R.center_crop(fx.stack16(spark, sf), fx.STACK16, (8, 4, 5))


@query("r26_slab_means", "uid:i slab:i y:i x:i v:d6", """SELECT uid, (z - 2) // 4 AS slab, y, x, avg(v) AS v FROM stack16 WHERE z BETWEEN 2 AND 13
    GROUP BY uid, (z - 2) // 4, y, x""", ["stack16"])
def r26(spark, sf):
    return R.slab_means(fx.stack16(spark, sf), 3, 4, 16)


@query("r26_tri_plane", "uid:i plane:s a:i b:i v:d6", """SELECT uid, 'axial' AS plane, y AS a, x AS b, avg(v) AS v FROM stack16 WHERE z BETWEEN 6 AND 9 GROUP BY uid, y, x
    UNION ALL SELECT uid, 'coronal', z, x, avg(v) FROM stack16 WHERE y BETWEEN 2 AND 5 GROUP BY uid, z, x
    UNION ALL SELECT uid, 'sagittal', z, y, avg(v) FROM stack16 WHERE x BETWEEN 2 AND 5 GROUP BY uid, z, y""", ["stack16"])
def r26t(spark, sf):
    return R.tri_plane(fx.stack16(spark, sf), fx.STACK16, 2)


@query("r27_slice_windows", "uid:i off:i y:i x:i thin:d6 thick:d6", """SELECT uid, z - 8 AS off, y, x, thin, thick FROM (SELECT uid, z, y, x,
    avg(v) OVER (PARTITION BY uid, y, x ORDER BY z RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS thin,
    avg(v) OVER (PARTITION BY uid, y, x ORDER BY z RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS thick FROM stack16)
    WHERE z BETWEEN 4 AND 12 AND z % 2 = 0""", ["stack16"])
def r27(spark, sf):
    return R.slice_windows(fx.stack16(spark, sf), 16, 4, 2)


_Q99 = "greatest(quantile_cont({v}, 99e-2) OVER (PARTITION BY uid), 1e-3)"


@query("r28_self_normalize", "uid:i z:i y:i x:i v:d6", f"SELECT uid, z, y, x, w / {_Q99.format(v='w')} AS v FROM (SELECT *, (v - 1e0) / 2e0 AS w FROM stack16)", ["stack16"])
def r28(spark, sf):
    """Division after centring."""
    return R.self_normalize(fx.stack16(spark, sf).withColumn("v", (F.col("v") - 1.0) / 2.0))


@query("r28_self_normalize_raw", "uid:i z:i y:i x:i v:d6", f"""SELECT uid, z, y, x, w / {_Q99.format(v='w')} * 2e0 - 1e0 AS v FROM (
    SELECT *, greatest((v - 1e0) / 2e0 * 2e0 + 1e0, 0e0) AS w FROM stack16)""", ["stack16"])
def r28r(spark, sf):
    """Division before centring."""
    return R.self_normalize(fx.stack16(spark, sf).withColumn("v", (F.col("v") - 1.0) / 2.0), centred=False)


HOT = {"z": (2, 4), "y": (1, 2), "x": (3, 5)}
_NOISE = u("uid::VARCHAR", "z::VARCHAR", "y::VARCHAR", "x::VARCHAR", "'noise'")
_KINDS = {
    "clean": "v", "crop edges": "CASE WHEN z BETWEEN 2 AND 13 THEN v ELSE 0e0 END", "top cut": "CASE WHEN z < 13 THEN v ELSE 0e0 END",
    "bottom cut": "CASE WHEN z >= 3 THEN v ELSE 0e0 END", "lateral cut": "CASE WHEN x BETWEEN 3 AND 4 THEN v ELSE 0e0 END",
    "hot spot": "CASE WHEN z BETWEEN 2 AND 4 AND y BETWEEN 1 AND 2 AND x BETWEEN 3 AND 5 THEN top * 16e-1 ELSE v END",
    "intensity": "v * 7e-1", "noise": f"greatest(v + m * 6e-1 * ({_NOISE} - 5e-1), 0e0)",
}


@query("r29_corrupt", "uid:i kind:s z:i y:i x:i v:d6", " UNION ALL ".join(f"SELECT uid, '{k}' AS kind, z, y, x, {e} AS v FROM s" for k, e in _KINDS.items()), ["stack16"],
       [("s", "SELECT *, quantile_cont(v, 999e-3) OVER (PARTITION BY uid) AS top, avg(v) OVER (PARTITION BY uid) AS m FROM stack16")])
def r29(spark, sf):
    return R.corrupt(fx.stack16(spark, sf), R.corruptions(fx.STACK16, 2, 3, HOT))


_M12, _T12 = R.rotation(12.0, (0, 1), fx.GRID4)
_TILT = "SELECT uid, z AS oz, y AS oy, x AS ox, " + ", ".join(
    f"{_M12[i][0]!r}::DOUBLE * z + {_M12[i][1]!r}::DOUBLE * y + {_M12[i][2]!r}::DOUBLE * x + {_T12[i]!r}::DOUBLE AS s{a}" for i, a in enumerate("zyx")) + " FROM voxels"
_SHIFT = "SELECT uid, z AS oz, y AS oy, x AS ox, z * 1e0 AS sz, y - 15e-1 AS sy, x - 5e-1 AS sx FROM voxels"


@query("r29_corrupt_moved", "uid:i kind:s z:i y:i x:i v:d6", f"""SELECT uid, 'blur' AS kind, z, y, x, v FROM ({blur_sql("voxels", (8.0 / 2.0 / 2.355,) * 3, (4, 4, 4), "reflect")})
    UNION ALL SELECT uid, 'tilt', z, y, x, v FROM ({_edge_sql(_TILT, False)}) UNION ALL SELECT uid, 'shift', z, y, x, v FROM ({_edge_sql(_SHIFT, False)})""", ["voxels"])
def r29m(spark, sf):
    """Blur, tilt and shift, which mix cells, in one pass over each volume."""
    return R.corrupt_moved(fx.voxels(spark, sf).drop("label"), fx.GRID4, shift=(0.0, 1.5, 0.5))


def _harmonize_sql() -> str:
    sg = "SELECT uid, sg, CASE WHEN sg > 0 THEN floor(4e0 * sg + 5e-1)::INTEGER ELSE 0 END AS r FROM (SELECT uid, CASE WHEN mm > 1e-1 THEN mm / 2e0 ELSE 0e0 END AS sg FROM (" \
         "SELECT DISTINCT uid, sqrt(greatest(power(8e-1 * 4e0, 2e0) - power(8e-1 * (15e-1 + 1e-1 * (uid % 30)), 2e0), 0e0)) AS mm FROM voxels))"
    ker = f"SELECT uid, k, e / sum(e) OVER (PARTITION BY uid) AS w FROM (SELECT uid, k, CASE WHEN sg > 0 THEN exp(-5e-1 * power(k / sg, 2e0)) ELSE 1e0 END AS e " \
          f"FROM ({sg}), (SELECT unnest(range(-12, 13)) AS k) WHERE abs(k) <= r)"
    sql = "SELECT uid, z, y, x, v FROM voxels"
    for axis in "zyx":
        rest = ", ".join(f"s.{a}" for a in "zyx" if a != axis)
        # gather: output o takes input reflect(o + k); on a grid of 4 the reflection has period 8
        at = "((o + k) % 8 + 8) % 8"
        sql = (f"SELECT s.uid, {rest}, o AS {axis}, sum(s.v * w) AS v FROM (SELECT uid, o, k, w, CASE WHEN {at} < 4 THEN {at} ELSE 7 - {at} END AS i FROM ker, "
               f"(VALUES (0), (1), (2), (3)) t(o)) g JOIN ({sql}) s ON s.uid = g.uid AND s.{axis} = g.i GROUP BY s.uid, {rest}, o")
    return sql, ker


_HSQL, _HKER = _harmonize_sql()


@query("r30_harmonize_blur", "uid:i z:i y:i x:i v:d6", _HSQL, ["voxels"], [("ker", _HKER)])
def r30(spark, sf):
    vox = fx.voxels(spark, sf).drop("label")
    zooms = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid")).distinct().select("uid", (F.lit(1.5) + F.lit(0.1) * (F.col("uid") % 30)).alias("zoom"))
    return R.harmonize_blur(vox, zooms, 0.8, fx.GRID4)
