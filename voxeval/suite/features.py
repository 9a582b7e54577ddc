"""Features: F1-F17."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.operators import features as X
from voxeval.session import stage
from voxeval.suite.base import query
from voxeval.suite.masks import dilate_sql, erode_sql
from voxeval.suite.rasters import MASK16, mask16

HALF = (4, 3, 3)
ML = 8.0 / 1000.0
_SIDES = """SELECT uid, CASE WHEN x < 4 THEN 'R' ELSE 'L' END AS side, z - 4 AS z, y - 1 AS y, CASE WHEN x < 4 THEN x - 1 ELSE 6 - x END AS x, v, gmax
    FROM (SELECT *, max(v) OVER (PARTITION BY uid) + 1e-6 AS gmax FROM stack16) WHERE z BETWEEN 4 AND 11 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"""
S = [("sides", _SIDES)]


def sides(spark, sf):
    return X.split_sides(fx.stack16(spark, sf), fx.STACK16, HALF)


@query("f1_quantiles", "uid:i g_p50:d6 g_p90:d6 g_p99:d6 g_p999:d6 g_max:d6", """SELECT uid, quantile_cont(v, 5e-1) AS g_p50, quantile_cont(v, 9e-1) AS g_p90,
    quantile_cont(v, 99e-2) AS g_p99, quantile_cont(v, 999e-3) AS g_p999, max(v) + 1e-6 AS g_max FROM stack16 GROUP BY uid""", ["stack16"])
def f1(spark, sf):
    return X.quantile_features(fx.stack16(spark, sf)).withColumnRenamed("g_p99.9", "g_p999")


@query("f2_split_sides", "uid:i side:s z:i y:i x:i v:d6 gmax:d6", "SELECT * FROM sides", ["stack16"], S)
def f2(spark, sf):
    return sides(spark, sf)


_TOPK = """SELECT uid, side, max(v) AS max, avg(v) FILTER (r <= 30) AS top30, avg(v) FILTER (r <= 125) AS top125, avg(v) FILTER (r <= 400) AS top400,
    avg(v) FILTER (r <= 1000) AS top1000 FROM (SELECT *, row_number() OVER (PARTITION BY uid, side ORDER BY v DESC) AS r FROM sides) GROUP BY uid, side"""


@query("f3_topk_mean", "uid:i side:s max:d6 top30:d6 top125:d6 top400:d6 top1000:d6", _TOPK, ["stack16"], S)
def f3(spark, sf):
    return X.topk_mean(sides(spark, sf))


_LARGE = [("sides", """SELECT uid, CASE WHEN x < 40 THEN 'R' ELSE 'L' END AS side, v FROM stored WHERE z BETWEEN 16 AND 39 AND y BETWEEN 20 AND 59 AND x BETWEEN 20 AND 59""")]


@query("f3_topk_stored", "uid:i side:s max:d6 top30:d6 top125:d6 top400:d6 top1000:d6", _TOPK, ["stored"], _LARGE)
def f3l(spark, sf):
    """Volumes of the stored size with sides of up to 19,200 cells, where every k cuts."""
    return X.topk_mean(X.split_sides(fx.stored(spark, sf), fx.STORED))


@query("f1_quantiles_stored", "uid:i g_p50:d6 g_p90:d6 g_p99:d6 g_p999:d6 g_max:d6", """SELECT uid, quantile_cont(v, 5e-1) AS g_p50, quantile_cont(v, 9e-1) AS g_p90,
    quantile_cont(v, 99e-2) AS g_p99, quantile_cont(v, 999e-3) AS g_p999, max(v) + 1e-6 AS g_max FROM stored GROUP BY uid""", ["stored"])
def f1l(spark, sf):
    return X.quantile_features(fx.stored(spark, sf)).withColumnRenamed("g_p99.9", "g_p999")


def _q(x: float) -> str:
    """A decimal as SQL text that is a double from the start."""
    return f"{round(x * 10)}e-1"


def _tag(name: str) -> str:
    return name.replace(".", "")


def _plain(df):
    """Column names without dots."""
    return df.select(*[F.col(f"`{c}`").alias(_tag(c)) for c in df.columns])


_VOL = "SELECT uid, side, " + ", ".join(f"count(*) FILTER (v > {_q(t)}) * 8e-3 AS {_tag(f'vol{t}')}" for t in X.VOLUME_LEVELS) + " FROM sides GROUP BY uid, side"
_VCOLS = [_tag(f"vol{t}") for t in X.VOLUME_LEVELS]


@query("f4_volume_above", "uid:i side:s " + " ".join(f"{c}:d6" for c in _VCOLS), _VOL, ["stack16"], S)
def f4(spark, sf):
    return _plain(sides(spark, sf).groupBy("uid", "side").agg(*X.volume_aggs(ML)))


def _ext(c: str, f: float) -> str:
    q = f"quantile_cont({c}::DOUBLE, {{q}}) FILTER (v > {_q(f)} * gmax)"
    return f"coalesce(CASE WHEN count(*) FILTER (v > {_q(f)} * gmax) >= 3 THEN ({q.format(q='95e-2')} - {q.format(q='5e-2')}) * 2e0 END, 0e0) AS {_tag(f'{c}ext{f}')}"


_HOT = "SELECT uid, side, " + ", ".join(
    f"count(*) FILTER (v > {_q(f)} * gmax) * 8e-3 AS {_tag(f'n{f}')}, " + ", ".join(_ext(c, f) for c in "yzx") for f in X.HOT_LEVELS) + " FROM sides GROUP BY uid, side"
_HCOLS = [_tag(f"{c}{f}") for f in X.HOT_LEVELS for c in ("n", "yext", "zext", "xext")]


@query("f5_hot_extent", "uid:i side:s " + " ".join(f"{c}:d6" for c in _HCOLS), _HOT, ["stack16"], S)
def f5(spark, sf):
    return _plain(sides(spark, sf).groupBy("uid", "side").agg(*[e for f in X.HOT_LEVELS for e in X.hot_extent_aggs(f, ML, 2.0)]))


def _cen(f: float) -> str:
    n, s = f"count(*) FILTER (v > {_q(f)} * gmax)", f"sum(v) FILTER (v > {_q(f)} * gmax)"
    return (f"CASE WHEN {n} >= 3 THEN (sum(v * y) FILTER (v > {_q(f)} * gmax) / {s} - 3e0) * 2e0 ELSE 0e0 END AS {_tag(f'ycen{f}')}, "
            f"CASE WHEN {n} >= 3 THEN sum(v * x) FILTER (v > {_q(f)} * gmax) / {s} * 2e0 ELSE 0e0 END AS {_tag(f'xcen{f}')}")


_CEN = f"SELECT uid, side, {', '.join(_cen(f) for f in X.HOT_LEVELS)} FROM sides GROUP BY uid, side"
_CENCOLS = [_tag(f"{c}{f}") for f in X.HOT_LEVELS for c in ("ycen", "xcen")]


@query("f6_hot_centroid", "uid:i side:s " + " ".join(f"{c}:d6" for c in _CENCOLS), _CEN, ["stack16"], S)
def f6(spark, sf):
    return _plain(sides(spark, sf).groupBy("uid", "side").agg(*[e for f in X.HOT_LEVELS for e in X.hot_centroid_aggs(f, 6, 2.0)]))


def _eig(f: float) -> str:
    return f"""SELECT uid, side, n, sqrt(e1 / greatest(3e0 * q - e1 - (q + 2e0 * p * cos(phi + 2e0 * pi() / 3e0)), 1e-6)) AS elong FROM (SELECT *, q + 2e0 * p * cos(phi) AS e1 FROM (
    SELECT *, acos(least(greatest(coalesce(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz))
    / nullif(2e0 * p * p * p, 0e0), 1e0), -1e0), 1e0)) / 3e0 AS phi FROM (SELECT *, sqrt((power(xx - q, 2e0) + power(yy - q, 2e0) + power(zz - q, 2e0)
    + 2e0 * (xy * xy + xz * xz + yz * yz)) / 6e0) AS p FROM (SELECT *, (xx + yy + zz) / 3e0 AS q FROM (SELECT uid, side, count(*) AS n, covar_samp(x, x) + 1e-6 AS xx,
    covar_samp(y, y) + 1e-6 AS yy, covar_samp(z, z) + 1e-6 AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz
    FROM sides WHERE v > {_q(f)} * gmax GROUP BY uid, side)))))"""


_ELONG = "SELECT s.uid, s.side, " + ", ".join(f"coalesce(CASE WHEN e{i}.n >= 3 THEN e{i}.elong END, 0e0) AS {_tag(f'elong{f}')}" for i, f in enumerate(X.HOT_LEVELS)) \
    + " FROM (SELECT DISTINCT uid, side FROM sides) s " + " ".join(f"LEFT JOIN ({_eig(f)}) e{i} ON e{i}.uid = s.uid AND e{i}.side = s.side" for i, f in enumerate(X.HOT_LEVELS))
_ECOLS = [_tag(f"elong{f}") for f in X.HOT_LEVELS]


@query("f7_elongation", "uid:i side:s " + " ".join(f"{c}:d4" for c in _ECOLS), _ELONG, ["stack16"], S)
def f7(spark, sf):
    """Four digits: the second eigenvalue of a thin set is a difference of nearly equal numbers."""
    return _plain(sides(spark, sf).groupBy("uid", "side").agg(*[e for f in X.HOT_LEVELS for e in X.elongation_aggs(f)]))


_F8 = """SELECT uid, side, CASE WHEN n > 5 THEN m0 / (m2 + 1e-6) ELSE 0e0 END AS post_ant,
    CASE WHEN n > 5 THEN m1 / (m2 + 1e-6) ELSE 0e0 END AS mid_ant FROM (SELECT uid, side, count(*) FILTER (hot) AS n,
    coalesce(sum(v) FILTER (hot AND t = 0), 0e0) / greatest(count(*) FILTER (hot AND t = 0), 1) AS m0,
    coalesce(sum(v) FILTER (hot AND t = 1), 0e0) / greatest(count(*) FILTER (hot AND t = 1), 1) AS m1,
    coalesce(sum(v) FILTER (hot AND t = 2), 0e0) / greatest(count(*) FILTER (hot AND t = 2), 1) AS m2 FROM (SELECT *,
    CASE WHEN y - y0 < (h + 2) // 3 THEN 0 WHEN y - y0 < (h + 2) // 3 + (h + 1) // 3 THEN 1 ELSE 2 END AS t FROM (SELECT *, y1 - y0 + 1 AS h FROM (
    SELECT *, v > 4e-1 * gmax AS hot, min(y) FILTER (v > 4e-1 * gmax) OVER w AS y0, max(y) FILTER (v > 4e-1 * gmax) OVER w AS y1 FROM sides
    WINDOW w AS (PARTITION BY uid, side)))) GROUP BY uid, side)"""


@query("f8_ap_gradient", "uid:i side:s post_ant:d6 mid_ant:d6", _F8, ["stack16"], S)
def f8(spark, sf):
    return X.ap_gradient(sides(spark, sf))


_BOX = """SELECT b.uid, b.side, box, v, row_number() OVER (PARTITION BY b.uid, b.side, box ORDER BY v DESC) AS r FROM (SELECT s.*, 'ant' AS box FROM sides s JOIN pk p USING (uid, side)
    WHERE abs(s.z - p.pz) <= 3 AND s.y >= least(py + 2, 8) AND s.y < least(py + 9, 6) UNION ALL SELECT s.*, 'post' FROM sides s JOIN pk p USING (uid, side)
    WHERE abs(s.z - p.pz) <= 3 AND s.y >= greatest(py - 12, 0) AND s.y < greatest(py - 3, 1)) b"""


_F9 = """SELECT uid, side, p AS box_post, a AS box_ant, p / (a + 1e-6) AS box_ratio FROM (
    SELECT pk.uid, pk.side, coalesce(avg(v) FILTER (box = 'post' AND r <= 60), 0e0) AS p, coalesce(avg(v) FILTER (box = 'ant' AND r <= 60), 0e0) AS a
    FROM pk LEFT JOIN b ON b.uid = pk.uid AND b.side = pk.side GROUP BY pk.uid, pk.side)"""
PEAKS = [*S, ("pk", "SELECT uid, side, z AS pz, y AS py FROM (SELECT *, row_number() OVER (PARTITION BY uid, side ORDER BY v DESC, z, y, x) AS r FROM sides) WHERE r = 1"),
        ("b", _BOX)]


@query("f9_peak_boxes", "uid:i side:s box_post:d6 box_ant:d6 box_ratio:d6", _F9, ["stack16"], PEAKS)
def f9(spark, sf):
    return X.peak_boxes(sides(spark, sf), 6, 8)


_FOLD = ", ".join(f"least(a.{c}, b.{c}) AS {c}_min, greatest(a.{c}, b.{c}) AS {c}_max, (a.{c} + b.{c}) / 2e0 AS {c}_mean, abs(a.{c} - b.{c}) / (abs(a.{c}) + abs(b.{c}) + 1e-6) AS {c}_asym"
                  for c in ("max", "top30"))


@query("f10_fold_sides", "uid:i " + " ".join(f"{c}_{k}:d6" for c in ("max", "top30") for k in ("min", "max", "mean", "asym")),
       f"SELECT a.uid, {_FOLD} FROM tk a JOIN tk b ON a.uid = b.uid AND a.side = 'R' AND b.side = 'L'", ["stack16"], [*S, ("tk", _TOPK)])
def f10(spark, sf):
    return X.fold_sides(X.topk_mean(sides(spark, sf)), ["max", "top30"])


_SIDE_COLS = ["max", *[f"top{k}" for k in X.TOPS], *_VCOLS, *_HCOLS, *_CENCOLS, *_ECOLS, "post_ant", "mid_ant", "box_post", "box_ant", "box_ratio"]
_FOLDS = ("min", "max", "mean", "asym")


def _fold_sql(c: str, eps: str) -> str:
    return (f"least(a.{c}, b.{c}) AS {c}_min, greatest(a.{c}, b.{c}) AS {c}_max, (a.{c} + b.{c}) / 2e0 AS {c}_mean, "
            f"abs(a.{c} - b.{c}) / (abs(a.{c}) + abs(b.{c}) + {eps}) AS {c}_asym")


_ROW = [f"{c}_{k}" for c in _SIDE_COLS for k in _FOLDS]
_GCOLS = ["g_p50", "g_p90", "g_p99", "g_p999", "g_max"]


@query("f10_scan_features", "uid:i " + " ".join(f"{c}:{'d3' if c.startswith('elong') else 'd6'}" for c in [*_GCOLS, *_ROW]),
       f"SELECT g.*, {', '.join(_fold_sql(c, '1e-6') for c in _SIDE_COLS)} FROM ps a JOIN ps b ON a.uid = b.uid AND a.side = 'R' AND b.side = 'L' JOIN g ON g.uid = a.uid",
       ["stack16"], [*PEAKS, ("tk", _TOPK), ("vol", _VOL), ("hot_", _HOT), ("cen", _CEN), ("elo", _ELONG), ("f8", _F8), ("f9", _F9),
                     ("ps", "SELECT * FROM tk JOIN vol USING (uid, side) JOIN hot_ USING (uid, side) JOIN cen USING (uid, side) JOIN elo USING (uid, side) "
                            "JOIN f8 USING (uid, side) JOIN f9 USING (uid, side)"),
                     ("g", """SELECT uid, quantile_cont(v, 5e-1) AS g_p50, quantile_cont(v, 9e-1) AS g_p90, quantile_cont(v, 99e-2) AS g_p99, quantile_cont(v, 999e-3) AS g_p999,
                         max(v) + 1e-6 AS g_max FROM stack16 GROUP BY uid""")])
def f10s(spark, sf):
    """Every column of the wide feature row."""
    return _plain(X.scan_features(fx.stack16(spark, sf), fx.STACK16, HALF))


_ZONES = """SELECT z.*, ref FROM (SELECT uid, code, avg(v) AS m, sum(v) AS s, count(*) AS n, avg(v) FILTER (r <= greatest(5, n // 4)) AS t FROM (
    SELECT uid, code, v, row_number() OVER (PARTITION BY uid, code ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY uid, code) AS n
    FROM voxels JOIN atlas4 USING (z, y, x)) GROUP BY uid, code) z JOIN (SELECT uid, avg(v) + 1e-3 AS ref FROM voxels WHERE z = 0 GROUP BY uid) r ON r.uid = z.uid WHERE code <> 9"""


def _zone(code: int, e: str) -> str:
    return f"max({e} / ref - 1e0) FILTER ((code - 1) % 3 = {code})"


_RATIO = f"""SELECT uid, CASE WHEN code <= 3 THEN 'a' ELSE 'b' END AS side, {_zone(0, "m")} AS caud_sbr, {_zone(0, "t")} AS caud_top, {_zone(1, "m")} AS put_ant_sbr,
    {_zone(1, "t")} AS put_ant_top, {_zone(2, "m")} AS put_post_sbr, {_zone(2, "t")} AS put_post_top,
    (sum(s) FILTER ((code - 1) % 3 <> 0)) / (sum(n) FILTER ((code - 1) % 3 <> 0)) / max(ref) - 1e0 AS put_sbr, sum(s) / sum(n) / max(ref) - 1e0 AS str_sbr, max(ref) AS ref
    FROM zs GROUP BY uid, CASE WHEN code <= 3 THEN 'a' ELSE 'b' END"""
_ZCOLS = "caud_sbr:d6 caud_top:d6 put_ant_sbr:d6 put_ant_top:d6 put_post_sbr:d6 put_post_top:d6 put_sbr:d6 str_sbr:d6"


@query("f11_zonal_ratio", f"uid:i side:s {_ZCOLS} ref:d6", _RATIO, ["atlas4"], [("zs", _ZONES)])
def f11(spark, sf):
    return X.zonal_ratio(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf)))


@query("f12_zone_ratios", "uid:i side:s put_caud:d6 post_ant:d6 post_caud:d6", """SELECT uid, side, (put_sbr + 5e-2) / (caud_sbr + 5e-2) AS put_caud,
    (put_post_sbr + 5e-2) / (put_ant_sbr + 5e-2) AS post_ant, (put_post_sbr + 5e-2) / (caud_sbr + 5e-2) AS post_caud FROM zr""", ["atlas4"], [("zs", _ZONES), ("zr", _RATIO)])
def f12(spark, sf):
    return X.zone_ratios(X.zonal_ratio(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf))))


_ZSIDE = ["caud_sbr", "caud_top", "put_ant_sbr", "put_ant_top", "put_post_sbr", "put_post_top", "put_sbr", "str_sbr", "put_caud", "post_ant", "post_caud"]


@query("f12_zone_features", "uid:i v_ref:d6 " + " ".join(f"v_{c}_{k}:d6" for c in _ZSIDE for k in _FOLDS), "SELECT a.uid, a.ref AS v_ref, " + ", ".join(
    _fold_sql(c, "1e-3").replace(f"AS {c}_", f"AS v_{c}_") for c in _ZSIDE) + " FROM zq a JOIN zq b ON a.uid = b.uid AND a.side = 'a' AND b.side = 'b'", ["atlas4"], [
    ("zs", _ZONES), ("zr", _RATIO), ("zq", """SELECT *, (put_sbr + 5e-2) / (caud_sbr + 5e-2) AS put_caud, (put_post_sbr + 5e-2) / (put_ant_sbr + 5e-2) AS post_ant,
        (put_post_sbr + 5e-2) / (caud_sbr + 5e-2) AS post_caud FROM zr""")])
def f12f(spark, sf):
    """Every column of the wide zone row."""
    return X.zone_features(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf)))


@query("f13_profile", "uid:i side:s p0:d6 p1:d6 p2:d6 p3:d6 p_top:d6 slope:d6", """SELECT uid, side, avg(w) FILTER (b = 0) AS p0, avg(w) FILTER (b = 1) AS p1, avg(w) FILTER (b = 2) AS p2,
    avg(w) FILTER (b = 3) AS p3, avg(w) FILTER (r <= n // 3) AS p_top, regr_slope(w, y) AS slope FROM (SELECT *, (y >= q1)::INTEGER + (y >= q2)::INTEGER + (y >= q3)::INTEGER AS b FROM (
    SELECT *, quantile_cont(y::DOUBLE, 25e-2) OVER p AS q1, quantile_cont(y::DOUBLE, 5e-1) OVER p AS q2, quantile_cont(y::DOUBLE, 75e-2) OVER p AS q3, count(*) OVER p AS n,
    row_number() OVER (PARTITION BY uid, side ORDER BY w DESC) AS r FROM (SELECT v.uid, y, CASE WHEN code <= 3 THEN 'a' ELSE 'b' END AS side, v / ref - 1e0 AS w
    FROM voxels v JOIN atlas4 USING (z, y, x) JOIN (SELECT uid, avg(v) + 1e-3 AS ref FROM voxels WHERE z = 0 GROUP BY uid) g ON g.uid = v.uid
    WHERE code <> 9 AND (code - 1) % 3 <> 0) WINDOW p AS (PARTITION BY uid, side))) GROUP BY uid, side""", ["atlas4"])
def f13(spark, sf):
    return X.profile_bins_slope(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf)))


_REFS = "r_occ_p75:d6 r_occ_bg:d6 r_p75_bg:d6 " + " ".join(f"m_{r}_{k}:d6" for r in ("bg", "occ", "p75") for k in ("postput_min", "put_mean", "caud_mean", "stri_mean"))
_MREF = ", ".join(f"least(pp0, pp1) / {rv} AS m_{r}_postput_min, (pu0 + pu1) / 2e0 / {rv} AS m_{r}_put_mean, (ca0 + ca1) / 2e0 / {rv} AS m_{r}_caud_mean, st / {rv} AS m_{r}_stri_mean"
                  for r, rv in (("bg", "1e0"), ("occ", "occ"), ("p75", "p75")))


@query("f14_multi_reference", f"uid:i {_REFS}", f"""SELECT uid, occ / p75 AS r_occ_p75, occ AS r_occ_bg, p75 AS r_p75_bg, {_MREF} FROM (SELECT uid,
    avg(v) FILTER (z = 0 AND y < 2) + 1e-3 AS occ, quantile_cont(v, 75e-2) FILTER (z = 0 AND x < 3) + 1e-3 AS p75, avg(v) FILTER (code = 3) AS pp0, avg(v) FILTER (code = 6) AS pp1,
    avg(v) FILTER (code IN (2, 3)) AS pu0, avg(v) FILTER (code IN (5, 6)) AS pu1, avg(v) FILTER (code = 1) AS ca0, avg(v) FILTER (code = 4) AS ca1,
    avg(v) FILTER (code <= 6) AS st FROM voxels JOIN atlas4 USING (z, y, x) GROUP BY uid)""", ["atlas4"])
def f14(spark, sf):
    a = fx.atlas4(spark, sf)
    return X.multi_reference(fx.voxels(spark, sf), a, a.where("code = 9 AND x < 3"), a.where("code = 9 AND y < 2"))


def _grown(src: str) -> str:
    return dilate_sql(src).replace("BETWEEN 0 AND 15", "BETWEEN 0 AND 3").replace("BETWEEN 0 AND 7", "BETWEEN 0 AND 3")


@query("f15_integrated_excess", "uid:i k:i i_min:d6 i_max:d6 i_asym:d6", """SELECT uid, k, least(a, b) AS i_min, greatest(a, b) AS i_max, abs(a - b) / (a + b + 1e-3) AS i_asym FROM (
    SELECT uid, k, coalesce(sum(greatest(v - 1e0, 0e0)) FILTER (x < 2), 0e0) * 8e-3 AS a, coalesce(sum(greatest(v - 1e0, 0e0)) FILTER (x >= 2), 0e0) * 8e-3 AS b FROM voxels JOIN s USING (z, y, x)
    GROUP BY uid, k)""", ["atlas4"], [("c", "SELECT 0 AS uid, z, y, x FROM atlas4 WHERE code BETWEEN 1 AND 6"), ("c1", _grown("c")), ("c2", _grown("c1")), ("c3", _grown("c2")), ("c4", _grown("c3")),
                                      ("s", "SELECT z, y, x, 0 AS k FROM c UNION ALL SELECT z, y, x, 2 FROM c2 UNION ALL SELECT z, y, x, 4 FROM c4")])
def f15(spark, sf):
    """All zones, as they are and grown by two and by four steps."""
    return X.integrated_excess(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf)), fx.GRID4)


_CTX = f"""SELECT uid, count(*) * 64e-3 AS c_vol_ml, (max(x) - min(x) + 1) * 4e0 AS c_ext_x, (max(y) - min(y) + 1) * 4e0 AS c_ext_y, (max(z) - min(z) + 1) * 4e0 AS c_ext_z,
    avg((v < 4e-1)::INTEGER) FILTER (use) AS c_low04, avg((v < 6e-1)::INTEGER) FILTER (use) AS c_low06,
    quantile_cont(v, 75e-2) FILTER (use) - quantile_cont(v, 25e-2) FILTER (use) AS c_iqr, stddev_pop(v) FILTER (use) / (avg(v) FILTER (use) + 1e-6) AS c_cv,
    quantile_cont(v, 1e-1) FILTER (use) AS c_p10, quantile_cont(v, 9e-1) FILTER (use) AS c_p90, avg(v) FILTER (y > my) / (avg(v) FILTER (y <= my) + 1e-6) AS c_ant_post,
    avg(v) FILTER (z > mz) / (avg(v) FILTER (z <= mz) + 1e-6) AS c_sup_inf, avg(v) FILTER (r <= 300) AS c_top_mean FROM (
    SELECT *, inn OR count(*) FILTER (inn) OVER p <= 50 AS use, median(y) OVER p AS my, median(z) OVER p AS mz, row_number() OVER (PARTITION BY uid ORDER BY v DESC) AS r FROM (
    SELECT b.*, e.uid IS NOT NULL AS inn FROM b LEFT JOIN e ON e.uid = b.uid AND e.z = b.z AND e.y = b.y AND e.x = b.x) WINDOW p AS (PARTITION BY uid)) GROUP BY uid"""
_CCOLS = "c_vol_ml c_ext_x c_ext_y c_ext_z c_low04 c_low06 c_iqr c_cv c_p10 c_p90 c_ant_post c_sup_inf c_top_mean"


@query("f16_context", "uid:i " + " ".join(f"{c}:d6" for c in _CCOLS.split()), _CTX, ["stack16"], [
    ("m", MASK16), ("b", "SELECT uid, z, y, x, v FROM (SELECT *, max(z) OVER (PARTITION BY uid) AS t FROM m) WHERE z >= greatest(t - 27, 0) AND z < greatest(t - 5, 1)"), ("e", erode_sql("b"))])
def f16(spark, sf):
    return X.context_features(fx.stack16(spark, sf), mask16(spark, sf), shrink=1)


@query("f17_asymmetry", "uid:i asym:d6 subset:s", """SELECT uid, asym, CASE WHEN abs(asym) < q THEN 'bilateral' WHEN asym < -q THEN 'a_reduced' WHEN asym > q THEN 'b_reduced' END AS subset FROM (
    SELECT *, median(abs(asym)) OVER () AS q FROM (SELECT uid, (a - b) / (a + b) AS asym FROM (SELECT uid, avg(v) FILTER (code <= 3) AS a, avg(v) FILTER (code BETWEEN 4 AND 6) AS b
    FROM voxels JOIN atlas4 USING (z, y, x) GROUP BY uid)))""", ["atlas4"])
def f17(spark, sf):
    return X.asymmetry_subsets(X.signed_asymmetry(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf))))
