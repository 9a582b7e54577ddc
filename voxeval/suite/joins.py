"""Joins: J1-J10."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import uniform
from voxeval.operators import joins as J
from voxeval.operators.calibration import temperature_floor_grid
from voxeval.session import stage
from voxeval.suite.base import clip, loss, query, sig, u


@query("j1_attach_labels", "uid:s zoom_x:d6 y:i", "SELECT uid, zoom_x, y FROM scans", ["scans"])
def j1(spark, sf):
    s = fx.scans(spark, sf).select("uid", "zoom_x")
    return J.attach_labels(s, fx.subjects(spark, sf).select("uid", "y"))


@query("j2_align_runs", "n_both:i only_left:i only_right:i fold_differs:i", """SELECT count(*) FILTER (a.uid IS NOT NULL AND b.uid IS NOT NULL) AS n_both,
    count(*) FILTER (b.uid IS NULL) AS only_left, count(*) FILTER (a.uid IS NULL) AS only_right,
    count(*) FILTER (a.fold <> b.fold) AS fold_differs FROM (SELECT * FROM folded WHERE run = 'a' AND y + fold <> 0) a
    FULL JOIN (SELECT * FROM folded WHERE run = 'c' AND fold <> 9) b ON a.uid = b.uid""", ["folded"])
def j2(spark, sf):
    """Two runs that each lack some rows and use different splits."""
    rows = fx.folded(spark, sf, ("a", "c"))
    return J.align_runs(rows.where("run = 'a' AND y + fold <> 0"), rows.where("run = 'c' AND fold <> 9"))


@query("j3_zonal_join", "uid:i z:i y:i x:i v:d6 code:i", "SELECT uid, z, y, x, v, code FROM voxels JOIN atlas4 USING (z, y, x)", ["atlas4"])
def j3(spark, sf):
    return J.zonal_join(fx.voxels(spark, sf), stage(fx.atlas4(spark, sf)))


@query("j4_mirror", "uid:i z:i y:i x:i v:d6", """SELECT a.uid, a.z, a.y, a.x, (a.v + b.v) / 2e0 AS v FROM voxels a JOIN voxels b
    ON a.uid = b.uid AND a.z = b.z AND a.y = b.y AND b.x = 3 - a.x""", ["voxels"])
def j4(spark, sf):
    return J.mirror_mean(fx.voxels(spark, sf), 4)


@query("j4_mirror_difference", "uid:i z:i y:i x:i d:d6", """SELECT a.uid, a.z, a.y, a.x, a.v - b.v AS d FROM voxels a JOIN voxels b
    ON a.uid = b.uid AND a.z = b.z AND a.y = b.y AND b.x = 3 - a.x WHERE a.x < 2""", ["voxels"])
def j4d(spark, sf):
    return J.mirror_difference(fx.voxels(spark, sf), 4)


@query("j5_box_join", "uid:i z:i y:i x:i v:d6", """SELECT v.uid, v.z, v.y, v.x, v.v FROM stack16 v JOIN (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY uid ORDER BY v DESC, z, y, x) AS r FROM stack16) WHERE r = 1) p ON v.uid = p.uid
    AND v.z BETWEEN p.z - 3 AND p.z + 3 AND v.y BETWEEN p.y - 2 AND p.y + 1 AND v.x BETWEEN p.x AND p.x + 2""", ["stack16"])
def j5(spark, sf):
    vox = fx.stack16(spark, sf)
    order = F.struct(F.col("v"), -F.col("z"), -F.col("y"), -F.col("x"))
    peaks = vox.groupBy("uid").agg(F.max_by(F.struct("z", "y", "x"), order).alias("p")).select("uid", "p.*")
    return J.box_join(vox, peaks, (-3, -2, 0), (3, 1, 2))


@query("j6_best_of", "uid:s score:d6 tag:s replaced:b", """SELECT a.uid, CASE WHEN b.score > a.score THEN b.score ELSE a.score END AS score,
    CASE WHEN b.score > a.score THEN 'alt' ELSE 'cur' END AS tag, coalesce(b.score > a.score, false) AS replaced
    FROM (SELECT uid, cnn1 AS score FROM wide_oof) a LEFT JOIN (SELECT uid, cnn2 AS score FROM wide_oof WHERE fold < 3) b ON a.uid = b.uid""", ["wide_oof"])
def j6(spark, sf):
    w = fx.wide_oof(spark, sf)
    alt = w.where("fold < 3").select("uid", F.col("cnn2").alias("score"), F.lit("alt").alias("tag"))
    return J.best_of(w.select("uid", F.col("cnn1").alias("score"), F.lit("cur").alias("tag")), alt, "score")


@query("j7_argbest", "uid:s cand:i score:d6", """SELECT uid, cand, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, cand) AS r
    FROM (SELECT uid, cand, floor((CASE cand WHEN 0 THEN cnn1 WHEN 1 THEN cnn2 WHEN 2 THEN gbm ELSE lr END) * 4e0) AS score
    FROM wide_oof, (VALUES (0), (1), (2), (3)) c(cand))) WHERE r = 1""", ["wide_oof"])
def j7(spark, sf):
    """Coarse scores, so that ties occur."""
    w = fx.wide_oof(spark, sf)
    cands = F.array(*[F.struct(F.lit(i).alias("cand"), F.floor(F.col(c) * 4.0).alias("score")) for i, c in enumerate(("cnn1", "cnn2", "gbm", "lr"))])
    return J.argbest_candidate(w.select("uid", F.explode(cands).alias("c")).select("uid", "c.*"), "score", "cand")


@query("j8_parity", "n:i mean_abs:d6 max_abs:d6", f"""SELECT count(*) AS n, avg(abs({sig("cnn1")} - {sig("cnn2")})) AS mean_abs,
    max(abs({sig("cnn1")} - {sig("cnn2")})) AS max_abs FROM wide_oof""", ["wide_oof"])
def j8(spark, sf):
    from voxeval.functions.scalars import sigmoid

    w = fx.wide_oof(spark, sf)
    return J.parity(w.select("uid", sigmoid("cnn1").alias("p")), w.select("uid", sigmoid("cnn2").alias("p")), "p")


@query("j9_retry", "uid:s ok:i zoom_x:d6", f"""SELECT uid, CASE WHEN ok = 1 OR {u("uid", "'again'")} < 5e-1 THEN 1 ELSE 0 END AS ok,
    CASE WHEN ok = 0 AND {u("uid", "'again'")} < 5e-1 THEN zoom_x + 1e0 ELSE zoom_x END AS zoom_x FROM scans""", ["scans"])
def j9(spark, sf):
    """Failures get a second attempt that works for about half of them."""
    done = fx.scans(spark, sf).select("uid", "ok", "zoom_x")
    again = done.join(J.retry_set(done), "uid").where(uniform(F.col("uid"), "again") < 0.5)
    return J.merge_retries(done, again.select("uid", F.lit(1).alias("ok"), (F.col("zoom_x") + 1.0).alias("zoom_x")))


@query("j10_grid_join", "temp:d6 floor:d6 loss:d6", f"""SELECT t AS temp, e AS floor, avg({loss("y", clip(sig("cnn / t"), "greatest(e, 1e-15)", "1e0 - greatest(e, 1e-15)"))}) AS loss
    FROM wide_oof, (VALUES (1e0), (12e-1), (15e-1)) a(t), (VALUES (0e0), (1e-2), (3e-2)) b(e) GROUP BY t, e""", ["wide_oof"])
def j10(spark, sf):
    return temperature_floor_grid(fx.wide_oof(spark, sf), (1.0, 1.2, 1.5), (0.0, 0.01, 0.03), z="cnn")
