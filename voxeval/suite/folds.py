"""Folds, samples and weights: K1-K8."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.operators import folds as K
from voxeval.suite.base import fold_sql, query, sig

_MERGED = """SELECT *, CASE WHEN count(*) OVER (PARTITION BY key) >= {k} THEN key ELSE 'rare_' || y END AS stratum FROM (
    SELECT *, (CASE WHEN count(*) OVER (PARTITION BY {g}) >= 2 * {k} THEN {g} ELSE 'rare' END) || '_' || y AS key FROM subjects)"""


@query("k1_merge_rare", "uid:s stratum:s", _MERGED.format(k=5, g="cust"), ["subjects"])
def k1(spark, sf):
    """Customers as groups of about ten rows, so that both rules apply."""
    return K.merge_rare(fx.subjects(spark, sf), 5, "cust")


@query("k2_stratified_folds", "uid:s fold:i", f"SELECT uid, {fold_sql(['stratum'], '5', chr(39) + '2026' + chr(39))} AS fold FROM m", ["subjects"],
       [("m", _MERGED.format(k=5, g="grp"))])
def k2(spark, sf):
    return K.stratified_folds(K.merge_rare(fx.subjects(spark, sf), 5), ["stratum"], 5, 2026)


_GROUP = """SELECT zfam, (CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END + h) % 5 AS fold FROM (SELECT zfam, band,
    row_number() OVER (PARTITION BY band ORDER BY n DESC, md5(concat_ws('-', zfam, '7'))) - 1 AS p,
    ('0x' || substr(md5(concat_ws('-', band::BIGINT::VARCHAR, '7')), 1, 8))::BIGINT % 5 AS h FROM (
    SELECT zfam, count(*) AS n, floor(avg(y) * 10e0) AS band FROM subjects GROUP BY zfam))"""


@query("k3_group_folds", "uid:s zfam:s fold:i", "SELECT s.uid, s.zfam, g.fold FROM subjects s JOIN g ON s.zfam = g.zfam", ["subjects"], [("g", _GROUP)])
def k3(spark, sf):
    return K.group_folds(fx.subjects(spark, sf), 5, 7, "zfam")


_OUTER = "SELECT uid, y, fold, o AS outer_ FROM folded, (VALUES (0), (1), (2), (3), (4)) t(o) WHERE run = 'a' AND fold <> o"


@query("k4_inner_folds", "uid:s outer_fold:i inner_fold:i", f"""SELECT uid, outer_ AS outer_fold, f AS inner_fold FROM (SELECT uid, outer_,
    {fold_sql(["outer_", "y"], "4", "(outer_ + 100)::VARCHAR")} AS f FROM o)""", ["folded"], [("o", _OUTER)])
def k4(spark, sf):
    return K.inner_folds(fx.folded(spark, sf, ("a",)).select("uid", "y", "fold"), 5, 4, 100)


@query("k5_fold_balance", "run:s fold:i n:i rate:d6", "SELECT run, fold, count(*) AS n, avg(y) AS rate FROM folded GROUP BY run, fold", ["folded"])
def k5(spark, sf):
    return K.fold_balance(fx.folded(spark, sf), ["run"])


@query("k5_fold_violations", "run:s units:i violations:i", """SELECT run, count(*) AS units, count(*) FILTER (lo <> hi) AS violations FROM (
    SELECT run, zfam, min(fold) AS lo, max(fold) AS hi FROM folded GROUP BY run, zfam) GROUP BY run""", ["folded"])
def k5v(spark, sf):
    """Stratified folds do split families, so every family is a violation here."""
    return K.fold_violations(fx.folded(spark, sf), "run", "zfam")


@query("k6_noise_weights", "outer_fold:i n:i n_bad:i share:d6 mean_w:d6", f"""SELECT outer_ AS outer_fold, count(*) AS n, count(*) FILTER (b) AS n_bad, avg(b::INTEGER) AS share,
    avg(CASE WHEN b THEN 3e-1 ELSE 1e0 END) AS mean_w FROM (SELECT o AS outer_, abs({sig("cnn + 1e-1 * o")} - y) > 8e-1 AS b FROM wide_oof,
    (VALUES (0), (1), (2), (3), (4)) t(o) WHERE fold <> o) GROUP BY outer_""", ["wide_oof"])
def k6(spark, sf):
    """Inner scores given: here a fixed function of the row and the outer fold."""
    rows = K.outer_training_rows(fx.wide_oof(spark, sf), 5).withColumn("z", F.col("cnn") + F.col("outer_fold") * 0.1)
    w = K.noise_weights(rows)
    means = w.groupBy("outer_fold").agg(F.avg("w").alias("mean_w"))
    return K.noise_summary(w).join(means, "outer_fold")


@query("k7_balanced_weights", "uid:s zfam:s w:d6", """SELECT uid, zfam, least(count(*) OVER () / (f * count(*) OVER (PARTITION BY zfam) * 1e0), 105e-2) AS w
    FROM subjects, (SELECT count(DISTINCT zfam) AS f FROM subjects)""", ["subjects"])
def k7(spark, sf):
    return K.balanced_weights(fx.subjects(spark, sf), "zfam", 1.05)


@query("k8_sample", "uid:s y:i", "SELECT uid, y FROM subjects ORDER BY md5(concat_ws('-', uid, '3')), uid LIMIT 400", ["subjects"])
def k8(spark, sf):
    return K.sample_k(fx.subjects(spark, sf), 400, 3)
