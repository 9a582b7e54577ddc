"""Metrics and reports: M1-M13."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import sigmoid
from voxeval.operators import metrics as M
from voxeval.operators.joins import argbest_candidate
from voxeval.operators.rasters import center_of_mass
from voxeval.plans.bounded import with_grid
from voxeval.session import stage
from voxeval.suite.base import auc_sql, loss, query, sig, u


@query("m1_logloss", "zfam:s n:i logloss:d6", f"SELECT zfam, count(*) AS n, avg({loss('y', sig('2e0 * x'))}) AS logloss FROM subjects GROUP BY zfam", ["subjects"])
def m1(spark, sf):
    return M.logloss(fx.subjects(spark, sf).withColumn("p", sigmoid(F.col("x") * 2.0)), ["zfam"])


@query("m2_auc", "auc:d6", auc_sql("subjects", [], z="x"), ["subjects"])
def m2(spark, sf):
    return M.auc(fx.subjects(spark, sf), z="x")


@query("m2_auc_by_group", "grp:s auc:d6", auc_sql("(SELECT grp, y, round(x * 20e0) AS t FROM subjects)", ["grp"], z="t"), ["subjects"])
def m2g(spark, sf):
    """Coarse scores, so that ties matter."""
    return M.auc(fx.subjects(spark, sf).withColumn("t", F.round(F.col("x") * 20.0)), ["grp"], z="t")


@query("m3_group_report", "grp:s n:i logloss:d6", f"""SELECT grp, count(*) AS n, avg({loss('y', sig('cnn'))}) AS logloss FROM wide_oof GROUP BY grp
    ORDER BY n DESC, grp LIMIT 12""", ["wide_oof"])
def m3(spark, sf):
    return M.group_report(fx.wide_oof(spark, sf).withColumn("p", sigmoid("cnn")), "grp")


@query("m4_scoreboard", "run:s family:s n:i logloss:d6 auc:d6", f"""SELECT l.run, l.family, n, logloss, auc FROM (SELECT run, family, count(*) AS n,
    avg({loss('y', sig('z'))}) AS logloss FROM e GROUP BY run, family) l JOIN ({auc_sql("e", ["run", "family"])}) a ON l.run = a.run AND l.family = a.family""",
       ["raw_oof"], [("e", "SELECT uid, run, family, any_value(y) AS y, avg(z) AS z FROM raw_oof GROUP BY uid, run, family")])
def m4(spark, sf):
    """Seed means of every run and family, scored."""
    from voxeval.operators.ensemble import seed_mean

    return M.scoreboard(seed_mean(fx.raw_oof(spark, sf), families=tuple(fx.SLOPES)), ["run", "family"])


_DELTA = f"SELECT uid, fold, {loss('y', sig('(cnn + gbm) / 2e0'))} - {loss('y', sig('cnn'))} AS d FROM wide_oof"


def _delta(spark, sf):
    w = stage(fx.wide_oof(spark, sf).select("uid", "y", "cnn", "gbm"))
    base = w.select("uid", "y", sigmoid("cnn").alias("p"))
    return M.paired_delta(base, w.select("uid", sigmoid((F.col("cnn") + F.col("gbm")) / 2).alias("p")))


@query("m5_paired_delta", "uid:s d:d6", _DELTA, ["wide_oof"])
def m5(spark, sf):
    return _delta(spark, sf)


B = 2000
_KEYS = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT)" for i, (a, b, c) in enumerate(M.replicate_keys(B)))
_STEPS = " + ".join(f"(q >= {c}::DOUBLE)::INTEGER" for c in (repr(v) for v in M._poisson_cdf()))


@query("m6_paired_bootstrap", "replicates:i share_better:d6 mean_d:d6 sd_d:d6", """SELECT count(*) AS replicates, avg((m < 0)::INTEGER) AS share_better, avg(m) AS mean_d,
    stddev_pop(m) AS sd_d FROM r""", ["wide_oof"], [
    ("d", _DELTA), ("k", f"SELECT * FROM (VALUES {_KEYS}) t(rep, a, b, c)"),
    ("r", f"""SELECT rep, sum(w * d) / sum(w) AS m FROM (SELECT rep, d, {_STEPS} AS w FROM (SELECT rep, d, ((h * a + g * b + c) % 2147483647) / 2147483647e0 AS q
        FROM (SELECT d, ('0x' || substr(md5(concat_ws('-', uid, '0')), 1, 8))::BIGINT % 2147483647 AS h,
            ('0x' || substr(md5(concat_ws('-', uid, '0b')), 1, 8))::BIGINT % 2147483647 AS g FROM d), k)) GROUP BY rep"""),
])
def m6(spark, sf):
    return M.paired_bootstrap(_delta(spark, sf), B)


@query("m7_model_correlation", "a:s b:s corr:d6", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM wide_oof" for a, b in
    (("cnn1", "cnn2"), ("cnn1", "gbm"), ("cnn1", "lr"), ("cnn2", "gbm"), ("cnn2", "lr"), ("gbm", "lr"))), ["wide_oof"])
def m7(spark, sf):
    return M.model_correlation(fx.wide_oof(spark, sf), list(fx.SLOPES))


@query("m8_disagreement", "uid:s sd:d6", """SELECT uid, stddev_pop(z) AS sd FROM (SELECT uid, family, avg(z) AS z FROM raw_oof WHERE run = 'a' GROUP BY uid, family)
    GROUP BY uid""", ["raw_oof"])
def m8(spark, sf):
    from voxeval.operators.ensemble import seed_mean

    return M.disagreement(seed_mean(fx.raw_oof(spark, sf, ("a",)), families=tuple(fx.SLOPES)))


@query("m9_shift_report", "kind:s n:i median:d6 p90:d6 worst:d6 share_above:d6", """SELECT kind, count(*) AS n, quantile_cont(mm, 5e-1) AS median, quantile_cont(mm, 9e-1) AS p90,
    max(mm) AS worst, avg((mm > 15)::INTEGER) AS share_above FROM shifts WHERE mm IS NOT NULL GROUP BY kind""", ["shifts"])
def m9(spark, sf):
    return M.shift_report(fx.shifts(spark, sf))


_COM = "SELECT uid, sum(v * z) / sum(v) AS cz, sum(v * y) / sum(v) AS cy, sum(v * x) / sum(v) AS cx FROM voxels GROUP BY uid"
_COS, _SIN = repr(math.cos(math.radians(20.0))), repr(math.sin(math.radians(20.0)))


@query("m10_localization_error", "uid:i mm:d6", f"""SELECT uid, sqrt(power((cy - (15e-1 + (cy - 15e-1) * {_COS}::DOUBLE - (cx - 15e-1) * {_SIN}::DOUBLE)) * 4e0, 2e0)
    + power((cx - (15e-1 + (cy - 15e-1) * {_SIN}::DOUBLE + (cx - 15e-1) * {_COS}::DOUBLE)) * 2e0, 2e0)) AS mm FROM ({_COM})""", ["voxels"])
def m10(spark, sf):
    """How far a localiser that ignores a 20 degree turn would be off."""
    com = center_of_mass(fx.voxels(spark, sf), "v")
    z, y, x = M.rotate_centre(("cz", "cy", "cx"), fx.GRID4, 20.0, (1, 2))
    return M.localization_error(com, com.select("uid", z.alias("cz"), y.alias("cy"), x.alias("cx")), (2.0, 4.0, 2.0))


KINDS = [("clean", 2.0, 0.0, 0.0), ("blur", 1.4, 0.0, 0.0), ("noise", 2.0, 0.0, 3.0), ("shift", 2.0, 0.4, 0.5)]
_KVAL = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, a, b, c in KINDS)


@query("m11_degradation", "kind:s n:i logloss:d6 auc:d6 delta:d6", f"""SELECT l.kind, n, logloss, auc, logloss - max(CASE WHEN l.kind = 'clean' THEN logloss END) OVER () AS delta
    FROM (SELECT kind, count(*) AS n, avg({loss('y', sig('z'))}) AS logloss FROM k GROUP BY kind) l JOIN ({auc_sql("k", ["kind"])}) a ON a.kind = l.kind""",
       ["subjects"], [("k", f"""SELECT kind, y, a * x + b + c * ({u("uid", "kind")} - 5e-1) AS z FROM subjects, (VALUES {_KVAL}) t(kind, a, b, c)""")])
def m11(spark, sf):
    from voxeval.functions.scalars import uniform

    rows = with_grid(fx.subjects(spark, sf).select("uid", "x", "y"), [{"kind": k, "_a": a, "_b": b, "_c": c} for k, a, b, c in KINDS])
    z = F.col("_a") * F.col("x") + F.col("_b") + F.col("_c") * (uniform(F.col("uid"), F.col("kind")) - 0.5)
    return M.degradation_report(rows.select("kind", "y", z.alias("z")))


@query("m12_choice_counts", "y:i cand:i n:i", """SELECT y, cand, count(*) AS n FROM (SELECT uid, y, CASE WHEN cnn1 >= cnn2 AND cnn1 >= gbm THEN 0
    WHEN cnn2 >= gbm THEN 1 ELSE 2 END AS cand FROM wide_oof) GROUP BY y, cand""", ["wide_oof"])
def m12(spark, sf):
    w = fx.wide_oof(spark, sf)
    cands = F.array(*[F.struct(F.lit(i).alias("cand"), F.col(c).alias("score")) for i, c in enumerate(("cnn1", "cnn2", "gbm"))])
    best = argbest_candidate(w.select("uid", "y", F.explode(cands).alias("c")).select("uid", "y", "c.*"), "score", "cand", ("uid", "y"))
    return M.choice_counts(best, "cand", "y")


@query("m13_cohort_summary", "n:i pos_rate:d6 groups:i features:i", """SELECT count(*) AS n, avg(y) AS pos_rate, count(DISTINCT grp) AS groups, 5 AS features
    FROM features""", ["features"])
def m13(spark, sf):
    from voxeval.functions.scalars import feature_columns

    rows = fx.features(spark, sf)
    return M.cohort_summary(rows, [c for c in feature_columns(rows) if c not in ("y", "grp", "zfam")])
