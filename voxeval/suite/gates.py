"""Gates, streams and the external scorer: Q1-Q8, ST1, U1."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import sigmoid, uniform
from voxeval.operators import gates as Q
from voxeval.operators.calibration import temperature_floor_grid
from voxeval.operators.ensemble import hierarchical_weights
from voxeval.session import stage
from voxeval.sources.tables import union_runs
from voxeval.streaming import scoring as ST
from voxeval.suite.base import clip, loss, query, sig, u

_SUB = f"""SELECT uid, pos + CASE WHEN pos % 500 = 7 THEN 1 ELSE 0 END AS pos, CASE WHEN r < 1e-2 THEN NULL WHEN r < 2e-2 THEN 15e-1 ELSE {sig("x")} END AS p
    FROM (SELECT *, {u("uid", "'sub'")} AS r FROM subjects) WHERE r < 95e-2 UNION ALL SELECT 'x' || uid, pos, 5e-1 FROM subjects WHERE zoom > 38e-1"""


def _submission(spark, sf):
    """Every kind of fault, at hashed places."""
    s = fx.subjects(spark, sf).withColumn("r", uniform(F.col("uid"), "sub"))
    p = F.when(F.col("r") < 0.01, F.lit(None).cast("double")).when(F.col("r") < 0.02, F.lit(1.5)).otherwise(sigmoid("x"))
    sub = s.where("r < 0.95").select("uid", (F.col("pos") + F.when(F.col("pos") % 500 == 7, 1).otherwise(0)).alias("pos"), p.alias("is_pathologic"))
    return sub.unionByName(s.where("zoom > 3.8").select(F.concat(F.lit("x"), "uid").alias("uid"), "pos", F.lit(0.5).alias("is_pathologic")))


@query("q1_check_submission", "matched:i missing:i extra:i out_of_order:i nulls:i out_of_range:i", """SELECT count(*) FILTER (f.uid IS NOT NULL AND s.uid IS NOT NULL) AS matched,
    count(*) FILTER (s.uid IS NULL) AS missing, count(*) FILTER (f.uid IS NULL) AS extra, count(*) FILTER (f.pos <> s.pos) AS out_of_order,
    count(*) FILTER (s.uid IS NOT NULL AND p IS NULL) AS nulls, count(*) FILTER (p NOT BETWEEN 0 AND 1) AS out_of_range
    FROM subjects f FULL JOIN s ON f.uid = s.uid""", ["subjects"], [("s", _SUB)])
def q1(spark, sf):
    return Q.check_submission(_submission(spark, sf), fx.subjects(spark, sf).select("uid", "pos"))


@query("q1_submission_difference", "uid:s side:s", """SELECT uid, 'missing' AS side FROM (SELECT uid FROM subjects EXCEPT ALL SELECT uid FROM s) UNION ALL
    SELECT uid, 'extra' FROM (SELECT uid FROM s EXCEPT ALL SELECT uid FROM subjects)""", ["subjects"], [("s", _SUB)])
def q1d(spark, sf):
    return Q.submission_difference(_submission(spark, sf), fx.subjects(spark, sf))


@query("q2_check_identical", "n:i max_abs:d6 identical:b", "SELECT count(*) AS n, 0e0 AS max_abs, true AS identical FROM subjects", ["subjects"])
def q2(spark, sf):
    a = fx.subjects(spark, sf).select("uid", sigmoid("x").alias("p"))
    return Q.check_identical(a, a.repartition(5, "uid"), "p")


@query("q2_check_different", "n:i max_abs:d6 identical:b", f"""SELECT count(*) AS n, max(abs({sig("x")} - {sig("x + 1e-1 * (zoom > 3e0)::INTEGER")})) AS max_abs, false AS identical
    FROM subjects""", ["subjects"])
def q2d(spark, sf):
    """Two tables that differ for wide spacings."""
    s = fx.subjects(spark, sf)
    return Q.check_identical(s.select("uid", sigmoid("x").alias("p")), s.select("uid", sigmoid(F.col("x") + F.when(F.col("zoom") > 3.0, 0.1).otherwise(0.0)).alias("p")), "p")


@query("q3_missing_assets", "run:s file:s", f"""SELECT DISTINCT run, file FROM raw_oof WHERE NOT {u("file", "'there'")} < 9e-1""", ["raw_oof"])
def q3(spark, sf):
    files = stage(fx.raw_oof(spark, sf).select("run", "file").distinct())
    have = files.where(uniform(F.col("file"), "there") < 0.9).select("file").distinct()
    return Q.missing_assets(files, have)


@query("q4_check_weights", "family:s files:i total:d6 spread:d6 sums_to_one:b", """SELECT family, count(DISTINCT run || file) AS files, 1e0 AS total, 0e0 AS spread, true AS sums_to_one
    FROM raw_oof GROUP BY family""", ["raw_oof"])
def q4(spark, sf):
    files = fx.raw_oof(spark, sf).select("run", "family", "file").distinct()
    return Q.check_weights(hierarchical_weights(files, {"a": 0.5, "b": 0.3, "c": 0.2}, "run"), ("family",), "run")


@query("q4_check_bad_weights", "family:s files:i total:d6 spread:d6 sums_to_one:b", """SELECT family, sum(n)::BIGINT AS files, sum(w) AS total, max(s) AS spread, abs(sum(w) - 1e0) < 1e-9 AS sums_to_one
    FROM (SELECT family, run, count(*) AS n, sum(w) AS w, max(w) - min(w) AS s FROM (SELECT DISTINCT family, run, file, CASE WHEN seed = 2 THEN 4e-2 ELSE 2e-2 END AS w FROM raw_oof)
    GROUP BY family, run) GROUP BY family""", ["raw_oof"])
def q4b(spark, sf):
    """Weights that depend on the seed and don't sum to one."""
    files = fx.raw_oof(spark, sf).select("run", "family", "file", F.when(F.col("seed") == 2, 0.04).otherwise(0.02).alias("weight")).distinct()
    return Q.check_weights(files, ("family",), "run")


@query("q5_leak_check", "file:s leaks:i", """SELECT file, count(*) AS leaks FROM (SELECT r.uid, r.file, h.fold AS held, o.fold AS own FROM raw_oof r
    JOIN (SELECT DISTINCT file, fold FROM raw_oof WHERE run = 'a') h ON h.file = r.file JOIN folded o ON o.uid = r.uid AND o.run = 'a' WHERE r.run = 'b') WHERE held <> own GROUP BY file""",
       ["raw_oof", "folded"])
def q5(spark, sf):
    """Rows of run b claimed for checkpoints of run a with the same file names: most are leaks."""
    raw = fx.raw_oof(spark, sf, ("a", "b"))
    files = stage(raw.where("run = 'a'").select("file", F.col("run").alias("split"), "fold").distinct())
    folds = fx.folded(spark, sf, ("a",)).select("uid", F.col("run").alias("split"), "fold")
    return Q.leak_check(raw.where("run = 'b'"), folds, files)


@query("q6_coverage_report", "ok:i loc_note:i n:i", "SELECT ok, loc_note, count(*) AS n FROM scans GROUP BY ok, loc_note", ["scans"])
def q6(spark, sf):
    return Q.coverage_report(fx.scans(spark, sf))


@query("q7_union_runs", "run:s uid:s z:d6 seeds:i", """SELECT 'first' AS run, uid, cnn AS z, 3 AS seeds FROM wide_oof UNION ALL SELECT 'second', uid, gbm, NULL FROM wide_oof""", ["wide_oof"])
def q7(spark, sf):
    w = fx.wide_oof(spark, sf)
    return union_runs({"first": w.select("uid", F.col("cnn").alias("z"), F.lit(3).alias("seeds")), "second": w.select(F.col("gbm").alias("z"), "uid")})


_GRID = f"""SELECT t AS temp, e AS floor, avg({loss("y", clip(sig("cnn / t"), "greatest(e, 1e-15)", "1e0 - greatest(e, 1e-15)"))}) AS loss FROM wide_oof,
    (VALUES (8e-1), (1e0), (12e-1), (15e-1)) a(t), (VALUES (0e0), (1e-2), (3e-2)) b(e) GROUP BY t, e"""


@query("q8_topn_grid", "temp:d6 floor:d6 loss:d6", f"SELECT * FROM ({_GRID}) ORDER BY loss, temp, floor LIMIT 8", ["wide_oof"])
def q8(spark, sf):
    grid = temperature_floor_grid(fx.wide_oof(spark, sf), (0.8, 1.0, 1.2, 1.5), (0.0, 0.01, 0.03), z="cnn")
    return Q.topn_grid(grid, 8, ties=("temp", "floor"))


MODELS = [({"cols": ["o_totalprice"], "mu": [250000.0], "sd": [144000.0], "coef": [2.0], "b": 0.0}, 1.0),
          ({"cols": ["o_totalprice", "absent"], "mu": [240000.0, 0.0], "sd": [150000.0, 1.0], "coef": [1.5, 1.0], "b": 0.1}, 2.0)]
_ZS = """(2e0 * least(greatest((o_totalprice - 250000e0) / 144000e0, -6e0), 6e0) + 2e0 * (1e-1 + 15e-1 * least(greatest((o_totalprice - 240000e0) / 150000e0, -6e0), 6e0))) / 3e0"""


@query("st1_score_stream", "uid:s p:d6", f"""SELECT o_orderkey::VARCHAR AS uid, CASE WHEN o_orderpriority <> '1-URGENT' THEN {clip(sig(_ZS), "1e-3", "(1e0 - 1e-3)")} ELSE 55e-2 END AS p
    FROM orders""")
def st1(spark, sf):
    """The orders file read as a stream, scored and written in append mode."""
    schema = fx.table(spark, sf, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    rows = stream.select(F.col("o_orderkey").cast("string").alias("uid"), "o_totalprice", F.when(F.col("o_orderpriority") != "1-URGENT", 1).otherwise(0).alias("ok"))
    out = ST.run_available(ST.score_stream(rows, MODELS, eps=0.0, prior=0.55))
    return spark.read.schema("uid string, p double").parquet(out)


def _loader():
    """Stands for an external model that is costly to load."""
    def model(pdf):
        return np.tanh(pdf["x"] + 0.3 * pdf["zoom"])

    return model


@query("u1_batch_score", "uid:s z:d6", "SELECT uid, tanh(x + 3e-1 * zoom) AS z FROM subjects", ["subjects"])
def u1(spark, sf):
    return ST.batch_score(fx.subjects(spark, sf), _loader, ["x", "zoom"])
