"""Ensembles: E1-E14."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import uniform
from voxeval.operators import ensemble as E
from voxeval.session import stage
from voxeval.suite.base import auc_sql, loss, newton_ctes, query, sig, u
from voxeval.suite.metrics import _KEYS, _STEPS, B

_SEED = "SELECT uid, run, family, any_value(y) AS y, any_value(fold) AS fold, avg(z) AS z FROM raw_oof GROUP BY uid, run, family"
SEED = [("e", _SEED)]
FAMILIES = tuple(fx.SLOPES)


def seeded(spark, sf, runs=("a", "b", "c")):
    return E.seed_mean(fx.raw_oof(spark, sf, runs), families=FAMILIES)


@query("e1_seed_mean", "uid:s run:s family:s z:d6", "SELECT uid, run, family, z FROM e", ["raw_oof"], SEED)
def e1(spark, sf):
    return seeded(spark, sf)


@query("e2_group_mean", "uid:s run:s grp_col:s z:d6", """SELECT uid, run, CASE WHEN family IN ('cnn1', 'cnn2') THEN 'cnn' ELSE family END AS grp_col,
    sum(w * z) / sum(w) AS z FROM (SELECT *, CASE family WHEN 'cnn2' THEN 2e0 ELSE 1e0 END AS w FROM e)
    GROUP BY uid, run, CASE WHEN family IN ('cnn1', 'cnn2') THEN 'cnn' ELSE family END""", ["raw_oof"], SEED)
def e2(spark, sf):
    """A member of the group that no run has is skipped."""
    return E.group_mean(seeded(spark, sf), {"cnn": {"cnn1": 1.0, "cnn2": 2.0, "absent": 3.0}}, ("uid", "run"), families=FAMILIES)


BAG = [{"run": r, "family": f, "weight": w} for r, f, w in (
    ("a", "cnn1", 0.5), ("b", "cnn1", 0.5), ("a", "cnn2", 1.0), ("a", "gbm", 0.5), ("b", "gbm", 0.5), ("a", "lr", 0.25), ("b", "lr", 0.75))]


def _weights_sql(rows) -> str:
    return "(VALUES " + ", ".join(f"('{r['run']}', '{r['family']}', {r['weight']!r}::DOUBLE)" for r in rows) + ") w(run, family, weight)"


@query("e3_bag_splits", "uid:s y:i family:s z:d6", f"""SELECT uid, y, e.family, sum(weight * z) / sum(weight) AS z FROM e JOIN {_weights_sql(BAG)}
    ON w.run = e.run AND w.family = e.family GROUP BY uid, y, e.family""", ["raw_oof"], SEED)
def e3(spark, sf):
    """One family comes from a single split."""
    return E.bag_splits(seeded(spark, sf, ("a", "b")), BAG)


@query("e4_seed_weighted_bag", "uid:s family:s z:d6", """SELECT uid, family, (z1 + z2) / 2e0 AS z FROM (SELECT uid, family, sum(z * k) / sum(k) AS z1 FROM (
    SELECT *, CASE WHEN run = 'a' THEN 1e0 WHEN family IN ('cnn1', 'cnn2') THEN 2e0 ELSE 1e0 END AS k FROM e WHERE run IN ('a', 'b')) GROUP BY uid, family)
    JOIN (SELECT uid, family, z AS z2 FROM e WHERE run = 'c') USING (uid, family)""", ["raw_oof"], SEED)
def e4(spark, sf):
    """Run b counts twice for the families with two seeds; then half and half with run c."""
    counts = {(r, f): 2 if r == "b" and f.startswith("cnn") else 1 for r in "ab" for f in fx.SLOPES}
    rows = stage(seeded(spark, sf))
    bag = E.weighted_mean(rows.where("run <> 'c'"), E.seed_weights(counts), ["run", "family"], ["uid", "family"], families=FAMILIES)
    return E.halves(bag, rows.where("run = 'c'"), ["uid", "family"])


_FILEW = "SELECT DISTINCT file, 1e0 + seed AS weight FROM raw_oof WHERE run = 'a'"


@query("e5_per_checkpoint_mean", "uid:s family:s plain:d6 z:d6", f"""SELECT uid, family, avg(z) AS plain, sum(weight * z) / sum(weight) AS z FROM raw_oof
    JOIN ({_FILEW}) USING (file) WHERE run = 'a' GROUP BY uid, family""", ["raw_oof"])
def e5(spark, sf):
    rows = fx.raw_oof(spark, sf, ("a",))
    w = stage(rows.select("file", (F.lit(1.0) + F.col("seed")).alias("weight")).distinct())
    return E.checkpoint_means(rows.select("uid", "family", "file", "z"), w)


def _files(spark, sf, runs=("a", "b", "c")):
    """Checkpoints of the runs, one row per file."""
    return fx.raw_oof(spark, sf, runs).select("run", "family", "seed", "fold", "file").distinct()


@query("e6_hierarchical_weights", "run:s family:s file:s weight:d8", """SELECT run, family, file, (CASE run WHEN 'a' THEN 5e-1 WHEN 'b' THEN 3e-1 ELSE 2e-1 END)
    / count(*) OVER (PARTITION BY family, run) AS weight FROM (SELECT DISTINCT run, family, file FROM raw_oof)""", ["raw_oof"])
def e6(spark, sf):
    return E.hierarchical_weights(_files(spark, sf), {"a": 0.5, "b": 0.3, "c": 0.2}, "run")


@query("e7_weight_audit", "family:s max_abs:d6 sum_evaluated:d6 sum_deployed:d6", """SELECT family, max(abs(ev - de)) AS max_abs, sum(ev) AS sum_evaluated, sum(de) AS sum_deployed FROM (
    SELECT family, run, 1e0 / 3e0 AS ev, count(*) / (sum(count(*)) OVER (PARTITION BY family) * 1e0) AS de FROM (SELECT DISTINCT run, family, file FROM raw_oof) GROUP BY family, run)
    GROUP BY family""", ["raw_oof"])
def e7(spark, sf):
    """Runs weighted alike in evaluation, files weighted alike in deployment."""
    n = stage(_files(spark, sf).groupBy("family", "run").agg(F.count(F.lit(1)).alias("n")))
    tot = n.groupBy("family").agg(F.sum("n").alias("t"))
    deployed = n.join(tot, "family").select("family", "run", (F.col("n") / F.col("t")).alias("weight"))
    return E.weight_audit(n.select("family", "run", F.lit(1.0 / 3.0).alias("weight")), deployed)


@query("e7_definition_gap", "mean_gap:d6", f"SELECT avg(abs({sig('(cnn1 + cnn2) / 2e0')} - {sig('(cnn1 + 3e0 * cnn2) / 4e0')})) AS mean_gap FROM wide_oof", ["wide_oof"])
def e7g(spark, sf):
    w = fx.wide_oof(spark, sf)
    return E.definition_gap(w.select("uid", E.mix({"cnn1": 1, "cnn2": 1}).alias("z")), w.select("uid", E.mix({"cnn1": 1, "cnn2": 3}).alias("z")))


CANDS = [{"cnn1": 1.0, "cnn2": 1.0}, {"cnn1": 1.0, "cnn2": 2.0}, {"cnn1": 2.0, "cnn2": 1.0}, {"cnn1": 1.0, "cnn2": 0.0}]
_CROWS = f"""SELECT cand, y, fold, gbm, lr, (cnn1 * a + cnn2 * b) / (a + b) AS cnn FROM wide_oof, (VALUES {", ".join(f"({i}, {c['cnn1']!r}::DOUBLE, {c['cnn2']!r}::DOUBLE)"
    for i, c in enumerate(CANDS))}) t(cand, a, b)"""
_LAM10 = ["10e0", "10e0", "10e0", "0e0"]


@query("e8_weight_scan", "cand:i loss:d6 best:b", "SELECT cand, l AS loss, row_number() OVER (ORDER BY l, cand) = 1 AS best FROM s", ["wide_oof"], [
    ("rows_", _CROWS),
    *newton_ctes("n", "rows_", ["cnn", "gbm", "lr"], "SELECT cand, fold AS held FROM (SELECT DISTINCT cand, fold FROM rows_)", ["cand", "held"], "c.cand = r.cand AND c.held <> r.fold", _LAM10),
    ("s", f"""SELECT r.cand, avg({loss('r.y', sig('c.b0 * cnn + c.b1 * gbm + c.b2 * lr + c.b3'))}) AS l FROM rows_ r JOIN n_b10 c
        ON c.cand = r.cand AND c.held = r.fold GROUP BY r.cand"""),
])
def e8(spark, sf):
    got = E.weight_scan(fx.wide_oof(spark, sf), CANDS, ["gbm", "lr"], range(5))
    return spark.createDataFrame([(r["cand"], r["loss"], r["best"]) for r in got], "cand int, loss double, best boolean")


@query("e9_variant", "uid:s z:d6 files:i", """SELECT uid, (avg(z) FILTER (family = 'cnn1') + 2e0 * avg(z) FILTER (family = 'gbm')) / 3e0 AS z,
    (SELECT count(DISTINCT family || file) FROM raw_oof WHERE run = 'a' AND family NOT IN ('cnn2')) AS files FROM e WHERE run = 'a' GROUP BY uid""", ["raw_oof"], SEED)
def e9(spark, sf):
    """One family is dropped with its files, another is reweighted."""
    rows, files = E.variant(seeded(spark, sf, ("a",)), _files(spark, sf, ("a",)), {"cnn1": 1.0, "cnn2": 0.0, "gbm": 2.0}, ["uid"])
    return rows.withColumn("files", F.lit(files.count()))


_VIEW = f"""SELECT uid, view, cnn + ({u("uid", "view")} - 5e-1) AS z FROM wide_oof, (VALUES ('plain'), ('mirrored'), ('shifted')) v(view)"""


@query("e10_view_mean", "uid:s z:d6 views:i", "SELECT uid, avg(z) AS z, count(*) AS views FROM v GROUP BY uid", ["wide_oof"], [("v", _VIEW)])
def e10(spark, sf):
    from voxeval.plans.bounded import with_grid

    rows = with_grid(fx.wide_oof(spark, sf).select("uid", "cnn"), [{"view": v} for v in ("plain", "mirrored", "shifted")])
    return E.view_mean(rows.select("uid", (F.col("cnn") + uniform(F.col("uid"), F.col("view")) - 0.5).alias("z")))


@query("e11_pooling", "uid:s by_probability:d6 by_logit:d6", f"""SELECT uid, 5e-1 * {sig("cnn")} + 3e-1 * {sig("gbm")} + 2e-1 * {sig("lr")} AS by_probability,
    {sig("5e-1 * cnn + 3e-1 * gbm + 2e-1 * lr")} AS by_logit FROM wide_oof""", ["wide_oof"])
def e11(spark, sf):
    w = {"cnn": 0.5, "gbm": 0.3, "lr": 0.2}
    return fx.wide_oof(spark, sf).select("uid", E.pool_probability(w).alias("by_probability"), E.pool_logit(w).alias("by_logit"))


_SIMPLEX = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for a, b, c in E.simplex(3, 10))


@query("e11_pool_scan", "w0:d6 w1:d6 w2:d6 loss:d6 objective:d6", f"""SELECT w0, w1, w2, l AS loss, l + 2e-2 * (power(w0 - 1e0 / 3e0, 2e0) + power(w1 - 1e0 / 3e0, 2e0) + power(w2 - 1e0 / 3e0, 2e0)) AS objective
    FROM (SELECT w0, w1, w2, avg({loss('y', f"w0 * {sig('cnn')} + w1 * {sig('gbm')} + w2 * {sig('lr')}")}) AS l FROM wide_oof, (VALUES {_SIMPLEX}) t(w0, w1, w2) GROUP BY w0, w1, w2)""", ["wide_oof"])
def e11s(spark, sf):
    return E.pool_scan(fx.wide_oof(spark, sf), ("cnn", "gbm", "lr"))


@query("e12_apply_stack", "uid:s z:d6", "SELECT uid, 7e-1 * cnn + 2e-1 * gbm - 1e-1 * lr + 5e-2 AS z FROM wide_oof", ["wide_oof"])
def e12(spark, sf):
    return E.apply_stack(fx.wide_oof(spark, sf), {"cols": ["cnn", "gbm", "lr"], "coef": [0.7, 0.2, -0.1], "b": 0.05})


_MV = [("m1", "SELECT uid, y, fold, gbm, cnn1 AS g1, (cnn1 + 2e0 * cnn2) / 3e0 AS g2 FROM wide_oof")]
for _i in (1, 2):
    _MV += newton_ctes(f"n{_i}", "m1", [f"g{_i}", "gbm"], "SELECT DISTINCT fold AS held FROM m1", ["held"], "c.held <> r.fold", ["10e0", "10e0", "0e0"])


@query("e13_marginal_value", "uid:s d:d6", f"""SELECT uid, {loss('y', sig('b.b0 * g2 + b.b1 * gbm + b.b2'))} - {loss('y', sig('a.b0 * g1 + a.b1 * gbm + a.b2'))} AS d
    FROM m1 JOIN n1_b10 a ON a.held = fold JOIN n2_b10 b ON b.held = fold""", ["wide_oof"], _MV)
def e13(spark, sf):
    return E.marginal_value(fx.wide_oof(spark, sf), {"cnn1": 1.0}, "cnn2", 2.0, ["gbm"], range(5))


_CR = [("cr", "SELECT uid, y, fold, gbm, cnn1 AS g0, (cnn1 + cnn2) / 2e0 AS g1, (cnn1 + 2e0 * cnn2) / 3e0 AS g2, (cnn1 + lr) / 2e0 AS g3, (cnn1 + 2e0 * lr) / 3e0 AS g4 FROM wide_oof")]
for _i in range(5):
    _CR += newton_ctes(f"r{_i}", "cr", [f"g{_i}", "gbm"], "SELECT DISTINCT fold AS held FROM cr", ["held"], "c.held <> r.fold", ["10e0", "10e0", "0e0"])
_CR += [
    ("ls", "SELECT uid, " + ", ".join(loss("y", sig(f"r{i}.b0 * g{i} + r{i}.b1 * gbm + r{i}.b2")) + f" AS l{i}" for i in range(5))
     + " FROM cr " + " ".join(f"JOIN r{i}_b10 r{i} ON r{i}.held = fold" for i in range(5))),
    ("ds", "SELECT uid, unnest([0, 1, 2, 3]) AS part, unnest([l1 - l0, l2 - l0, l3 - l0, l4 - l0]) AS d FROM ls"), ("keys", f"SELECT * FROM (VALUES {_KEYS}) t(rep, a, b, c)"),
    ("reps", f"""SELECT part, rep, sum(w * d) / sum(w) AS m FROM (SELECT part, rep, d, {_STEPS} AS w FROM (SELECT part, rep, d, ((h * a + g * b + c) % 2147483647) / 2147483647e0 AS q
        FROM (SELECT part, d, ('0x' || substr(md5(concat_ws('-', uid, '0')), 1, 8))::BIGINT % 2147483647 AS h,
            ('0x' || substr(md5(concat_ws('-', uid, '0b')), 1, 8))::BIGINT % 2147483647 AS g FROM ds), keys)) GROUP BY part, rep"""),
    ("own", "SELECT y, unnest(['cnn2', 'lr']) AS candidate, unnest([cnn2, lr]) AS z FROM wide_oof"),
]


@query("e13_candidate_report", "candidate:s weight:d6 logloss:d6 auc:d6 mean_d:d6 share_better:d6 replicates:i", f"""SELECT ['cnn2', 'cnn2', 'lr', 'lr'][c.part + 1] AS candidate,
    [1e0, 2e0, 1e0, 2e0][c.part + 1] AS weight, logloss, auc, mean_d, share_better, replicates FROM (SELECT part, avg(d) AS mean_d FROM ds GROUP BY part) c
    JOIN (SELECT part, count(*) AS replicates, avg((m < 0)::INTEGER) AS share_better FROM reps GROUP BY part) p ON p.part = c.part
    JOIN (SELECT candidate, avg({loss('y', sig('z'))}) AS logloss FROM own GROUP BY candidate) l ON l.candidate = ['cnn2', 'cnn2', 'lr', 'lr'][c.part + 1]
    JOIN ({auc_sql("own", ["candidate"])}) a ON a.candidate = l.candidate""", ["wide_oof"], _CR)
def e13r(spark, sf):
    """Two candidates at two weights, with the share of 2,000 replicates in which they improve."""
    return E.candidate_report(fx.wide_oof(spark, sf), {"cnn1": 1.0}, ["cnn2", "lr"], ["gbm"], range(5), b=B)


@query("e14_alternate_average", "uid:s family:s z:d6", f"""SELECT uid, family, (o + a) / 2e0 AS z FROM (SELECT uid, family, avg(z) AS o,
    avg(z + 2e-1 * ({u("uid", "file", "'alt'")} - 5e-1)) AS a FROM raw_oof WHERE run = 'a' GROUP BY uid, family)""", ["raw_oof"])
def e14(spark, sf):
    """Alternative scores exist for every fold's checkpoint; only the row's own fold counts."""
    raw = fx.raw_oof(spark, sf, ("a",))
    every = raw.select("uid", "family", "seed", "z", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    file = fx.checkpoint_file("family", "seed", "fold")
    alt = every.select("uid", "family", "fold", (F.col("z") + F.lit(0.2) * (uniform(F.col("uid"), file, "alt") - 0.5)).alias("z"))
    original = E.seed_mean(raw, ("uid", "family"), (), families=FAMILIES)
    return E.alternate_average(original, alt, fx.folded(spark, sf, ("a",)).select("uid", "fold"), families=FAMILIES)
