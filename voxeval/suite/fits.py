"""Fitted models: L1-L11."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.functions.scalars import uniform
from voxeval.operators import fits as L
from voxeval.operators.folds import group_folds, stratified_folds
from voxeval.operators.metrics import scoreboard
from voxeval.plans import wide
from voxeval.session import stage
from voxeval.suite.base import auc_sql, clip, fold_sql, loss, newton_ctes, query, sig, u
from voxeval.suite.folds import _GROUP

COLS = ["cnn", "gbm", "lr"]
_DET = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _det(*cells: str) -> str:
    return _DET.format(**dict(zip("abcdefghi", cells)))


_S = "SELECT h.held, k, sum(1e0) AS s0, sum(zoom) AS s1, sum(zoom ** 2) AS s2, sum(zoom ** 3) AS s3, sum(zoom ** 4) AS s4, sum(v) AS t0, sum(v * zoom) AS t1, sum(v * zoom ** 2) AS t2 " \
     "FROM {src} r JOIN (SELECT DISTINCT fold AS held FROM {src}) h ON h.held <> r.fold WHERE y = 0 GROUP BY h.held, k"
_A = {
    "d": _det("s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"), "0": _det("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"),
    "1": _det("s0", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), "2": _det("s0", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2"),
}
_LONG = "SELECT uid, y, zoom, fold, unnest(['cnn', 'gbm']) AS k, unnest([cnn, gbm]) AS v FROM wide_oof"


@query("l1_quadratic_trend", "fold:i feature:s a0:d6 a1:d6 a2:d6", f"SELECT held AS fold, k AS feature, {_A['0']} / {_A['d']} AS a0, {_A['1']} / {_A['d']} AS a1, {_A['2']} / {_A['d']} AS a2 FROM s",
       ["wide_oof"], [("r", _LONG), ("s", _S.format(src="r"))])
def l1(spark, sf):
    return L.quadratic_trend(fx.wide_oof(spark, sf), ["cnn", "gbm"])


@query("l2_fold_scaler", "fold:i feature:s mu:d6 sd:d6", " UNION ALL ".join(
    f"SELECT held AS fold, '{c}' AS feature, avg({c}) AS mu, stddev_pop({c}) + 1e-6 AS sd FROM features f JOIN (SELECT DISTINCT fold AS held FROM features) h ON h.held <> f.fold GROUP BY held"
    for c in ("f_len", "f_words", "f_ratio")), ["features"])
def l2(spark, sf):
    return L.fold_scaler(fx.features(spark, sf), ["f_len", "f_words", "f_ratio"])


@query("l3_fit_logistic", "c0:d4 c1:d4 c2:d4 b:d4", "SELECT b0 AS c0, b1 AS c1, b2 AS c2, b3 AS b FROM n_b10", ["wide_oof"],
       newton_ctes("n", "wide_oof", COLS, "SELECT 0 AS one", ["one"], "true", ["20e0", "20e0", "20e0", "0e0"]))
def l3(spark, sf):
    m = L.fit_logistic(stage(fx.wide_oof(spark, sf)), COLS, 0.05)
    return spark.createDataFrame([(*m["coef"], m["b"])], "c0 double, c1 double, c2 double, b double")


CS = (0.03, 0.1, 0.3, 1.0)
_CFG = "SELECT held, cc FROM (VALUES (-1), (0), (1), (2), (3), (4)) h(held), (VALUES (3e-2), (1e-1), (3e-1), (1e0)) c(cc)"
_LAM = ["1e0 / c.cc"] * 3 + ["0e0"]
_FITS = newton_ctes("n", "wide_oof", COLS, _CFG, ["held", "cc"], "c.held <> r.fold", _LAM)


@query("l4_fit_many_logistic", "fold:i c:d6 c0:d6 c1:d6 c2:d6 b:d6 n:i", """SELECT held AS fold, cc AS c, b0 AS c0, b1 AS c1, b2 AS c2, b3 AS b,
    (SELECT count(*) FROM wide_oof w WHERE w.fold <> held) AS n FROM n_b10""", ["wide_oof"], _FITS)
def l4(spark, sf):
    """Twenty-four fits together: four penalties, five held-out folds and all rows."""
    got = L.fit_many_logistic(fx.wide_oof(spark, sf), COLS, range(-1, 5), CS)
    return spark.createDataFrame([(*m.name, *m.coef, m.b, m.n) for m in got], "fold int, c double, c0 double, c1 double, c2 double, b double, n long")


_Z = "c.b0 * w.cnn + c.b1 * w.gbm + c.b2 * w.lr + c.b3"


@query("l5_cv_predict", "uid:s z:d6", f"SELECT uid, {_Z} AS z FROM wide_oof w JOIN n_b10 c ON c.held = w.fold AND c.cc = 1e-1", ["wide_oof"], _FITS)
def l5(spark, sf):
    w = stage(fx.wide_oof(spark, sf))
    return L.cv_predict(w, COLS, range(5), 0.1)


_FEATS = ["cnn", "gbm"]
_ADJ = [
    ("r", _LONG), ("s", _S.format(src="r")),
    ("ad", f"SELECT held, k, {_A['0']} / {_A['d']} AS a0, {_A['1']} / {_A['d']} AS a1, {_A['2']} / {_A['d']} AS a2 FROM s"),
    ("res", "SELECT r.uid, r.y, r.fold, ad.held, r.k, v - (a0 + a1 * zoom + a2 * zoom ** 2) AS v FROM r JOIN ad ON ad.k = r.k"),
    ("st", "SELECT held, k, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM res WHERE fold <> held GROUP BY held, k"),
    ("sc", f"""SELECT uid, held, any_value(y) AS y, any_value(fold) AS fold, max(x) FILTER (k = 'cnn') AS cnn, max(x) FILTER (k = 'gbm') AS gbm FROM (
        SELECT res.*, {clip("(v - mu) / sd", "-6e0", "6e0")} AS x FROM res JOIN st ON st.held = res.held AND st.k = res.k) GROUP BY uid, held"""),
    *newton_ctes("n", "sc", _FEATS, "SELECT DISTINCT held FROM sc", ["held"], "c.held = r.held AND c.held <> r.fold", ["20e0", "20e0", "0e0"]),
]


@query("l5_cv_predict_features", "uid:s z:d6", "SELECT uid, c.b0 * cnn + c.b1 * gbm + c.b2 AS z FROM sc JOIN n_b10 c ON c.held = sc.held WHERE sc.fold = sc.held", ["wide_oof"], _ADJ)
def l5f(spark, sf):
    """Trend, scaler and fit all outside the scored fold."""
    w = stage(fx.wide_oof(spark, sf))
    return L.cv_predict_features(w, _FEATS, range(5), zoom="zoom")


#: 64 components, their squares and 45 products of neighbours.
WIDE_COLS = [f"w{i:03d}" for i in range(173)]
_WIDE_LIST = "list_concat(e, list_concat(list_transform(e, lambda a: a * a), list_transform(range(1, 46), lambda i: e[i] * e[i + 1])))"
_WIDE = [
    ("w", f"""SELECT *, {fold_sql(["y"], "5", "'11'")}::INTEGER AS fold FROM (SELECT vec_id::VARCHAR AS uid, (label >= 5)::INTEGER AS y,
        15e-1 + 2e0 * {u("vec_id::VARCHAR", "'zoom'")} AS zoom, embedding::DOUBLE[] AS e FROM embeddings)"""),
    ("r", f"SELECT uid, y, zoom, fold, unnest(range(173)) AS k, unnest({_WIDE_LIST}) AS v FROM w"), ("s", _S.format(src="r")),
    ("ad", f"SELECT held, k, {_A['0']} / {_A['d']} AS a0, {_A['1']} / {_A['d']} AS a1, {_A['2']} / {_A['d']} AS a2 FROM s"),
]


def wide_features(spark, sf):
    """173 features of the embeddings with label, spacing and fold."""
    e = F.col("embedding").cast("array<double>")
    rows = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
        (F.lit(1.5) + F.lit(2.0) * uniform(F.col("vec_id").cast("string"), "zoom")).alias("zoom"), e.alias("e"),
    )
    pairs = F.transform(F.sequence(F.lit(1), F.lit(45)), lambda i: F.element_at("e", i) * F.element_at("e", i + 1))
    rows = rows.withColumn("e", F.concat("e", F.transform("e", lambda a: a * a), pairs))
    rows = stage(rows.select("uid", "y", "zoom", *[F.col("e")[i].alias(c) for i, c in enumerate(WIDE_COLS)]))
    return stage(stratified_folds(rows, ["y"], 5, 11))


@query("l5_wide_scaler", "fold:i feature:i a0:d5 a1:d5 a2:d5 mu:d6 sd:d6", """SELECT ad.held AS fold, ad.k AS feature, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2,
    avg(v - (a0 + a1 * zoom + a2 * zoom ** 2)) AS mu, stddev_pop(v - (a0 + a1 * zoom + a2 * zoom ** 2)) + 1e-6 AS sd
    FROM r JOIN ad ON ad.k = r.k AND ad.held <> r.fold GROUP BY ad.held, ad.k""", [], _WIDE)
def l5ws(spark, sf):
    """Trend and scaler of 173 features outside each fold, from array-valued sums."""
    data = wide.packed(wide_features(spark, sf), WIDE_COLS, "y", "fold", zoom="zoom")
    adj = wide.trends(data, range(5))
    scale = wide.scales(data, range(5), adj)
    rows = [(f, j, *map(float, adj[f][:, j]), float(scale[f][0][j]), float(scale[f][1][j])) for f in range(5) for j in range(173)]
    return spark.createDataFrame(rows, "fold int, feature int, a0 double, a1 double, a2 double, mu double, sd double")


@query("l5_wide_features", "fold:i n:i columns:i stationary:b scored:i", """SELECT h.held AS fold, count(*) FILTER (fold <> h.held) AS n, 173 AS columns, true AS stationary,
    count(*) FILTER (fold = h.held) AS scored FROM w, (SELECT DISTINCT fold AS held FROM w) h GROUP BY h.held""", [], _WIDE[:1])
def l5w(spark, sf):
    """The feature model at its full width: each fold's gradient, summed again from the returned parameters by SQL, is below 1e-4."""
    w, c = wide_features(spark, sf), L.FEATURE_C
    models = L.fit_feature_models(w, WIDE_COLS, range(5), c, zoom="zoom")
    scored = w.withColumn("z", L.array_score(models, zoom="zoom")).where("z IS NOT NULL").groupBy("fold").agg(F.count(F.lit(1)).alias("scored"))
    sums = None
    for f, m in models.items():
        x = L.array_inputs(m, "zoom")
        train = w.where(F.col("fold") != f).select("y", L.array_dot(x, m).alias("z"), F.concat(x, F.array(F.lit(1.0))).alias("x"))
        g = train.select(F.posexplode("x").alias("j", "x"), (1.0 / (1.0 + F.exp(-F.col("z"))) - F.col("y")).alias("r"))
        g = g.groupBy("j").agg(F.sum(F.col("r") * F.col("x")).alias("g"), F.count(F.lit(1)).alias("n"))
        pull = F.get(F.expr("array(" + ", ".join(f"{v / c!r}D" for v in m["coef"]) + ", 0D)"), F.col("j"))
        g = g.select(F.lit(f).alias("fold"), "n", F.abs(F.col("g") + pull).alias("g"))
        sums = g if sums is None else sums.unionByName(g)
    sums = sums.groupBy("fold").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("columns"), (F.max("g") < 1e-4).alias("stationary"))
    return sums.join(scored, "fold").withColumn("columns", F.col("columns") - 1)


@query("l6_fit_gbt", "n:i logloss:d6 auc:d6")
def l6(spark, sf):
    """All 350 trees on five folds: every row is scored by the trees of the others."""
    w = stage(stratified_folds(fx.wide_inputs(spark, sf, ("lr",)), ["y"], 5, 11))
    return scoreboard(L.cv_predict_boosted(w, ["x", "zoom", "lr"], range(5)).select("y", "z"))


@query("l6_stump", "uid:s z:d6", """SELECT uid, 2e0 * CASE WHEN zoom <= cut THEN lm ELSE rm END AS z FROM subjects, (
    SELECT (v + nxt) / 2e0 AS cut, ls / ln AS lm, (ts - ls) / (tn - ln) AS rm FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(n) OVER (ORDER BY v) AS ln, sum(s) OVER (ORDER BY v) AS ls,
        sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM (SELECT zoom AS v, count(*)::DOUBLE AS n, sum(2e0 * y - 1e0) AS s FROM subjects GROUP BY zoom))
    WHERE nxt IS NOT NULL AND ln >= 15 AND tn - ln >= 15 ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, v LIMIT 1)""", ["subjects"])
def l6s(spark, sf):
    """One boosted tree of one split on the 25 spacings, where the best cut is plain arithmetic."""
    s = stage(fx.subjects(spark, sf).select("uid", "y", "zoom"))
    model = L.fit_gbt(s, ["zoom"], trees=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all")
    return L.gbt_logit(model, s).select("uid", "z")


@query("l7_fit_alternatives", "kind:s n:i ranks:b beats_prior:b", """SELECT kind, count(*) AS n, true AS ranks, true AS beats_prior FROM wide_oof,
    (VALUES ('rbf'), ('mlp'), ('forest')) k(kind) GROUP BY kind""", ["wide_oof"])
def l7(spark, sf):
    """Kernel support vectors, perceptron and forest with full settings on five folds: every row is scored by models of
    the others, ranks above 0.75, and the score as a logit loses less than the prior."""
    w, out = stage(fx.wide_oof(spark, sf)), None
    for kind, scored in L.cv_predict_alternatives(("rbf", "mlp", "forest"), w, COLS, range(5)).items():
        part = scored.select(F.lit(kind).alias("kind"), "y", "z")
        out = part if out is None else out.unionByName(part)
    out = stage(out)
    board = scoreboard(out, ["kind"])
    prior = out.groupBy("kind").agg(F.avg("y").alias("p"))
    entropy = -(F.col("p") * F.log("p") + (1 - F.col("p")) * F.log(1 - F.col("p")))
    return board.join(prior, "kind").select("kind", "n", (F.col("auc") > 0.75).alias("ranks"), (F.col("logloss") < entropy).alias("beats_prior"))


@query("l8_pca_logistic", "n:i scored:i spread:b", "SELECT count(*) AS n, count(*) AS scored, true AS spread FROM embeddings")
def l8(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("string").alias("uid"), F.when(F.col("label") >= 5, 1.0).otherwise(0.0).alias("y"),
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    rows = stage(stratified_folds(rows, ["y"], 5, 11))
    parts = [L.pca_logistic(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), "vec").select("z") for f in range(5)]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("z") < 50).alias("scored"), (F.stddev_pop("z") > 0).alias("spread"))


_E6 = [f"e{i}" for i in range(6)]


@query("l8_all_components", "uid:s z:d3", f"SELECT uid, {' + '.join(f'c.b{i} * {e}' for i, e in enumerate(_E6))} + c.b6 AS z FROM sc JOIN n_b10 c ON c.held = sc.held WHERE sc.fold = sc.held", [], [
    ("e", f"""SELECT *, {fold_sql(["y"], "5", "'11'")}::INTEGER AS fold FROM (SELECT vec_id::VARCHAR AS uid, (label >= 5)::INTEGER AS y,
        {", ".join(f"embedding[{i + 1}]::DOUBLE AS {e}" for i, e in enumerate(_E6))} FROM embeddings)"""),
    ("st", f"SELECT held, {', '.join(f'avg({e}) AS m_{e}, stddev_pop({e}) AS s_{e}' for e in _E6)} FROM e JOIN (SELECT DISTINCT fold AS held FROM e) h ON h.held <> e.fold GROUP BY held"),
    ("sc", f"SELECT uid, y, fold, held, {', '.join(f'({e} - m_{e}) / s_{e} AS {e}' for e in _E6)} FROM e, st"),
    *newton_ctes("n", "sc", _E6, "SELECT DISTINCT held FROM sc", ["held"], "c.held = r.held AND c.held <> r.fold", ["20e0"] * 6 + ["0e0"])])
def l8a(spark, sf):
    """With every component kept, the fit is the plain one on the standardised columns."""
    e = fx.table(spark, sf, "embeddings")
    vec = array_to_vector(F.slice(F.col("embedding").cast("array<double>"), 1, 6))
    rows = e.select(F.col("vec_id").cast("string").alias("uid"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"), vec.alias("vec"))
    rows = stage(stratified_folds(rows, ["y"], 5, 11)).withColumn("y", F.col("y").cast("double"))
    parts = [L.pca_logistic(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), "vec", 6).select("uid", "z") for f in range(5)]
    return reduce(lambda a, b: a.unionByName(b), parts)


FLOORS = (0.0, *L.STACK_FLOORS)


def _choose(src: str, n: int, keep: str) -> str:
    """Earlier rows stay unless a later one gains more than 1e-5; ``src`` has i, v, l."""
    sql = f"SELECT v, l FROM {src} WHERE i = 0"
    for i in range(1, n):
        sql = f"SELECT CASE WHEN s.l < b.l - 1e-5 THEN s.v ELSE b.v END AS v, CASE WHEN s.l < b.l - 1e-5 THEN s.l ELSE b.l END AS l FROM ({sql}) b, {src} s WHERE s.i = {i}"
    return f"SELECT v AS {keep}, l FROM ({sql})"


_STACK = [
    *_FITS,
    ("lc", f"SELECT row_number() OVER (ORDER BY cc) - 1 AS i, cc AS v, avg({loss('w.y', sig(_Z))}) AS l FROM wide_oof w JOIN n_b10 c ON c.held = w.fold GROUP BY cc"),
    ("bc", _choose("lc", 4, "c")),
    ("le", f"""SELECT i, e AS v, avg({loss('w.y', clip(sig(_Z), 'e', '1e0 - e'))}) AS l FROM wide_oof w JOIN n_b10 c ON c.held = w.fold JOIN bc ON bc.c = c.cc,
        (VALUES {", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(FLOORS))}) f(i, e) GROUP BY i, e"""),
    ("be", _choose("le", 7, "eps")),
]


@query("l9_fit_stack", "c:d6 eps:d6 nested_logloss:d6 c0:d6 c1:d6 c2:d6 b:d6 prior:d6", """SELECT bc.c, eps, be.l AS nested_logloss, b0 AS c0, b1 AS c1, b2 AS c2, b3 AS b,
    (SELECT avg(y) FROM wide_oof) AS prior FROM bc, be, n_b10 n WHERE n.held = -1 AND n.cc = bc.c""", ["wide_oof"], _STACK)
def l9(spark, sf):
    s = L.fit_stack(stage(fx.wide_oof(spark, sf)), COLS, range(5))
    return spark.createDataFrame([(s["C"], s["eps"], s["nested_logloss"], *s["coef"], s["b"], s["prior"])],
                                 "c double, eps double, nested_logloss double, c0 double, c1 double, c2 double, b double, prior double")


_OTHER = """SELECT uid, any_value(y) AS y, (avg(z) FILTER (family = 'cnn1') + avg(z) FILTER (family = 'cnn2')) / 2e0 AS cnn, avg(z) FILTER (family = 'gbm') AS gbm,
    avg(z) FILTER (family = 'lr') AS lr FROM raw_oof WHERE run = 'c' GROUP BY uid"""


@query("l10_transfer_score", "temp:d6 n:i logloss:d6 auc:d6", f"""SELECT l.temp, n, logloss, auc FROM (SELECT temp, count(*) AS n, avg({loss('y', sig('z'))}) AS logloss FROM s GROUP BY temp) l
    JOIN ({auc_sql("s", ["temp"])}) a ON a.temp = l.temp""", ["wide_oof"], [
    *_FITS, ("o", _OTHER),
    ("s", f"SELECT temp, y, ({_Z}) / temp AS z FROM o w JOIN n_b10 c ON c.held = -1 AND c.cc = 1e-1, (VALUES (1e0), (11e-1), (12e-1)) t(temp)")])
def l10(spark, sf):
    """A stack of one split judged on another split's predictions."""
    m = L.fit_many_logistic(fx.wide_oof(spark, sf), COLS, [-1], [0.1])[0]
    return L.transfer_score(fx.wide_oof(spark, sf, "c"), {"cols": COLS, "coef": m.coef, "b": m.b})


SETS = {"scores": ["cnn", "gbm"], "signal": ["x", "zoom"]}
_AB, _PARTS = [("g", _GROUP), ("ab", "SELECT w.*, g.fold AS held_family FROM wide_oof w JOIN g ON g.zfam = w.zfam")], []
for _f in ("fold", "held_family"):
    for _n, _c in SETS.items():
        _p = f"{_n}_{_f}"
        _AB.append((f"st_{_p}", f"SELECT held, {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) + 1e-6 AS sd_{c}' for c in _c)} FROM ab JOIN (SELECT DISTINCT {_f} AS held FROM ab) h "
                                f"ON h.held <> ab.{_f} GROUP BY held"))
        _AB.append((f"sc_{_p}", f"SELECT uid, y, {_f} AS fold, held, {', '.join(clip(f'({c} - mu_{c}) / sd_{c}', '-6e0', '6e0') + f' AS {c}' for c in _c)} FROM ab, st_{_p}"))
        _AB += newton_ctes(f"n_{_p}", f"sc_{_p}", _c, f"SELECT held FROM st_{_p}", ["held"], "c.held = r.held AND c.held <> r.fold", ["20e0", "20e0", "0e0"])
        _PARTS.append(f"SELECT '{_f}' AS scheme, '{_n}' AS features, y, c.b0 * {_c[0]} + c.b1 * {_c[1]} + c.b2 AS z FROM sc_{_p} s JOIN n_{_p}_b10 c ON c.held = s.held WHERE s.fold = s.held")
_AB.append(("allz", " UNION ALL ".join(_PARTS)))


_AB.append(("arm", f"""SELECT l.scheme, l.features, n, logloss, auc FROM (SELECT scheme, features, count(*) AS n,
    avg({loss('y', sig('z'))}) AS logloss FROM allz GROUP BY scheme, features) l JOIN ({auc_sql("allz", ["scheme", "features"])}) a ON a.scheme = l.scheme AND a.features = l.features"""))


@query("l11_feature_ablation", "scheme:s features:s model:s n:i logloss:d6 auc:d6 ranks:b beats_prior:b", """SELECT scheme, features, 'logistic' AS model, n, logloss, auc,
    auc > 75e-2 AS ranks, logloss < (SELECT -(avg(y) * ln(avg(y)) + (1e0 - avg(y)) * ln(1e0 - avg(y))) FROM wide_oof) AS beats_prior FROM arm
    UNION ALL SELECT scheme, features, model, n, NULL AS logloss, NULL AS auc, true AS ranks, true AS beats_prior FROM arm, (VALUES ('boosted'), ('stack')) m(model)""",
       ["wide_oof"], _AB)
def l11(spark, sf):
    """Two feature sets under random and family-held-out folds, each by logistic fit, 350 boosted trees and their stack with the
    network's logit. SQL gives the logistic values; the other arms rank above 0.75 and lose less than the prior."""
    w = stage(group_folds(fx.wide_oof(spark, sf), 5, 7, "zfam", name="held_family"))
    board = L.feature_ablation(w, SETS, {"fold": range(5), "held_family": range(5)}, base=["cnn"])
    p = w.agg(F.avg("y")).first()[0]
    entropy = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    by_value = [F.when(F.col("model") == "logistic", F.col(c)).alias(c) for c in ("logloss", "auc")]
    return board.select("scheme", "features", "model", "n", *by_value, (F.col("auc") > 0.75).alias("ranks"), (F.col("logloss") < entropy).alias("beats_prior"))
