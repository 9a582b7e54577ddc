"""Fitted models: trends, scalers, logistic and boosted fits, stacking."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxeval.functions.scalars import ZOOM_DEFAULT, clip, linear_score, row_logloss, sigmoid
from voxeval.operators.metrics import scoreboard
from voxeval.plans import wide
from voxeval.plans.boosted import Boosted, Boosting, fit_boosted
from voxeval.plans.bounded import with_grid
from voxeval.plans.newton import Fit, Fitted, fit_many, ridge
from voxeval.plans.sums import collected_tasks
from voxeval.session import stage, unstage

# Fixed values of the stack selection.
STACK_C = (0.03, 0.1, 0.3, 1.0)
STACK_FLOORS = (0.002, 0.005, 0.01, 0.015, 0.02, 0.03)
STACK_GAIN = 1e-5
FEATURE_C = 0.05
CLIP = 6.0
#: Columns from which feature models are fitted on arrays; below, Newton steps on column sums need fewer passes.
WIDE = 30


def _long_sums(df: DataFrame, cols: Sequence[str], fold: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per (fold, feature) from one pass over the wide rows."""
    feats = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])
    keep = [c for c in df.columns if c not in cols]
    long = df.select(*keep, F.explode(feats).alias("_f")).select(*keep, F.col("_f.k").alias("feature"), F.col("_f.v").alias("x"))
    return long.groupBy(fold, "feature").agg(*[F.sum(e).alias(k) for k, e in sums.items()])


def _without_fold(part: DataFrame, names: Sequence[str], fold: str) -> DataFrame:
    """Training sums of every fold: totals minus the held-out fold's own sums."""
    total = part.groupBy("feature").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    j = part.join(total, "feature")
    return j.select(fold, "feature", *[(F.col(f"_{n}") - F.col(n)).alias(n) for n in names])


def quadratic_trend(df: DataFrame, cols: Sequence[str], zoom: str = "zoom", y: str = "y", fold: str = "fold") -> DataFrame:
    """Least squares of each feature on (1, z, z^2) over the normals outside each fold (L1).

    Nine sums per (fold, feature) suffice; the 3x3 system is solved in closed form.
    """
    mid = float(df.agg(F.avg(F.col(zoom).cast("double"))).first()[0] or 0.0)  # powers of centred values keep their digits
    z, normal = F.col("z1"), F.when(F.col(y) == 0, 1.0).otherwise(0.0)
    sums = {f"s{i}": F.col("m") * F.pow(z, F.lit(float(i))) for i in range(5)}
    sums |= {f"t{i}": F.col("m") * F.pow(z, F.lit(float(i))) * F.col("x") for i in range(3)}
    src = df.select(fold, (F.col(zoom).cast("double") - F.lit(mid)).alias("z1"), normal.alias("m"), *cols)
    tr = _without_fold(_long_sums(src, cols, fold, sums), list(sums), fold)
    s, t = [F.col(f"s{i}") for i in range(5)], [F.col(f"t{i}") for i in range(3)]
    a = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]

    def det(m):
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))

    def replaced(j):
        return [[t[r] if c == j else a[r][c] for c in range(3)] for r in range(3)]

    d = det(a)
    b = tr.select(fold, "feature", *[(det(replaced(j)) / d).alias(f"b{j}") for j in range(3)])
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    return b.select(fold, "feature", (b0 - b1 * mid + b2 * (mid * mid)).alias("a0"), (b1 - b2 * (2.0 * mid)).alias("a1"), b2.alias("a2"))


def fold_scaler(df: DataFrame, cols: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean and population deviation (+1e-6) of each feature outside each fold (L2)."""
    feats = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(fold, F.explode(feats).alias("_f")).select(fold, F.col("_f.k").alias("feature"), F.col("_f.v").alias("x"))
    # count, mean and squared deviations per fold are merged, which keeps the digits of columns with a large offset
    part = stage(long.groupBy(fold, "feature").agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("q")))
    others = part.select(F.col(fold).alias("_o"), "feature", "n", "m", "q")
    pairs = part.select(fold, "feature").join(others, "feature").where(F.col("_o") != F.col(fold))
    tr = pairs.groupBy(fold, "feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    dev = pairs.join(tr, [fold, "feature"]).groupBy(fold, "feature", "mu")
    var = F.sum(F.col("q") + F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))) / F.sum("n")
    return dev.agg((F.sqrt(var) + 1e-6).alias("sd"))


def pivot_params(table: DataFrame, cols: Sequence[str], fold: str = "fold") -> dict[int, dict[str, tuple]]:
    """Per-fold feature parameters on the driver: folds x features values, not rows."""
    out: dict[int, dict[str, tuple]] = {}
    names = [c for c in table.columns if c not in (fold, "feature")]
    for r in table.collect():
        out.setdefault(r[fold], {})[r["feature"]] = tuple(r[n] for n in names)
    return out


def residual_scaler(df: DataFrame, cols: Sequence[str], adj: dict[int, list[list[float]]], zoom: str, fold: str = "fold") -> DataFrame:
    """Mean and guarded deviation of trend-free features outside each fold: one wide row per fold.

    A residual depends on the fold whose trend is removed, so rows are repeated per training fold
    and collapse in the partial sums.
    """
    grid = [{"_f": f} | {f"a{k}_{j}": v for k, row in enumerate(a) for j, v in enumerate(row)} for f, a in adj.items()]
    z = F.coalesce(F.col(zoom).cast("double"), F.lit(ZOOM_DEFAULT))
    rows = with_grid(df.select(fold, z.alias("_z"), *cols), grid).where(F.col("_f") != F.col(fold))
    res = [F.col(c) - (F.col(f"a0_{j}") + F.col(f"a1_{j}") * F.col("_z") + F.col(f"a2_{j}") * F.col("_z") * F.col("_z")) for j, c in enumerate(cols)]
    aggs = [e for j, r in enumerate(res) for e in (F.avg(r).alias(f"mu{j}"), (F.stddev_pop(r) + 1e-6).alias(f"sd{j}"))]
    return rows.groupBy("_f").agg(*aggs)


def fit_feature_models(df: DataFrame, cols: Sequence[str], folds: Sequence[int], c: float = FEATURE_C, y: str = "y", fold: str = "fold",
                       zoom: str | None = None, weight: str | None = None) -> dict[int, dict]:
    """Per held-out fold: optional trend of the normals, scaler, clipped logistic fit (L1 + L2 + L4).

    Returns the parameters of each fold as ``linear_score`` takes them. Both ways find the same minimum.
    """
    if len(cols) >= WIDE:
        return _wide_feature_models(df, cols, folds, c, y, fold, zoom, weight)
    d, adj = len(cols), {}
    if zoom is None:
        stats = pivot_params(fold_scaler(df.select(fold, *cols), cols, fold), cols, fold)
        scale = {f: ([p[n][0] for n in cols], [p[n][1] for n in cols]) for f, p in stats.items()}
    else:
        trend = pivot_params(quadratic_trend(df, cols, zoom, y, fold), cols, fold)
        adj = {f: [[p[n][k] for n in cols] for k in range(3)] for f, p in trend.items()}
        rows = residual_scaler(df, cols, adj, zoom, fold).collect()  # one row per fold
        scale = {r["_f"]: ([r[f"mu{j}"] for j in range(d)], [r[f"sd{j}"] for j in range(d)]) for r in rows}
    fits = [Fit((f,), held=f, penalty=ridge(c, d), adj=adj.get(f), mu=scale[f][0], sd=scale[f][1]) for f in folds]
    got = fit_many(df, cols, fits, y=y, fold=fold, weight=weight, zoom=zoom)
    return {m.name[0]: {"cols": list(cols), "mu": scale[m.name[0]][0], "sd": scale[m.name[0]][1], "coef": m.coef, "b": m.b,
                        "adj": adj.get(m.name[0])} for m in got}


def _wide_feature_models(df: DataFrame, cols: Sequence[str], folds: Sequence[int], c: float, y: str, fold: str, zoom: str | None, weight: str | None) -> dict[int, dict]:
    data = wide.packed(df, cols, y, fold, weight, zoom)
    adj = wide.trends(data, folds) if zoom is not None else {}
    scale = wide.scales(data, folds, adj)
    fits = [Fit((f,), held=f, penalty=ridge(c, len(cols)), adj=adj.get(f), mu=scale[f][0], sd=scale[f][1]) for f in folds]
    return {m.name[0]: {"cols": list(cols), "mu": scale[m.name[0]][0].tolist(), "sd": scale[m.name[0]][1].tolist(), "coef": m.coef, "b": m.b,
                        "adj": adj[m.name[0]].tolist() if adj else None, "gradient": m.gradient} for m in wide.fit_wide(data, fits)}


def _numbers(v: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(a)!r}D" for a in v) + ")")


def _less(x: Column, row: Column, factor: Column) -> Column:
    return F.zip_with(x, row, lambda a, b: a - b * factor)


def array_inputs(model: dict, zoom: str | None = None) -> Column:
    """The features of a model as one array: trend removed, standardised, clipped."""
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in model["cols"]])
    if model.get("adj") is not None:
        z = F.coalesce(F.col(zoom).cast("double"), F.lit(ZOOM_DEFAULT)) if zoom is not None else F.lit(ZOOM_DEFAULT)
        for row, power in zip(model["adj"], (F.lit(1.0), z, z * z)):
            x = _less(x, _numbers(row), power)
    x = F.zip_with(_less(x, _numbers(model["mu"]), F.lit(1.0)), _numbers(model["sd"]), lambda a, b: a / b)
    return F.transform(x, lambda a: F.least(F.greatest(a, F.lit(-CLIP)), F.lit(CLIP)))


def array_dot(x: Column, model: dict) -> Column:
    return F.aggregate(F.zip_with(x, _numbers(model["coef"]), lambda a, b: a * b), F.lit(float(model["b"])), lambda a, b: a + b)


def array_score(models: dict[int, dict], fold: str = "fold", zoom: str | None = None) -> Column:
    """Score of each row by the model of its fold, over arrays: a fixed number of expressions for any number of columns."""
    out = F.lit(None).cast("double")
    for f, m in models.items():
        out = F.when(F.col(fold) == f, array_dot(array_inputs(m, zoom), m)).otherwise(out)
    return out


def cv_predict_features(df: DataFrame, cols: Sequence[str], folds: Sequence[int], c: float = FEATURE_C, y: str = "y", fold: str = "fold",
                        zoom: str | None = None, name: str = "z") -> DataFrame:
    """Out-of-fold logits of the feature model: every step is fitted outside the scored fold."""
    if len(cols) >= WIDE:
        return df.withColumn(name, array_score(fit_feature_models(df, cols, folds, c, y, fold, zoom), fold, zoom))
    z = F.lit(None).cast("double")
    for f, params in fit_feature_models(df, cols, folds, c, y, fold, zoom).items():
        z = F.when(F.col(fold) == f, linear_score(params, zoom)).otherwise(z)
    return df.withColumn(name, z)


def fit_logistic(df: DataFrame, cols: Sequence[str], c: float = FEATURE_C, y: str = "y", weight: str | None = None) -> dict:
    """L2 logistic fit with a free intercept, for any number of features (L3)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = df.agg(F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")).first()[0]
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    model = LogisticRegression(
        featuresCol="_v", labelCol=y, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=500, tol=1e-12, **({"weightCol": weight} if weight else {}),
    )
    got = model.fit(vec.withColumn(y, F.col(y).cast("double")))
    return {"cols": list(cols), "coef": [float(v) for v in got.coefficients], "b": float(got.intercept)}


def fit_many_logistic(df: DataFrame, cols: Sequence[str], folds: Sequence[int], cs: Sequence[float], y: str = "y",
                      fold: str = "fold", weight: str | None = None) -> list[Fitted]:
    """Every (held-out fold, C) together; fold -1 trains on all rows (L4)."""
    d = len(cols)
    fits = [Fit((f, c), held=None if f < 0 else f, penalty=ridge(c, d)) for c in cs for f in folds]
    return fit_many(df, cols, fits, y=y, fold=fold, weight=weight)


def dot(cols: Sequence[str], coef: Sequence[float], b: float) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(cols, coef)), F.lit(float(b)))


def score_by_fold(cols: Sequence[str], fitted: dict[int, Fitted], fold: str = "fold") -> Column:
    """Held-out score: each row by the model that did not train on its fold."""
    out = F.lit(None).cast("double")
    for f, m in fitted.items():
        out = F.when(F.col(fold) == f, dot(cols, m.coef, m.b)).otherwise(out)
    return out


def cv_predict(df: DataFrame, cols: Sequence[str], folds: Sequence[int], c: float = 0.1, y: str = "y", fold: str = "fold",
               name: str = "z") -> DataFrame:
    """Out-of-fold logits of a logistic fit."""
    fitted = {m.name[0]: m for m in fit_many_logistic(df, cols, folds, [c], y, fold)}
    return df.withColumn(name, score_by_fold(cols, fitted, fold))


def cv_predict_with(df: DataFrame, fit, score, folds: Sequence[int], fold: str = "fold", name: str = "z", at_once: int = 1) -> DataFrame:
    """Out-of-fold scores of any ``fit(train) -> model`` and ``score(model, rows) -> rows with name``.

    ``at_once``: folds fitted side by side, for fits of many short jobs; what they cache is held at once too.
    """
    tasks = [inheritable_thread_target(df.sparkSession)(lambda f=f: fit(df.where(F.col(fold) != f))) for f in folds]
    with ThreadPool(min(at_once, len(tasks))) as pool:
        models = pool.imap(lambda task: task(), tasks) if at_once > 1 else (task() for task in tasks)
        out = None
        for f, model in zip(folds, models):
            part = score(model, df.where(F.col(fold) == f))
            out = part if out is None else out.unionByName(part)
    return out


def fit_gbt(df: DataFrame, cols: Sequence[str], y: str = "y", trees: int = 350, seed: int = 0, **over):
    """One fit of Spark's boosted trees of at most 8 leaves (L6), some three jobs a tree; ``cv_predict_boosted`` grows many fits in
    shared passes. The logit is twice the raw margin, see ``gbt_logit``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    args = dict(maxDepth=3, stepSize=0.03, maxIter=trees, minInstancesPerNode=15, subsamplingRate=0.8,
                featureSubsetStrategy="0.6", seed=seed) | over
    gbt = GBTClassifier(featuresCol="_v", labelCol=y, **args)
    stages = [VectorAssembler(inputCols=list(cols), outputCol="_v"), gbt]
    return Pipeline(stages=stages).fit(df.withColumn(y, F.col(y).cast("double")))


def gbt_logit(model, df: DataFrame, name: str = "z") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).withColumn(name, vector_to_array("rawPrediction")[1] * 2.0)
    return scored.select(*df.columns, name)


def boosted_scores(df: DataFrame, models: dict[int, Boosted], fold: str = "fold", name: str = "z") -> DataFrame:
    """The logit of each row by the model that is held for its fold; null where there is none."""
    cols = next(iter(models.values())).cols

    @F.pandas_udf("double")
    def margin(held: pd.Series, *x: pd.Series) -> pd.Series:
        rows, out = np.stack([v.to_numpy(float, na_value=np.nan) for v in x], axis=1), np.full(len(held), np.nan)
        for f, m in models.items():
            use = (held == f).to_numpy(bool, na_value=False)
            out[use] = m.logit(rows[use])
        return pd.Series(out)

    z = margin(F.col(fold).cast("int"), *[F.col(c).cast("double") for c in cols])
    return df.withColumn(name, F.nullif(z, F.lit(float("nan"))))


def cv_predict_boosted(df: DataFrame, cols: Sequence[str], folds: Sequence[int], y: str = "y", fold: str = "fold", name: str = "z", **over) -> DataFrame:
    """Out-of-fold logits of boosted trees (L6): all folds grow together, see ``plans.boosted``; ``over``: fields of ``Boosting``."""
    fits = fit_boosted(df, [Boosted(list(cols), f, fold) for f in folds], y, Boosting(**over))
    return boosted_scores(df, {m.held: m for m in fits}, fold, name)


def probability_logit(model, df: DataFrame, name: str = "z", eps: float = 1e-6) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = clip(vector_to_array("probability")[1], eps, 1 - eps)
    return model.transform(df).withColumn(name, F.log(p / (1 - p))).select(*df.columns, name)


def alternative(kind: str, cols: Sequence[str], y: str = "y", seed: int = 0, **over):
    """Linear SVM, multilayer perceptron or a forest on the columns of ``standardized`` (L7); see ``fit_alternative``."""
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml.feature import VectorAssembler

    base = dict(featuresCol="_v", labelCol=y)
    makers = {
        "svm": lambda: C.LinearSVC(**base | dict(regParam=0.01, maxIter=50) | over),
        "mlp": lambda: C.MultilayerPerceptronClassifier(
            **base | dict(layers=[len(cols), 32, 2], maxIter=100, seed=seed) | over),
        "forest": lambda: C.RandomForestClassifier(
            **base | dict(numTrees=100, minInstancesPerNode=5, featureSubsetStrategy="0.3", seed=seed) | over),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=[f"_s_{c}" for c in cols], outputCol="_v"), makers[kind]()])


def standardized(df: DataFrame, cols: Sequence[str], bound: float = CLIP):
    """A stage that adds each column standardised (population deviation of ``df`` + 1e-6) and clipped as ``_s_<column>``."""
    from pyspark.ml.feature import SQLTransformer

    got = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    outs = [f"least(greatest((cast(`{c}` AS double) - {got[f'm{i}']!r}D) / {got[f's{i}'] + 1e-6!r}D, {-bound!r}D), {bound!r}D) AS `_s_{c}`" for i, c in enumerate(cols)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(outs)} FROM __THIS__")


#: Sine of a quarter turn each way as an odd series in turns, to 1e-13.
_SINE = [(-1) ** i * (2.0 * math.pi) ** (2 * i + 1) / math.factorial(2 * i + 1) for i in range(9)]


def _cosines(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sqrt(2 / size) * cos(x @ w + b). Passes over small arrays: ``np.cos`` alone takes three times as long in double precision."""
    t = x @ (w / (2.0 * math.pi))
    t += b / (2.0 * math.pi)
    t -= np.rint(t)
    np.abs(t, out=t)
    np.subtract(0.25, t, out=t)  # the cosine of |t| turns is the sine of the rest of a quarter
    square, scale = t * t, math.sqrt(2.0 / len(b))
    out = square * (_SINE[-1] * scale)
    for v in _SINE[-2:0:-1]:
        out += v * scale
        out *= square
    out += _SINE[0] * scale
    out *= t
    return out


class KernelSvm:
    """Support vectors with a Gaussian kernel by random Fourier features: cosines of ``size`` random projections, whose inner
    products are the kernel up to an error of about 1 / sqrt(size), with a linear fit on them. The projections are parameters
    (columns x size numbers). Cosines are made of a block of rows where they are summed and never stored or exchanged."""

    def __init__(self, first, gamma: float, d: int, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.first, self.gamma = first, gamma
        self.w, self.b = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, size)), rng.uniform(0.0, 2.0 * np.pi, size)
        self.coef, self.intercept = np.zeros(size), 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return _cosines(x, self.w, self.b)

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, c: float, max_iter: int) -> KernelSvm:
        """Mean hinge loss plus the ridge 1 / (2 c n) by L-BFGS with a free intercept; a step is one pass that returns size + 2 sums a task."""
        inputs = [f"_s_{n}" for n in cols]
        rows = stage(self.first.transform(df).select(F.col(y).cast("double").alias("_y"), *inputs))
        self.cols = list(cols)
        _descend(rows.select("_y", F.lit(-1).alias("_fold"), *inputs), [(self, None)], c, max_iter)
        unstage(rows)
        return self

    def transform(self, df: DataFrame, name: str = "z") -> DataFrame:
        w, b, coef, intercept = self.w, self.b, self.coef, self.intercept

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            v = np.stack(x.to_list())
            parts = [_cosines(v[a : a + KERNEL_ROWS], w, b) @ coef + intercept for a in range(0, len(v), KERNEL_ROWS)]
            return pd.Series(np.concatenate(parts))

        rows = self.first.transform(df)
        return rows.withColumn(name, margin(F.array(*[f"_s_{c}" for c in self.cols])))


#: Rows whose cosines a task holds at once: arrays this small are reused, larger ones are mapped anew at each step, which takes longer than the sums.
KERNEL_ROWS = 192


def _descend(rows: DataFrame, fits: Sequence[tuple[KernelSvm, int | None]], c: float, max_iter: int) -> None:
    """Fit every (model, held-out fold) on ``rows``: label, fold, then the inputs of each model in turn.

    A pass reads the rows once for all fits that have not settled; each has a descent of its own.
    """
    d, size = len(fits[0][0].cols), len(fits[0][0].b)
    search = [_Search(wide.Descent(np.zeros(size + 1))) for _ in fits]
    scale = np.ones(size + 1)
    while todo := [i for i, s in enumerate(search) if not s.settled and s.taken <= max_iter]:
        trial = [(i, fits[i][1], fits[i][0].w, fits[i][0].b, search[i].descent.trial) for i in todo]

        def partial(p: pa.RecordBatch, trial=trial) -> dict[int, np.ndarray]:
            y, fold = p.column(0).to_numpy(), p.column(1).to_numpy()
            out = {}
            for i, held, w, b, beta in trial:
                use = slice(None) if held is None else fold != held
                sign = 2.0 * y[use] - 1.0
                lift = _cosines(np.stack([p.column(2 + i * d + j).to_numpy()[use] for j in range(d)], axis=1), w, b)
                short = np.maximum(1.0 - sign * (lift @ beta[:-1] + beta[-1]), 0.0)
                pull = np.where(short > 0, -sign, 0.0)
                out[i] = np.concatenate([pull @ lift, [pull.sum(), short.sum(), len(sign)]])
            return out

        got = collected_tasks(rows, partial, KERNEL_ROWS)
        for i in todo:
            s, n = search[i], got[i][-1] if i in got else 0.0
            if not n:
                raise ValueError(f"the fit without fold {fits[i][1]} has no rows")
            ridge_by, at = 1.0 / (c * n), s.descent.trial  # C sums the losses, their mean is taken here
            inner, sums = np.append(at[:-1], 0.0), got[i][:-1] / n
            s.seen(sums[-1] + 0.5 * ridge_by * float(inner @ inner), sums[:-1] + ridge_by * inner, scale)
    for (model, _), s in zip(fits, search):
        model.coef, model.intercept = s.descent.at[:-1], float(s.descent.at[-1])


@dataclass
class _Search:
    """How far the descent of one kernel SVM has come."""

    descent: wide.Descent
    taken: int = 0
    last: float | None = None
    settled: bool = False

    def seen(self, value: float, gradient: np.ndarray, scale: np.ndarray) -> None:
        self.settled = self.descent.seen(value, gradient, scale, 1e-6)
        if self.descent.cuts == 0:
            self.taken += 1
            self.settled = self.settled or (self.last is not None and self.last - self.descent.value <= 1e-6 * abs(self.last))
            self.last = self.descent.value


def _kernel_svm(df: DataFrame, cols: Sequence[str], size: int, seed: int) -> KernelSvm:
    first = standardized(df, cols)
    every = F.array(*[f"_s_{n}" for n in cols])
    var = first.transform(df).select(F.explode(every).alias("v")).agg(F.var_pop("v")).first()[0]
    return KernelSvm(first, 1.0 / (len(cols) * (var or 1.0)), len(cols), size, seed)


def fit_kernel_svm(df: DataFrame, cols: Sequence[str], y: str = "y", c: float = 0.5, size: int = 256, seed: int = 0, max_iter: int = 50) -> KernelSvm:
    """Gaussian support vectors on standardised, clipped columns (L7); gamma is 1 over columns times their variance."""
    return _kernel_svm(df, cols, size, seed).fit(df, cols, y, c, max_iter)


def fit_kernel_svms(df: DataFrame, cols: Sequence[str], folds: Sequence[int], y: str = "y", fold: str = "fold", c: float = 0.5, size: int = 256,
                    seed: int = 0, max_iter: int = 50) -> dict[int, KernelSvm]:
    """``fit_kernel_svm`` on the rows outside each fold: the steps of all folds share their passes over one narrow table."""
    rows = stage(df.where(F.col(fold).isNotNull()).select(F.col(y).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"), *cols))
    models = {f: _kernel_svm(rows.where(F.col("_fold") != f), cols, size, seed) for f in folds}
    every, inputs = rows, []
    for i, model in enumerate(models.values()):
        model.cols = list(cols)
        every = model.first.transform(every).withColumnsRenamed({f"_s_{n}": f"_s{i}_{n}" for n in cols})
        inputs += [f"_s{i}_{n}" for n in cols]
    _descend(every.select("_y", "_fold", *inputs), [(m, f) for f, m in models.items()], c, max_iter)
    unstage(rows)
    return models


def fit_alternative(kind: str, df: DataFrame, cols: Sequence[str], y: str = "y", seed: int = 0, **over):
    """``alternative``, or a kernel SVM ("rbf"), fitted on standardised, clipped columns of ``df``."""
    from pyspark.ml import PipelineModel

    if kind == "rbf":
        return fit_kernel_svm(df, cols, y, seed=seed, **over)
    first = standardized(df, cols)
    return PipelineModel([first, alternative(kind, cols, y, seed, **over).fit(first.transform(df))])


def score_alternative(kind: str, model, df: DataFrame, name: str = "z") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    if kind == "rbf":
        return model.transform(df, name).select(*df.columns, name)
    if kind == "svm":
        scored = model.transform(df).withColumn(name, vector_to_array("rawPrediction")[1])
        return scored.select(*df.columns, name)
    return probability_logit(model, df, name)


def cv_predict_alternatives(kinds: Sequence[str], df: DataFrame, cols: Sequence[str], folds: Sequence[int], y: str = "y", fold: str = "fold",
                            name: str = "z", seed: int = 0) -> dict[str, DataFrame]:
    """Out-of-fold scores of each kind of ``fit_alternative``; kinds are fitted side by side, as their many short jobs leave cores idle.

    So are the folds of a perceptron. Those of a forest follow each other: it caches a count a row and tree.
    """
    def one(kind: str) -> DataFrame:
        if kind == "rbf":
            models = fit_kernel_svms(df, cols, folds, y, fold, seed=seed)
            return reduce(DataFrame.unionByName, [score_alternative(kind, m, df.where(F.col(fold) == f), name) for f, m in models.items()])
        return cv_predict_with(df, lambda t: fit_alternative(kind, t, cols, y, seed), lambda m, r: score_alternative(kind, m, r, name),
                               folds, fold, name, at_once=1 if kind == "forest" else len(folds))

    tasks = [inheritable_thread_target(df.sparkSession)(lambda k=k: one(k)) for k in kinds]
    with ThreadPool(len(tasks)) as pool:
        return dict(zip(kinds, pool.map(lambda task: task(), tasks)))


def pca_logistic(train: DataFrame, rows: DataFrame, vec: str, k: int = 32, c: float = FEATURE_C, y: str = "y",
                 name: str = "z") -> DataFrame:
    """Scaler, principal components and a logistic fit, all from the training rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    n = train.count()
    pipe = Pipeline(stages=[
        StandardScaler(inputCol=vec, outputCol="_s", withMean=True, withStd=True),
        PCA(k=k, inputCol="_s", outputCol="_pc"),
        # the scaler divides by the sample deviation; for the population one the inputs are larger by sqrt(n / (n - 1)), which
        # is the same fit under a penalty smaller by that ratio
        LogisticRegression(featuresCol="_pc", labelCol=y, regParam=(n - 1) / (c * n * n), standardization=False, maxIter=200),
    ])
    model = pipe.fit(train)
    return model.transform(rows).withColumn(name, vector_to_array("rawPrediction")[1]).select(*rows.columns, name)


def _first_better(losses: Sequence[tuple[float, float]]) -> tuple[float, float]:
    """Earlier candidates stay unless a later one gains more than 1e-5."""
    best = losses[0]
    for cand in losses[1:]:
        if cand[1] < best[1] - STACK_GAIN:
            best = cand
    return best


def nested_losses(df: DataFrame, cols: Sequence[str], fitted: Sequence[Fitted], cs: Sequence[float], floors: Sequence[float],
                  y: str = "y", fold: str = "fold") -> dict[tuple[float, float], float]:
    """Held-out loss of every (C, floor) from one pass."""
    models = {c: {m.name[0]: m for m in fitted if m.name[1] == c and m.name[0] >= 0} for c in cs}
    base = df.select(y, fold, *cols)
    for i, c in enumerate(cs):
        base = base.withColumn(f"_p{i}", sigmoid(score_by_fold(cols, models[c], fold)))
    aggs = [
        F.avg(row_logloss(F.col(y), clip(F.col(f"_p{i}"), e, 1 - e))).alias(f"l{i}_{k}")
        for i in range(len(cs)) for k, e in enumerate(floors)
    ]
    row = base.agg(*aggs).first()
    return {(c, e): row[f"l{i}_{k}"] for i, c in enumerate(cs) for k, e in enumerate(floors)}


def fit_stack(oof: DataFrame, cols: Sequence[str], folds: Sequence[int], cs: Sequence[float] = STACK_C,
              floors: Sequence[float] = STACK_FLOORS, y: str = "y", fold: str = "fold") -> dict:
    """Logistic stack of OOF logits: nested choice of C, then of the floor, then a refit on all rows."""
    return _stack(oof, cols, folds, cs, floors, y, fold)[0]


def _stack(oof: DataFrame, cols: Sequence[str], folds: Sequence[int], cs: Sequence[float], floors: Sequence[float], y: str, fold: str) -> tuple[dict, dict[int, Fitted]]:
    """``fit_stack`` and its fits outside each fold."""
    fitted = fit_many_logistic(oof, cols, [-1, *folds], cs, y, fold)
    table = nested_losses(oof, cols, fitted, cs, [0.0, *floors], y, fold)
    c, plain = _first_better([(c, table[c, 0.0]) for c in cs])
    eps, loss = _first_better([(e, table[c, e]) for e in (0.0, *floors)])
    final = next(m for m in fitted if m.name == (-1, c))
    prior = oof.agg(F.avg(F.col(y).cast("double"))).first()[0]
    stack = dict(cols=list(cols), coef=final.coef, b=final.b, eps=eps, C=c, nested_logloss=loss, plain_logloss=plain, prior=prior)
    return stack, {m.name[0]: m for m in fitted if m.name[1] == c and m.name[0] >= 0}


def cv_predict_stack(oof: DataFrame, cols: Sequence[str], folds: Sequence[int], y: str = "y", fold: str = "fold", name: str = "z") -> DataFrame:
    """Out-of-fold logits of the stack of ``fit_stack``, floor included: their loss is its nested loss."""
    stack, held = _stack(oof, cols, folds, STACK_C, STACK_FLOORS, y, fold)
    z, eps = score_by_fold(cols, held, fold), stack["eps"]
    if eps > 0:
        p = clip(sigmoid(z), eps, 1 - eps)
        z = F.log(p / (1 - p))
    return oof.withColumn(name, z)


def transfer_score(rows: DataFrame, stack: dict, temps: Sequence[float] = (1.0, 1.1, 1.2), y: str = "y") -> DataFrame:
    """A stack fitted on one fold scheme judged on another scheme's predictions, per temperature."""
    scored = rows.select(y, dot(stack["cols"], stack["coef"], stack["b"]).alias("_s"))
    grid = with_grid(scored, [{"temp": float(t)} for t in temps])
    return scoreboard(grid.withColumn("z", F.col("_s") / F.col("temp")), ["temp"], y, "z")


def feature_ablation(df: DataFrame, sets: dict[str, Sequence[str]], fold_cols: dict[str, Sequence[int]], c: float = FEATURE_C,
                     y: str = "y", boosted: dict | None = None, base: Sequence[str] = ()) -> DataFrame:
    """Held-out scoreboard of feature sets under several fold schemes (L11): the logistic fit, the boosted trees, and the stack of both
    with the logits in ``base``, which shows what a set adds to them.

    ``boosted``: fields of ``Boosting`` other than the defaults. The trees of all sets, schemes and folds grow together.
    """
    arms = [(fold, name, list(cols)) for fold in fold_cols for name, cols in sets.items()]
    data = stage(df.select(*dict.fromkeys([y, *fold_cols, *base, *(n for _, _, cols in arms for n in cols)])))
    grown = fit_boosted(data, [Boosted(cols, f, fold) for fold, _, cols in arms for f in fold_cols[fold]], y, Boosting(**(boosted or {})))
    parts = []
    for fold, name, cols in arms:
        models, grown = grown[: len(fold_cols[fold])], grown[len(fold_cols[fold]) :]
        scored = cv_predict_features(data, cols, fold_cols[fold], c, y, fold, name="_logistic")
        scored = boosted_scores(scored, {m.held: m for m in models}, fold, "_boosted")
        keep = [F.col(n).cast("double").alias(f"_base{i}") for i, n in enumerate(base)]
        parts.append(scored.select(F.lit(fold).alias("scheme"), F.lit(name).alias("features"), F.col(y).alias("y"), F.col(fold).cast("int").alias("fold"),
                                   "_logistic", "_boosted", *keep))
    scored = stage(reduce(DataFrame.unionByName, parts))
    logits = [f"_base{i}" for i in range(len(base))] + ["_boosted", "_logistic"]

    def stacked(arm: tuple) -> DataFrame:
        own = scored.where((F.col("scheme") == arm[0]) & (F.col("features") == arm[1]) & F.col("_logistic").isNotNull())
        return cv_predict_stack(own, logits, fold_cols[arm[0]]).select("scheme", "features", F.lit("stack").alias("model"), "y", "z")

    tasks = [inheritable_thread_target(df.sparkSession)(lambda arm=arm: stacked(arm)) for arm in arms]
    with ThreadPool(len(tasks)) as pool:
        rows = pool.map(lambda task: task(), tasks)
    rows += [scored.select("scheme", "features", F.lit(m).alias("model"), "y", F.col(f"_{m}").alias("z")) for m in ("logistic", "boosted")]
    return scoreboard(reduce(DataFrame.unionByName, rows), ["scheme", "features", "model"])
