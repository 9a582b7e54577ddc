"""Stationarity, bounds, weights and scaling of the distributed fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxeval.operators import calibration as C
from voxeval.operators import ensemble as E
from voxeval.operators import fits as L
from voxeval.plans import wide
from voxeval.plans.newton import Fit, fit_many, ridge


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 800
    a, b = rng.normal(size=n), rng.normal(size=n)
    zoom = rng.uniform(1.5, 3.5, n)
    p = 1 / (1 + np.exp(-(1.5 * a - b + 0.3)))
    return pd.DataFrame({"uid": [str(i) for i in range(n)], "a": a + 0.3 * zoom**2, "b": b - zoom, "zoom": zoom, "fold": np.arange(n) % 4, "w": rng.uniform(0.3, 1, n),
                         "y": (rng.random(n) < p).astype(int)})


def gradient(x, y, w, coef, b, c):
    r = w * (1 / (1 + np.exp(-(x @ coef + b))) - y)
    return np.append(x.T @ r + np.array(coef) / c, r.sum())


def test_many_fits_are_stationary(spark, data):
    got = L.fit_many_logistic(spark.createDataFrame(data), ["a", "b"], [-1, 0, 1, 2, 3], [0.05, 1.0], weight="w")
    assert len(got) == 10
    for m in got:
        f, c = m.name
        d = data[data.fold != f]
        g = gradient(d[["a", "b"]].to_numpy(), d.y.to_numpy(), d.w.to_numpy(), m.coef, m.b, c)
        assert np.abs(g).max() < 1e-6 and m.n == len(d)


def test_single_fit_agrees_with_ml(spark, data):
    df = spark.createDataFrame(data)
    one = L.fit_logistic(df, ["a", "b"], 0.1)
    many = L.fit_many_logistic(df, ["a", "b"], [-1], [0.1])[0]
    assert np.allclose(one["coef"] + [one["b"]], many.coef + [many.b], atol=1e-5)


def test_bounds_hold(spark, data):
    fit = Fit(("x",), penalty=[1e-3, 1e-3, 1e-3], center=[0.0, 0.0, 0.0], bounds=[(0.0, 0.5), (-0.2, 0.0), (-5.0, 5.0)])
    m = fit_many(spark.createDataFrame(data), ["a", "b"], [fit])[0]
    assert m.coef == [0.5, -0.2]


def test_separable_data_needs_the_ridge_only(spark):
    df = spark.createDataFrame([(float(i), int(i > 0)) for i in range(-20, 21) if i], "a double, y int")
    m = fit_many(df, ["a"], [Fit(("s",), penalty=ridge(1.0, 1))])[0]
    x = np.array([i for i in range(-20, 21) if i], float)
    assert np.abs(gradient(x[:, None], (x > 0).astype(int), 1.0, m.coef, m.b, 1.0)).max() < 1e-6


def test_feature_models_use_training_rows_only(spark, data):
    df = spark.createDataFrame(data)
    models = L.fit_feature_models(df, ["a", "b"], range(4), 0.05, zoom="zoom")
    for f, m in models.items():
        d = data[data.fold != f]
        normal = d[d.y == 0]
        basis = np.stack([np.ones(len(normal)), normal.zoom, normal.zoom**2], 1)
        adj = np.linalg.lstsq(basis, normal[["a", "b"]].to_numpy(), rcond=None)[0]
        assert np.allclose(m["adj"], adj, atol=1e-6)
        res = d[["a", "b"]].to_numpy() - np.stack([np.ones(len(d)), d.zoom, d.zoom**2], 1) @ adj
        assert np.allclose(m["mu"], res.mean(0), atol=1e-8) and np.allclose(m["sd"], res.std(0) + 1e-6, atol=1e-8)
        z = np.clip((res - res.mean(0)) / (res.std(0) + 1e-6), -6, 6)
        assert np.abs(gradient(z, d.y.to_numpy(), 1.0, m["coef"], m["b"], 0.05)).max() < 1e-5
    scored = L.cv_predict_features(df, ["a", "b"], range(4), zoom="zoom").toPandas()
    assert scored.z.notna().all() and len(scored) == len(data)


def test_calibration_improves_bad_scores(spark, data):
    z = 3.0 * (1.5 * data.a - data.b) / 4 + 1.0
    df = spark.createDataFrame(data.assign(z=z))
    t, loss = C.fit_temperature(df)
    assert 0.5 <= t <= 3.0

    def total(zz):
        p = 1 / (1 + np.exp(-zz))
        return float(-np.mean(data.y * np.log(p) + (1 - data.y) * np.log(1 - p)))

    assert loss <= total(z) + 1e-12
    got = C.fit_affine(df)
    assert total(got["a"] * z + got["b"]) < total(z)


def test_doubly_nested_identity_equals_cv(spark, data):
    df = spark.createDataFrame(data)
    got = {r.kind: r.logloss for r in C.doubly_nested_calibration(df, ["a", "b"], 4, 3).collect()}
    z = L.cv_predict(df, ["a", "b"], range(4), 0.1)
    from voxeval.operators.metrics import loss_of_logit

    assert got["identity"] == pytest.approx(z.agg(F.avg(loss_of_logit())).first()[0], abs=1e-9)
    assert set(got) == {"identity", "temperature", "affine", "beta"}


def test_inner_scores_never_see_their_row(spark, data):
    rows = C.inner_stack_scores(spark.createDataFrame(data), ["a", "b"], 4, 3).toPandas()
    assert len(rows) == 3 * len(data) and (rows.outer_fold != rows.fold).all() and rows.s.notna().all()


def test_simplex_weights_sum_to_one():
    ws = E.simplex(3, 4)
    assert len(ws) == 15 and all(abs(sum(w) - 1) < 1e-12 for w in ws)


def test_boosted_logit_is_twice_the_margin(spark, data):
    df = spark.createDataFrame(data)
    model = L.fit_gbt(df, ["a", "b"], trees=5)
    got = L.gbt_logit(model, df).select("uid", "z").toPandas().set_index("uid")
    prob = model.transform(df.withColumn("y", F.col("y").cast("double"))).select("uid", "probability").toPandas().set_index("uid")
    p = prob.probability.map(lambda v: float(v[1]))
    assert np.allclose(got.z, np.log(p / (1 - p)), atol=1e-6)


def test_wide_fits_equal_newton_fits(spark, data):
    """Weights, held folds, centres and penalties per row: the same minimum as by Newton steps."""
    df = spark.createDataFrame(data)
    fits = [Fit((f, c), held=None if f < 0 else f, penalty=ridge(c, 2)) for f in (-1, 0, 2) for c in (0.05, 1.0)]
    fits += [Fit(("row",), penalty=[0.1, 0.2, 0.3], center=[1.0, -1.0, 0.5], per_row=True)]
    want = fit_many(df, ["a", "b"], fits, fold="fold", weight="w")
    got = wide.fit_wide(wide.packed(df, ["a", "b"], "y", "fold", "w"), fits)
    for m, n in zip(got, want):
        assert m.name == n.name and m.n == n.n and m.gradient <= 1e-6
        assert np.allclose([*m.coef, m.b], [*n.coef, n.b], atol=1e-6)


def test_wide_feature_models_equal_narrow_ones(spark, data, monkeypatch):
    df = spark.createDataFrame(data)
    for zoom in (None, "zoom"):
        narrow = L.cv_predict_features(df, ["a", "b"], range(4), 0.05, zoom=zoom).select("uid", "z").toPandas().set_index("uid").z
        with monkeypatch.context() as m:
            m.setattr(L, "WIDE", 1)
            broad = L.cv_predict_features(df, ["a", "b"], range(4), 0.05, zoom=zoom).select("uid", "z").toPandas().set_index("uid").z
        assert np.allclose(narrow.sort_index(), broad.sort_index(), atol=1e-6)


def test_hundreds_of_columns(spark):
    """Null and NaN features count as 0; the gradient settles and the time of a pass grows with the columns, not with their square."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 240))
    x[3, 5], x[7, 9] = np.nan, np.nan
    cols = [f"c{i}" for i in range(240)]
    pdf = pd.DataFrame(x, columns=cols).assign(y=(x[:, 0] + rng.normal(size=300) > 0).astype(int), fold=np.arange(300) % 3)
    df = spark.createDataFrame(pdf).withColumn("c1", F.when(F.col("fold") == 9, 1.0).otherwise(F.col("c1")))
    models = L.fit_feature_models(df, cols, range(3), 0.05)
    clean = np.nan_to_num(x)
    for f, m in models.items():
        use = (np.arange(300) % 3) != f
        z = np.clip((clean[use] - clean[use].mean(0)) / (clean[use].std(0) + 1e-6), -6, 6)
        assert np.abs(gradient(z, pdf.y[use].to_numpy(), 1.0, m["coef"], m["b"], 0.05)).max() < 1e-5
    with pytest.raises(ValueError):
        wide.fit_wide(wide.packed(df.where("fold = 0"), cols[:3], "y", "fold"), [Fit(("none",), held=0, penalty=ridge(1.0, 3))])


def test_random_features_are_the_kernel_and_bend_the_margin(spark):
    """Inner products within 0.1 of the exact kernel on 2,000 rows, and a ring that no line parts."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    model = L.KernelSvm(None, 0.2, 3, 4096, 1)
    lifted = model.features(x)
    exact = np.exp(-0.2 * ((x[:400, None] - x[None, 400:800]) ** 2).sum(axis=2))
    assert np.abs(lifted[:400] @ lifted[400:800].T - exact).max() < 0.1
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=((x[:, :2] ** 2).sum(axis=1) < 1.2).astype(int))
    df = spark.createDataFrame(pdf)
    hits = {}
    for kind in ("rbf", "svm"):
        scored = L.score_alternative(kind, L.fit_alternative(kind, df.where("a < 10"), ["a", "b", "c"]), df).toPandas()
        hits[kind] = ((scored.z > 0) == (scored.y == 1)).mean()
    assert hits["rbf"] > 0.93 and hits["svm"] < 0.75
