"""Boosted trees that grow in shared passes: against a plain grower on rows, and the settings of the queries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxeval.operators import fits as L
from voxeval.plans import boosted as B


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(700, 3)).astype(float)
    y = (np.sin(x[:, 0]) + 0.2 * x[:, 1] + rng.normal(size=700) > 1.2).astype(int)
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, fold=np.arange(700) % 3, uid=[str(i) for i in range(700)])


def plain(x, y, at, trees, rate=0.1, depth=3, least=15, lam=2.0):
    """Every cut between values of every column, row by row; no draws."""
    z, out = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), np.full(len(at), np.log(y.mean() / (1 - y.mean())))

    def grow(use, seen, level):
        p = 1 / (1 + np.exp(-z[use]))
        g, h = p - y[use], p * (1 - p)
        best = (1e-9, None)
        for j in range(x.shape[1]) if level < depth else ():
            for cut in np.unique(x[:, j])[:-1]:
                left = x[use, j] <= cut
                if min(left.sum(), (~left).sum()) >= least:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + lam)
                    if gain > best[0] + 1e-6:
                        best = (gain, (j, cut))
        if best[1] is None:
            return [(use, seen, -rate * g.sum() / (h.sum() + lam))]
        j, cut = best[1]
        return grow(use[x[use, j] <= cut], seen[at[seen, j] <= cut], level + 1) + grow(use[x[use, j] > cut], seen[at[seen, j] > cut], level + 1)

    for _ in range(trees):
        for use, seen, v in grow(np.arange(len(y)), np.arange(len(at)), 0):
            z[use] += v
            out[seen] += v
    return out


def test_trees_of_all_folds_equal_a_plain_grower(spark, rows, monkeypatch):
    """Without draws, each fold's trees are those grown row by row on the other folds; stored scores make no difference."""
    monkeypatch.setattr(B, "KEEP", 4)
    monkeypatch.setattr(B, "CELLS", 100)
    df = spark.createDataFrame(rows).repartition(5)
    got = L.cv_predict_boosted(df, ["a", "b", "c"], range(3), trees=9, rate=0.1, rows=1.0, columns=1.0).toPandas().set_index("uid").z
    for f in range(3):
        train, held = rows[rows.fold != f], rows[rows.fold == f]
        want = plain(train[["a", "b", "c"]].to_numpy(), train.y.to_numpy(), held[["a", "b", "c"]].to_numpy(), 9)
        np.testing.assert_allclose(got[held.uid].to_numpy(), want, atol=1e-5)


def test_draws_do_not_depend_on_the_layout(spark, rows):
    """Row and column draws give the same trees from one partition and from seven, and a tree sees a share of the rows."""
    df, out = spark.createDataFrame(rows), []
    for parts in (1, 7):
        m = B.fit_boosted(df.repartition(parts, "uid"), [B.Boosted(["a", "b", "c"], 0, "fold")], params=B.Boosting(trees=6))[0]
        out.append((m.feature, m.cut, m.value))
    for a, b in zip(*out):
        np.testing.assert_array_equal(a, b)
    assert (out[0][1] < 32).any() and all(len(set(f[c < 32])) <= 2 for f, c in zip(out[0][0], out[0][1]))


def test_rows_without_a_fold_or_a_value(spark, rows):
    """A missing value counts as 0; a row without a fold trains nothing and has no score; a fit without a label is refused."""
    df = spark.createDataFrame(rows)
    gaps = df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))).withColumn("b", F.when(F.col("b") > 0, F.col("b")).otherwise(float("nan")))
    want = L.cv_predict_boosted(df, ["a", "b"], range(3), trees=3).select("uid", "z")
    got = L.cv_predict_boosted(gaps.unionByName(gaps.withColumn("fold", F.lit(None).cast("long")).withColumn("uid", F.lit("none"))), ["a", "b"], range(3), trees=3)
    both = got.select("uid", F.col("z").alias("w")).join(want, "uid", "left").toPandas()
    assert len(both) == 1400 and both[both.uid == "none"].w.isna().all()
    np.testing.assert_array_equal(both[both.uid != "none"].w, both[both.uid != "none"].z)
    with pytest.raises(ValueError, match="lacks rows"):
        L.cv_predict_boosted(df.where("y = 1"), ["a"], range(2), trees=1)


def test_query_of_boosted_trees_takes_every_tree_and_fold(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "fit_boosted", lambda df, fits, y, params: seen.append((fits, params)) or B.fit_boosted(df, fits, y, B.Boosting(trees=2)))
    assert entry.queries()["l6_fit_gbt"](spark, sf).first()["n"] == 1500
    fits, params = seen[0]
    assert params == B.Boosting() and params.trees == 350 and [m.held for m in fits] == list(range(5))


def test_ablation_has_every_arm(spark, rows, monkeypatch):
    """Logistic, boosted and stack of each set and scheme; the values are those of each arm alone, trees grow in one call with the defaults."""
    seen = []
    monkeypatch.setattr(L, "fit_boosted", lambda df, fits, y, params: seen.append((len(fits), params)) or B.fit_boosted(df, fits, y, B.Boosting(trees=4, rate=0.3, rows=1.0, columns=1.0)))
    rng = np.random.default_rng(6)
    pdf = rows.assign(held=(rows.a % 3).astype(int), net=rows.b - 5 + rng.normal(size=700))
    df, sets = spark.createDataFrame(pdf), {"one": ["a"], "all": ["a", "b", "c"]}
    board = L.feature_ablation(df, sets, {"fold": range(3), "held": range(3)}, base=["net"]).toPandas().set_index(["scheme", "features", "model"])
    assert seen == [(12, B.Boosting())] and len(board) == 12 and (board.n == 700).all()
    lr = L.cv_predict_features(df, sets["all"], range(3), name="lr", fold="held")
    both = L.cv_predict_boosted(lr, sets["all"], range(3), fold="held", name="gb").toPandas()  # the same trees: nothing is drawn
    for model, z in (("logistic", both.lr), ("boosted", both.gb)):
        assert abs(board.loc[("held", "all", model), "logloss"] - (np.logaddexp(0, z) - both.y * z).mean()) < 1e-9
    stack = L.fit_stack(spark.createDataFrame(both), ["net", "gb", "lr"], range(3), fold="held")
    assert abs(board.loc[("held", "all", "stack"), "logloss"] - stack["nested_logloss"]) < 1e-9
