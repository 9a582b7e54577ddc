"""Steps whose cost must not outgrow their input: what they exchange, sort or draw, and that results stay the same."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.operators import calibration as C
from voxeval.operators import ensemble as E
from voxeval.operators import fits as L
from voxeval.operators import metrics as M
from voxeval.operators import rasters as R
from voxeval.plans import newton, volumes
from voxeval.sources import tables as IO


def test_runs_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(400).select(F.col("id").alias("uid"), F.concat(F.lit("r"), F.col("id") % 20).alias("run"))
    IO.write_oof(rows, str(tmp_path / "oof"))
    assert seen and seen[0] > 1 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    back = IO.read_runs(spark, str(tmp_path / "oof"), ["r0", "r3"]).toPandas()
    assert sorted(back.uid) == [i for i in range(400) if i % 20 in (0, 3)]


def test_names_side_by_side(spark):
    """The mean per name equals the plain one, takes one exchange, and a further aggregate by more keys takes none."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"uid": rng.integers(0, 40, 900).astype(str), "run": rng.choice(["a", "b"], 900), "family": rng.choice(["x", "y", "w"], 900), "z": rng.normal(size=900)})
    rows = rows[~((rows.uid == "7") & (rows.family == "y"))]
    df = spark.createDataFrame(rows).withColumn("z", F.when(F.col("uid") != "9", F.col("z")))
    plain = E.seed_mean(df, keep=()).toPandas()
    means = E.seed_mean(df, keep=(), families=["x", "y", "w", "none"])
    keys = ["uid", "run", "family"]
    pd.testing.assert_frame_equal(*(t.sort_values(keys).reset_index(drop=True)[[*keys, "z"]] for t in (plain, means.toPandas())))
    groups = {"g": {"x": 1.0, "y": 2.0, "absent": 3.0}}
    got = E.group_mean(means, groups, ("uid", "run"), families=["x", "y", "w", "none"])
    want = E.group_mean(spark.createDataFrame(plain), groups, ("uid", "run")).toPandas()
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    keys = ["uid", "run", "grp_col"]
    pd.testing.assert_frame_equal(*(t.sort_values(keys).reset_index(drop=True)[[*keys, "z"]] for t in (want, got.toPandas())))
    with pytest.raises(Exception, match="family not listed: w"):
        E.seed_mean(df, keep=(), families=["x", "y"]).collect()


def test_alternative_scores_meet_folds_averaged(spark):
    """Checkpoints of a fold are one row a subject before the join with the folds."""
    alt = spark.createDataFrame([("a", "x", f, s, float(10 * f + s)) for f in range(5) for s in range(3)], "uid string, family string, fold int, seed int, z double")
    first = spark.createDataFrame([("a", "x", 1.0)], "uid string, family string, z double")
    own = spark.createDataFrame([("a", 3)], "uid string, fold int")
    got = E.alternate_average(first, alt, own, families=["x", "y"])
    assert [tuple(r) for r in got.collect()] == [("a", "x", 16.0)]


def test_bootstrap_counts_at_the_steps():
    """Looked-up counts are those of the division and search, next to every step too."""
    cdf, m = np.array(M._poisson_cdf()), M.MERSENNE31
    near = np.unique(np.clip(np.concatenate([(cdf * m).astype(np.int64) + k for k in range(-3, 4)] + [np.array([0, 1, m - 2, m - 1])]), 0, m - 1))
    got = M.bootstrap_weights(near, np.zeros_like(near), np.array([[1, 1, 0]], np.int64))[:, 0]
    assert (got == np.searchsorted(cdf, near / float(m), side="right")).all()
    rng = np.random.default_rng(5)
    h, g = rng.integers(0, m, (2, 500))
    keys = np.array(M.replicate_keys(50), np.int64)
    a, b, c = keys.T
    assert (M.bootstrap_weights(h, g, keys) == np.searchsorted(cdf, (h[:, None] * a + g[:, None] * b + c) % m / float(m), side="right")).all()


def test_bootstrap_of_several_columns_draws_once(spark):
    """Columns side by side give the replicates of each alone, nulls left out."""
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"uid": [str(i) for i in range(300)], "p": rng.normal(size=300), "q": rng.normal(size=300)})
    df = spark.createDataFrame(rows).withColumn("q", F.when(F.col("uid") != "5", F.col("q")))
    both = M.bootstrap_sums(df, 20, d=["p", "q"]).toPandas().sort_values(["part", "rep"])
    for i, c in enumerate(["p", "q"]):
        alone = M.bootstrap_sums(df.where(F.col(c).isNotNull()), 20, d=c).toPandas().sort_values("rep")
        np.testing.assert_allclose(both[both.part == i].mean_d, alone.mean_d, rtol=1e-12)


def test_fits_start_from_a_share(spark, monkeypatch):
    """On many rows the passes over all of them are few, and the fit is the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 2))
    y = (x @ [1.0, -2.0] + 0.5 + rng.logistic(size=6000) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "fold": np.arange(6000) % 3}))
    fits = [newton.Fit((f,), held=f, penalty=newton.ridge(0.1, 2)) for f in range(3)]
    plain = newton.fit_many(df, ["a", "b"], fits, fold="fold")
    monkeypatch.setattr(newton, "WARM_ROWS", 1000)
    warm = newton.fit_many(df, ["a", "b"], fits, fold="fold")
    for p, w in zip(plain, warm):
        np.testing.assert_allclose([*w.coef, w.b], [*p.coef, p.b], rtol=1e-8)
        assert w.n == p.n and w.iterations < p.iterations
    monkeypatch.setattr(newton, "WARM_SHARE", 1 << 40)  # no row at all: the centres are the start
    for p, w in zip(plain, newton.fit_many(df, ["a", "b"], fits, fold="fold")):
        np.testing.assert_allclose([*w.coef, w.b], [*p.coef, p.b], rtol=1e-8)


@pytest.mark.parametrize("scale", [0.2, 1.0, 9.0, 30.0])
def test_best_temperatures_are_the_grid_s(spark, scale):
    rng = np.random.default_rng(9)
    s = scale * rng.normal(size=(2, 400))
    y = (s / scale * 2 + rng.logistic(size=s.shape) > 0).astype(int)
    temps = [round(0.5 + 0.025 * i, 6) for i in range(101)]
    rows = pd.DataFrame({"part": np.repeat([0, 1], 400), "y": y.ravel(), "s": s.ravel()})
    got = C.best_temperatures(spark.createDataFrame(rows), temps)
    for k in (0, 1):
        p = np.clip(1 / (1 + np.exp(-s[k][:, None] / np.array(temps))), 1e-15, 1 - 1e-15)
        loss = -(y[k][:, None] * np.log(p) + (1 - y[k][:, None]) * np.log(1 - p)).mean(axis=0)
        assert got[k] == temps[int(loss.argmin())]


def test_kernel_svm_stores_columns_not_cosines(spark, monkeypatch):
    """What is written for a fit are the label and the columns; margins separate a circle that no line can."""
    staged, keep = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df: staged.append(df.columns) or keep(df))
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 2))
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": ((x**2).sum(axis=1) < 1.4).astype(int)})
    df = spark.createDataFrame(rows).repartition(3)
    got = L.score_alternative("rbf", L.fit_alternative("rbf", df, ["a", "b"]), df).toPandas()
    assert staged == [["_y", "_s_a", "_s_b"]]
    assert ((got.z > 0) == (got.y == 1)).mean() > 0.95


def test_a_task_of_a_blur_takes_no_more_volumes_when_there_are_more(spark, monkeypatch):
    """Partitions follow the number of volumes, and the values do not depend on them."""
    grid = (2, 3, 4)
    rng = np.random.default_rng(8)
    cells = pd.DataFrame([(u, z, y, x) for u in range(60) for z in range(2) for y in range(3) for x in range(4)], columns=["uid", "z", "y", "x"])
    vox = spark.createDataFrame(cells.assign(v=rng.normal(size=len(cells))))
    zooms = spark.range(60).select(F.col("id").alias("uid"), (F.lit(1.5) + F.col("id") % 30 * 0.1).alias("zoom"))
    keys = ["uid", "z", "y", "x"]
    plain = R.harmonize_blur(vox, zooms, 0.8, grid).toPandas().sort_values(keys).reset_index(drop=True)
    flat = R.gaussian_blur(vox, (0.7, 1.0, 1.3), grid).toPandas().sort_values(keys).reset_index(drop=True)
    monkeypatch.setattr(volumes, "TASK_CELLS", 50)  # two volumes
    for tasks, want, got in ((30, plain, R.harmonize_blur(vox, zooms, 0.8, grid)), (30, flat, R.gaussian_blur(vox, (0.7, 1.0, 1.3), grid, tasks=volumes.volume_tasks(zooms, grid)))):
        most = got.select(F.spark_partition_id().alias("p"), "uid").groupBy("p").agg(F.count_distinct("uid").alias("n")).agg(F.max("n"), F.count("p")).first()
        assert got.rdd.getNumPartitions() == tasks and most[0] <= 8 and most[1] > 15
        pd.testing.assert_frame_equal(got.toPandas().sort_values(keys).reset_index(drop=True), want)


def test_inputs_of_boosted_trees_rank_and_draw_nothing_else(spark, sf):
    """The rows of the wide table, without its folds and its other families."""
    got = fx.wide_inputs(spark, sf, ("lr",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("md5(") == 4  # the label and three seeds
    want = fx.wide_oof(spark, sf).select(*got.columns).toPandas().sort_values("uid").reset_index(drop=True)
    pd.testing.assert_frame_equal(got.toPandas().sort_values("uid").reset_index(drop=True), want)


def test_folds_fitted_side_by_side(spark):
    """Each fit waits for the other; every row gets the score of its own fold's model."""
    df = spark.range(20).select(F.col("id").alias("uid"), (F.col("id") % 2).cast("int").alias("fold"))
    both = threading.Barrier(2, timeout=60)

    def fit(train):
        both.wait()
        return train.agg(F.max("fold")).first()[0]

    score = lambda m, rows: rows.withColumn("z", F.lit(m))
    got = L.cv_predict_with(df, fit, score, range(2), at_once=2).collect()
    assert len(got) == 20 and all(r.z == 1 - r.fold for r in got)
    both.reset()
    with pytest.raises(ValueError, match="no fit"):
        L.cv_predict_with(df, lambda t: (_ for _ in ()).throw(ValueError("no fit")), score, range(2), at_once=2)


def test_kernel_svms_of_all_folds_share_their_passes(spark, monkeypatch):
    """The fits of each fold alone, in as many passes as the longest of them takes; rows without a fold are left out."""
    passes, keep = [], L.collected_tasks
    monkeypatch.setattr(L, "collected_tasks", lambda *args: passes.append(1) or keep(*args))
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 2))
    rows = pd.DataFrame({"a": x[:, 0], "b": 5 + x[:, 1], "y": ((x**2).sum(axis=1) < 1.4).astype(int), "fold": np.arange(900) % 3})
    df = spark.createDataFrame(rows).withColumn("fold", F.when(F.col("a") < 2.5, F.col("fold"))).repartition(3)
    alone, took = {}, []
    for f in range(3):
        alone[f] = L.fit_kernel_svm(df.where(F.col("fold") != f), ["a", "b"], size=32, max_iter=8)
        took.append(len(passes) - sum(took))
    passes.clear()
    for f, m in L.fit_kernel_svms(df, ["a", "b"], range(3), size=32, max_iter=8).items():
        np.testing.assert_allclose([*m.coef, m.intercept], [*alone[f].coef, alone[f].intercept], rtol=1e-6, atol=1e-9)
    assert len(passes) == max(took)
    many = rng.normal(size=(50, 3)) * 20
    w, b = rng.normal(size=(3, 16)), rng.uniform(0, 7, 16)
    np.testing.assert_allclose(L._cosines(many, w, b), np.sqrt(2 / 16) * np.cos(many @ w + b), atol=1e-12)
