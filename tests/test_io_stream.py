"""Sources, sinks, the stream and the external scorer."""

import json

import pytest
from pyspark.sql import functions as F

from voxeval.functions import scalars as S
from voxeval.operators import gates as Q
from voxeval.operators import joins as J
from voxeval.sources import tables as IO
from voxeval.streaming import scoring as ST


def test_file_inventory(spark, tmp_path):
    for name in ("a/s1.nii", "a/s1.nii.gz", "b/c/s2.nii", "b/notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"xy")
    got = {r.uid: (r.path.split("/")[-1], r.length) for r in IO.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("s1.nii.gz", 2), "s2": ("s2.nii", 2)}


def test_run_config(spark, tmp_path):
    cfg = {"run": "r", "folds": 2, "split_seed": 7, "nets": [{"name": "n", "seeds": [0, 3], "weights": [0.1, 0.2, 0.3, 0.4]}, {"name": "m", "seeds": [1], "files": ["p", "q"]}],
           "groups": {"g": ["n", "m"]}, "group_weights": {"g": {"n": 2.0}}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(cfg, indent=1))
    df = IO.read_run_config(spark, str(path))
    rows = {(r.family, r.seed, r.fold): (r.file, r.weight) for r in IO.checkpoints(df).collect()}
    assert rows == {("n", 0, 0): ("n_s0_f0", 0.1), ("n", 0, 1): ("n_s0_f1", 0.2), ("n", 3, 0): ("n_s3_f0", 0.3), ("n", 3, 1): ("n_s3_f1", 0.4),
                    ("m", 1, 0): ("p", 1.0), ("m", 1, 1): ("q", 1.0)}
    assert {(r.family, r.weight) for r in IO.group_table(df).collect()} == {("n", 2.0), ("m", 1.0)}


def test_params_round_trip(spark, tmp_path):
    params = {"cols": ["a", "b"], "coef": [1.5, -2.0], "b": 0.25, "adj": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]}
    IO.write_params(spark, params, str(tmp_path / "p"))
    assert IO.read_params(spark, str(tmp_path / "p")) == params


def test_submission_order(spark, tmp_path):
    fmt = spark.createDataFrame([(str(100 - i), i) for i in range(50)], "uid string, pos int")
    scored = fmt.where("pos % 7 <> 0").select("uid", F.lit(0.25).alias("p"))
    sub = IO.submission(fmt, scored, 0.5)
    IO.write_submission(sub, str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert back.count() == 50 and back.where("is_pathologic = 0.5").count() == 8
    bad = Q.check_submission(sub, fmt).first()
    assert (bad.matched, bad.missing, bad.extra, bad.out_of_order, bad.nulls, bad.out_of_range) == (50, 0, 0, 0, 0, 0)


def test_labels_must_cover_rows(spark):
    a = spark.createDataFrame([("1",), ("2",)], "uid string")
    with pytest.raises(ValueError):
        J.attach_labels(a, spark.createDataFrame([("1", 1)], "uid string, y int"))


def test_stream_equals_batch(spark, sf):
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    models = [({"cols": ["o_totalprice"], "mu": [2.5e5], "sd": [1e5], "coef": [1.0], "b": 0.1}, 1.0)]

    def rows(df):
        return df.select(F.col("o_orderkey").cast("string").alias("uid"), "o_totalprice", F.lit(1).alias("ok"))

    stream = rows(spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf))
    out = spark.read.parquet(ST.run_available(ST.score_stream(stream, models, eps=0.0, prior=0.5)))
    batch = ST.score_rows(rows(spark.read.parquet(f"{sf}/orders.parquet")), models, eps=0.0, prior=0.5)
    assert out.count() == batch.count() and out.exceptAll(batch).count() == 0


def test_failing_scorer_gives_prior(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(10)], "uid string, x double")

    def loader():
        raise RuntimeError("no model")

    assert ST.batch_score(df, loader, ["x"]).where("z is null").count() == 10
    assert ST.batch_score(df, loader, ["x"], prior=0.5).where("z = 0.5").count() == 10


def test_only_rows_that_fail_alone_are_lost(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(200)], "uid string, x double").coalesce(1)

    def loader():
        def model(pdf):
            if (pdf["x"] == 70.0).any():
                raise ValueError("bad row")
            return pdf["x"] * 2

        return model

    got = {r.uid: r for r in ST.batch_score(df, loader, ["x"]).collect()}
    assert [u for u, r in got.items() if not r.ok] == ["70"] and got["70"].z is None and "bad row" in got["70"].err
    assert all(r.z == 2.0 * int(u) and r.err is None for u, r in got.items() if r.ok)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    models = [({"cols": ["x"], "mu": [0.0], "sd": [1.0], "coef": [1.0], "b": 0.0}, 1.0)]
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for a in (0, 100):
        part = spark.range(a, a + 100).select(F.col("id").cast("string").alias("uid"), (F.col("id") / 100.0).alias("x"), F.lit(1).alias("ok"))
        part.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(part.schema).parquet(feed)
        ST.run_available(ST.score_stream(stream, models, eps=0.0, prior=0.5), out, str(tmp_path / "progress"))
    whole = ST.score_rows(spark.read.parquet(feed), models, eps=0.0, prior=0.5)
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.exceptAll(whole).count() == 0


def test_volumes_outside_their_plane_fail(spark, tmp_path):
    vox = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 2, 1, 2.0)], "uid string, z int, y int, x int, v double")
    IO.write_volumes(vox, str(tmp_path / "v"), (3, 2))
    got = IO.read_volumes(spark, str(tmp_path / "v"), 2)
    assert got.count() == 6 and got.where("v <> 0").count() == 2 and got.where("y = 2 and x = 1 and v = 2").count() == 1
    with pytest.raises(Exception, match="outside"):
        IO.write_volumes(vox, str(tmp_path / "w"), (2, 2))


def test_scalar_edges(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.0,), (2.5,), (None,)], "v double")
    got = [tuple(r) for r in df.select(S.clean_value("v"), S.sane_spacing("v"), S.family_key("v")).collect()]
    assert [g[0] for g in got] == [0.0, 0.0, 0.0, 2.5, 0.0]
    assert [g[1] for g in got] == [2.0, 2.0, 2.0, 2.5, 2.0]
    assert got[3][2] == "2.5" and got[4][2] == "na"
    p = spark.range(1).select(S.finalize_probability(F.lit(50.0), F.lit(1), eps=0.0, prior=0.4), S.finalize_probability(F.lit(float("nan")), F.lit(1), eps=0.0, prior=0.4),
                              S.finalize_probability(F.lit(1.0), F.lit(0), eps=0.0, prior=0.4), S.noisy_or_logit(F.lit(-800.0), F.lit(-800.0))).first()
    assert p[0] == pytest.approx(0.999) and p[1] == p[2] == 0.4 and p[3] == pytest.approx(-13.8155, abs=1e-3)
