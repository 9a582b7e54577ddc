"""Ranks, prefix sums and quantiles with one key that holds most rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxeval.operators import folds as K
from voxeval.operators import metrics as M
from voxeval.plans.bounded import lookup_join
from voxeval.plans.ranking import exact_quantiles, hash_rank


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdefgh"), n))
    z = np.where(rng.random(n) < 0.35, 0.5, np.round(rng.normal(size=n), 2))  # one tied score holds a third
    return pd.DataFrame({"uid": [str(i) for i in range(n)], "g": g, "z": z, "y": (z + rng.normal(size=n) > 0).astype(int)})


def brute_auc(y, z):
    p, q = z[y == 1], z[y == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


def test_hash_rank_is_exact(spark, skewed):
    got = hash_rank(spark.createDataFrame(skewed), ["g"], ["7"]).toPandas()
    h = skewed.uid.map(lambda u: hashlib.md5(f"{u}-7".encode()).hexdigest())
    want = skewed.assign(h=h).sort_values(["g", "h", "uid"]).groupby("g").cumcount() + 1
    want = skewed.assign(w=want).set_index("uid").w
    assert (got.set_index("uid")["rank"].sort_index() == want.sort_index()).all()


def test_exact_quantiles(spark, skewed):
    got = exact_quantiles(spark.createDataFrame(skewed), ["g"], "z", [0.0, 0.37, 0.5, 0.9, 1.0]).toPandas().set_index("g")
    for g, d in skewed.groupby("g"):
        assert np.allclose(got.loc[g], np.quantile(d.z, [0.0, 0.37, 0.5, 0.9, 1.0]))


def test_quantiles_of_all_rows(spark, skewed):
    row = exact_quantiles(spark.createDataFrame(skewed), [], "z", [0.25, 0.5]).first()
    assert np.allclose([row.q0, row.q1], np.quantile(skewed.z, [0.25, 0.5]))


def test_auc_with_ties_and_skew(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = {r.g: r.auc for r in M.auc(df, ["g"]).collect()}
    for g, d in skewed.groupby("g"):
        assert got[g] == pytest.approx(brute_auc(d.y.to_numpy(), d.z.to_numpy()))
    whole = M.auc(df).first().auc
    assert whole == pytest.approx(brute_auc(skewed.y.to_numpy(), skewed.z.to_numpy()))
    assert M.auc(df.withColumn("z", -F.col("z"))).first().auc == pytest.approx(1 - whole)


def test_mid_ranks(spark, skewed):
    got = M.mid_ranks(spark.createDataFrame(skewed)).toPandas().set_index("z")["rank"]
    want = skewed.z.rank().groupby(skewed.z).first()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_lookup_join_beyond_the_limit(spark, skewed):
    df = spark.createDataFrame(skewed)
    small = df.groupBy("g").count()
    a = lookup_join(df, small, "g").groupBy("g").agg(F.sum("count").alias("s")).toPandas().sort_values("g").reset_index(drop=True)
    b = lookup_join(df, small, "g", max_bytes=2).groupBy("g").agg(F.sum("count").alias("s")).toPandas().sort_values("g").reset_index(drop=True)
    assert a.equals(b)


def test_folds_are_balanced_partitions(spark, skewed):
    got = K.stratified_folds(spark.createDataFrame(skewed), ["g", "y"], 5, 3).toPandas()
    assert len(got) == len(skewed) and got.uid.is_unique
    sizes = got.groupby(["g", "y", "fold"]).size().unstack(fill_value=0)
    assert ((sizes.max(axis=1) - sizes.min(axis=1)) <= 1).all()


def test_group_folds_keep_families_together(spark, skewed):
    got = K.group_folds(spark.createDataFrame(skewed), 4, 3, "g").toPandas()
    assert (got.groupby("g").fold.nunique() == 1).all() and got.fold.nunique() > 1


def test_group_folds_do_not_depend_on_the_ranking_path(spark, skewed):
    df = spark.createDataFrame(skewed.assign(fam=(skewed.uid.astype(int) // 7).astype(str)))
    a = K.group_folds(df, 4, 3, "fam").select("uid", "fold")
    b = K.group_folds(df, 4, 3, "fam", window_rows=0).select("uid", "fold")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == len(skewed)


def test_merge_rare_counts(spark, skewed):
    k = 60
    got = K.merge_rare(spark.createDataFrame(skewed), k, "g").toPandas().set_index("uid")
    size = skewed.groupby("g").uid.transform("count")
    key = np.where(size >= 2 * k, skewed.g, "rare") + "_" + skewed.y.astype(str)
    n = pd.Series(key).map(pd.Series(key).value_counts())
    want = np.where(n >= k, key, "rare_" + skewed.y.astype(str))
    assert (got.stratum.loc[skewed.uid] == want).all()


def test_bootstrap_moments(spark, skewed):
    d = spark.createDataFrame(skewed.assign(d=skewed.z)[["uid", "d"]])
    row = M.paired_bootstrap(d, 400).first()
    assert row.mean_d == pytest.approx(skewed.z.mean(), abs=0.005)
    assert row.sd_d == pytest.approx(skewed.z.std() / np.sqrt(len(skewed)), rel=0.15)


def test_samples_and_flips_are_the_smallest_hashes(spark):
    """Below and above the bound that puts rows aside."""
    import hashlib

    from voxeval.operators import calibration as C
    from voxeval.operators.folds import sample_k

    ids = [str(i) for i in range(1500)]
    df = spark.createDataFrame([(i, float(k % 7), k % 2) for k, i in enumerate(ids)], "uid string, z double, y int")
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}-s".encode()).hexdigest(), i))
    for k in (1, 30, 700, 1500, 2000):
        assert sorted(r["uid"] for r in sample_k(df, k, "s").collect()) == sorted(order[:k])
    for ks in ((1, 5), (3, 1400)):
        got = C.flip_sets(df, {"odd": F.col("y") == 1}, ks, 2).select("rep", "k", "uid").collect()
        for rep in range(2):
            want = sorted(ids[1::2], key=lambda i: (hashlib.md5(f"{i}-odd-{rep}".encode()).hexdigest(), i))
            for k in ks:
                assert sorted(r["uid"] for r in got if (r["rep"], r["k"]) == (rep, k)) == sorted(want[:k])
