"""Views over the given tables that the registered queries read; everything is derived by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxeval.functions.scalars import family_key, uniform
from voxeval.operators.folds import stratified_folds
from voxeval.plans.bounded import with_grid
from voxeval.sources.tables import read_table

RUNS = ({"run": "a", "split": 2026, "k": 5}, {"run": "b", "split": 7, "k": 5}, {"run": "c", "split": 2026, "k": 10})
SLOPES = {"cnn1": 2.0, "cnn2": 1.8, "gbm": 1.5, "lr": 1.2}
SEEDS = (0, 1, 2)
GRID4 = (4, 4, 4)
PLANE8 = (1, 8, 8)
STACK16 = (16, 8, 8)
CUBE16 = (16, 16, 16)
STORED = (56, 80, 80)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: label, signal, spacing family and acquisition group."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    x = (F.col("o_totalprice") - 250000.0) / 144000.0
    zoom = F.lit(1.5) + F.lit(0.1) * F.col("c_nationkey")
    uid = F.col("o_orderkey").cast("string")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        uid.alias("uid"), x.alias("x"), zoom.alias("zoom"), family_key(zoom).alias("zfam"),
        F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("grp"),
        F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderkey").alias("pos"),
    )
    return j.withColumn("y", F.when(F.col("x") + (uniform(F.col("uid"), "y") - 0.5) * 2.0 > 0, 1).otherwise(0))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("pos") % 3
    s = subjects(spark, sf)
    return s.select(
        "uid", "pos", "y", F.when(uniform(F.col("uid"), "ok") < 0.01, 0).otherwise(1).alias("ok"),
        F.col("zoom").alias("zoom_x"), F.col("zoom").alias("zoom_y"), (F.lit(2.0) + m * 0.5).alias("zoom_z"),
        (m * 32 + 64).cast("int").alias("shape_x"), (m * 32 + 64).cast("int").alias("shape_y"), (m * 8 + 48).cast("int").alias("shape_z"),
        F.when(uniform(F.col("uid"), "note") < 0.02, 2).otherwise(0).alias("loc_note"),
    )


def folded(spark: SparkSession, sf: str, runs: tuple = ("a", "b", "c")) -> DataFrame:
    """Subjects once per run with that run's folds."""
    rows = with_grid(subjects(spark, sf), [r for r in RUNS if r["run"] in runs])
    return stratified_folds(rows, ["run", "y"], F.col("k"), F.col("split").cast("string"))


def raw_z(run: Column, family: Column, seed: Column) -> Column:
    u = uniform(F.col("uid"), run, family, seed.cast("string"))
    return F.col("slope") * F.col("x") + (u - 0.5) * 1.5


def checkpoint_file(family: str, seed: str, fold: str) -> Column:
    return F.concat(F.col(family), F.lit("_s"), F.col(seed).cast("string"), F.lit("_f"), F.col(fold).cast("string"))


def raw_oof(spark: SparkSession, sf: str, runs: tuple = ("a", "b", "c")) -> DataFrame:
    """Held-out logits per run, family and seed."""
    rows = with_grid(folded(spark, sf, runs), [{"family": f, "slope": s, "seed": i} for f, s in SLOPES.items() for i in SEEDS])
    return rows.select(
        "uid", "y", "grp", "run", "split", "k", "fold", "family", "seed",
        checkpoint_file("family", "seed", "fold").alias("file"),
        raw_z(F.col("run"), F.col("family"), F.col("seed")).alias("z"),
    )


def _seed_mean(family: str) -> Column:
    us = [uniform(F.col("uid"), F.col("run"), F.lit(family), str(i)) for i in SEEDS]
    return (F.lit(SLOPES[family]) * F.col("x") + (sum(us[1:], us[0]) / len(us) - 0.5) * 1.5).alias(family)


def wide_inputs(spark: SparkSession, sf: str, families: tuple, run: str = "a") -> DataFrame:
    """The rows of ``wide_oof`` with some of its families and without its folds, so that nothing is ranked or drawn for the others."""
    rows = with_grid(subjects(spark, sf), [r for r in RUNS if r["run"] == run])
    return rows.select("uid", "y", "x", "zoom", *[_seed_mean(f) for f in families])


def wide_oof(spark: SparkSession, sf: str, run: str = "a") -> DataFrame:
    """One row per subject of one run with the seed mean of every family."""
    w = folded(spark, sf, (run,)).select("uid", "y", "x", "zoom", "zfam", "grp", "pos", "run", "fold", *[_seed_mean(f) for f in SLOPES])
    return w.withColumn("cnn", (F.col("cnn1") + F.col("cnn2")) / 2)


def _voxel_rows(spark: SparkSession, sf: str, uid: Column, z: Column, y: Column, x: Column) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    v = F.greatest(F.lit(0.0), F.lit(1.0) + F.col("e").cast("double") * 4.0)
    return rows.select(uid.alias("uid"), "label", z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), v.alias("v"))


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 4x4x4 volumes."""
    p = F.col("p")
    return _voxel_rows(spark, sf, F.col("vec_id"), F.floor(p / 16), F.floor(p / 4) % 4, p % 4)


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8x8 planes."""
    p = F.col("p")
    return _voxel_rows(spark, sf, F.col("vec_id"), F.lit(0), F.floor(p / 8), p % 8)


def stack16(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen consecutive planes as one volume; the last one may be short."""
    p = F.col("p")
    return _voxel_rows(spark, sf, F.floor(F.col("vec_id") / 16), F.col("vec_id") % 16, F.floor(p / 8), p % 8).drop("label")


def cube16(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty-four consecutive embeddings as one volume of 16 cells a side; the last one may be short."""
    i = F.col("vec_id") % 64 * 64 + F.col("p")
    return _voxel_rows(spark, sf, F.floor(F.col("vec_id") / 64), F.floor(i / 256), F.floor(i / 16) % 16, i % 16).drop("label")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines laid out in volumes of the stored size, 358,400 cells: three values a line, eight lines an order."""
    n = STORED[0] * STORED[1] * STORED[2]
    values = F.array(F.col("l_extendedprice").cast("double") / 1e4, F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 10 + F.col("l_tax").cast("double"))
    rows = table(spark, sf, "lineitem").select(((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 3).alias("c"), F.posexplode(values).alias("i", "v"))
    rows = rows.groupBy((F.col("c") + F.col("i")).alias("c")).agg(F.max("v").alias("v"))  # a line number may repeat within an order
    at = F.col("c") % n
    d, h, w = STORED
    return rows.select(F.floor(F.col("c") / n).alias("uid"), F.floor(at / (h * w)).cast("int").alias("z"), (F.floor(at / w) % h).cast("int").alias("y"), (at % w).cast("int").alias("x"), "v")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Three time frames with non-finite and negative values put in at hashed places."""
    rows = with_grid(voxels(spark, sf), [{"t": t} for t in range(3)])
    key = [F.col(c).cast("string") for c in ("uid", "t", "z", "y", "x")]
    u = uniform(*key, "bad")
    v = F.col("v") * (F.lit(1.0) + F.lit(0.1) * F.col("t"))
    bad = F.when(u < 0.01, F.lit(float("nan"))).when(u < 0.02, F.lit(float("inf"))).when(u < 0.05, -v - 5.0).otherwise(v)
    return rows.select("uid", "t", "z", "y", "x", bad.alias("v"))


def atlas4(spark: SparkSession, sf: str) -> DataFrame:
    """Zone codes on the 4x4x4 grid of the volumes."""
    g = voxels(spark, sf).select("z", "y", "x").distinct()
    third = F.floor(F.col("y") * 3 / 4).cast("int") + 1
    return g.select("z", "y", "x", F.when(F.col("z") == 0, 9).when(F.col("x") < 2, third).otherwise(third + 3).alias("code"))


def shifts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = uniform(F.col("event_id").cast("string"), "n")
    return e.select(F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("kind"), F.when(u >= 0.02, F.col("value")).alias("mm"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Document length features with the quality label."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    words = F.size(F.split("text", " ", -1)).cast("double")
    spare = F.when(uniform(F.col("doc_id").cast("string"), "nan") < 0.05, F.lit(float("nan"))).otherwise(F.log(words))
    return d.select(
        F.col("doc_id").cast("string").alias("uid"), F.col("quality").alias("y"), F.col("source").alias("grp"), F.col("lang").alias("zfam"),
        F.log(F.col("n_chars").cast("double")).alias("f_len"), F.log(words).alias("f_words"),
        (F.col("n_chars") / words / 10.0).alias("f_ratio"), spare.alias("f_spare"),
        (F.lit(1.5) + uniform(F.col("doc_id").cast("string"), "zoom") * 2.0).alias("zoom"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
    )
