"""Folds, samples and row weights; every choice is a hash of uid and seed (K1-K8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.functions.scalars import hash_hex, hash_int, sigmoid
from voxeval.plans.bounded import lookup_join
from voxeval.plans.ranking import distinct_counts, hash_rank, prefix_sums
from voxeval.session import stage


def merge_rare(df: DataFrame, k: int, grp: str = "grp", y: str = "y", name: str = "stratum") -> DataFrame:
    """Stratum of each row: its group and label, small groups pooled (K1).

    Groups below 2k rows become ``rare``; group and label pairs below k become ``rare_y``.
    Both counts come from one (group, label) aggregate, so rows are never windowed by group.
    """
    label = F.col("_y").cast("int").cast("string")
    pairs = stage(df.groupBy(F.col(grp).alias("_g"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    sizes = pairs.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    merged = pairs.join(sizes, "_g").withColumn(
        "_key", F.concat_ws("_", F.when(F.col("_gn") >= 2 * k, F.col("_g")).otherwise(F.lit("rare")), label)
    )
    keys = merged.groupBy("_key").agg(F.sum("_n").alias("_kn"))
    table = merged.join(keys, "_key").select(
        F.col("_g").alias(grp), F.col("_y").alias(y),
        F.when(F.col("_kn") >= k, F.col("_key")).otherwise(F.concat_ws("_", F.lit("rare"), label)).alias(name),
    )
    return lookup_join(df, stage(table), [grp, y])


def stratified_folds(df: DataFrame, strata: Sequence[str], k: int, seed, uid: str = "uid", name: str = "fold") -> DataFrame:
    """Folds balanced to within one row per stratum (K2).

    Each stratum starts at a hashed fold, so that remainders do not pile up on fold 0.
    """
    ranked = hash_rank(df, strata, [seed], uid, "_rank")
    start = F.pmod(hash_int(*[F.col(s).cast("string") for s in strata], seed), F.lit(k))
    return ranked.withColumn(name, ((F.col("_rank") - 1 + start) % k).cast("int")).drop("_rank")


def _family_positions(fam: DataFrame, family: str, seed, window_rows: int) -> DataFrame:
    """Adds ``_pos``, the 0-based place of a family in its band by size, ties by hash.

    Counted families up to the limit are ranked by a window per band; more of them by a prefix
    sum over sizes and a hashed rank within a size, so that no band is sorted in one task.
    """
    if fam.count() <= window_rows:
        w = W.partitionBy("_band").orderBy("_size", hash_hex(F.col(family), seed), family)
        return fam.withColumn("_pos", F.row_number().over(w) - 1)
    sizes = stage(distinct_counts(fam, ["_band"], "_size", {"_c": F.lit(1)}))
    larger = stage(prefix_sums(sizes, ["_band"], "_size", ["_c"]).select("_band", "_size", "_c_before"))
    ranked = lookup_join(hash_rank(fam, ["_band", "_size"], [seed], family, "_rank"), larger, ["_band", "_size"])
    return ranked.withColumn("_pos", F.col("_c_before") + F.col("_rank") - 1)


def group_folds(df: DataFrame, k: int, seed, family: str = "family", y: str = "y", name: str = "fold",
                window_rows: int = 100_000) -> DataFrame:
    """Whole families held out, balanced by size and label rate (K3).

    Families are ordered by label-rate band (tenths), then size, and dealt to folds in a snake.
    """
    fam = df.groupBy(family).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(y).cast("double")).alias("_rate"))
    fam = stage(fam.select(family, F.floor(F.col("_rate") * 10).alias("_band"), (-F.col("_n")).alias("_size")))
    pos = F.col("_pos")
    lap, at = F.floor(pos / F.lit(k)), pos % k
    snake = F.when(lap % 2 == 0, at).otherwise(F.lit(k - 1) - at)
    shift = F.pmod(hash_int(F.col("_band").cast("string"), seed), F.lit(k))
    table = _family_positions(fam, family, seed, window_rows).select(family, ((snake + shift) % k).cast("int").alias(name))
    return lookup_join(df, stage(table), family)


def outer_training_rows(df: DataFrame, k: int, fold: str = "fold", name: str = "outer_fold") -> DataFrame:
    """Each row once for every outer fold that trains on it."""
    held = F.sequence(F.lit(0), F.lit(k - 1))
    outs = F.filter(held, lambda f: f != F.col(fold))
    return df.withColumn(name, F.explode(outs))


def inner_folds(df: DataFrame, outer_k: int, inner_k: int, seed_base: int, strata: Sequence[str] = ("y",),
                fold: str = "fold") -> DataFrame:
    """Second-level folds inside every outer training set, seeded by the outer fold (K4)."""
    rows = outer_training_rows(df, outer_k, fold)
    seed = (F.col("outer_fold") + seed_base).cast("string")
    return stratified_folds(rows, ["outer_fold", *strata], inner_k, seed, name="inner_fold")


def fold_balance(df: DataFrame, by: Sequence[str] = (), y: str = "y", fold: str = "fold") -> DataFrame:
    """Rows and label rate per fold, e.g. of every run (K5)."""
    return df.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))


def fold_violations(df: DataFrame, split: str, unit: str, fold: str = "fold") -> DataFrame:
    """Units (uids, or held-out families) that sit in more than one fold of a split (K5)."""
    g = df.groupBy(split, unit).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return g.groupBy(split).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("lo") != F.col("hi")).alias("violations")
    )


# Fixed values of the label-noise rule.
NOISE_GAP = 0.8
NOISE_WEIGHT = 0.3


def noise_weights(inner: DataFrame, z: str = "z", y: str = "y") -> DataFrame:
    """Down-weight training rows whose inner held-out score contradicts the label (K6)."""
    bad = F.abs(sigmoid(z) - F.col(y)) > NOISE_GAP
    return inner.withColumn("bad", bad).withColumn("w", F.when(bad, F.lit(NOISE_WEIGHT)).otherwise(F.lit(1.0)))


def noise_summary(weights: DataFrame) -> DataFrame:
    return weights.groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.avg(F.col("bad").cast("double")).alias("share")
    )


def balanced_weights(df: DataFrame, family: str, cap: float) -> DataFrame:
    """Inverse-frequency family weights n / (families * size), capped (K7)."""
    counts = stage(df.groupBy(family).agg(F.count(F.lit(1)).alias("_n")))
    tot = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("f")).first()
    w = F.least(F.lit(float(tot["n"] or 0)) / (F.col("_n") * F.lit(float(tot["f"] or 1))), F.lit(float(cap)))
    return lookup_join(df, counts.select(family, w.alias("w")), family)


def sample_k(df: DataFrame, k: int, seed, uid: str = "uid") -> DataFrame:
    """k rows without replacement, the smallest hashes (K8).

    Rows above a hash bound that leaves some 1.5 k of them are put aside at once; the others are ranked in even hash buckets, so
    k rows never meet in one task. Should the bound leave fewer than k, all rows are ranked.
    """
    h = hash_hex(F.col(uid), seed)
    share = (1.5 * k + 60) / max(1, df.count())
    near = df.where(h < f"{int(share * 16**12):012x}") if share < 1 else df
    if share < 1 and near.count() < k:
        near = df
    return hash_rank(near, [], (seed,), uid, "_rank").where(F.col("_rank") <= k).select(*df.columns)
