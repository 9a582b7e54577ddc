"""Joins by key, never by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxeval.plans.bounded import lookup_join

__all__ = [
    "attach_labels", "align_runs", "zonal_join", "mirror_mean", "mirror_difference", "box_join", "best_of",
    "argbest_candidate", "parity", "retry_set", "merge_retries",
]


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "uid", strict: bool = True) -> DataFrame:
    """Rows with their label; any row without one is an error."""
    if strict:
        gap = df.join(labels, key, "left_anti").limit(1).count()
        if gap:
            raise ValueError("rows without a label")
    return df.join(labels, key)


def align_runs(a: DataFrame, b: DataFrame, key: str = "uid", fold: str = "fold") -> DataFrame:
    """One row of mismatch counts between two runs."""
    l = a.select(key, F.col(fold).alias("_fa"), F.lit(1).alias("_a"))
    r = b.select(key, F.col(fold).alias("_fb"), F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    j = l.join(r, key, "full_outer")
    return j.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(both & (F.col("_fa") != F.col("_fb"))).alias("fold_differs"),
    )


def zonal_join(voxels: DataFrame, zones: DataFrame) -> DataFrame:
    """Voxels with their zone code; the atlas is bounded by the grid."""
    return lookup_join(voxels, zones, ["z", "y", "x"])


def mirror_mean(voxels: DataFrame, width: int, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Average of a volume and its left/right mirror, without a join.

    A voxel and its mirror share the folded coordinate, so one aggregate yields both.
    """
    half = F.least(F.col("x"), F.lit(width - 1) - F.col("x"))
    folded = voxels.groupBy(*keys, "z", "y", half.alias("h")).agg(F.avg("v").alias("v"))
    sides = F.array_distinct(F.array(F.col("h"), F.lit(width - 1) - F.col("h")))
    return folded.select(*keys, "z", "y", F.explode(sides).alias("x"), "v")


def mirror_difference(voxels: DataFrame, width: int, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """v(x) - v(mirror x) for the first half."""
    half = F.least(F.col("x"), F.lit(width - 1) - F.col("x"))
    first = F.col("x") <= F.lit(width - 1) - F.col("x")
    g = voxels.groupBy(*keys, "z", "y", half.alias("x"))
    a = F.max(F.when(first, F.col("v")))
    b = F.max(F.when(F.lit(width - 1) - F.col("x") <= F.col("x"), F.col("v")))
    return g.agg((a - b).alias("d"))


def box_join(voxels: DataFrame, peaks: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int],
             keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Voxels inside [peak + lo, peak + hi] of their own entity: equi join plus range predicate."""
    p = peaks.select(*keys, *[F.col(c).alias(f"p{c}") for c in ("z", "y", "x")])
    j = voxels.join(p, list(keys))
    inside = F.lit(True)
    for c, a, b in zip(("z", "y", "x"), lo, hi):
        inside = inside & F.col(c).between(F.col(f"p{c}") + a, F.col(f"p{c}") + b)
    return j.where(inside)


def best_of(current: DataFrame, alt: DataFrame, score: str, key: str = "uid") -> DataFrame:
    """The alternative only where it is strictly better."""
    a = alt.select(key, *[F.col(c).alias(f"_{c}") for c in current.columns if c != key])
    better = F.col(f"_{score}") > F.col(score)
    cols = [F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c != key]
    return current.join(a, key, "left").select(key, *cols, F.coalesce(better, F.lit(False)).alias("replaced"))


def argbest_candidate(cands: DataFrame, score: str, order: str, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Best scoring candidate per key, the earliest on ties.

    One aggregate that keeps a single candidate per key and task before the exchange. A candidate is a struct, which has no
    fixed-width buffer, so tasks sort by key; a maximum joined back would exchange the candidates twice instead.
    """
    rank = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))
    cols = [c for c in cands.columns if c not in keys]
    return cands.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("_b")).select(*keys, "_b.*")


def parity(a: DataFrame, b: DataFrame, value: str, key: str = "uid") -> DataFrame:
    """Count, mean and largest absolute difference by key."""
    d = F.abs(F.col("_a") - F.col("_b"))
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"))


def retry_set(done: DataFrame, key: str = "uid", ok: str = "ok") -> DataFrame:
    """Keys to process again."""
    return done.where(F.coalesce(F.col(ok), F.lit(0)) != 1).select(key)


def merge_retries(done: DataFrame, again: DataFrame, key: str = "uid", ok: str = "ok") -> DataFrame:
    """Successes kept, failures replaced by their second attempt where there is one."""
    good = done.where(F.col(ok) == 1)
    failed = done.where(F.coalesce(F.col(ok), F.lit(0)) != 1)
    second = again.join(failed.select(key), key, "left_semi").select(*done.columns)
    still = failed.join(again.select(key), key, "left_anti").select(*done.columns)
    return good.unionByName(second).unionByName(still)
