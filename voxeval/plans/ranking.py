"""Exact ranks, prefix sums and quantiles over groups that may hold any share of the rows.

A window over a whole group would sort that group in one task. Here a group is cut into
ordered buckets; windows run inside one bucket, and over the short table of bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.functions.scalars import hash_hex
from voxeval.plans.bounded import lookup_join
from voxeval.session import stage


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_rank(df: DataFrame, keys: Sequence[str], seed_parts: Sequence, uid: str = "uid",
              name: str = "rank") -> DataFrame:
    """1-based position within ``keys`` in the order md5(uid-seed), ties by uid.

    The hash is uniform, so its leading hex digits are an ordered split into even buckets,
    however large one key is.
    """
    digits = 2 if _partitions(df) <= 64 else 3 if _partitions(df) <= 1024 else 4
    keys = list(keys)
    rows = df.withColumn("_h", hash_hex(F.col(uid), *seed_parts)).withColumn("_b", F.substring("_h", 1, digits))
    totals = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = stage(totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", uid))
    ranked = lookup_join(rows.withColumn("_r", inside), offsets, [*keys, "_b"])
    return ranked.withColumn(name, F.col("_off") + F.col("_r")).drop("_h", "_b", "_r", "_off")


def _with_bucket(df: DataFrame, value: str, n: int) -> DataFrame:
    """Adds ``_b``, the number of ``_bounds`` (sorted, fewer than ``n``) below the value, by halving: log2(n) comparisons a row.

    One column a step, not a lambda: compiled code reads the bounds where they lie, a lambda would have them copied to every row.
    """
    out = df.withColumn("_b", F.lit(0))
    for k in reversed(range((n - 1).bit_length())):
        step = F.lit(1 << k)
        below = F.coalesce(F.get("_bounds", F.col("_b") + step - 1) < F.col(value), F.lit(False))
        out = out.withColumn("_b", F.when(below, F.col("_b") + step).otherwise(F.col("_b")))
    return out


#: Bounds that a row is compared with at most. A task then sorts 1 / BUCKETS of a group's distinct values; that takes memory of
#: its own (Spark spills a window's sort), it loses nothing.
BUCKETS = 4096


def value_buckets(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``_b``, an ordered bucket of ``value`` within ``keys``; equal values share one.

    Bounds are approximate quantiles, so buckets are even; correctness does not depend on them.
    """
    n = max(8, min(BUCKETS, _partitions(df)))
    probs = [i / n for i in range(1, n)]
    keys = list(keys)
    agg = F.expr(f"percentile_approx(`{value}`, array({','.join(map(str, probs))}), {20 * n})").alias("_bounds")
    bounds = df.groupBy(*keys).agg(F.array_distinct(agg).alias("_bounds"))
    if keys:
        return _with_bucket(lookup_join(df, stage(bounds), keys), value, n).select(*df.columns, "_b")
    cuts = bounds.first()["_bounds"] or []  # fewer than BUCKETS numbers
    literal = F.array(*[F.lit(float(q)) for q in cuts]) if cuts else F.array().cast("array<double>")
    return _with_bucket(df.withColumn("_bounds", literal), value, n).select(*df.columns, "_b")


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with the given sums: a hot tied value becomes one row."""
    return df.groupBy(*keys, value).agg(*[F.sum(e).alias(k) for k, e in sums.items()])


def prefix_sums(hist: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str]) -> DataFrame:
    """For each distinct value: ``<c>_before`` (sum over smaller values) and ``<c>_all`` of every column."""
    keys = list(keys)
    rows = value_buckets(hist, keys, value)
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    part = rows
    for c in cols:
        part = part.withColumn(f"_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    over = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy(*keys)
    offs = (
        rows.groupBy(*keys, "_b")
        .agg(*[F.sum(c).alias(f"_t{c}") for c in cols])
        .select(
            *keys, "_b",
            *[F.coalesce(F.sum(f"_t{c}").over(over), F.lit(0)).alias(f"_o{c}") for c in cols],
            *[F.sum(f"_t{c}").over(total).alias(f"{c}_all") for c in cols],
        )
    )
    out = lookup_join(part, stage(offs), [*keys, "_b"])
    return out.select(
        *hist.columns,
        *[(F.col(f"_{c}") + F.col(f"_o{c}")).alias(f"{c}_before") for c in cols],
        *[f"{c}_all" for c in cols],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size: columns ``q0, q1, ...`` per key."""
    keys = list(keys)
    hist = distinct_counts(df.where(F.col(value).isNotNull()), keys, value, {"_n": F.lit(1)})
    ranked = prefix_sums(stage(hist), keys, value, ["_n"])
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n_all") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo{i}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi{i}"),
            F.max(pos - lo).alias(f"_w{i}"),
        ]
    got = ranked.groupBy(*keys).agg(*aggs)
    outs = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
            for i in range(len(probs))]
    return got.select(*keys, *outs)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "_r") -> DataFrame:
    """First ``k`` rows per key; Spark limits each task to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
