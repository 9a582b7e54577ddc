"""Metrics and reports over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.functions.scalars import hash_int, row_logloss, sigmoid
from voxeval.plans.ranking import distinct_counts, exact_quantiles, prefix_sums, value_buckets
from voxeval.plans.sums import task_sums
from voxeval.session import stage


def loss_of_logit(y: str = "y", z: str = "z") -> Column:
    return row_logloss(F.col(y), sigmoid(z))


def logloss(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Row count and mean cross entropy (M1)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(row_logloss(y, p)).alias("logloss"))


def score_counts(df: DataFrame, keys: Sequence[str], y: str, z: str) -> DataFrame:
    """Positives and negatives of every distinct score, staged: tied scores collapse before anything is ordered."""
    pos = F.col(y).cast("double")
    return stage(distinct_counts(df, keys, z, {"_p": pos, "_q": F.lit(1.0) - pos}))


def _area(hist: DataFrame, keys: Sequence[str], z: str) -> DataFrame:
    """Mann-Whitney area from score counts.

    A score bucket adds its own wins plus its positives times the negatives of lower buckets,
    so only bucket totals are ordered per group.
    """
    rows = value_buckets(hist, keys, z)
    inside = W.partitionBy(*keys, "_b").orderBy(z).rowsBetween(W.unboundedPreceding, -1)
    wins = F.col("_p") * (F.coalesce(F.sum("_q").over(inside), F.lit(0.0)) + F.col("_q") / 2)
    buckets = (
        rows.withColumn("_u", wins)
        .groupBy(*keys, "_b")
        .agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    )
    below = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    lifted = buckets.withColumn("_u", F.col("_u") + F.col("_p") * F.coalesce(F.sum("_q").over(below), F.lit(0.0)))
    pairs = F.sum("_p") * F.sum("_q")
    return lifted.groupBy(*keys).agg(F.when(pairs > 0, F.sum("_u") / pairs).alias("auc"))


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """Exact area under the ROC curve with half credit for ties (M2)."""
    src, keys = _keyed(df, by)
    return _area(score_counts(src, keys, y, z), keys, z).select(*by, "auc")


def scoreboard(df: DataFrame, by: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """Count, log loss and AUC per group of logits, e.g. per run and family (M4).

    All three come from the staged score counts, so the predictions are computed once.
    """
    src, keys = _keyed(df, by)
    hist = score_counts(src, keys, y, z)
    p = sigmoid(z)
    lost = F.col("_p") * row_logloss(F.lit(1.0), p) + F.col("_q") * row_logloss(F.lit(0.0), p)
    n = F.sum(F.col("_p") + F.col("_q"))
    loss = hist.groupBy(*keys).agg(n.cast("long").alias("n"), (F.sum(lost) / n).alias("logloss"))
    return loss.join(_area(hist, keys, z), keys).select(*by, "n", "logloss", "auc")


def group_report(df: DataFrame, group: str, top: int = 12, y: str = "y", p: str = "p") -> DataFrame:
    """The largest groups with their loss (M3)."""
    return logloss(df, [group], y, p).orderBy(F.col("n").desc(), group).limit(top)


def paired_delta(base: DataFrame, cand: DataFrame, key: str = "uid", y: str = "y", p: str = "p") -> DataFrame:
    """Loss of the candidate minus loss of the base, per row (M5)."""
    j = base.select(key, F.col(y).alias("_y"), F.col(p).alias("_b")).join(cand.select(key, F.col(p).alias("_c")), key)
    return j.select(key, (row_logloss("_y", "_c") - row_logloss("_y", "_b")).alias("d"))


def _poisson_cdf(limit: int = 12) -> list[float]:
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(limit):
        total += term
        out.append(total)
        term /= k + 1
    return out


MERSENNE31 = 2147483647


def replicate_keys(b: int, seed: int = 0) -> list[tuple[int, int, int]]:
    """Two multipliers and an offset of every replicate, from a fixed integer recurrence."""
    keys, s = [], (seed * 7919 + 12345) % MERSENNE31 or 1
    for _ in range(b):
        key = []
        for _ in range(3):
            s = s * 48271 % MERSENNE31
            key.append(s)
        keys.append(tuple(key))
    return keys


@cache
def _count_table() -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of every Poisson count from 1, and the count by the upper 16 of a hash's 31 bits; 255 where a cell holds a step."""
    steps = []
    for c in _poisson_cdf():
        u = max(0, int(c * MERSENNE31) - 4)
        while u / float(MERSENNE31) < c:
            u += 1
        steps.append(u)
    steps = np.array(steps, np.int64)
    low = np.arange(1 << 16, dtype=np.int64) << 15
    first, last = (np.searchsorted(steps, e, side="right") for e in (low, low + 32767))
    return steps, np.where(first == last, first, 255).astype(np.uint8)


def bootstrap_weights(h: np.ndarray, g: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, rows x replicates, by inverse CDF of (a h + b g + c) mod 2^31-1; counts end at 12.

    ``h`` and ``g`` are independent 31-bit hashes of the row, so that rows stay apart far beyond 2^31 of them. Counts are
    pairwise independent within a replicate, which fixes mean and variance of the replicate sums. The remainder is folded from
    31-bit halves, counts are looked up.
    """
    steps, table = _count_table()
    a, b, c = keys.T
    u = np.multiply.outer(h, a)
    part = np.multiply.outer(g, b)
    part += c
    u += part
    for _ in range(2):
        np.right_shift(u, 31, out=part)
        u &= MERSENNE31
        u += part
    np.add(u, 1, out=part)
    part >>= 31
    u += part
    u &= MERSENNE31
    w = table[np.right_shift(u, 15, out=part)]
    split = np.nonzero(w == 255)
    w[split] = np.searchsorted(steps, u[split], side="right")
    return w.astype(float)


#: Rows whose counts are drawn together: their 2,000 replicates stay in a core's cache.
BOOT_ROWS = 64


def bootstrap_sums(delta: DataFrame, b: int, seed: int = 0, uid: str = "uid", d: str | Sequence[str] = "d") -> DataFrame:
    """Mean difference of every replicate, in one pass (M6): a task keeps two arrays of ``b`` sums, no replicate is a row.

    Several columns ``d`` are comparisons (``part``, from 0) whose replicates are kept apart; a row's counts are drawn once for all.
    """
    keys = np.array(replicate_keys(b, seed), np.int64)
    several, cols = not isinstance(d, str), [d] if isinstance(d, str) else list(d)
    hashes = [F.pmod(hash_int(F.col(uid), s), F.lit(MERSENNE31)).alias(n) for n, s in (("_h", str(seed)), ("_i", f"{seed}b"))]

    def partial(p: pa.RecordBatch) -> dict[int, np.ndarray]:
        h, g = (p.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        diff = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in p.columns[2:]])
        have = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in p.columns[2:]]).astype(float)
        both = np.stack([diff, have], axis=1).reshape(2 * len(cols), -1)
        sums = np.zeros((2 * len(cols), b))
        for a in range(0, len(h), BOOT_ROWS):
            at = slice(a, a + BOOT_ROWS)
            sums += both[:, at] @ bootstrap_weights(h[at], g[at], keys)
        return dict(enumerate(sums))

    rows = delta.select(*hashes, *[F.col(c).cast("double").alias(f"_d{i}") for i, c in enumerate(cols)])
    by = [F.col("at").alias("rep")] + ([F.floor(F.col("key") / 2).alias("part")] if several else [])
    total, weight = (F.sum(F.when(F.col("key") % 2 == k, F.col("v"))) for k in (0, 1))
    return task_sums(rows, partial).groupBy(*by).agg((total / weight).alias("mean_d"))


def paired_bootstrap(delta: DataFrame, b: int = 2000, seed: int = 0, uid: str = "uid", d: str = "d") -> DataFrame:
    """Share of replicates whose mean difference is below 0 (M6)."""
    reps = bootstrap_sums(delta, b, seed, uid, d)
    return reps.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg((F.col("mean_d") < 0).cast("double")).alias("share_better"),
        F.avg("mean_d").alias("mean_d"),
        F.stddev_pop("mean_d").alias("sd_d"),
    )


def model_correlation(wide: DataFrame, families: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of logit columns, in one pass (M7)."""
    pairs = list(combinations(families, 2))
    one = wide.agg(*[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def disagreement(long: DataFrame, key: str = "uid", z: str = "z") -> DataFrame:
    """Population standard deviation over family logits per row (M8)."""
    return long.groupBy(key).agg(F.stddev_pop(z).alias("sd"))


def shift_report(shifts: DataFrame, kind: str = "kind", mm: str = "mm", limit: float = 15.0) -> DataFrame:
    """Median, p90, worst and share above a limit per corruption; nulls dropped (M9)."""
    have = shifts.where(F.col(mm).isNotNull())
    q = exact_quantiles(have, [kind], mm, [0.5, 0.9])
    a = have.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.max(mm).alias("worst"),
        F.avg((F.col(mm) > F.lit(limit)).cast("double")).alias("share_above"),
    )
    return a.join(q, kind).select(kind, "n", F.col("q0").alias("median"), F.col("q1").alias("p90"), "worst", "share_above")


def rotate_centre(center: Sequence[str], shape: Sequence[int], angle_deg: float, axes: tuple[int, int]) -> list[Column]:
    """Where a centre lands after rotating the grid by an angle in a plane."""
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    mid = [(n - 1) / 2.0 for n in shape]
    d = [F.col(name) - m for name, m in zip(center, mid)]
    i, j = axes
    out = [dd + m for dd, m in zip(d, mid)]
    out[i] = d[i] * c - d[j] * s + mid[i]
    out[j] = d[i] * s + d[j] * c + mid[j]
    return out


def localization_error(got: DataFrame, expected: DataFrame, spacing: Sequence[float], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Distance in mm between found and expected centres."""
    e = expected.select(*keys, *[F.col(c).alias(f"e{c}") for c in ("cz", "cy", "cx")])
    j = got.join(e, list(keys))
    sq = sum(((F.col(c) - F.col(f"e{c}")) * s) ** 2 for c, s in zip(("cz", "cy", "cx"), spacing))
    return j.select(*keys, F.sqrt(sq).alias("mm"))


def degradation_report(df: DataFrame, kind: str = "kind", clean: str = "clean", y: str = "y", z: str = "z") -> DataFrame:
    """Scoreboard per corruption and its loss over the clean rows."""
    board = stage(scoreboard(df, [kind], y, z))
    base = board.where(F.col(kind) == clean).agg(F.max("logloss").alias("b")).first()["b"]
    return board.withColumn("delta", F.col("logloss") - F.lit(base))


def choice_counts(chosen: DataFrame, choice: str, label: str) -> DataFrame:
    """How often each candidate won, by label."""
    return chosen.groupBy(label, choice).agg(F.count(F.lit(1)).alias("n"))


def cohort_summary(df: DataFrame, feature_cols: Sequence[str], y: str = "y", group: str = "grp") -> DataFrame:
    """Rows, positive rate, groups, features."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("p"))
    return groups.agg(
        F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("pos_rate"), F.count(F.lit(1)).alias("groups")
    ).withColumn("features", F.lit(len(feature_cols)))


def mid_ranks(df: DataFrame, z: str = "z", y: str | None = None) -> DataFrame:
    """Tie-averaged rank of every distinct score of the whole table, with its positives if asked."""
    pos = F.col(y).cast("double") if y else F.lit(0.0)
    hist = stage(distinct_counts(df, [], z, {"_n": F.lit(1), "pos": pos}))
    ranked = prefix_sums(hist, [], z, ["_n"])
    return ranked.select(z, "pos", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias("rank"))
