"""Checks before a table leaves: submission, identity, assets, weights, leaks, coverage (Q1-Q8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxeval.operators.joins import parity


def check_submission(sub: DataFrame, fmt: DataFrame, p: str = "is_pathologic") -> DataFrame:
    """One row of violation counts: missing, extra, out of order, out of range, null (Q1)."""
    s = sub.select("uid", F.col("pos").alias("_ps"), F.col(p).alias("_v"), F.lit(1).alias("_s"))
    f = fmt.select("uid", F.col("pos").alias("_pf"), F.lit(1).alias("_f"))
    j = f.join(s, "uid", "full_outer")
    v = F.col("_v")
    both = F.col("_s").isNotNull() & F.col("_f").isNotNull()
    return j.agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_s").isNull()).alias("missing"),
        F.count_if(F.col("_f").isNull()).alias("extra"),
        F.count_if(both & (F.col("_ps") != F.col("_pf"))).alias("out_of_order"),
        F.count_if(F.col("_s").isNotNull() & (v.isNull() | F.isnan(v))).alias("nulls"),
        F.count_if(v.isNotNull() & ~v.between(0.0, 1.0)).alias("out_of_range"),
    )


def submission_difference(sub: DataFrame, fmt: DataFrame) -> DataFrame:
    """Requested but absent and present but not requested ids, as sets (Q1)."""
    a, b = fmt.select("uid"), sub.select("uid")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def check_identical(a: DataFrame, b: DataFrame, value: str, key: str = "uid") -> DataFrame:
    """Whether two result tables agree exactly, as after a retry (Q2)."""
    got = parity(a, b, value, key)
    return got.select("n", "max_abs", (F.col("max_abs") == 0).alias("identical"))


def missing_assets(checkpoints: DataFrame, inventory: DataFrame) -> DataFrame:
    """Configured files that are absent (Q3)."""
    return checkpoints.join(inventory.select("file"), "file", "left_anti")


def check_weights(weights: DataFrame, by: Sequence[str] = ("family",), split: str = "split") -> DataFrame:
    """Sum, count and equality within each split (Q4)."""
    per = weights.groupBy(*by, split).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), (F.max("weight") - F.min("weight")).alias("spread")
    )
    return per.groupBy(*by).agg(
        F.sum("n").alias("files"), F.sum("w").alias("total"), F.max("spread").alias("spread"),
        (F.abs(F.sum("w") - 1.0) < 1e-9).alias("sums_to_one"),
    )


def leak_check(scores: DataFrame, folds: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Scores from a checkpoint that trained on the scored row (Q5).

    A row is honest only if, in the checkpoint's own split, the row's fold is the one held out.
    """
    c = checkpoints.select("file", F.col("split").alias("_split"), F.col("fold").alias("_held"))
    f = folds.select("uid", F.col("split").alias("_split"), F.col("fold").alias("_own"))
    j = scores.select("uid", "file").join(F.broadcast(c) if _few(c) else c, "file").join(f, ["uid", "_split"])
    return j.where(F.col("_held") != F.col("_own")).groupBy("file").agg(F.count(F.lit(1)).alias("leaks"))


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    return df.count() <= rows


def coverage_report(scans: DataFrame, ok: str = "ok", note: str = "loc_note") -> DataFrame:
    """Rows per status and fallback note (Q6)."""
    return scans.groupBy(ok, note).agg(F.count(F.lit(1)).alias("n"))


def topn_grid(results: DataFrame, n: int = 8, loss: str = "loss", ties: Sequence[str] = ()) -> DataFrame:
    """The n smallest losses, ties by parameters (Q8); a distributed take-ordered."""
    return results.orderBy(loss, *ties).limit(n)
