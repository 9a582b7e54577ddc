"""Mixing sources to target weights.

Word counts are summed per source (partial sums first, so a source with a third of all rows costs one row per task). The
budget is shared by weight; a source whose share would pass its ceiling keeps the ceiling and the rest is shared again.
That has a closed form: with sources ordered by ceiling / weight, all up to some place sit at their ceiling and the others
get one common level times their weight. Only the table of sources is ordered, never documents. A document is then
emitted floor(rate) times, and once more if a hash of seed and doc_id falls below the fraction.

Defined cases: a null or empty text has size 0 and is emitted like any other row of its source; a null source is a source
of its own, ordered last; a source of size 0 has target 0 and rate 0; repeated rows are separate documents with one draw;
an empty table has an empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxeval.session import stage

from .base import WORD, full_text, uniform

WEIGHTS = (3, 1, 2)
BROADCAST_BYTES = 16 << 20


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """_source, source_size, weight, target, rate from a table (_source, _size).

    Weights go to the sources in code point order, null last, and repeat. ``share`` times all words are dealt out, at most
    ``ceiling`` times its own words to a source.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # one row per source
    place = F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last()))
    weighted = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1))
    weighted = weighted.withColumn("_cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    below = every.orderBy("_ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    run = weighted.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("_all"),
        F.coalesce(F.sum("_cap").over(below), F.lit(0.0)).alias("_caps"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))).alias("_free"),
    )
    run = run.withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_free"))
    # the first source, in this order, that the level does not lift above its ceiling
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    run = run.withColumn("target", target)
    return run.select("_source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def repetitions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` as the struct ``doc`` with size, source_size, target, rate and copies."""
    size = F.regexp_count(full_text(), F.lit(WORD)).cast("long")
    targets = stage(source_targets(docs.select(F.col("source").alias("_source"), size.alias("_size")), weights, share, ceiling))
    # one short row per source: broadcast within a bound on its bytes, else a shuffle join whose large keys Spark splits
    held = targets.agg(F.sum(F.coalesce(F.octet_length(F.col("_source").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    targets = targets.withColumnRenamed("_source", "_by")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), size.alias("size"), F.col("source").alias("_source"))
    joined = rows.join(F.broadcast(targets) if held <= BROADCAST_BYTES else targets, F.col("_source").eqNullSafe(F.col("_by")), "left")
    whole = F.floor("rate")
    extra = (uniform(seed, F.col("doc.doc_id")) < F.col("rate") - whole).cast("long")
    return joined.select("doc", "size", "source_size", "target", "rate", (whole + extra).alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    taken = repetitions(docs, weights, share, ceiling, seed).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc.*")


def words_taken(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return repetitions(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2e0 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
k AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level FROM r
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM k WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * weight) END AS target FROM k),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate FROM d JOIN t
  ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (SELECT *, (floor(rate) +
  (('0x' || substr(md5('mix-' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496e0 < rate - floor(rate))::INTEGER)::BIGINT AS copies FROM c)
"""
