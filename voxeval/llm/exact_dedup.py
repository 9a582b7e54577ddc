"""Exact deduplication by a stateful stream.

A stateful streaming aggregate keeps, per digest of the normalised text, the stable identifier of the row that stays, the
locator of its content (file and row) and the number of rows seen. The state lives on disk (RocksDB), is keyed by the
digest and never expires; batches pre-aggregate before they meet it, so a text that a third of all rows share costs one
state update per task. The state is read back as a table, and every hit (a row whose digest another row holds) has its
full bytes compared with the text at the locator. Rows that differ in spite of equal digests are grouped by their whole text.

Defined cases: a null text is the empty text; equal texts with equal ``doc_id`` (repeated rows) are separate rows of one
group, of which the one with the larger locator stays; a null ``doc_id`` is smaller than any other; an empty table has an
empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxeval.session import fresh_path, stage

from .base import ascii_lower, files_only, full_text, located, without

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition holds megabytes of empty file
}
#: Rows of a group that one task compares with one copy of the text that stays.
ROWS_PER_COMPARISON = 256


def digests(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """doc_id, sha (of the normalised text), digest (its first ``digest_chars`` hex digits) and the row's place."""
    sha = F.sha2(ascii_lower(full_text()), 256)
    return located(docs).select("doc_id", sha.alias("sha"), F.substring(sha, 1, digest_chars).alias("digest"), "_file", "_row")


def ingest(spark: SparkSession, rows: DataFrame, checkpoint: str) -> None:
    """Add a stream of ``digests`` rows to the state below ``checkpoint``; a restart goes on where the last run ended."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        first = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_file", "_row")
        state = rows.groupBy("digest").agg(F.max(first).alias("keep"), F.count(F.lit(1)).alias("n"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep (doc_id, _file, _row) and n of every digest that the state holds."""
    kept = spark.read.format("statestore").load(checkpoint)
    keep, n = (F.col("value").getField(f) for f in kept.schema["value"].dataType.names)
    return kept.select(
        F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["_file"].alias("keep_file"), keep["_row"].alias("keep_row"), n.alias("n")
    )


def _is_keeper() -> Column:
    return (F.col("_file") == F.col("keep_file")) & (F.col("_row") == F.col("keep_row"))


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    text = located(docs).select(F.col("_file").alias("_f"), F.col("_row").alias("_r"), ascii_lower(full_text()).alias("body"))
    return rows.join(text, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))).drop("_f", "_r")


def differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of which a row's bytes differ from those of the row that stays.

    Each hit is compared with one of ceil(n / ROWS_PER_COMPARISON) copies of that text, so large groups are spread.
    """
    parts = F.ceil(F.col("n") / F.lit(ROWS_PER_COMPARISON)).cast("long")
    texts = _with_text(docs, members.filter("n > 1").withColumn("parts", parts))
    keepers = texts.filter(_is_keeper()).select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("body").alias("keep_body"))
    hits = texts.filter(~_is_keeper()).select("digest", F.pmod(F.xxhash64("_file", "_row"), "parts").alias("part"), "body")
    return hits.join(keepers, ["digest", "part"]).filter(F.col("body") != F.col("keep_body")).select("digest").distinct()


def exact_groups(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, _file, _row, sha, keep_id, keep_file, keep_row, n.

    ``keep_*`` names the row with the largest doc_id among those of equal text, ``n`` their number. ``digest_chars`` is for
    tests of colliding digests.
    """
    spark = docs.sparkSession
    docs = files_only(docs, ["doc_id", "text"])
    slim = stage(digests(docs, digest_chars))
    source = slim.inputFiles()
    checkpoint = fresh_path(spark, "dedup-state")
    if not source:
        return slim.select("doc_id", "_file", "_row", "sha", F.col("doc_id").alias("keep_id"), F.col("_file").alias("keep_file"), F.col("_row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    ingest(spark, spark.readStream.schema(slim.schema).parquet(source[0].rpartition("/")[0]), checkpoint)
    members = slim.join(read_state(spark, checkpoint), "digest")
    odd = stage(differing(docs, members))
    out = ["doc_id", "_file", "_row", "sha", "keep_id", "keep_file", "keep_row", "n"]
    if odd.isEmpty():
        return members.select(*out)
    again = _with_text(docs, slim.join(odd, "digest", "left_semi"))
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_file", "_row"))
    groups = again.groupBy("digest", "body").agg(first.alias("k"), F.count(F.lit(1)).alias("n"))
    groups = groups.select("digest", "body", F.col("k.doc_id").alias("keep_id"), F.col("k._file").alias("keep_file"), F.col("k._row").alias("keep_row"), "n")
    return members.join(odd, "digest", "left_anti").select(*out).unionByName(again.join(groups, ["digest", "body"]).select(*out))


def verdicts(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    g = exact_groups(docs, digest_chars)
    return g.select("doc_id", "keep_id", F.col("n").alias("group_size"), _is_keeper().alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    docs = files_only(docs)
    return without(docs, exact_groups(docs).filter(~_is_keeper()).select("_file", "_row"))
