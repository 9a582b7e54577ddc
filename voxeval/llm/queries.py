"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, hard_negatives, language_id, mixing, ngram_join, personal_data, phrases, substring_dedup, suffix_dedup, toxicity, url_filter
from .base import query, residue, table

SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_url_filter", url_filter.sql("quality = 0 OR toxic = 1", SITE_RULES))
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and labels share their numbering: a page is bad if its label says low quality or toxic."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf, "pages"), labels, SITE_RULES)


@query("op2_mixing", mixing.SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.words_taken(table(spark, sf, "documents").select("doc_id", "text", "source"))


@query("op7_exact_dedup", EXACT_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.coded(table(spark, sf, "documents").select("doc_id", "text"), vocabulary())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op10_ngram_join", ngram_join.SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf, "documents")).select("doc_id", "copy_id", "class_id", "n_links")


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels").select("doc_id", "toxic"), residue(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (residue(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "hits")


@query("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, residue(5) != 0)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (residue(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op4_personal_data")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.find(table(spark, sf, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(personal_data.KINDS)]
    every = "array_sort(concat(base, added))"
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(personal_data.span_text("base")), 256).alias("base_sha256"), F.expr(personal_data.span_text(every)).alias("spans")
    )


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf, "documents"))
    words = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    spans = F.expr("array_join(transform(spans, x -> concat(x.start, ':', x.end)), ',')")
    passages = F.expr("array_join(transform(passages, x -> concat(x.start, ':', x.end, ':', x.group)), ',')")
    return found.select(
        "doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("repeated_words"), spans.alias("spans"), passages.alias("passages"), "partners", "copies"
    )


@query("op8_fingerprints")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf, "documents"))


@query("op11_phrases", phrases.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"))


@query("op12_hard_negatives", hard_negatives.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op13_substring_dedup")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
