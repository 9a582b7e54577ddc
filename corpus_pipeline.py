"""The corpus pipeline: filter, deduplicate twice, mix, tokenise. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxeval.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from voxeval.llm.base import query, residue, table
from voxeval.llm.queries import vocabulary
from voxeval.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon comes from the labelled documents of ``sf_dir``."""
    learn = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(learn, table(spark, sf_dir, "labels").select("doc_id", "toxic"), residue(4) != 2)
    return toxicity.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 or more, connect."""
    return ngram_join.near_deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and the digest of the text that the ids decode to."""
    coded = bpe.coded(docs.select("doc_id", "source", "lang", "text"), vocabulary())
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: The lexicon fit and the merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
