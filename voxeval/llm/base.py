"""Registry and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxeval.plans.bounded import held_bytes
from voxeval.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word is a run of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is DuckDB text with the same rows."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def full_text(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def uniform(seed: str, *cols: Column) -> Column:
    """A hashed number in [0, 1): the first 52 bits of md5 over the seed and the columns, equal in other engines."""
    text = F.concat_ws("-", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def residue(n: int) -> Column:
    """The fold of a document: crc32 of its doc_id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def portions(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in portions: what a task makes of a text takes several times the memory of the text."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row, ``_file`` and ``_row``; a frame that is not read from files is staged first.

    The place tells repeated rows apart and stays the same when a task is run again.
    """
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return stage(docs).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (read from files) without the rows at the places ``gone`` (_file, _row); its columns may have any names."""
    file, row = F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row")
    placed = docs.select(F.struct(*docs.columns).alias("_doc"), file, row)
    return placed.join(gone, (F.col("_at_file") == F.col("_file")) & (F.col("_at_row") == F.col("_row")), "left_anti").select("_doc.*")


def split_join(big: DataFrame, small: DataFrame, on: list[str] | str, max_bytes: int = 8 << 20) -> DataFrame:
    """Inner join whose frequent keys, marked ``heavy`` in ``small`` (staged, a row a key), are broadcast; the others are shuffled.

    The caller marks keys by their share of all rows, which bounds their number; their bytes are checked too.
    """
    heavy = small.filter("heavy")
    if held_bytes(heavy) > max_bytes:
        return big.join(small, on)
    keys = [on] if isinstance(on, str) else on
    light = big.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(small.filter("not heavy"), keys)
    return big.join(F.broadcast(heavy), keys).unionByName(light)


def files_only(docs: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``docs`` (or some of its columns) as read from files, so that every pass finds the same row at the same place."""
    docs = docs.select(*cols) if cols else docs
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return stage(docs)
    return docs
