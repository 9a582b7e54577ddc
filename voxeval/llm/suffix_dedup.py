"""Repeated passages by content-chosen places and the 50-word runs around them.

A passage is repeated if another document has the same run of ``MIN_WORDS`` words. Of the ``SPAN`` windows of ``WINDOW`` words
in such a run, the one with the smallest hash is its place: equal runs have the same place, whatever stands around. Places
whose window only one document has are left out after a count per hash. Of the others every run is one row (two 64-bit
hashes of its 50 words), and equal rows of two documents or more are found by one aggregate. So each occurrence of each
repeated run is found, however often a document or its neighbours hold parts of it, and no pair of documents is a row.

Runs that the same documents hold form a group. Its id is the exclusive or of the documents' hashes: two documents share
a passage if, and only if, a group id stands in both of them. Equal texts are one node from the start: copies have their
whole text repeated, as a group of their own.

There is no suffix array: sorted suffixes bring only the nearest ones together, and a common ending hides the others. Texts
are not compared again; unequal runs would have to agree in both hashes.

A word is a run between ASCII white space. Defined cases: a null text and one of fewer than 50 words has no passage; repeated
rows are copies of each other; a passage that only its own document repeats is not reported; an empty table has an empty
result; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage, unstage

from .base import WORD, files_only, full_text, located, portions

MIN_WORDS = 50
WINDOW = 16
SPAN = MIN_WORDS - WINDOW + 1
FIND = re.compile(WORD).findall


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def rolled(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Polynomial hash of the ``size`` words from each word on, by doubling; ``h`` holds at least ``size`` words."""
    out, done, width = None, 0, 1
    while size:
        power = np.uint64(factor)
        if size & 1:
            out = h if out is None else out[: len(h) - done] * power + h[done:]
            done += width
        size >>= 1
        if size:
            h = h[:-width] * power + h[width:]
            width, factor = 2 * width, factor * factor % (1 << 64)
    return out


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of MIN_WORDS words of a text (by the words' hashes) its place, and per word the hash of the window there."""
    total = rolled(h, WINDOW, 0x9E3779B97F4A7C15)
    total = total ^ (total >> np.uint64(31))
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(total, SPAN)
    return views.argmin(axis=1) + np.arange(len(views)), total


PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "word", "window")])


def sampled(nodes: DataFrame) -> DataFrame:
    """node, word, window of the chosen places, from (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = FIND(text or "")
                if len(words) >= MIN_WORDS:
                    at, window = places(word_hashes(words, known))
                    at = np.unique(at)
                    cols = [np.full(len(at), node, np.int64), at.astype(np.int64), window[at].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=PLACE.names)

    return nodes.select("node", "text").mapInArrow(run, PLACE)


RUN = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("node", "mark", "start", "one", "two")], T.StructField("first", T.BooleanType()),
])


def runs_at(texts: DataFrame) -> DataFrame:
    """node, mark, start, one, two (hashes of the run) and first (not met before in its text), per run whose place is one of
    ``words``, from (node, mark, text, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in portions(batches, 32):
            for node, mark, text, kept in zip(*(b.column(i).to_pylist() for i in range(4))):
                h = word_hashes(FIND(text), known)
                start = np.flatnonzero(np.isin(places(h)[0], np.array(kept)))
                one = rolled(h, MIN_WORDS, 0x9E3779B97F4A7C15)[start]
                two = rolled((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), MIN_WORDS, 0xA0761D6478BD642F)[start]
                first = np.zeros(len(start), bool)
                first[np.unique(np.stack([one, two]), axis=1, return_index=True)[1]] = True
                ids = [np.full(len(start), x, np.int64) for x in (node, mark)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, start.astype(np.int64), one.view(np.int64), two.view(np.int64), first)], names=RUN.names)

    return texts.select("node", "mark", "text", "words").mapInArrow(run, RUN)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of start, end in words), passages (array of start, end, group), partners and copies of the documents
    with repeated passages.

    Two documents share a passage if a ``group`` stands in the passages of both. ``partners`` are examples: per group the
    first and last of its texts that are not the document's own, and one copy of the whole text.
    """
    docs = files_only(docs, ["doc_id", "text"])
    sha = F.sha2(full_text(), 256)
    rows = stage(located(docs).select("doc_id", "_file", "_row", sha.alias("sha"), F.regexp_count(full_text(), F.lit(WORD)).cast("long").alias("n_words")).filter(F.col("n_words") >= MIN_WORDS))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    grouped = rows.groupBy("sha").agg(F.min(place).alias("rep"), F.max(place).alias("far"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    nodes = stage(grouped.select("sha", "rep", "far", "copies", "n_words", F.monotonically_increasing_id().alias("node"), F.xxhash64("sha").alias("mark")))
    where = nodes.select("node", "mark", F.col("rep._file").alias("_f"), F.col("rep._row").alias("_r"))
    text = located(docs).select("_file", "_row", full_text().alias("text"))
    held = stage(where.join(text, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))).select("node", "mark", "text"))

    chosen = stage(sampled(held))
    common = chosen.groupBy("window").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("window")
    kept = chosen.join(common, "window").groupBy("node").agg(F.array_sort(F.collect_set("word")).alias("words"))
    runs = stage(runs_at(held.join(kept, "node")))
    unstage(held)
    unstage(chosen)
    once = F.when(F.col("first"), F.col("mark")).otherwise(F.lit(0).cast("long"))
    shared = stage(runs.groupBy("one", "two").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.bit_xor(once).alias("group")).filter("a < z"))
    found = runs.join(shared, ["one", "two"]).select("node", "start", "group")

    # runs of a group that follow each other join to one passage; what a node holds is bounded by its own length
    isle = F.col("start") - F.row_number().over(Window.partitionBy("node", "group").orderBy("start"))
    joined = found.repartition("node").withColumn("isle", isle).groupBy("node", "group", "isle").agg(F.min("start").alias("start"), (F.max("start") + MIN_WORDS).alias("end"))
    passages = stage(joined.select("node", "start", "end", "group"))
    unstage(runs)

    # overlapping passages of a node join to one span
    by_node = passages.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "end", "group"))).alias("passages"))
    by_node = by_node.withColumn("spans", F.expr("transform(passages, p -> named_struct('start', p.start, 'end', p.end))"))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).end >= s.start,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))""")
    by_node = by_node.select("node", merged.alias("spans"), "passages")
    ends = shared.select("group", F.explode(F.array("a", "z")).alias("other")).distinct()
    ends = stage(ends.join(nodes.select(F.col("node").alias("other"), F.col("rep.doc_id").alias("partner")), "other"))
    partners = passages.select("node", "group").distinct().join(ends, "group").filter("other <> node").groupBy("node").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    marked = nodes.join(by_node, "node", "left").join(partners, "node", "left").filter("copies > 1 or spans is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("mark").alias("group")))
    none = F.array().cast("array<struct<start: bigint, end: bigint, group: bigint>>")
    marked = marked.select(
        F.col("sha").alias("_sha"), F.col("rep.doc_id").alias("rep_id"), F.col("far.doc_id").alias("far_id"), "copies", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
        F.concat(F.coalesce("passages", none), F.when(F.col("copies") > 1, every).otherwise(none)).alias("passages"),
        F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"),
    )
    twin = F.when(F.col("doc_id").eqNullSafe(F.col("rep_id")), F.col("far_id")).otherwise(F.col("rep_id"))
    own = F.when(F.col("copies") > 1, F.array(twin)).otherwise(F.array().cast("array<bigint>"))
    out = rows.select("doc_id", "sha").join(marked, F.col("sha") == F.col("_sha"))
    return out.select("doc_id", "spans", "passages", F.array_sort(F.array_distinct(F.concat("partners", own))).alias("partners"), "copies")
