"""Removal of repeated passages by an FM-index per shard.

A window is ``size`` consecutive words of a document; it is removed if its words also start earlier, in a document with a smaller
doc_id or further up in the same one. Words that a removed window covers go, the others stay.

Windows are dealt to shards by content: the smallest hash among the runs of ``GRAM`` words inside a window is its key, so
equal windows have equal keys, and neighbouring windows with one key travel as one stretch. A stretch whose key no other
has is unlike any other and stays where it is. Of the rest, equal stretches collapse to their earliest by an aggregate, so a
passage that many documents share is one stretch. What is left goes to its shard, is indexed there in the order of the documents,
and the stretches are streamed through the index: backward search over its wavelet tree gives the matching statistics of every
place, and where they reach ``size`` the earliest place of the match. A shard holds about ``SHARD_WORDS`` words. A key
with too many different stretches for that has them cut into single windows, which collapse again and are dealt out by
their whole content.

Keys that hold one in ``HEAVY`` of all stretches are looked up by broadcast, so none gathers in one task. Cost grows with the words;
no document meets another, and no pair of documents is a row.

Words are runs between ASCII white space, unchanged. Defined cases: a null text has no words; a null doc_id comes after all others;
rows with the same doc_id (repeated rows too) come in the order of the table's files; documents of fewer than ``size`` words stay
whole; an empty table has an empty result; other columns are passed by, or kept by ``trimmed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.plans.bounded import lookup_join
from voxeval.session import stage, unstage

from .base import WORD, files_only, full_text, located, portions, split_join
from .fm_index import END, FMIndex

#: Words of the runs whose hashes choose the shard of a window.
GRAM = 6
#: Windows of a stretch at most.
STRETCH = 256
#: Words of a shard, and the words of one key from which its stretches are cut into windows.
SHARD_WORDS, KEY_WORDS = 1 << 18, 1 << 16
#: A key with one in HEAVY of all stretches or more is looked up by broadcast: there are 2 * HEAVY of them at most.
HEAVY = 1000
#: Low bits of a run's hash that tell its place apart from the places near it.
PLACE_BITS = 14


class Hashes(dict):
    """64-bit hashes of words; those of short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


def least_of(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    more = span - width
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def stretches(words: list[bytes], size: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """start, windows, key and whether the key's run stands in it more than once, of each stretch of a document."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    gram = min(GRAM, size)
    run = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        run *= np.uint64(0x9E3779B97F4A7C15)
        run += h[k : len(h) - gram + 1 + k]
    run ^= run >> np.uint64(31)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(29)
    low = np.uint64((1 << PLACE_BITS) - 1)
    at = np.arange(len(run), dtype=np.uint64) & low
    least = least_of((run & ~low) | at, size - gram + 1)
    key = least >> np.uint64(PLACE_BITS)
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    windows = np.diff(np.append(start, len(key)))
    if windows.max() > STRETCH:
        parts = -(-windows // STRETCH)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = np.repeat(start, parts) + nth * STRETCH, np.repeat(start + windows, parts)
        windows = np.minimum(end - start, STRETCH)
    last = start + windows - 1
    # places are counted up to 2^PLACE_BITS; a stretch across that edge goes to the index in any case
    again = (least[start] != least[last]) | ((start >> PLACE_BITS) != ((last + size) >> PLACE_BITS))
    return start, windows, key[start].astype(np.int64), again


CUT = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("sha", T.StringType()),
    T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.ShortType())), T.StructField("key", T.ArrayType(T.LongType())),
    T.StructField("digest", T.ArrayType(T.LongType())), T.StructField("again", T.ArrayType(T.BooleanType())),
])


def cut_documents(texts: DataFrame, size: int) -> DataFrame:
    """Number of words, digest of the words and the stretches of every document, from (node, doc_id, _file, _row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in portions(batches, 512):
            n_words, sha, cols, counts = [], [], [], [0]
            for text in b.column(4).cast(pa.binary()).to_pylist():
                words = text.split()
                body = b" ".join(words)
                n_words.append(len(words))
                sha.append(hashlib.sha256(body).hexdigest())
                if len(words) < size:
                    counts.append(0)
                    continue
                start, windows, key, again = stretches(words, size, hashes)
                ends = np.zeros(len(words) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=ends[1:])
                spans = zip(ends[start].tolist(), (ends[start + windows + size - 1] - 1).tolist())
                digest = np.fromiter((xxhash.xxh3_64_intdigest(body[a:z]) for a, z in spans), np.uint64, len(start)).view(np.int64)
                cols.append((start.astype(np.int32), windows.astype(np.int16), key, digest, again))
                counts.append(len(start))
            offsets = pa.array(np.cumsum(counts), pa.int32())
            kinds = (np.int32, np.int16, np.int64, np.int64, bool)
            parts = [np.concatenate([c[i] for c in cols]) if cols else np.zeros(0, k) for i, k in enumerate(kinds)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(p)) for p in parts]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), *lists], names=CUT.names)

    return texts.select("node", "doc_id", "_file", "_row", "text").mapInArrow(run, CUT)


PIECE = "single boolean, shard_key long, digest long, none boolean, doc_id long, node long, start int, body binary"


def lists(col: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """Offsets of a list column, and the fields of its structs as flat arrays."""
    flat = col.flatten()
    return (col.offsets.to_numpy() - col.offsets[0].as_py(), *[flat.field(f).to_numpy(zero_copy_only=False) for f in fields])


def pieces_of(held: DataFrame, size: int) -> DataFrame:
    """The words of the stretches that go to a shard, from (node, none, doc_id, text, sent); of those marked ``single``, window by window."""
    names = PIECE.replace(",", "").split()[::2]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 64):
            edge, start, windows, single, key = lists(b.column(4), "start", "windows", "single", "key")
            owner, rows = [], [[] for _ in range(5)]
            for i, text in enumerate(b.column(3).cast(pa.binary()).to_pylist()):
                at = slice(edge[i], edge[i + 1])
                if at.start == at.stop:
                    continue
                words = text.split()
                for a, n, alone, k in zip(start[at].tolist(), windows[at].tolist(), single[at].tolist(), key[at].tolist()):
                    if not alone:
                        made = [(False, k, 0, a, b" ".join(words[a : a + n + size - 1]))]
                    else:
                        made = []
                        for j in range(a, a + n):
                            body = b" ".join(words[j : j + size])
                            both = np.frombuffer(xxhash.xxh3_128_digest(body), np.int64)
                            made.append((True, int(both[0]), int(both[1]), j, body))
                    owner += [i] * len(made)
                    for col, values in zip(rows, zip(*made)):
                        col += values
            if owner:
                place = [b.column(c).take(pa.array(owner)) for c in (1, 2, 0)]
                cols = [*rows[:3], *place, *rows[3:]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return held.select("node", "none", "doc_id", "text", "sent").mapInArrow(run, PIECE)


class Numbers(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self) + 1
        return self[word]


def first_windows(bodies: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that start nowhere earlier, by an index over all pieces in this order: piece, first window and number of windows."""
    numbers = Numbers({b"\xff": END})  # 255 is in no text
    words = b" \xff ".join([*bodies, b""]).split(b" ")[:-1]
    text = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    index = FMIndex(text, size)
    place = np.arange(len(text)) - size + 1  # where the window starts that ends at a place
    first = text != END
    piece = np.cumsum(~first) - ~first
    opening = np.concatenate([[0], np.flatnonzero(~first)[:-1] + 1])
    first &= place >= opening[piece]
    length, low, high = index.statistics(text)
    full = np.flatnonzero(length >= size)
    first[full] &= index.earliest(low[full], high[full]) == place[full]
    at = np.flatnonzero(first)
    cut = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    start = at[cut]
    return piece[start], place[start] - opening[piece[start]], np.diff(np.append(cut, len(at)))


FIRSTS = "node long, start int, windows int"


def firsts_of(sent: DataFrame, size: int, shards: int) -> DataFrame:
    """node, start, windows: the runs of first windows in the stretches that were sent to the shards."""
    shard = F.pmod(F.xxhash64("shard_key"), F.lit(shards)).alias("shard")
    dealt = sent.select(shard, "none", "doc_id", "node", "start", "body").repartition(shards, "shard").sortWithinPartitions("shard", "none", "doc_id", "node", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(held: list[tuple]) -> pa.RecordBatch:
            node, start = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            piece, at, windows = first_windows([body for h in held for body in h[2]], size)
            cols = [pa.array(node[piece], pa.int64()), pa.array(start[piece] + at, pa.int32()), pa.array(windows, pa.int32())]
            return pa.RecordBatch.from_arrays(cols, names=["node", "start", "windows"])

        shard, held = None, []
        for b in batches:
            shards = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                if shards[a] != shard and held:
                    yield result(held)
                    held = []
                shard = shards[a]
                held.append((b.column(3).slice(a, z - a).to_numpy(), b.column(4).slice(a, z - a).to_numpy(), b.column(5).slice(a, z - a).to_pylist()))
        if held:
            yield result(held)

    return dealt.mapInArrow(run, FIRSTS)


RESULT = "node long, spans array<struct<start: long, end: long>>, n_removed long, kept_sha256 string"


def covered(start: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places some runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows, -1)
    return np.cumsum(edge[:-1]) > 0


def removed_from(held: DataFrame, size: int) -> DataFrame:
    """node, spans, n_removed, kept_sha256 from (node, n_words, text, marks, firsts): all marked windows but the first ones go.

    Documents that keep all their words have no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 64):
            nodes, removed, sha, edges, bounds = [], [], [], [0], []
            at, start, windows = lists(b.column(3), "start", "windows")
            at_first, first, n_first = lists(b.column(4), "start", "windows")
            bodies = b.column(2).cast(pa.binary())
            for i, (node, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                marks, firsts = slice(at[i], at[i + 1]), slice(at_first[i], at_first[i + 1])
                gone = covered(start[marks], windows[marks], n) & ~covered(first[firsts], n_first[firsts], n)
                gone = np.flatnonzero(gone)
                if not len(gone):
                    continue
                kept = ~covered(gone, np.int64(size), n)
                turns = np.flatnonzero(np.diff(kept, prepend=True, append=True))
                nodes.append(node), removed.append(int(n - kept.sum())), bounds.append(turns)
                edges.append(edges[-1] + len(turns) // 2)
                sha.append(hashlib.sha256(b" ".join(compress(bodies[i].as_py().split(), kept.tolist()))).hexdigest())
            if nodes:
                flat = np.concatenate(bounds).reshape(-1, 2)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), spans, pa.array(removed), pa.array(sha)], names=["node", "spans", "n_removed", "kept_sha256"])

    return held.select("node", "n_words", "text", "marks", "firsts").mapInArrow(run, RESULT)


def repeated(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, _file, _row, n_words, spans (of words to remove: start, end), n_removed, kept_sha256 (of the other words, joined by a blank) per row."""
    docs = files_only(docs, ["doc_id", "text"])
    texts = located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "_file", "_row", full_text().alias("text"))
    cut = stage(cut_documents(texts.withColumn("node", F.monotonically_increasing_id()), size))  # a row's number is fixed here
    rows = stage(cut.select("node", "doc_id", "_file", "_row", "n_words", "sha"))
    order = [F.col("doc_id").isNull().alias("none"), "doc_id", "node"]
    every = cut.select(*order, F.expr("inline(arrays_zip(start, windows, key, digest, again))"))

    # keys that several stretches have, or one in several places
    shared = stage(every.groupBy("key").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).filter("n > 1"))
    total = cut.agg(F.sum(F.size("start"))).first()[0] or 0
    marked = stage(split_join(every, shared.select("key", (F.col("n") * HEAVY >= total).alias("heavy")), "key").drop("again", "heavy"))
    unstage(cut)
    place = F.struct("none", "doc_id", "node", "start")
    sent = stage(marked.groupBy("key", "digest").agg(F.min(place).alias("at"), F.max("windows").alias("windows")).select("key", "at.node", "at.start", "windows"))
    words = (F.col("windows") + size - 1).cast("long")
    large = stage(sent.groupBy("key").agg(F.sum(words).alias("words")).filter(F.col("words") >= KEY_WORDS).select("key", F.lit(True).alias("single")))
    shards = max(1, -(-(sent.agg(F.sum(words)).first()[0] or 0) // SHARD_WORDS))

    one = F.coalesce("single", F.lit(False)).alias("single")
    asked = lookup_join(sent, large, "key", "left").select("node", "start", "windows", one, "key", F.lit(True).alias("sent"))
    known = marked.select("node", "start", "windows", F.lit(False).alias("single"), "key", F.lit(False).alias("sent"))
    some = [F.collect_list(F.when(F.col("sent"), F.struct("start", "windows", "single", "key"))).alias("sent"), F.collect_list(F.when(~F.col("sent"), F.struct("start", "windows"))).alias("marks")]
    where = rows.select(*order, "n_words", F.col("_file").alias("_f"), F.col("_row").alias("_r")).join(asked.unionByName(known).groupBy("node").agg(*some), "node")
    body = texts.select("_file", "_row", "text")
    held = stage(body.join(where, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))).select("node", "none", "doc_id", "n_words", "text", "sent", "marks"))
    unstage(marked)

    pieces = pieces_of(held, size)
    if not large.isEmpty():
        pieces = stage(pieces)
        alone = pieces.filter("single").groupBy("shard_key", "digest").agg(F.min(place).alias("at"), F.first("body").alias("body"))
        pieces = pieces.filter("not single").drop("single", "digest").unionByName(alone.select("shard_key", "at.*", "body"))
    empty = F.array().cast("array<struct<start: int, windows: int>>")
    firsts = firsts_of(pieces, size, shards).groupBy("node").agg(F.collect_list(F.struct("start", "windows")).alias("firsts"))
    found = removed_from(held.join(firsts, "node", "left").withColumn("firsts", F.coalesce("firsts", empty)), size)
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return rows.join(found, "node", "left").select(
        "doc_id", "_file", "_row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def trimmed(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` with its columns; texts that lose words become their other words, joined by a blank."""
    docs = files_only(docs)
    spans = repeated(docs, size).filter("n_removed > 0").select("_file", "_row", F.col("spans").alias("_spans"))
    file, row = F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row")
    placed = docs.select(F.struct(*docs.columns).alias("_doc"), file, row)
    both = placed.join(spans, (F.col("_at_file") == F.col("_file")) & (F.col("_at_row") == F.col("_row")), "left")
    text = full_text("_doc.text")
    kept = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w, i: ~F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    text = F.when(F.col("_spans").isNull(), F.col("_doc.text")).otherwise(F.array_join(kept, " "))
    return both.select(*[text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
