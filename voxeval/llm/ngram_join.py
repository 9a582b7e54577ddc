"""N-gram Jaccard join by banded MinHash.

A document is its set of hashed word shingles. Documents of equal sets form one copy class, which goes on as a single
node. Bands of min-hash values propose partners: nodes that agree in all values of some band are in one bucket. The values
of a band are the most with which a pair at the threshold is met with the target recall; they are set before any row is
read, so this is no LSH forest. Nodes connected by buckets are compared exactly, each with each: a connected set is dealt
into blocks of bounded size and every pair of blocks is one unit of work, so a group of near copies of any size is spread
over tasks, each set travels once per block and no candidate pair is ever a row. Per block a task emits, for each node, the
rows it links to and a root of its linked part, so results grow with the nodes.

A word is a run between ASCII white space, lower-cased. Defined cases: a text of fewer words than a shingle has one shingle
of all its words; a null or wordless text has no shingle, no links and a class of its own; repeated rows are documents of
one copy class; an empty table has an empty result; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage

from .base import WORD, files_only, located, portions, without

SHINGLE, THRESHOLD = 5, 0.8
TREES, FULL_DEPTH, TARGET_RECALL = 32, 8, 0.999
#: Nodes of a block; a task holds two blocks.
BLOCK = 128
COLUMNS = 4096
REMEMBERED = 150_000


def recall(depth: int, similarity: float, trees: int = TREES) -> float:
    """Chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def depth_for(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, full: int = FULL_DEPTH) -> int:
    """The longest prefix with the target recall at the threshold, found by shortening the full one."""
    depth = full
    while depth > 1 and recall(depth, threshold, trees) < target:
        depth -= 1
    return depth


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.known, self.find = n, {}, re.compile(WORD).findall
        self.odd = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(n)], np.uint64)

    def _word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        found = self.find((text or "").lower())
        if not found:
            return np.zeros(0, np.uint64)
        h = np.array([self._word(w) for w in found], np.uint64)
        size = min(self.n, len(h))
        total = np.full(len(h) - size + 1, len(found) if size < self.n else 0, np.uint64)
        for i in range(size):
            total += h[i : len(h) - size + 1 + i] * self.odd[i]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        return np.unique(total)


class Forest:
    """Per tree, one 64-bit key of the signature's prefix."""

    def __init__(self, depth: int, trees: int = TREES):
        rng = np.random.default_rng(20)
        self.trees, self.depth = trees, depth
        self.mul = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, trees, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(low), 512):
            np.minimum(least, (low[a : a + 512, None] * self.mul + self.add).min(axis=0), out=least)
        key = (least.reshape(self.trees, self.depth).astype(np.uint64) * self.odd).sum(axis=1, dtype=np.uint64) + self.salt
        key ^= key >> np.uint64(32)
        return (key * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def signatures(docs: DataFrame, depth: int, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _file, _row, set_key (digest of the shingle set, null without words) and keys (one per tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, forest = Shingler(shingle), Forest(depth)
        for b in portions(batches):
            digests, keys = [], []
            for text in b.column(3).to_pylist():
                s = sets(text)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                keys.append(forest(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.string()), _lists(keys)], names=["doc_id", "_file", "_row", "set_key", "keys"])

    rows = located(docs).select("doc_id", "_file", "_row", "text")
    extra = [T.StructField("set_key", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *extra]))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) from edges (a, b); each round also jumps to the label's label."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    for _ in range(60):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("via"))
        far = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        nxt = stage(low.join(far, "via").select("node", "old", F.least("via", "far").alias("comp")))
        labels = nxt.select("node", "comp")
        if not nxt.filter("comp < old").count():
            return labels
    raise RuntimeError("components did not settle in 60 rounds")


def link_matrix(sets: list[np.ndarray], allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Which allowed pairs have Jaccard similarity of at least ``threshold``, exactly."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if (rows := np.argwhere(np.triu(allowed, 1))).shape[0] <= 2 * m:
        out = np.zeros((m, m), bool)
        for i, j in rows:
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out[i, j] = out[j, i] = same >= threshold * (size[i] + size[j] - same) - 1e-9
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    _, column = np.unique(inverse[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    same = np.zeros((m, m), np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        grid = np.zeros((m, COLUMNS), np.float32)
        grid[owner[lo:hi], column[lo:hi] - a] = 1
        same += (grid @ grid.T).astype(np.int64)
    return allowed & (same >= threshold * (size[:, None] + size[None, :] - same) - 1e-9)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")])


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key; rows come sorted by key and a key may reach over batches."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        cols = np.stack([t.column(k).to_numpy() for k in key])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1), t.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            now = tuple(cols[:, a])
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, z - a))
            last = now
    if held:
        yield pa.concat_tables(held)


def compare_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """node, links, root per node and pair of blocks, from members (comp, one, two, block, node, size, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["comp", "one", "two"]):
            t = t.combine_chunks()
            node, block, weight = (t.column(c).to_numpy() for c in ("node", "block", "size"))
            m = len(node)
            lists = t.column("shingles").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sets = [flat[a:z] for a, z in zip(ends, ends[1:])]
            apart = t.column("one")[0].as_py() != t.column("two")[0].as_py()
            allowed = block[:, None] != block[None, :] if apart else ~np.eye(m, dtype=bool)
            linked = link_matrix(sets, allowed, threshold)
            hit = linked.any(axis=1)
            if hit.any():
                out = [node, linked @ weight, node[roots(linked)]]
                yield pa.RecordBatch.from_arrays([pa.array(c[hit].astype(np.int64)) for c in out], names=RESULT.fieldNames())

    return members.mapInArrow(run, RESULT)


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, _file, _row, copy_id, class_id, n_links, kept.

    ``copy_id`` is the smallest doc_id with the same shingle set, ``class_id`` the smallest one of the group that links
    connect, ``n_links`` the number of other rows of similarity ``threshold`` or more; one row of each group is ``kept``.
    """
    docs = files_only(docs, ["doc_id", "text"])
    depth = depth_for(threshold, target_recall)
    rows = stage(signatures(docs, depth, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    grouped = rows.filter("set_key is not null").groupBy("set_key").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("keys").alias("keys"))
    nodes = stage(grouped.select("set_key", "rep", "size", "keys", F.monotonically_increasing_id().alias("node")))

    entries = nodes.select("node", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = stage(entries.join(buckets, "key").filter("node <> lead").select("node", "lead").distinct())
    # a node of many buckets hangs on the smallest lead only, and so do its other leads: about one edge a node is left
    lowest = stars.groupBy("node").agg(F.min("lead").alias("b"))
    leads = stars.join(lowest, "node").filter("lead <> b").select(F.col("lead").alias("a"), "b").distinct()
    met = components(lowest.select(F.col("node").alias("a"), "b").unionByName(leads))

    sizes = met.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("blocks"))
    wanted = nodes.join(met, "node").join(sizes, "comp").select("comp", "blocks", "node", "size", F.col("rep._file").alias("_f"), F.col("rep._row").alias("_r"))
    text = located(docs).select("_file", "_row", "text")
    texts = wanted.join(text, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))).select("comp", "blocks", "node", "size", "text")
    members = stage(with_shingles(texts, shingle)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("comp", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "size", "shingles")
    found = stage(compare_blocks(pairs.repartition("comp", "one", "two").sortWithinPartitions("comp", "one", "two"), threshold))

    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    marked = nodes.select("node", "set_key", "rep", "size").join(linked, "node", "left").join(links, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = marked.groupBy("comp").agg(F.min("rep").alias("best"))
    classes = marked.join(best, "comp").select(F.col("set_key").alias("_key"), "rep", "best", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    whole = rows.select("doc_id", "_file", "_row", "set_key").join(classes, F.col("set_key") == F.col("_key"), "left")
    alone = F.col("set_key").isNull()
    here = (F.col("best._file") == F.col("_file")) & (F.col("best._row") == F.col("_row"))
    return whole.select(
        "doc_id", "_file", "_row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links"),
        F.when(alone, F.lit(True)).otherwise(here).alias("kept"),
    )


def with_shingles(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``texts`` with the column text replaced by its shingle hashes."""
    fields = [f for f in texts.schema.fields if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(shingle)
        for b in portions(batches):
            lists = _lists([sets(t).view(np.int64) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists], names=[*names, "shingles"])

    return texts.mapInArrow(run, T.StructType([*fields, T.StructField("shingles", T.ArrayType(T.LongType()))]))


def near_deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each linked group, with the columns of ``docs``."""
    docs = files_only(docs)
    return without(docs, near_groups(docs, threshold).filter("not kept").select("_file", "_row"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b, same, x.n AS na, y.n AS nb FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 5 * same >= 4 * (x.n + y.n - same)),
r AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b),
c AS (SELECT node, min(low) AS class_id FROM r GROUP BY 1)
SELECT doc_id, least(doc_id, (SELECT min(b) FROM l WHERE a = doc_id AND same = na AND same = nb)) AS copy_id, class_id,
  (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM w JOIN c ON node = doc_id"""
