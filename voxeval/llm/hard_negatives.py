"""Hard negatives by bounds of segment summaries.

Each vector is kept with the mean and the deviation of its segments of ``SEGMENT`` components. Within a segment of n components
the inner product of x and y is n mean(x) mean(y) plus the product of what is left of both, and that lies within
n deviation(x) deviation(y) of zero. So the summaries bound every score from both sides. Bounds of long segments come
first (their summaries are merged from the stored ones), pairs that they cannot exclude go on to segments of half the length
and so on, and what is left is scored exactly.

The anchors are a stated share of the rows, and each meets all rows: rows are dealt into ``parts`` and anchors into blocks that a
task can hold; a cell, one part with one block, is one partition, in which the rows stream past the held anchors in the
order of their ids while the best found so far tighten what bounds must reach. A row travels once per block of anchors, an
anchor once per part; no pair is a row. The best of each cell, a handful an anchor, are then ranked by a window.

Two such passes: the nearest rows of the same label, the positives; then, for the range of scores that each positive
allows, the best rows of other labels.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; components are
``floor(256 x)``; shorter vectors count as filled up with zeros; rows that share the anchor's id are not its others; an
anchor given several times counts once (its least label and vector), other repeated rows each count; equal scores go by
smaller id; an anchor without positives, and a positive without negatives, has no rows; an empty table has an empty result;
other columns are passed by. Scores are exact; one beyond 64 bits fails the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxeval.session import stage

#: Components of the shortest segments, whose summaries are stored.
SEGMENT = 8
#: Stored segments that each level of bounds joins, coarsest first.
LEVELS = (8, 2, 1)
#: Anchors that a task holds: some 100 MB at 64 components.
BLOCK = 1 << 17
#: Rows of a part at least; below that more tasks cost more than they save.
PART_ROWS = 1 << 10
#: Anchors and rows whose scores are looked at together.
TILE = (512, 1024)
PREPARED = "vec_id long, label int, x array<double>, mean array<double>, dev array<double>"


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, x (floor(256 e)) with the mean and deviation of its segments, of the rows that take part."""
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    scaled = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("double")).alias("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = padded(b.column(2), SEGMENT)
            cut = x.reshape(len(x), -1, SEGMENT)
            both = [pa.array(list(part), pa.list_(pa.float64())) for part in (cut.mean(axis=2), cut.std(axis=2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *both], names=["vec_id", "label", "x", "mean", "dev"])

    return rows.select("vec_id", "label", scaled).mapInArrow(run, PREPARED)


def padded(col: pa.Array, multiple: int, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros to a multiple of components, ``width`` at least."""
    sizes = np.diff(col.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    width = -(-max(width, 1) // multiple) * multiple
    out = np.zeros((len(col), width))
    out[np.arange(width) < sizes[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Vectors:
    """Vectors of one side of a cell, with their summaries at every level."""

    def __init__(self, batch: pa.RecordBatch):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.ids, self.labels = col["vec_id"].to_numpy(), col["label"].to_numpy()
        self.x = padded(col["x"], SEGMENT * max(LEVELS))
        mean, dev = (padded(col[n], max(LEVELS), self.x.shape[1] // SEGMENT) for n in ("mean", "dev"))
        self.levels = []
        for k in LEVELS:  # a joined segment varies within its parts and between their means
            m, v = mean.reshape(len(mean), -1, k), dev.reshape(len(dev), -1, k) ** 2
            n = math.sqrt(SEGMENT * k)
            self.levels.append((m.mean(axis=2) * n, np.sqrt(v.mean(axis=2) + m.var(axis=2)) * n))


def bounds(a: Vectors, ai: np.ndarray, y: Vectors, yi: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each score, a little wide for the rounding of the sums."""
    (am, ad), (ym, yd) = a.levels[level], y.levels[level]
    width = max(am.shape[1], ym.shape[1])
    mid = widened(am[ai], width) @ widened(ym[yi], width).T
    off = widened(ad[ai], width) @ widened(yd[yi], width).T
    off += 1e-9 * (off + np.abs(mid)) + 1e-6
    return mid - off, mid + off


def exact(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by doubles as long as 100 times a score is exact in them, else by whole numbers."""
    width = max(a.shape[1], y.shape[1])
    a, y = widened(a, width), widened(y, width)
    if 100.0 * width * np.abs(a).max(initial=0) * np.abs(y).max(initial=0) < 2.0**53:
        return a @ y.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(y).T if a.size and y.size else np.zeros((len(a), len(y)))


class Best:
    """The best ``k`` (score, id) of each slot, met in ascending order of ids: equal scores met later are worse."""

    def __init__(self, slots: int, k: int):
        self.k, self.score = k, np.full((slots, k), -math.inf)
        self.id, self.held = np.zeros((slots, k), np.int64), np.zeros(slots, np.int64)

    def least(self) -> np.ndarray:
        """What a score must exceed to enter."""
        return self.score[:, -1]

    def add(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        """Matrix of ``scores`` (slots x ids), of which those that ``fits`` marks may enter."""
        fits = fits & (scores > self.least()[slots][:, None]).astype(bool)
        if fits.sum() > 4 * self.k * len(slots) and fits.shape[1] > self.k:
            low = np.partition(np.where(fits, scores, -math.inf), -self.k, axis=1)[:, -self.k][:, None]
            ties = fits & (scores == low).astype(bool)
            fits = (fits & (scores > low).astype(bool)) | (ties & (np.cumsum(ties, axis=1) <= self.k))
        r, c = np.nonzero(fits)
        if not len(r):
            return
        touched = np.unique(r)
        old = np.repeat(touched, self.held[slots[touched]])
        at = np.concatenate([np.arange(n) for n in self.held[slots[touched]]]) if len(old) else np.zeros(0, int)
        row = np.concatenate([old, r])
        score = np.concatenate([self._scores(slots[old], at), scores[r, c]])
        ids = np.concatenate([self.id[slots[old], at], ids[c]])
        order = np.lexsort((np.arange(len(row)), -score, row))  # held ones come first among equals
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, score, ids, rank = slots[row[keep]], score[keep], ids[keep], rank[keep]
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        self.score[row, rank], self.id[row, rank] = score, ids
        np.maximum.at(self.held, row, rank + 1)

    def _scores(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.score[slots, at]

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Slot, id and score of all that are held."""
        slot = np.repeat(np.arange(len(self.held)), self.held)
        at = np.concatenate([np.arange(n) for n in self.held]) if len(slot) else np.zeros(0, int)
        return slot, self.id[slot, at], [int(s) for s in self.score[slot, at]]


class Nearest:
    """Search of a cell for the ``k`` best rows of the anchor's own label."""

    def __init__(self, anchors: pa.RecordBatch, k: int):
        self.a, self.best, self.k = Vectors(anchors), Best(anchors.num_rows, k), k

    def pairs(self, y: Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Anchors and rows that share a label."""
        for label in np.intersect1d(self.a.labels, y.labels):
            yield np.flatnonzero(self.a.labels == label), np.flatnonzero(y.labels == label)

    def fits(self, ai: np.ndarray, y: Vectors, yi: np.ndarray) -> np.ndarray:
        return self.a.ids[ai][:, None] != y.ids[yi][None, :]

    def reach(self, ai: np.ndarray, low: np.ndarray, high: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Pairs that may enter: above the k-th score that is held, or that lower bounds already promise."""
        need = self.best.least()[ai].astype(float)
        if np.isinf(need).any() and low.shape[1] > self.k:
            need = np.maximum(need, np.partition(np.where(fits, low, -math.inf), -self.k, axis=1)[:, -self.k])
        return fits & (high >= need[:, None])

    def take(self, ai: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        self.best.add(ai, ids, scores, fits)

    def result(self) -> list:
        slot, ids, score = self.best.found()
        return [self.a.ids[slot], ids, score]

    names = ("anchor_id", "id", "score")


class Ranged(Nearest):
    """Search of a cell, per positive, for the ``k`` best rows of other labels within the positive's range of scores."""

    def __init__(self, anchors: pa.RecordBatch, k: int, percent: tuple[int, int]):
        self.a, self.k, self.percent = Vectors(anchors), k, percent
        given = anchors.column("positive").to_pylist()
        slots = max(map(len, given), default=0)
        big = any(abs(p) > 1 << 46 for ps in given for p in ps)
        self.p = np.array([list(ps) + [-1] * (slots - len(ps)) for ps in given], object if big else float).reshape(len(given), slots)
        self.best = [Best(len(given), k) for _ in range(slots)]

    def pairs(self, y: Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(self.a.ids)), np.arange(len(y.ids))

    def fits(self, ai: np.ndarray, y: Vectors, yi: np.ndarray) -> np.ndarray:
        return self.a.labels[ai][:, None] != y.labels[yi][None, :]

    def reach(self, ai: np.ndarray, low: np.ndarray, high: np.ndarray, fits: np.ndarray) -> np.ndarray:
        may = np.zeros(fits.shape, bool)
        for s, best in enumerate(self.best):
            p = self.p[ai, s].astype(float) / 100
            need = np.maximum(p * self.percent[0], best.least()[ai].astype(float)) - 1e-6
            may |= (high >= need[:, None]) & (low <= (p * self.percent[1] + 1e-6)[:, None])
        return fits & may

    def take(self, ai: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        hundred = scores * 100
        for s, best in enumerate(self.best):
            p = self.p[ai, s][:, None]  # a negative positive, or none (-1), has an empty range
            best.add(ai, ids, scores, fits & (hundred >= p * self.percent[0]).astype(bool) & (hundred <= p * self.percent[1]).astype(bool))

    def result(self) -> list:
        slot, anchor, ids, score = [], [], [], []
        for s, best in enumerate(self.best):
            at, i, sc = best.found()
            slot.append(np.full(len(at), s, np.int64)), anchor.append(self.a.ids[at]), ids.append(i), score.extend(sc)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return [join(anchor), join(slot), join(ids), score]

    names = ("anchor_id", "slot", "id", "score")


def met(search: Nearest, y: Vectors, counts: list[int]) -> None:
    """All pairs of a cell's anchors and some rows: bounded level by level, then scored. ``counts``: pairs seen, pairs scored."""
    for every, rows in search.pairs(y):
        for i in range(0, len(every), TILE[0]):
            for j in range(0, len(rows), TILE[1]):
                ai, yi = every[i : i + TILE[0]], rows[j : j + TILE[1]]
                may = search.fits(ai, y, yi)
                counts[0] += int(may.sum())
                for level in range(len(LEVELS)):
                    low, high = bounds(search.a, ai, y, yi, level)
                    may = search.reach(ai, low, high, may)
                    r, c = may.any(axis=1), may.any(axis=0)
                    ai, yi, may = ai[r], yi[c], may[r][:, c]  # pairs go in rectangles: rows and anchors without any leave
                    if not may.size:
                        break
                if may.size:
                    counts[1] += int(may.sum())
                    search.take(ai, y.ids[yi], exact(search.a.x[ai], y.x[yi]), may)


def searched(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, make, schema: str) -> DataFrame:
    """Results of ``make(anchors of a cell)`` that has met all rows of the cell, for all cells of ``parts`` x ``blocks``."""
    cols = ["vec_id", "label", "x", "mean", "dev", "positive"]
    part, block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    kind = "kind"
    data = rows.withColumn("positive", F.lit(None).cast("array<long>")).withColumn(kind, F.lit(1)).withColumn("part", part)
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = anchors.withColumn(kind, F.lit(0)).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cell = (F.col("part") * blocks + F.col("block")).cast("int").alias("cell")
    both = data.select(cell, kind, *cols).unionByName(held.select(cell, kind, *cols))
    both = both.repartition(parts * blocks, "cell").sortWithinPartitions("cell", kind, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, search, waiting, counts = None, None, [], [0, 0]

        def done() -> Iterator[pa.RecordBatch]:
            if search is not None:
                arrays = [pa.array(v, pa.int64()) for v in search.result()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(search.names))

        for b in batches:
            cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, b.num_rows]):
                if end == start:
                    continue
                piece = b.slice(start, end - start)
                if cells[start] != cell:
                    yield from done()
                    cell, search, waiting = cells[start], None, []
                if kinds[start] == 0:
                    waiting.append(piece)
                elif waiting or search is not None:  # rows of a cell without anchors have nothing to meet
                    if search is None:
                        search, waiting = make(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]), []
                    met(search, Vectors(piece), counts)
        yield from done()

    return both.mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from (vec_id, embedding, label).

    ``anchors`` (a condition on vec_id) says which rows are anchors. Their ``positives`` are the best other rows of the same
    label; a positive's ``negatives`` are the best rows of other labels whose score lies within ``percent`` of the positive's.
    """
    rows = stage(prepared(vectors, F.col("label") if label is None else label))
    least = F.min(F.struct("label", "x", "mean", "dev")).alias("row")
    chosen = rows.filter(anchors).groupBy("vec_id").agg(least).select("vec_id", "row.*")
    n, n_anchors = rows.count(), rows.filter(anchors).select("vec_id").distinct().count()
    blocks = max(1, math.ceil(n_anchors / block))
    parts = max(1, min(math.ceil(n * blocks / max(1, n_anchors)), math.ceil(n / PART_ROWS)))  # anchors sent about as often as rows
    near = searched(rows, chosen.withColumn("positive", F.lit(None).cast("array<long>")), parts, blocks, lambda a: Nearest(a, positives), "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc("id"))
    near = near.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < positives)
    near = stage(near.select("anchor_id", F.col("slot").cast("long").alias("slot"), "id", "score"))

    scores = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("s"))
    scores = scores.select("anchor_id", F.col("s.score").alias("positive"))
    asked = chosen.join(scores, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = searched(rows, asked, parts, blocks, lambda a: Ranged(a, negatives, percent), "anchor_id long, slot long, id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    found = found.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor_id", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
