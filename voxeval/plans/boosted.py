"""Boosted trees of many fits together: shared passes over collapsed rows, histograms on the driver.

Rows of a fit that fall into the same bins and agree in their label are told apart by no tree, so each fit trains on its
distinct cells with counts; a row draw of a tree is a binomial draw of each count. Cells lie in blocks (fit, hash of the bins)
of a cached table. A pass returns the sums of one level of every fit: three passes a tree for all fits, whatever their number.
Sums are of whole numbers, so nothing depends on the order or the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxeval.session import stage, unstage

#: Gradients are multiples of 1 / UNIT; sums of whole numbers below 2^53 are exact.
UNIT = 2.0**24
#: Cells of a block, blocks of a partition, and trees after which the scores of the cells are stored anew.
CELLS, BLOCKS, KEEP = 4096, 4, 25


@dataclass
class Boosting:
    """Parameters of every fit (L6): trees by level with at most 2^depth leaves, Newton leaves with a penalty. Draws differ by a fit's place in the call."""

    trees: int = 350
    rate: float = 0.03
    depth: int = 3
    rows: float = 0.8
    columns: float = 0.6
    least: int = 15
    penalty: float = 2.0
    bins: int = 32
    seed: int = 0


@dataclass
class Boosted:
    """One fit on rows outside fold ``held`` of column ``fold`` (all rows without one), and its trees once fitted.

    A tree is a complete one: node j has the children 2j + 1 and 2j + 2, a value goes left up to the cut's bin. A node that is
    not split sends all left.
    """

    cols: Sequence[str]
    held: int | None = None
    fold: str | None = None
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    feature: np.ndarray | None = None  # trees x nodes
    cut: np.ndarray | None = None
    value: np.ndarray | None = None  # trees x leaves

    def logit(self, x: np.ndarray) -> np.ndarray:
        """The margins of rows x columns; a value that is not a number counts as 0."""
        x = np.where(np.isnan(x), 0.0, x)
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        out = np.empty(len(x))
        for a in range(0, len(x), CELLS):
            part = bins[:, a : a + CELLS]
            out[a : a + CELLS] = self.base + _added(part, self.feature, self.cut, self.value)
        return out


def _nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each cell after some levels of one tree."""
    node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(levels):
        node = 2 * node + 1 + (bins[feature[node], at] > cut[node])
    return node


def _added(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    total = np.zeros(bins.shape[1])
    for f, c, v in zip(feature, cut, value):
        total += v[_nodes(bins, f, c, int(math.log2(len(v)))) - len(c)]
    return total


def _number(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def _bin(x: str, edges: Sequence[float], lo: int = 0, hi: int | None = None) -> str:
    """How many edges are below ``x``, by halving, as SQL."""
    hi = len(edges) if hi is None else hi
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"IF({x} <= {float(edges[mid])!r}D, {_bin(x, edges, lo, mid)}, {_bin(x, edges, mid + 1, hi)})"


def _edges(data: DataFrame, fits: Sequence[Boosted], bins: int) -> None:
    """Quantiles of each column over the training rows of each fit."""
    probs = ", ".join(repr(i / bins) for i in range(1, bins))
    wanted = {(f.fold, f.held, c): None for f in fits for c in f.cols}
    rows = {k: f"`{k[2]}`" if k[1] is None else f"IF(`{k[0]}` <> {k[1]}, `{k[2]}`, NULL)" for k in wanted}
    got = data.selectExpr(*[f"percentile_approx({e}, array({probs}), 10000) AS e{i}" for i, e in enumerate(rows.values())]).first()
    for i, k in enumerate(rows):
        wanted[k] = np.unique(got[f"e{i}"] or [])
    for f in fits:
        f.edges = [wanted[f.fold, f.held, c] for c in f.cols]


def _cells(data: DataFrame, fits: Sequence[Boosted], y: str) -> DataFrame:
    """fit, bins, pos, neg: the distinct cells of every fit with their numbers of rows of either label."""
    out = None
    for i, f in enumerate(fits):
        rows = data if f.held is None else data.where(F.col(f.fold) != f.held)
        bins = "concat(" + ", ".join(f"char({_bin(f'`{c}`', e)} + 32)" for c, e in zip(f.cols, f.edges)) + ")"
        part = rows.select(F.lit(i).alias("fit"), F.expr(bins).alias("bins"), F.col(y).alias("_y")).groupBy("fit", "bins").agg(
            F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(cells: DataFrame, sizes: Sequence[int]) -> RDD:
    """The cells as arrays (fit, shard, bins, pos, neg, score); what a block holds depends on the cells only."""
    shards, parts = -(-max(sizes) // CELLS), -(-sum(sizes) // (CELLS * BLOCKS))
    rows = cells.withColumn("shard", F.pmod(F.xxhash64("bins"), F.lit(shards)).cast("int"))
    rows = rows.repartition(parts, "fit", "shard").sortWithinPartitions("fit", "shard", "bins")

    def packed(it: Iterator) -> Iterator[tuple]:
        for (fit, shard), block in groupby(it, lambda r: (r["fit"], r["shard"])):
            block = list(block)
            bins = np.array([[ord(c) - 32 for c in r["bins"]] for r in block], np.int64).T
            yield fit, shard, bins, np.array([r["pos"] for r in block]), np.array([r["neg"] for r in block]), np.zeros(len(block))

    return rows.rdd.mapPartitions(packed)


def _scored(blocks: RDD, base: np.ndarray, trees: dict | None) -> RDD:
    """Blocks with the scores of further trees added, cached."""
    def add(b: tuple) -> tuple:
        fit, bins = b[0], b[2]
        return *b[:5], b[5] + (base[fit] if trees is None else _added(bins, *(trees[k][fit] for k in ("feature", "cut", "value"))))

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _level(blocks: RDD, p: Boosting, tree: int, level: int, grown: dict, now: dict, chosen: np.ndarray) -> dict[int, np.ndarray]:
    """Sums of gradients, curvatures and rows by fit, node of this level, chosen column and bin."""
    first, width = 2**level - 1, 2**level

    def sums(it: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for fit, shard, bins, pos, neg, score in it:
            rng = np.random.default_rng([p.seed, tree, fit, shard])
            pos, neg = (rng.binomial(v, p.rows) if p.rows < 1 else v for v in (pos, neg))
            z = score + _added(bins, *(grown[k][fit] for k in ("feature", "cut", "value")))
            prob = 1.0 / (1.0 + np.exp(-z))
            up, bend, n = np.rint(prob * UNIT), np.rint(prob * (1.0 - prob) * UNIT), pos + neg
            weights = (pos * (up - UNIT) + neg * up, n * bend, n)
            node = _nodes(bins, now["feature"][fit], now["cut"][fit], level) - first
            got = np.stack([[np.bincount(node * p.bins + bins[c], w, width * p.bins) for w in weights] for c in chosen[fit]])
            total[fit] = total[fit] + got if fit in total else got
        yield from total.items()

    out: dict[int, np.ndarray] = {}
    for fit, v in blocks.mapPartitions(sums).collect():
        out[fit] = out[fit] + v if fit in out else v
    return {fit: v.reshape(len(v), 3, width, p.bins).transpose(2, 1, 0, 3) for fit, v in out.items()}


def _split(node: np.ndarray, p: Boosting) -> tuple[int, int, float, float] | None:
    """Of 3 x columns x bins sums: the column, bin and leaf values of the split that gains most, or none."""
    g, h, n = np.cumsum(node, axis=2)
    tg, th, tn = g[:, -1:], h[:, -1:], n[:, -1:]
    lam = p.penalty * UNIT
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (h + lam) + (tg - g) ** 2 / (th - h + lam) - tg**2 / (th + lam)
    gain = np.where((n >= p.least) & (tn - n >= p.least) & np.isfinite(gain), gain, 0.0)
    best = int(gain.argmax())
    if gain.flat[best] <= 1e-9 * UNIT:
        return None
    c, b = divmod(best, gain.shape[1])
    return c, b, -g[c, b] / (h[c, b] + lam), -(tg[c, 0] - g[c, b]) / (th[c, 0] - h[c, b] + lam)


def fit_boosted(df: DataFrame, fits: Sequence[Boosted], y: str = "y", params: Boosting | None = None) -> list[Boosted]:
    """Grow every fit (L6). Only histograms reach the driver: tasks x fits x nodes x columns x bins numbers a pass."""
    p = params or Boosting()
    if not 2 <= p.bins <= 128:
        raise ValueError("bins are 2 to 128, each a character")
    cols, folds = sorted({c for f in fits for c in f.cols}), sorted({f.fold for f in fits if f.fold})
    data = stage(df.select(F.col(y).cast("int").alias(y), *[F.col(c).cast("int").alias(c) for c in folds], *[_number(c).alias(c) for c in cols]))
    _edges(data, fits, p.bins)
    cells = stage(_cells(data, fits, y))
    sizes = {r["fit"]: r for r in cells.groupBy("fit").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    for i, f in enumerate(fits):
        if i not in sizes or not sizes[i]["pos"] or not sizes[i]["neg"]:
            raise ValueError(f"the fit of {list(f.cols)} without fold {f.held} lacks rows of a label")
        f.base = math.log(sizes[i]["pos"] / sizes[i]["neg"])
    inner, leaves, n = 2**p.depth - 1, 2**p.depth, len(fits)
    every = {"feature": np.zeros((n, p.trees, inner), np.int64), "cut": np.full((n, p.trees, inner), p.bins), "value": np.zeros((n, p.trees, leaves))}
    first = _blocks(cells, [r["n"] for r in sizes.values()])
    blocks, old, kept = _scored(first, np.array([f.base for f in fits]), None), None, 0
    for t in range(p.trees):
        if t - kept == KEEP:
            old, blocks = blocks, _scored(blocks, np.zeros(n), {k: v[:, kept:t] for k, v in every.items()})
            kept = t
        grown, now = {k: v[:, kept:t] for k, v in every.items()}, {k: v[:, t] for k, v in every.items()}
        draw = np.random.default_rng([p.seed, t])
        chosen = [np.sort(draw.permutation(len(f.cols))[: max(1, math.ceil(p.columns * len(f.cols)))]) for f in fits]
        open_nodes = {(i, 0) for i in range(n)}
        for level in range(p.depth):
            got = _level(blocks, p, t, level, grown, now, chosen)
            for i, j in sorted(open_nodes):
                open_nodes.remove((i, j))
                node = got[i][j - (2**level - 1)]
                best, span = _split(node, p), 2 ** (p.depth - level)
                at = (j - (2**level - 1)) * span  # the leaves below the node
                if best is None:
                    if level == 0:
                        g, h = node[0, 0].sum(), node[1, 0].sum()
                        every["value"][i, t, at : at + span] = -p.rate * g / (h + p.penalty * UNIT)
                    continue
                c, b, left, right = best
                every["feature"][i, t, j], every["cut"][i, t, j] = chosen[i][c], b
                every["value"][i, t, at : at + span // 2], every["value"][i, t, at + span // 2 : at + span] = p.rate * left, p.rate * right
                open_nodes |= {(i, 2 * j + 1), (i, 2 * j + 2)} if level + 1 < p.depth else set()
            if not open_nodes:
                break
        if old is not None:
            old.unpersist()
            old = None
    blocks.unpersist()
    for table in (cells, data):
        unstage(table)
    for i, f in enumerate(fits):
        f.feature, f.cut, f.value = every["feature"][i], every["cut"][i], every["value"][i]
    return list(fits)
