"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from voxeval.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(items, every, positives=5, negatives=3, low=50, high=95):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in items if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in ok:
        if i % every == 0 and (i not in anchors or (y, v) < anchors[i]):
            anchors[i] = (y, v)
    out = []
    for a, (label, v) in anchors.items():
        score = [(-sum(p * q for p, q in zip(v, w)), i, y) for i, w, y in ok if i != a]
        for p, pid, _ in sorted(s for s in score if s[2] == label)[:positives]:
            fits = sorted((s, i) for s, i, y in score if y != label and low * -p <= 100 * -s <= high * -p)
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def some_items(seed, n=260, dim=12, labels=3):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = [(i, [c + r.gauss(0, 0.5) for c in r.choice(centre)], r.randrange(labels)) for i in range(n)]
    out += [(900 + i, out[7][1], i % 2) for i in range(40)]  # one common vector: ties of every length
    out += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [math.nan] * dim, 1), (2003, [math.inf] * dim, 1), (None, [1.0] * dim, 1), (2004, [1.0] * dim, None)]
    out += [(2005, [], 0), (2006, [2.0, -1.0], 0), (2010, [0.0] * dim, 1), (2020, [3.0] * (dim + 3), 2), out[0], out[0], (10, out[3][1], 2)]
    return out


@pytest.mark.parametrize("seed,block,part_rows", [(1, hn.BLOCK, hn.PART_ROWS), (2, 7, 16), (3, 1, 1 << 20)])
def test_against_all_pairs(spark, monkeypatch, seed, block, part_rows):
    monkeypatch.setattr(hn, "PART_ROWS", part_rows)
    items = some_items(seed)
    vectors = spark.createDataFrame(items, SCHEMA)
    assert sorted(rows(hn.hard_negatives(vectors, F.col("vec_id") % 10 == 0, block=block))) == plain(items, 10)


def test_other_settings_and_columns(spark):
    items = some_items(4)
    vectors = spark.createDataFrame(items, SCHEMA).select("*", *[F.lit("?").alias(c) for c in ("x", "mean", "dev", "cell", "kind", "part", "block", "slot", "score", "positive")])
    got = hn.hard_negatives(vectors, F.col("vec_id") % 25 == 0, positives=2, negatives=9, percent=(10, 80))
    assert sorted(rows(got)) == plain(items, 25, 2, 9, 10, 80)


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(5)
    items = [(i, [r.choice([-1, 1]) * r.random() * 2**19 for _ in range(8)], i % 2) for i in range(60)]
    got = hn.hard_negatives(spark.createDataFrame(items, SCHEMA), F.col("vec_id") % 6 == 0)
    assert sorted(rows(got)) == plain(items, 6)


def test_empty_tables_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert hn.hard_negatives(spark.createDataFrame(some_items(6), SCHEMA), F.col("vec_id") < 0).count() == 0


def batch(x, labels, ids=None):
    cut = x.reshape(len(x), -1, hn.SEGMENT)
    cols = [pa.array(np.arange(len(x)) if ids is None else ids), pa.array(labels, pa.int32()), *[pa.array(list(m), pa.list_(pa.float64())) for m in (x, cut.mean(axis=2), cut.std(axis=2))]]
    return pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "x", "mean", "dev"])


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(40, 64)) * 60 + rng.normal(size=(40, 1)) * 80)
    v = hn.Vectors(batch(x, [0] * 40))
    every = np.arange(40)
    want, last = x @ x.T, np.inf
    for level in range(len(hn.LEVELS)):
        low, high = hn.bounds(v, every, v, every, level)
        assert (low <= want).all() and (want <= high).all()
        assert (high - low).sum() <= last * (1 + 1e-9)
        last = (high - low).sum()


def test_summaries_save_exact_scores():
    """On vectors that lie in flat groups, most pairs are excluded by their bounds alone."""
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 40, 4000))
    x = np.floor(np.repeat(rng.normal(size=(40, 8)), 8, axis=1)[group] * 300 + rng.normal(size=(4000, 64)) * 5)
    x = x[rng.permutation(4000)]
    counts = [0, 0]
    search = hn.Nearest(batch(x[:64], [0] * 64, np.arange(64)), 5)
    for a in range(0, 4000, 500):
        hn.met(search, hn.Vectors(batch(x[a : a + 500], [0] * 500, np.arange(a, a + 500))), counts)
    assert counts[0] == 64 * 4000 - 64 and counts[1] < counts[0] / 3
    got = {}
    for a, i, s in zip(*search.result()):
        got.setdefault(int(a), []).append((-s, int(i)))
    for a in range(64):
        score = x @ x[a]
        assert sorted(got[a]) == sorted((-int(score[i]), i) for i in range(4000) if i != a)[:5]
