"""Removal of repeated windows against a plain dictionary of windows, and the index against slices."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import SCHEMA, empty, odd, odd_rows, passage, rows
from pyspark.sql import functions as F

from voxeval.llm import substring_dedup as sd
from voxeval.llm.fm_index import FMIndex, sorted_suffixes


def plain(items, size=20):
    """(doc_id, n_words, n_removed, sha, kept) per row, in the order of ids (nulls last, then as given)."""
    seen, out = set(), []
    for i in sorted(range(len(items)), key=lambda k: (items[k][0] is None, items[k][0] or 0, k)):
        words = re.findall(r"[^\x20\x09-\x0D]+", items[i][1] or "")
        gone = [False] * len(words)
        for a in range(len(words) - size + 1):
            w = tuple(words[a : a + size])
            if w in seen:
                gone[a : a + size] = [True] * size
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((items[i][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, size=20):
    return sorted(rows(sd.repeated(docs, size).select("doc_id", "n_words", "n_removed", "kept_sha256")), key=str)


def woven(seed, n=120, vocab=40, size=60):
    """Texts of a few words that share passages of every length, repeat themselves and hold runs of one word."""
    r = random.Random(seed)
    pool = [[f"w{r.randrange(vocab)}" for _ in range(r.randrange(5, size))] for _ in range(12)]
    items = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(6)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            words += p[a : a + r.randrange(1, size)] if r.random() < 0.7 else [f"w{r.randrange(vocab)}" for _ in range(r.randrange(30))]
        if r.random() < 0.2:
            words += ["again"] * r.randrange(70)
        items.append((r.choice([i, i, 7, None]) if i % 10 == 0 else r.randrange(10_000), " ".join(words)))
    return items


def table(spark, items):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in items], SCHEMA).coalesce(1)


@pytest.mark.parametrize("seed,size,shard,key", [(1, 20, 1 << 18, 1 << 16), (2, 20, 200, 100), (3, 8, 500, 60), (4, 5, 100, 1 << 16)])
def test_against_plain_windows(spark, monkeypatch, seed, size, shard, key):
    """Also with several shards, and with keys whose stretches are cut into windows."""
    monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    monkeypatch.setattr(sd, "KEY_WORDS", key)
    items = woven(seed)
    assert result(table(spark, items), size) == plain(items, size)


def test_odd_rows(spark):
    items = [(r[0], r[1]) for r in odd_rows()] + [(30, "again " * 3000), (31, "one two " * 700), (32, passage(40, 20_000) + " " + passage(40, 20_000))]
    assert result(table(spark, items)) == plain(items)


def test_edges_of_long_stretches(spark, monkeypatch):
    monkeypatch.setattr(sd, "PLACE_BITS", 6)
    monkeypatch.setattr(sd, "STRETCH", 10)
    items = woven(9, 60) + [(50, "a b c " * 100), (51, "x " * 200 + passage(3, 50) + " x" * 200)]
    assert result(table(spark, items)) == plain(items)


def test_common_passage_and_trimmed_texts(spark):
    common = passage(77, 40)
    items = [(i, f"{passage(1000 + i, 25)} {common} {passage(2000 + i, 25)}") for i in range(300)]
    docs = table(spark, items).withColumn("spans", F.lit("?")).withColumn("node", F.lit(1)).withColumn("_file", F.lit("?"))
    assert result(docs) == plain(items)
    got = sd.trimmed(docs)
    assert got.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["spans"]) for r in got.collect()}
    assert text[0] == (items[0][1], "?") and all(text[i] == (f"{passage(1000 + i, 25)} {passage(2000 + i, 25)}", "?") for i in range(1, 300))


def test_empty_tables(spark):
    for wide in (False, True):
        assert sd.repeated(empty(spark, wide)).count() == 0
        assert sd.trimmed(empty(spark, wide)).columns == empty(spark, wide).columns
    assert sorted(sd.trimmed(odd(spark, wide=True)).columns) == sorted(odd(spark, wide=True).columns)


def test_index_against_slices():
    r = np.random.default_rng(3)
    for symbols, n in ((2, 300), (5, 500), (90, 800)):
        text = r.integers(1, symbols + 1, n)
        text[r.random(n) < 0.03] = 0
        text[-1] = 0
        index = FMIndex(text, 7)
        length, low, high = index.statistics(text)
        runs = {}
        for k in range(1, 8):
            for a in range(n - k + 1):
                if 0 not in text[a : a + k]:
                    runs.setdefault(tuple(text[a : a + k]), []).append(a)
        for e in range(n):
            want = max((k for k in range(1, 8) if e - k + 1 >= 0 and len(runs.get(tuple(text[e - k + 1 : e + 1]), [])) > 1), default=0)
            assert length[e] == want
            if want == 7:
                assert sorted(index.places[low[e] : high[e]]) == runs[tuple(text[e - 6 : e + 1])]
        full = np.flatnonzero(length == 7)
        assert [int(x) for x in index.earliest(low[full], high[full])] == [runs[tuple(text[e - 6 : e + 1])][0] for e in full]


def test_suffixes_are_sorted_to_their_depth():
    text = np.array([2, 1, 2, 1, 2, 1, 0])
    order = sorted_suffixes(text, 8).tolist()
    assert order == sorted(range(7), key=lambda i: text[i:].tolist())
