"""Collocations against a plain count of every n-gram."""

import random
import re
from collections import Counter

import pytest
from helpers import SCHEMA, empty, odd, rows
from pyspark.sql import functions as F

from voxeval.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(items, longest, least, inside=50, best=2000):
    count, n = Counter(), Counter()
    for text, lang in items:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                count.update((lang or "und", *w[i : i + m]) for i in range(len(w) - m + 1))
    cands = {k: a for k, a in count.items() if len(k) > 2 and a >= least}
    out = []
    for lang in n:
        kept = []
        for key, a in cands.items():
            if key[0] != lang:
                continue
            w = key[1:]
            longer = [b for o, b in cands.items() if o[0] == lang and len(o) > len(key) and any(o[i : i + len(w)] == w for i in range(1, len(o)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (count[(lang, *w[:k])] * count[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(w).encode(), count[(lang, *w[:k])], count[(lang, *w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some_items(seed, size=160):
    r = random.Random(seed)
    vocab = ["red", "Red", "sun", "set", "über", "日本", "a", "b's", "x-y", "\U0001f642"]
    return [("".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(40)), r.choice(["en", "de", None])) for _ in range(size)]


@pytest.mark.parametrize("longest,least,best", [(3, 10, 2000), (4, 6, 25), (2, 10, 2000)])
def test_against_a_plain_count(spark, longest, least, best):
    items = some_items(longest)
    docs = spark.createDataFrame(items, "text string, lang string")
    got = phrases.collocations(docs, longest, least, best=best)
    assert sorted(rows(got)) == plain(items, longest, least, best=best)


def test_odd_rows_and_other_columns(spark):
    items = [(t, lang) for _, t, lang, _, _ in [tuple(r) for r in odd(spark).collect()]]
    docs = odd(spark, wide=True).select("*", F.lit("?").alias("phrase"), F.lit(1).alias("f"), F.lit(2).alias("w"), F.lit(2).alias("w1"))
    small = [(t, lang) for t, lang in items if len(t or "") < 100_000]  # the plain version compares all candidates
    got = phrases.collocations(docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 100_000), 3, 2)
    assert sorted(rows(got)) == plain(small, 3, 2)
    assert phrases.collocations(docs, 3, 2).columns == got.columns


def test_frequent_parts_and_no_room_to_send_them(spark, monkeypatch):
    items = [("the cat the dog the cow " * 30, "en"), (" ".join(f"the w{i % 50}" for i in range(1000)), "en")]
    docs = spark.createDataFrame(items, "text string, lang string")
    want = plain(items, 3, 10)
    assert sorted(rows(phrases.collocations(docs))) == want
    monkeypatch.setattr(phrases, "HEAVY_BYTES", 0)
    assert sorted(rows(phrases.collocations(docs))) == want


def test_large_counts_are_exact(spark):
    a, left, right = 123_456_789_012_345, 987_654_321_987_654, 123_456_789_012_399
    got = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


def test_empty_tables(spark):
    assert phrases.collocations(empty(spark)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None)] * 12, SCHEMA)).count() == 0
