"""Exact and near duplicates, and repeated passages, against plain versions."""

import string

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, passage, rows
from pyspark.sql import functions as F

from voxeval.llm import exact_dedup, ngram_join, suffix_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def groups_of(items):
    out = {}
    for i, t in items:
        out.setdefault((t or "").translate(LOWER), []).append(-1 if i is None else i)
    return out


def expected_exact(items):
    out = []
    for members in groups_of(items).values():
        best = max(members)
        for k, i in enumerate(sorted(members, reverse=True)):
            out.append((i, best, len(members), k == 0))
    return sorted(out)


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_groups(spark, digits):
    """Also with digests of one digit, where most hits differ in their bytes."""
    got = exact_dedup.verdicts(odd(spark), digits).select("doc_id", "keep_id", "group_size", "kept")
    got = sorted((-1 if a is None else a, -1 if b is None else b, n, k) for a, b, n, k in rows(got))
    assert got == expected_exact([(r[0], r[1]) for r in odd_rows()])


def test_exact_keeps_columns_and_one_row_of_each_text(spark):
    docs = odd(spark, wide=True)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert left.count() == len(groups_of([(r[0], r[1]) for r in odd_rows()]))


def test_state_goes_on_after_a_restart(spark, tmp_path):
    schema = "doc_id long, digest string, _file string, _row long"
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    for ids in ([1, 5], [3, 9]):
        part = spark.createDataFrame([(i, "d", "f", i) for i in ids] + [(ids[0], f"own{ids[0]}", "f", 0)], schema)
        part.write.mode("append").parquet(feed)
        exact_dedup.ingest(spark, spark.readStream.schema(schema).parquet(feed), state)
    got = {r["digest"]: (r["keep_id"], r["n"]) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {"d": (9, 4), "own1": (1, 1), "own3": (3, 1)}


def test_empty_tables(spark):
    for wide in (False, True):
        docs = empty(spark, wide)
        assert exact_dedup.verdicts(docs).count() == 0
        assert exact_dedup.deduplicated(docs).columns == docs.columns
        assert ngram_join.near_groups(docs).count() == 0
        assert ngram_join.near_deduplicated(docs).count() == 0
        assert suffix_dedup.repeats(docs).count() == 0


def shingle_set(text):
    words = [w for w in (text or "").lower().translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)])


def expected_links(items, threshold=0.8):
    sets = [shingle_set(t) for _, t in items]
    n = len(items)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in linked[i])])
            if low < label[i]:
                label[i], changed = low, True
    return linked, label


def near_texts():
    """Families of near copies around the threshold, one larger than two blocks."""
    out = []
    for family in range(6):
        base = passage(100 + family, 100).split(" ")
        for k in range(8):
            words = list(base)
            for j in range(k):
                words[(17 * j + family) % 100] = f"edit{family}x{k}x{j}"
            out.append(" ".join(words))
    big = passage(999, 150).split(" ")
    for k in range(300):
        words = list(big)
        words[k % 150] = f"big{k}"
        out.append(" ".join(words))
    return list(enumerate(out)) + [(2000 + i, passage(3000 + i, 90)) for i in range(40)]


def test_near_links_equal_brute_force(spark):
    items = near_texts()
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.near_groups(docs).collect()}
    linked, label = expected_links(items)
    for k, (i, _) in enumerate(items):
        assert got[i]["n_links"] == len(linked[k])
        assert got[i]["class_id"] == items[label[k]][0]
    assert sum(r["kept"] for r in got.values()) == len(set(label))


def test_known_links_without_a_common_band_stay(spark):
    """Versions in a chain: the next ones meet in a band, the far ones (similarity 0.52) mostly don't."""
    items = []
    for family in range(4):
        words = passage(4000 + family, 100).split(" ")
        for k in range(8):
            words[12 * k + 3] = f"version{family}x{k}"
            items.append((family * 10 + k, " ".join(words)))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_groups(spark.createDataFrame(items, "doc_id long, text string"), 0.5, target_recall=0.1).collect()}
    assert got == {i: len(x) for (i, _), x in zip(items, expected_links(items, 0.5)[0])}


def test_near_links_of_odd_rows(spark):
    items = [(r[0], r[1]) for r in odd_rows()]
    linked, label = expected_links(items)
    got = ngram_join.near_groups(odd(spark)).select("doc_id", "n_links", "kept").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got) == sorted((-1 if i is None else i, len(x)) for (i, _), x in zip(items, linked))
    assert sum(r["kept"] for r in got) == len(set(label))
    wide = odd(spark, wide=True)
    left = ngram_join.near_deduplicated(wide)
    assert left.columns == wide.columns and left.count() == len(set(label))


def test_recall_of_the_forest_at_the_threshold():
    depth = ngram_join.depth_for(0.8)
    assert ngram_join.recall(depth, 0.8) >= ngram_join.TARGET_RECALL > ngram_join.recall(depth + 1, 0.8)
    rng, sets, forest = np.random.default_rng(1), ngram_join.Shingler(1), ngram_join.Forest(depth)
    met = 0
    for k in range(300):
        words = [f"t{x}" for x in rng.choice(10**6, 190, replace=False)]
        a, b = " ".join(words[:180]), " ".join(words[:160] + words[180:])  # 160 of 190 to 200 shared: similarity 0.8 to 0.84
        met += bool((forest(sets(a)) == forest(sets(b))).any())
    assert met >= 297


def brute_repeats(items, n=50):
    """Per document, words inside a run of n words that another text has too."""
    texts = {}
    for i, t in items:
        texts.setdefault(t or "", []).append(i)
    where = {}
    for t in texts:
        words = suffix_dedup.FIND(t)
        for k in range(len(words) - n + 1):
            where.setdefault(tuple(words[k : k + n]), set()).add(t)
    out = {}
    for t, ids in texts.items():
        words = suffix_dedup.FIND(t)
        held = set()
        for k in range(len(words) - n + 1):
            if len(where[tuple(words[k : k + n])]) > 1 or len(ids) > 1:
                held.update(range(k, k + n))
        if held:
            for i in ids:
                out.setdefault(i, set()).update(held)
    return out


def spans_to_words(spans):
    return {k for s in spans for k in range(s["start"], s["end"])}


def test_repeats_equal_brute_force(spark):
    shared, short = passage(77, 64), passage(78, 49)
    items = [(i, f"{passage(200 + i, 30 + i)} {shared} {passage(400 + i, 45)}") for i in range(60)]
    items += [(100 + i, f"{passage(600 + i, 20)} {short} {passage(700 + i, 33)}") for i in range(10)]
    items += [(200, f"{passage(800, 55)} between {passage(800, 55)}")]  # repeats itself only
    items += [(300 + i, passage(900, 50)) for i in range(3)] + [(310, passage(900, 50) + " more")] + [(400, passage(7, 300))]
    items += [(500, passage(901, 50)), (501, "lead " + passage(901, 50)), (502, None), (503, "few words")]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    got = {r["doc_id"]: spans_to_words(r["spans"]) for r in suffix_dedup.repeats(docs).collect()}
    assert got == brute_repeats(items)
    partners = {r["doc_id"]: r["partners"] for r in suffix_dedup.repeats(docs).collect()}
    assert all(p and i not in p for i, p in partners.items())


def test_repeats_of_odd_rows(spark):
    items = [(-1 if r[0] is None else r[0], r[1]) for r in odd_rows()]
    docs = odd(spark, wide=True).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    got = {}
    for r in suffix_dedup.repeats(docs).collect():
        got.setdefault(r["doc_id"], set()).update(spans_to_words(r["spans"]))
    assert got == brute_repeats(items)
    assert suffix_dedup.repeats(odd(spark)).count() > 0


def common_endings():
    """Pairs that share 50 or 60 words whose last 25 or 40 stand in 200 other documents, whose next word sorts between theirs."""
    items = []
    for k in range(12):
        whole, last = (50, 25) if k % 2 else (60, 40)
        words = [f"p{k}x{i}" for i in range(whole)]
        items += [(k * 1000 + i, f"{passage(k * 31 + i, 20)} {' '.join(words)} {'az'[i]} {passage(k * 57 + i + 9, 20)}") for i in range(2)]
        items += [(k * 1000 + 10 + i, " ".join(f"q{k}y{i}z{j}" for j in range(30)) + " " + " ".join(words[-last:]) + f" r{k}y{i} " + passage(k + i, 10)) for i in range(200)]
    return items


def repeated_twice():
    """Passages that one document holds twice and another once."""
    out = []
    for k in range(40):
        words = " ".join(f"t{k}x{i}" for i in range(52))
        lead = [" ".join(f"u{k}y{i}z{j}" for j in range(15)) for i in range(4)]
        out += [(k * 10, f"{lead[0]} {words} {lead[1]} {words} {lead[2]}"), (k * 10 + 1, f"{lead[3]} {words}")]
    return out


@pytest.mark.parametrize("items", [common_endings(), repeated_twice()], ids=["common endings", "repeated twice"])
def test_every_occurrence_is_found(spark, items):
    docs = spark.createDataFrame(items, "doc_id long, text string")
    got = {r["doc_id"]: spans_to_words(r["spans"]) for r in suffix_dedup.repeats(docs).collect()}
    assert got == brute_repeats(items)


def test_groups_of_passages_give_all_links(spark):
    first, second = passage(31, 70), passage(32, 55)
    items = [(i, f"{passage(2000 + i, 25)} {first if i % 2 == 0 else ''} n{i} {second if i % 3 == 0 else ''} end{i}") for i in range(40)]
    items += [(50, passage(33, 60)), (51, passage(33, 60)), (52, "lead " + passage(33, 60)), (53, first[: len(first) - 9])]
    held = [{tuple(w[k : k + 50]) for k in range(len(w) - 49)} for w in (t.split() for _, t in items)]
    wanted = {(a[0], b[0]) for a, x in zip(items, held) for b, y in zip(items, held) if a[0] != b[0] and x & y}
    got = suffix_dedup.repeats(spark.createDataFrame(items, "doc_id long, text string")).collect()
    groups = {r["doc_id"]: {p["group"] for p in r["passages"]} for r in got}
    assert {(a, b) for a, x in groups.items() for b, y in groups.items() if a != b and x & y} == wanted
    for r in got:
        assert spans_to_words(r["passages"]) == spans_to_words(r["spans"])
