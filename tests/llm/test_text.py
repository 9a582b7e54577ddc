"""BPE, language, personal data, toxicity and fingerprints against libraries, plain versions and held-out rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, passage, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxeval.llm import bpe, fingerprints, language_id, personal_data, toxicity
from voxeval.llm.base import residue
from voxeval.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(vocabulary())
OWN = bpe.WordBpe.read(vocabulary())
NAMES = OWN.tokens()


def ids_of(text):
    return np.frombuffer(OWN.encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("abAB'stΣσ 1½.\t\x1cé́<|endoftxsarf>", max_size=60))
def test_ids_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == want
    assert " ".join(NAMES[i] for i in want) == LIBRARY.decode(want, skip_special_tokens=False)


@given(st.text("abcdeé", min_size=1, max_size=40))
def test_heap_and_scan_merge_alike(word):
    raw = word.encode()
    parts = [*(OWN.inner[b] for b in raw[:-1]), OWN.last[raw[-1]]]
    assert bpe.merge_scan(list(parts), OWN.ranks, OWN.joined) == bpe.merge_heap(list(parts), OWN.ranks, OWN.joined)


def test_bpe_of_odd_rows(spark):
    for wide in (False, True):
        docs = odd(spark, wide)
        got = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
        assert {*docs.columns} <= {*got.columns} | {"ids", "decoded"}
        for r in got.select("text", "ids", "decoded").collect():
            want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)
        assert bpe.decode(bpe.encode(empty(spark, wide), vocabulary()), vocabulary()).count() == 0
    strange = spark.createDataFrame([([5, -1, 10**6, 7],), (None,), ([],)], "ids array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(strange, vocabulary()).collect()) == sorted([f"{NAMES[5]} {NAMES[7]}", "", ""])


def test_one_pass_equals_two(spark):
    """Ids and decoded text in place of the text, other columns kept; words are forgotten when a task ends."""
    docs = odd(spark, wide=True)
    two = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).drop("text")
    one = bpe.coded(docs, vocabulary())
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.coded(empty(spark), vocabulary()).count() == 0
    coder = bpe.WordBpe.read(vocabulary())
    first = coder.encode("some words some")
    assert coder.words
    coder.forget()
    assert not coder.words and not coder.chunks and coder.encode("some words some") == first


def test_language_of_held_out_rows(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, residue(5) != 0)
    got = language_id.predict(docs.filter(residue(5) == 0).select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_tables_equal_the_network():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    e = net.embed[x]
    pooled = [(np.concatenate([e[:, i : x.shape[1] - w + 1 + i] for i in range(w)], axis=2) @ f).max(axis=1) for w, f in zip(language_id.WIDTHS, net.filters)]
    want = language_id.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.shift)
    assert np.abs(net.tables().probabilities(x) - want).max() < 1e-4


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = language_id.Network.fresh(["a", "b"], rng)
    x, y = rng.integers(0, 256, (3, 40)), np.array([0, 1, 0])
    grads, _ = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, sides = p[i], []
        for d in (1e-5, -1e-5):
            p[i] = old + d
            sides.append(net.gradients(x, y)[1])
        p[i] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - g[i]) < 1e-3 * max(1, abs(g[i]))


def test_language_of_odd_rows(spark):
    docs = odd(spark, wide=True)
    model = language_id.fit(docs)
    got = language_id.predict(docs, model)
    assert got.count() == len(odd_rows())
    unknown = {r["doc_id"] for r in got.filter("lang_pred = 'und'").collect()}
    assert unknown == {5, 6, 7, 17}
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "de", "fr", "es", "und"}
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for n, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m.group().split("."))
            if kind == "card":
                ok = 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text("ab1209.@-+_% ()\né", max_size=70))
def test_base_spans_equal_plain_patterns(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_base_spans_of_numbers():
    rng = random.Random(3)
    for _ in range(2000):
        digits = "".join(rng.choice("0123456789") + rng.choice(["", "", "", " ", "-"]) for _ in range(rng.randint(12, 21)))
        text = rng.choice(["", "n. "]) + digits + rng.choice(["", ".1.2.3", " x"])
        assert personal_data.base_spans(text) == plain_spans(text)


def test_learned_patterns_find_unseen_identifiers(spark):
    texts = [(i, f"word{i % 7} stuff. Phone: +1 (212) 555-{1000 + i} and so on") for i in range(20)]
    texts += [(100, "again. Phone: 555-0199 ok"), (101, "Order: 12345 here"), (102, None), (103, ""), (104, "see page 12 of 30, Phone: none"), (105, "Phone: 555-0199")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data.find(docs).collect()}
    assert [len(got[i]["base"]) for i in (0, 100, 102, 103)] == [1, 0, 0, 0]
    assert [(s["start"], s["end"]) for s in got[100]["added"]] == [(14, 22)]
    assert [(s["start"], s["end"]) for s in got[105]["added"]] == [(7, 15)]
    assert not got[101]["added"] and not got[104]["added"] and not got[0]["added"]


def test_personal_data_of_odd_rows(spark):
    for wide in (False, True):
        assert personal_data.find(odd(spark, wide)).count() == len(odd_rows())
        assert personal_data.find(empty(spark, wide)).count() == 0
    doubled = personal_data.find(spark.createDataFrame([(1, "a@b.cd")] * 3, "doc_id long, text string")).collect()
    assert [len(r["base"]) for r in doubled] == [1, 1, 1]


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(labels)[order]
    rank = np.searchsorted(s, s, "left") + np.searchsorted(s, s, "right") + 1
    n = y.sum()
    return (rank[y == 1].sum() / 2 - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_of_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.fit(docs, labels, residue(4) != 2)
    held = toxicity.score(docs.filter(residue(4) == 2), model).join(labels, "doc_id").select("score", "toxic", "hits").collect()
    assert auc([r["score"] for r in held], [r["toxic"] for r in held]) >= 0.95
    hit = [r["toxic"] for r in held if r["score"] >= toxicity.THRESHOLD]
    assert np.mean(hit) >= 0.9 and len(hit) >= 0.85 * sum(r["toxic"] for r in held)


def insults(n=40):
    out = [(i, f"{passage(i, 40)} you total idiot {passage(i + 50, 20)}", 1) for i in range(n)]
    return out + [(1000 + i, f"{passage(300 + i, 60)} nice idiot savant", 0) for i in range(10)] + [(2000 + i, passage(500 + i, 50), 0) for i in range(4 * n)]


def test_folding_and_exceptions(spark):
    data = spark.createDataFrame(insults(), "doc_id long, text string, toxic int")
    model = toxicity.fit(data, data)
    found = model.matcher()
    assert toxicity.fold("idiot") in model.terms
    for text in ("an 1D10T here", "an іdiоt here", "an ｉｄｉｏｔ", "an i​diot", "ÍDÏÓT!"):
        assert toxicity.evidence(toxicity.fold(text), found)[1] >= 1, text
    assert toxicity.evidence(toxicity.fold("an idiotic thing"), found)[1] == 0
    assert toxicity.evidence(toxicity.fold("an idiot savant"), found)[1] == 0
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(data.select("doc_id", "text"), model).collect()}
    assert min(scored[i] for i in range(40)) >= toxicity.THRESHOLD > max(v for k, v in scored.items() if k >= 1000)
    assert {r["doc_id"] for r in toxicity.accepted(data, model).select("doc_id").collect()} == {k for k in scored if k >= 1000}


def test_toxicity_of_odd_rows(spark):
    data = spark.createDataFrame(insults(), "doc_id long, text string, toxic int")
    labels = data.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 0), (77777, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(data, labels)
    for wide in (False, True):
        got = toxicity.score(odd(spark, wide), model)
        assert got.count() == len(odd_rows())
        assert got.filter("score < 0 or score > 1 or score is null").count() == 0
        assert toxicity.score(empty(spark, wide), model).count() == 0
        assert toxicity.accepted(odd(spark, wide), model).columns == odd(spark, wide).columns
    nothing = toxicity.fit(data, labels.limit(0))
    assert toxicity.score(odd(spark), nothing).agg(F.max("score")).first()[0] < 1e-9


def pieces(text):
    return {p.strip(" ") for p in re.split(fingerprints.PARAGRAPHS, text)} - {""}


def plain_likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check_fingerprints(spark, items, docs=None):
    """Items in the order of the documents, last first."""
    docs = docs or spark.createDataFrame(items, "doc_id long, text string")
    got = fingerprints.compared(docs).collect()
    assert len(got) == len(items)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k, (i, t) in enumerate(items):
        t, nxt = t or "", items[(k + 1) % len(items)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in by[i] if r["edited_sha256"] == sha)
        assert r["n_chars"] == len(t)
        assert abs(r["near_edited"] - plain_likeness(pieces(t), pieces(edited))) < 1e-12
        assert abs(r["near_next"] - plain_likeness(pieces(t), pieces(nxt))) < 1e-12
    return by


def test_fingerprints_recover_all_differences(spark):
    rng = random.Random(5)
    sizes = [0, 1, 2, 3, 8, 20, 21, 60, 200, 2500] + [rng.randint(1, 80) for _ in range(60)]
    items = [(1000 - k, "\n".join(f"line {rng.randint(0, 3000)} of text." for _ in range(n))) for k, n in enumerate(sizes)]
    items[5] = (items[5][0], items[4][1])
    by = check_fingerprints(spark, items)
    assert by[items[5][0]][0]["fingerprint"] == by[items[4][0]][0]["fingerprint"]
    assert by[items[5][0]][0]["fingerprint"] != by[items[6][0]][0]["fingerprint"]


def test_fingerprints_of_odd_rows(spark):
    items = sorted([(r[0], r[1]) for r in odd_rows() if r[0] is not None], key=lambda x: -x[0]) + [(None, passage(2, 80))] * 2
    check_fingerprints(spark, items, odd(spark, wide=True))
    assert fingerprints.compared(empty(spark, True)).count() == 0
    check_fingerprints(spark, [(7, "Alone. Here it stands. And more of it.")])


def test_rows_helper(spark):
    assert rows(spark.range(1)) == [(0,)]
