"""URL rules, mixing and the pipeline against plain versions; registered queries against their SQL."""

import itertools
import math

import pytest
from compare import compare, connect
from helpers import empty, insults_table, odd, odd_rows, passage
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from voxeval.llm import mixing, ngram_join, suffix_dedup, toxicity, url_filter
from voxeval.llm.base import ORACLES, QUERIES, residue
from voxeval.llm.queries import SITE_RULES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) is None


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares by resharing until nobody is above the ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, None: 40, "é": 0}, {"a": 1}, {"a": 0, "b": 0}, {str(i): i * i for i in range(20)}])
def test_targets_equal_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "_source string, _size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(table).collect()}
    want = plain_targets(sizes)
    assert {*got} == {*want} and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in got)


def test_mix_of_odd_rows(spark):
    docs = odd(spark, wide=True)
    taken = mixing.words_taken(docs).collect()
    assert len(taken) == len(odd_rows()) and all(r["taken"] <= 2 * r["size"] for r in taken)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in taken)
    assert sorted(map(str, taken)) == sorted(map(str, mixing.words_taken(odd(spark)).collect()))
    assert mixing.mixed(empty(spark, True)).count() == 0 and mixing.words_taken(empty(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, passage(i, 20 + i % 30), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.words_taken(docs).withColumn("s", F.col("doc_id") % 4).groupBy("s").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) < 0.05 * r["w"] for r in got)


URLS = [
    "http://a.example.net/en/x", "https://EXAMPLE.net/en/", "http://a.net/", "http://a.net", "http://example.com/de/q?x=1", "http://b.example.com/de", "http://x.org/fr/y#z",
    "http://net/", "http://internet/", None, "", "no scheme/de/", "http://", "http:///net/", "http://spam.biz/buy-now/1", "http://spam.biz/buy-now/2", "http://ok.biz/read/1",
]


def plain_site(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_site_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad boolean"), SITE_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_site(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u


def spam(spark):
    rows_ = [(i, f"http://{'m.' if i % 2 else ''}spam{i % 3}.biz/buy-now/{i}", True) for i in range(30)]
    rows_ += [(100 + i, f"http://fine{i % 5}.biz/read/{i}.html", False) for i in range(60)] + [(200 + i, f"http://spam0.biz/read/{i}", False) for i in range(30)]
    return spark.createDataFrame(rows_, "page_id long, url string, bad boolean")


def test_mined_rules_equal_brute_force(spark):
    data = spam(spark)
    baskets = [(set(r["tokens"]), r["bad"]) for r in url_filter.parsed(data).join(data.select("url", "bad"), "url").select("tokens", "bad").collect()]
    count = {}
    for tokens, bad in baskets:
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(tokens), k):
                n = count.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += bad
    want = {c: b / n for c, (n, b) in count.items() if b >= 5 and b / n >= url_filter.MIN_CONFIDENCE}
    mined = url_filter.mine(url_filter.parsed(data).join(data.select("url", "bad"), "url"))
    got = {tuple(r["rule_tokens"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c]) for c in got)
    new = spark.createDataFrame([(1, "http://new.biz/buy-now/9"), (2, "http://spam0.biz/read/7"), (3, "http://new.biz/other"), (None, None)], "page_id long, url string")
    judged = url_filter.judge(data.select("page_id", "url").unionByName(new.filter("page_id is null or page_id in (1, 2, 3)")), data.select("page_id", "bad"), [])
    by = {r["host"] + r["path"]: r["verdict"] for r in judged.collect()}
    assert (by["new.biz/buy-now/9"], by["spam0.biz/read/7"], by["new.biz/other"], by[""]) == ("block", "allow", "allow", "allow")


def test_url_cases(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), none, SITE_RULES).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/x", "?"), (1, "http://a.net/x", "?"), (None, "http://a.net/x", "?"), (4, None, None)], "page_id long, url string, host string")
    odd_labels = spark.createDataFrame([(1, None), (None, True), (9, True), (1, False), (1, True)], "page_id long, bad boolean")
    got = url_filter.judge(twice, odd_labels, SITE_RULES).collect()
    assert [r["verdict"] for r in got if r["host"]] == ["block"] * 3 and len(got) == 4


def test_stages_of_the_pipeline(spark, tmp_path):
    docs, labels = insults_table(spark)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    held = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, held, sf)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/{name}")
            held = spark.read.parquet(f"{sf}/{name}")
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/toxicity").select("doc_id").collect()}
    assert clean == {r["doc_id"] for r in docs.filter("doc_id >= 1000 or doc_id is null").collect()}
    kept = spark.read.parquet(f"{sf}/exact_dedup")
    assert kept.count() == spark.read.parquet(f"{sf}/toxicity").select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()
    near = spark.read.parquet(f"{sf}/near_dedup")
    assert near.filter("doc_id in (3000, 3001, 3002)").count() == 1 and near.filter("doc_id in (2005, 4002)").count() == 1
    assert spark.read.parquet(f"{sf}/mixing").count() == mixing.words_taken(near).agg(F.sum("copies")).first()[0]
    final = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, final.drop("ids").collect())) == sorted(map(str, out.drop("ids").collect()))


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd(spark, wide=True)), ("none", empty(spark, wide=True))):
        sf = str(tmp_path / name)
        docs.drop("_file", "_row").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 0), (4, 1), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.run(spark, sf).count() >= 0


def test_residue_of_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (3,)], "doc_id long").select(residue(5)).collect()] == [0, 1842515611 % 5]
    assert suffix_dedup.MIN_WORDS == 50 and ngram_join.SHINGLE == 5 and toxicity.THRESHOLD == 0.3
