"""URL filter by association rules.

Each labelled url is a transaction: its tokens (host labels, domain suffixes, path segments, file ending, query keys) and the item of its class.
Spark's FP-growth mines frequent combinations; those whose consequent is the bad class and that pass the confidence and
support bounds are rules. Every rule is filed in an inverted index under its rarest token; a url looks its tokens up there
and keeps the rules of which it has all tokens, so no url meets a rule that shares no token with it. Site rules of the
caller (host and path prefix, longest wins) come first.

Defined cases: a null url, or one without "://", has an empty host and path, no tokens, and is allowed; equal urls are
judged once; labels that are null or belong to no page are left out; without a labelled url there are no mined rules; an
empty table has an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage

from .base import ascii_lower

BAD = "class=bad"
#: Share of the labelled urls that have the combination and the bad class; share of bad ones among those with it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Labelled urls, whatever their share, that a rule needs.
MIN_ROWS = 5
#: Tokens of a rule at most.
MAX_TOKENS = 3
#: Rules that are broadcast at most; a rule holds MAX_TOKENS tokens of at most TOKEN_CHARS characters.
BROADCAST_RULES = 50_000
TOKEN_CHARS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels and their parts at hyphens, ``d:`` the last two labels, ``p:`` path segments
    without digits, ``e:`` file ending, ``q:`` keys of the query, ``s:`` scheme."""
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.concat(F.array(x), F.split(x, "-"))))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})\z", 1)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)

    def mark(m: str, xs: Column) -> Column:
        return F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(m), F.substring(ascii_lower(x), 1, TOKEN_CHARS - 2)))

    every = F.concat(
        mark("h:", parts), mark("d:", F.array(F.substring_index(host, ".", -2))), mark("p:", segments),
        mark("e:", F.array(ending)), mark("q:", keys), mark("s:", F.array(scheme)),
    )
    return F.array_sort(F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(every)))


def parsed(pages: DataFrame) -> DataFrame:
    """Distinct urls with host, path and tokens."""
    host, path = split_url(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    return urls.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (tokens, confidence, support) from a table (tokens, bad)."""
    spark = labelled.sparkSession
    schema = T.StructType([T.StructField("rule_tokens", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("support", T.DoubleType())])
    baskets = stage(labelled.filter("size(tokens) > 0").select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, (MIN_ROWS - 0.5) / n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == BAD) & (F.size("antecedent") <= max_tokens))
    return rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support")


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules under their rarest token: token, rule_tokens, confidence, support."""
    held = rules.select("rule_tokens", F.explode("rule_tokens").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").count()
    rarest = held.join(counts, "token", "left").groupBy("rule_tokens").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "token")).alias("r"))
    return rules.join(rarest, "rule_tokens").select(F.col("r.token").alias("token"), "rule_tokens", "confidence", "support")


def apply_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Urls with at least one rule: url, mined (the rule of largest confidence, then support, then tokens), confidence."""
    index = stage(index)
    small = index.count() <= BROADCAST_RULES
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index) if small else index, "token")
    hits = hits.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join("rule_tokens", " ").alias("mined")))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.mined", "b.confidence")


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest of ``rules`` (verdict, host, path) that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of every page.

    ``labels`` has page_id and bad (boolean).
    """
    urls = stage(parsed(pages))
    known = labels.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = pages.select("page_id", "url").join(known, "page_id").join(urls, "url").select("tokens", "bad")
    mined = stage(mine(marked, min_support, min_confidence))
    found = apply_rules(urls, index_rules(mined, urls))
    text, verdict = site_rule(F.col("host"), F.col("path"), rules)
    by_url = urls.join(found, "url", "left").select(
        F.col("url").alias("_url"), "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined", "confidence",
    )
    return pages.select("page_id", "url").join(by_url, F.col("url").eqNullSafe(F.col("_url")), "left").select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")


TOKEN_SQL = """
u AS (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT DISTINCT url FROM pages)),
m AS (SELECT url, host, path, CASE WHEN host = '' THEN [] ELSE list_concat(
  list_transform(flatten(list_transform(string_split(host, '.'), lambda x: list_concat([x], string_split(x, '-')))), lambda x: ['h:', x]),
  [['d:', array_to_string(string_split(host, '.')[-2:], '.')]],
  list_transform(list_filter(string_split(path, '/'), lambda x: NOT regexp_matches(x, '[0-9]')), lambda x: ['p:', x]),
  [['e:', regexp_extract(path, '\\.([A-Za-z]{1,5})$', 1)]],
  list_transform(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: ['q:', string_split(x, '=')[1]]),
  [['s:', regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)]]) END AS raw FROM u),
t AS (SELECT url, host, path, list_sort(list_distinct(list_transform(list_filter(raw, lambda x: x[2] <> ''),
  lambda x: x[1] || substr(translate(x[2], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1, 62)))) AS tokens FROM m)"""


def sql(bad: str, rules: Sequence[tuple[str, str, str]]) -> str:
    """DuckDB text of ``judge`` over pages and labels; ``bad`` is the condition on labels, joined by page_id = doc_id."""
    last_first = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:]), reverse=True)
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in last_first]
    rule = "CASE " + " ".join(f.format(h + p) for f, (_, h, p) in zip(fits, last_first)) + " END"
    verdict = "CASE " + " ".join(f.format(v) for f, (v, _, _) in zip(fits, last_first)) + " END"
    return f"""
WITH {TOKEN_SQL},
k AS (SELECT doc_id AS page_id, max({bad}) AS bad FROM labels WHERE ({bad}) IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
b AS (SELECT row_number() OVER () AS i, tokens, bad FROM (SELECT page_id, url FROM pages) JOIN k USING (page_id) JOIN t USING (url) WHERE len(tokens) > 0),
o AS (SELECT i, bad, unnest(tokens) AS a FROM b),
c AS (SELECT i, bad, [a] AS combo FROM o UNION ALL SELECT x.i, x.bad, [x.a, y.a] FROM o x JOIN o y ON x.i = y.i AND x.a < y.a
  UNION ALL SELECT x.i, x.bad, [x.a, y.a, z.a] FROM o x JOIN o y ON x.i = y.i AND x.a < y.a JOIN o z ON x.i = z.i AND y.a < z.a),
n AS (SELECT count(*)::DOUBLE AS n FROM b),
r AS (SELECT combo, count(*) FILTER (bad)::DOUBLE / count(*) AS confidence, count(*) FILTER (bad) / any_value(n) AS support FROM c, n GROUP BY combo
  HAVING count(*) FILTER (bad) >= ceil(greatest({MIN_SUPPORT}e0, {MIN_ROWS - 0.5}e0 / any_value(n)) * any_value(n)) AND count(*) FILTER (bad)::DOUBLE / count(*) >= {MIN_CONFIDENCE}e0),
f AS (SELECT url, array_to_string(combo, ' ') AS mined, confidence, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, support DESC, array_to_string(combo, ' ') DESC) AS pos
  FROM t JOIN r ON list_has_all(tokens, combo))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined, confidence
FROM pages p JOIN t ON p.url IS NOT DISTINCT FROM t.url LEFT JOIN (SELECT * FROM f WHERE pos = 1) f ON f.url = t.url"""
