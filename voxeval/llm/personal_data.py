"""Personal data by bootstrapped contextual extraction.

Base patterns find the seeds: e-mail addresses, network addresses, card and phone numbers. Every seed, and every other token
that looks like an identifier (it holds a digit), is an instance that stands after a lexical pattern: a cue word that ends
in ":", "=" or "#", or the two words before it. Spark scores the graph of patterns and instances in rounds: a pattern is as
good as the share of its instances that are believed, an instance is believed as far as a good pattern names it. Patterns of
high confidence, seen with several different seeds, then name the unseen identifiers that stand after them.

One pass over the texts collects spans and instances; all else works on those. Spans count code points, end exclusive.
Defined cases: a null text is empty and has no spans; repeated rows have the same spans each, and their instances count
once; an empty table has an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage

from .base import files_only, located

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that a learned pattern names.
FOUND = "id"
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS = 3, 0.75, 3
#: Letters of a cue and of an identifier at most; longer tokens are no identifiers.
MAX_CUE, MAX_TOKEN = 64, 128

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'`.,;:!?()[]{}<>|"
CUE = re.compile(r"[^\W\d_][\w.-]*[:=#]\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap: each goes from the start of the run before an @ to the end of its domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
            free = end.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    end = -1
    for m in ADDRESS.finditer(text):
        end = m.end()
        if all(len(g.lstrip("0")) <= 3 and int(g[-9:] if len(g.lstrip("0")) <= 3 else 999) <= 255 for g in m.groups()):
            out.append((m.start(), 1, end))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def cues(text: str, start: int) -> list[str]:
    """Patterns of an instance that starts here: a cue word with its sign, and the two words before."""
    left = text[max(0, start - 4 * MAX_CUE) : start].rstrip("\"'`(<[ \t")
    before = TOKEN.findall(left)[-2:]
    if not before or (start and text[start - 1] not in "\"'`(<[ \t\n=:#"):
        return []
    out = []
    last = before[-1].lower()
    if CUE.search(last) and len(last) <= MAX_CUE:
        out.append(CUE.search(last).group())
    if len(before) == 2:
        words = [w.lower().strip(EDGES + "=#") for w in before]
        if all(w and len(w) <= MAX_CUE and not any(c.isdigit() for c in w) for w in words):
            out.append(" ".join(words))
    return out


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, seed, value, pattern) of the seeds and of other identifier-like tokens."""
    out, covered = [], [(a, b) for a, _, b in base]
    for a, b in covered:
        out += [(a, b, True, text[a:b], p) for p in cues(text, a)]
    if not re.search("[0-9]", text):
        return out
    i = 0
    for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", text):
        token = m.group()
        a, b = m.start(), m.end()
        cut = max(token.rfind("="), token.rfind(":"), token.rfind("#")) + 1
        a += cut
        while a < b and text[a] in EDGES + "=#":
            a += 1
        while a < b and text[b - 1] in EDGES:
            b -= 1
        value = text[a:b]
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if not 4 <= b - a <= MAX_TOKEN or not any(c.isdigit() for c in value) or (i < len(covered) and covered[i][0] < m.end()):
            continue
        out += [(a, b, False, value, p) for p in cues(text, a)]
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
INSTANCE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("seed", T.BooleanType()),
    T.StructField("value", T.StringType()), T.StructField("pattern", T.StringType()),
])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, _file, _row, base (spans), seen (instances) of every row."""
    rows = located(docs).select("doc_id", "_file", "_row", "text")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("base", T.ArrayType(SPAN)), T.StructField("seen", T.ArrayType(INSTANCE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            base, seen = [], []
            for text in b.column(3).to_pylist():
                spans = base_spans(text or "")
                base.append([{"start": a, "kind": k, "end": z} for a, k, z in spans])
                seen.append([dict(zip(INSTANCE.names, x)) for x in instances(text or "", spans)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(base, kinds.field("base").type), pa.array(seen, kinds.field("seen").type)], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence, seeds from instances (pattern, value, seed).

    Belief of a seed is 1. In each round a pattern gets the mean belief of its distinct values (one doubt added), then a value
    the largest confidence of its patterns. Counts are taken over distinct pairs, summed per task first.
    """
    pairs = stage(seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    support = F.sum(F.col("seed").cast("long")).alias("seeds")
    scored = None
    belief = pairs.groupBy("value").agg(F.max("seed").cast("double").alias("belief"))
    for _ in range(rounds):
        scored = stage(pairs.join(belief, "value").groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), support))
        lifted = pairs.join(scored.filter(F.col("seeds") >= MIN_SEEDS), "pattern").groupBy("value").agg(F.max("confidence").alias("c"))
        own = pairs.groupBy("value").agg(F.max("seed").alias("seed"))
        belief = own.join(lifted, "value", "left").select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("belief"))
    return scored


def find(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added spans as arrays of (start, kind, end), sorted.

    Kinds count from 0 as in KINDS; added spans have the next number. Of added spans that overlap in a row, the leftmost and
    longest stays.
    """
    rows = stage(scan(files_only(docs, ["doc_id", "text"])))
    seen = rows.filter("size(seen) > 0").select("_file", "_row", F.explode("seen").alias("i")).select("_file", "_row", "i.*")
    good = score_patterns(seen.select("pattern", "value", "seed")).filter((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds))
    named = seen.filter("not seed").join(good.select("pattern"), "pattern")
    added = named.groupBy("_file", "_row").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end"))).alias("added"))
    none = F.array().cast(T.ArrayType(SPAN))
    return rows.select("doc_id", "_file", "_row", "base").join(added, ["_file", "_row"], "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans: str) -> str:
    """SQL text: kind:start:end of an array of spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in (*KINDS, FOUND))
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"
