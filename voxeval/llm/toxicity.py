"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, accents dropped, homoglyphs of other scripts and full-width forms replaced, digits and
signs that stand for letters put back. The lexicon is learned: folded words, and beginnings of words, that labelled toxic texts
use many times as often as others, in ever different company, weighted by the log of that ratio; two-word phrases around a
lexicon word that non-toxic texts hold as often are exceptions. One Aho-Corasick automaton finds words, beginnings and
exceptions in a single pass over the whole text; a word counts once, and not inside an exception. The summed weight and its
density per word enter a logistic score.

The fit uses at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id, and counts equal texts once. Defined cases:
a null or empty text has no words and scores as a text without a hit; labels that are null or name no document are left
out, of several labels of a document the larger counts; without labelled rows every score is 0; repeated rows are scored
alike; an empty table has an empty result; other columns are passed by, but for those with the names of results, which the
results replace.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage

from .base import WORD, full_text, portions

TRAIN_ROWS = 20_000
#: Bounds on what a fit may hold, so that the broadcast model is small whatever the data.
MAX_TERMS, MAX_EXCEPTIONS = 2_000, 2_000
MIN_TEXTS, MIN_SHARE, MIN_LOG_RATIO = 3, 0.02, 2.3
#: Letters of the beginnings of words, and the mark they carry while they are counted.
STEMS, MARK = (5, 6, 7), "*"
#: Different neighbourhoods per toxic text that a word needs: what only near copies repeat is no insult.
MIN_VARIETY = 0.7
MIN_EXCEPTION_TEXTS = 5
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and the signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ß": "b",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
#: Signs that stand for a letter only inside a word.
INSIDE = re.compile(r"(?<=[^\W_])[!|](?=[^\W_])")
#: i and l are written with the same signs, so both fold to i.
ALIKE = {"l": "i"}
#: Characters that only hide a word.
HIDDEN = dict.fromkeys(["­", "​", "‌", "‍", "⁠", "﻿"], "")


def folding() -> dict[int, str]:
    """Character by character; Latin letters with marks and full-width forms come from their decompositions."""
    table: dict[str, str] = {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != c:
            table[c] = plain
    for c in map(chr, range(0x300, 0x370)):
        table[c] = ""
    table |= HOMOGLYPHS | {k.upper(): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1} | HIDDEN
    table |= {chr(c): chr(c).lower() for c in range(ord("A"), ord("Z") + 1)}
    table = {k: SIGNS.get(v, v) for k, v in (SIGNS | table).items()}
    return {ord(k): ALIKE.get(v, v) for k, v in (ALIKE | table).items()}


FOLDING = folding()
WORDS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    text = text or ""
    if "!" in text or "|" in text:
        text = INSIDE.sub("i", text)
    return text.translate(FOLDING)


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]  # beginnings of words
    exceptions: list[str]
    weights: list[float]  # intercept, summed weight, density

    def matcher(self) -> ahocorasick.Automaton | None:
        """Values are the length, the weight as a word, as a beginning, and whether it is an exception."""
        found = ahocorasick.Automaton()
        for t in {**self.terms, **self.stems}:
            found.add_word(t, (len(t), self.terms.get(t, 0.0), self.stems.get(t, 0.0), False))
        for e in self.exceptions:
            found.add_word(e, (len(e), 0.0, 0.0, True))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def names(self, word: str) -> bool:
        return word in self.terms or any(word[:n] in self.stems for n in STEMS if n < len(word))


def evidence(folded: str, found: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Summed weight of hits outside exception phrases, the largest at each word, and the number of words hit."""
    if found is None:
        return 0.0, 0
    hits: dict[int, float] = {}
    barred, n_chars = [], len(folded)
    for end, (size, word, stem, exception) in found.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalnum():
            continue
        inside = end + 1 < n_chars and folded[end + 1].isalnum()
        if exception and not inside:
            barred.append((start, end))
        elif weight := stem if inside else max(word, 0.0):
            hits[start] = max(hits.get(start, 0.0), weight)
    if barred:
        hits = {a: w for a, w in hits.items() if not any(x <= a <= y for x, y in barred)}
    return sum(hits.values()), len(hits)


def features(text: str | None, found: ahocorasick.Automaton | None) -> tuple[float, float, int]:
    folded = fold(text)
    total, n = evidence(folded, found)
    size = max(1, len(folded.split())) if total else 1
    return math.log1p(total), math.log1p(100.0 * total / size), n


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows for which ``allowed`` holds; equal texts count once."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stage(known.filter(allowed).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit))
    texts = docs.select("doc_id", full_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("text").agg(F.max("toxic").alias("toxic"))


COUNT = T.StructType([T.StructField("word", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("texts", "pos", "neg", "others")]])


def _counts(rows: DataFrame, what) -> DataFrame:
    """word, toxic texts with it, its uses in toxic and in other texts, other texts with it; ``what`` maps a folded text to the
    words or phrases that it uses. Each batch is summed before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [Counter() for _ in range(4)]
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                uses = Counter(what(fold(text)))
                sums[1 if toxic > 0 else 2].update(uses)
                sums[0 if toxic > 0 else 3].update(uses.keys())
            words = sorted({*sums[1], *sums[2]})
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in sums)], names=COUNT.names)

    counted = rows.select("text", "toxic").mapInArrow(run, COUNT)
    return counted.groupBy("word").agg(*[F.sum(n).alias(n) for n in COUNT.names[1:]])


def parts_of(text: str) -> list[str]:
    """Words, and their beginnings with a mark at the end."""
    ws = [w for w in WORDS.findall(text) if len(w) >= 3]
    return ws + [w[:n] + MARK for w in ws for n in STEMS if n < len(w)]


def _contexts(rows: DataFrame, parts: set[str]) -> DataFrame:
    """word, n: distinct pairs of neighbours that each of ``parts`` has in toxic texts. Near copies share theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for text in b.column(0).to_pylist():
                ws = ["", *WORDS.findall(fold(text)), ""]
                for i, w in enumerate(ws[1:-1]):
                    out |= {(p, f"{ws[i]} {ws[i + 2]}") for p in (w, *(w[:n] + MARK for n in STEMS if n < len(w))) if p in parts}
            pairs = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], names=["word", "near"])

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.StringType())])
    return rows.filter("toxic > 0").select("text").mapInArrow(run, schema).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, limit: int = TRAIN_ROWS) -> Model:
    """Lexicon, exceptions and score weights; the driver sees at most MAX_TERMS words, MAX_EXCEPTIONS phrases and three
    numbers of each training row."""
    rows = stage(training_rows(docs, labels, F.lit(True) if allowed is None else allowed, limit))
    toxic = F.col("toxic") > 0
    size = F.regexp_count("text", F.lit(WORD))
    pos, all_, pos_words, all_words = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (toxic.cast("long"), F.lit(1), F.when(toxic, size), size)]).first()
    neg = all_ - pos
    if not pos or not neg:
        return Model({}, {}, [], [-50.0 if not pos else 50.0, 0.0, 0.0])
    ratio = F.log((F.col("pos") + 0.5) / F.lit(pos_words + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(all_words - pos_words + 1.0))
    likely = _counts(rows, parts_of).withColumn("w", ratio).filter((F.col("texts") >= max(MIN_TEXTS, MIN_SHARE * pos)) & (F.col("w") >= MIN_LOG_RATIO))
    likely = likely.orderBy(F.desc(F.col("w") * F.col("texts")), "word").limit(MAX_TERMS).collect()
    seen_in = {r["word"]: r["n"] for r in _contexts(rows, {r["word"] for r in likely}).collect()}
    weight = {r["word"]: float(r["w"]) for r in likely if seen_in.get(r["word"], 0) >= MIN_VARIETY * r["pos"]}
    terms, stems = {k: w for k, w in weight.items() if k[-1] != MARK}, {k[:-1]: w for k, w in weight.items() if k[-1] == MARK}
    model = Model(terms, stems, [], [0.0, 0.0, 0.0])

    def phrases(text: str) -> list[str]:
        ws = WORDS.findall(text)
        return [f"{a} {b}" for a, b in zip(ws, ws[1:]) if (model.names(a) or model.names(b)) and f"{a} {b}" in text]

    if weight:
        benign = _counts(rows, phrases).filter((F.col("others") >= MIN_EXCEPTION_TEXTS) & (F.col("others") / neg >= F.col("texts") / pos))
        model.exceptions = [r["word"] for r in benign.orderBy(F.desc("others"), "word").limit(MAX_EXCEPTIONS).collect()]
    seen = _features(rows, model).select("x", "y", "toxic").collect()
    x = np.array([[1.0, r["x"], r["y"]] for r in seen])
    y = np.array([float(r["toxic"] > 0) for r in seen])
    beta, ridge = np.array([math.log(pos / neg), 0.0, 0.0]), np.diag([0.0, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3), x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    model.weights = [float(b) for b in beta]
    return model


def _features(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without the text, with x, y and hits."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(text)
    rest = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value.matcher()
        for b in portions(batches):
            got = [features(t, found) for t in b.column(place).to_pylist()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in ((0, pa.float64()), (1, pa.float64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *cols], names=[*(f.name for f in rest), "x", "y", "hits"])

    extra = [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("hits", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rest, *extra]))


def score(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (some columns and ``text``) without the text, with hits and score."""
    texts = texts.drop("x", "y", "hits", "score")
    a, b, c = model.weights
    logit = F.lit(a) + F.lit(b) * F.col("x") + F.lit(c) * F.col("y")
    return _features(texts, model).withColumn("score", 1 / (1 + F.exp(-logit))).drop("x", "y")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c = held.value.weights
        found = held.value.matcher()
        for batch in portions(batches):
            xy = [features(t, found) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([1 / (1 + math.exp(-max(-700.0, a + b * x + c * y))) < threshold for x, y, _ in xy], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
