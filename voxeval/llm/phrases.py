"""Collocations by counting only the longest windows and summing them to shorter prefixes.

Every word of a piece leads one window of ``longest`` words, padded where the piece ends: the word itself and its lead
columns. Only these windows are counted, first in each task, then where they are dealt by their first words. A ROLLUP over
(lang, w1, ..) sums the counts to the shorter prefixes: as every word leads exactly one window, the prefix of m words sums
to the occurrences of that phrase, the lang alone to its words. No shorter n-gram is ever counted from the text.

A candidate is scored at each cut into two phrases, whose counts are looked up among the counted phrases. Keys that hold
more than one in ``HEAVY`` of all occurrences (so ``HEAVY`` of a length at most) are looked up in a broadcast table whose bytes are
checked, the others by a shuffle, so no frequent word gathers its candidates in one task.

Texts are lower-cased in A to Z, cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at blanks and tabs. Defined
cases: a null text is empty; a null lang is ``und`` and one with documents of that name; repeated rows count each; an empty
table and a lang without candidates have no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxeval.plans.bounded import held_bytes
from voxeval.session import stage

from .base import full_text, portions

#: Padding of windows beyond the end of a piece; a word is never empty.
PAD = ""
#: A phrase with one in HEAVY of all occurrences or more is looked up by broadcast.
HEAVY = 1000
#: Bytes of that table at most; longer words than this would allow are looked up by a shuffle.
HEAVY_BYTES = 8 << 20
#: Parts in which a lang's candidates are ranked before their best are ranked together.
RANK_PARTS = 64
#: Words whose windows a task counts together, and the parts in which those of a first word travel.
FLUSH, PARTS = 1 << 20, 4


LED = "lang string, w1 string, part int, rest string"


def led_windows(docs: DataFrame, longest: int) -> DataFrame:
    """lang, w1, part, rest: the padded windows of every word, counted per ``FLUSH`` words of a task.

    Lead columns are the words moved up within their piece. Windows with the same first word travel as one row, whose ``rest``
    holds a line for each: the other words and, if there are several such windows, their number. ``part`` is dealt by the second
    word, so that a frequent first word is no single key.
    """
    cut = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\xff" * 10)  # 255 is in no text

    def rows(numbers: dict[bytes, int], codes: dict[str, list]) -> Iterator[pa.RecordBatch]:
        words = [PAD, *(w.decode() for w in list(numbers)[1:])]
        salt = np.array([crc32(w) % PARTS for w in numbers], np.int64)
        bits = max(1, (len(words) - 1).bit_length())
        for lang, lists in codes.items():
            text = np.concatenate([*lists, np.zeros(longest, np.int64)])
            cols = [text[: len(text) - longest]]
            for k in range(1, longest):
                cols.append(np.where(cols[-1] == 0, 0, text[k : len(text) - longest + k]))
            led = cols[0] != 0
            cols = [c[led] for c in cols]
            if longest * bits < 64:
                packed = cols[0]
                for c in cols[1:]:
                    packed = (packed << bits) | c
                packed, n = np.unique(packed, return_counts=True)
                cols = [(packed >> (bits * k)) & ((1 << bits) - 1) for k in reversed(range(longest))]
            elif len(cols[0]):
                both, n = np.unique(np.stack(cols, axis=1), axis=0, return_counts=True)
                cols = list(both.T)
            else:
                n = cols[0]
            part = salt[cols[1]] if longest > 1 else np.zeros(len(n), np.int64)
            order = np.lexsort((part, cols[0]))
            first, part, n = cols[0][order], part[order], n[order]
            rest = [[words[i] for i in c[order].tolist()] for c in cols[1:]]
            lines = [" ".join(r) if k == 1 else f"{' '.join(r)} {k}" for *r, k in zip(*rest, n.tolist())]
            start = np.flatnonzero(np.diff(first * PARTS + part, prepend=-1))
            spans = zip(start.tolist(), [*start[1:].tolist(), len(first)])
            out = [[lang] * len(start), [words[i] for i in first[start].tolist()], part[start].tolist(), ["\n".join(lines[a:z]) for a, z in spans]]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            for a in range(0, len(start), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000], k) for c, k in zip(out, kinds)], names=["lang", "w1", "part", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, held = {b"\xff": 0}, {}, 0
        for b in portions(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = text.lower().translate(cut).replace(b"\xff", b" \xff ").split()
                words.append(b"\xff")
                code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                codes.setdefault(lang, []).append(code)
                held += len(words)
                if held >= FLUSH:
                    yield from rows(numbers, codes)
                    numbers, codes, held = {b"\xff": 0}, {}, 0
        yield from rows(numbers, codes)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, full_text().alias("text")).mapInArrow(run, LED)


def counted_phrases(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words (array), f of all phrases of 1 to ``longest`` words that occur ``least`` times; without words: n of the lang."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    place = ["lang", "w1", "part"]
    line = led_windows(docs, longest).repartition(*place).select(*place, F.explode(F.split("rest", "\n")).alias("line"))
    words = F.split("line", " ")
    line = line.select(*place, *[F.get(words, k).alias(n) for k, n in enumerate(names[1:])], F.coalesce(F.get(words, longest - 1).cast("long"), F.lit(1).cast("long")).alias("f"))
    # grouped by more than they are dealt by, windows are not exchanged again
    windows = line.groupBy(*place, *names[1:]).agg(F.sum("f").alias("f"))
    # a condition on the count stays above the count, so that this and the prefixes read one exchange
    top = windows.filter(F.when(F.col("f") >= least, F.col(names[-1]) != PAD).otherwise(F.lit(False))).select("lang", F.array(*names).alias("words"), "f")
    # prefixes of two words or more are whole where their windows are: rare ones need not travel, only their first word counts
    prefix = line.groupBy(*place, *names[1:-1]).agg(F.sum("f").alias("f"))
    total = F.sum("f").over(Window.partitionBy(*place, "w2")) if longest > 3 else F.col("f")
    known = prefix.withColumn("known", total >= least) if longest > 2 else prefix
    known = known.select("lang", "w1", *[F.when(F.col("known"), F.col(n)).otherwise(F.lit(PAD)).alias(n) for n in names[1:-1]], "f")
    # a rolled-up column is null; arrays drop it, and a prefix that ends in padding is no phrase
    shorter = known.rollup("lang", *names[:-1]).agg(F.sum("f").alias("f")).filter(F.col("lang").isNotNull())
    words = F.array_compact(F.array(*names[:-1])).alias("words")
    shorter = shorter.select("lang", words, "f").filter((F.size("words") == 0) | ((F.col("f") >= least) & ~F.array_contains("words", PAD)))
    return top.unionByName(shorter)


def _looked_up(parts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``parts`` (lang, part, ..) with f of each part: frequent parts by broadcast, the others by a shuffle."""
    heavy = counts.filter(F.col("f") * HEAVY >= total)
    if held_bytes(heavy) > HEAVY_BYTES:
        return parts.join(counts, ["lang", "part"])
    heavy = F.broadcast(heavy)
    light = parts.join(heavy.select("lang", "part"), ["lang", "part"], "left_anti").join(counts, ["lang", "part"])
    return parts.join(heavy, ["lang", "part"]).unionByName(light)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) by whole decimals of 38 digits: exact up to counts of 10^15."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``best`` collocations of each lang, from (lang, text).

    Candidates are phrases of 2 to ``longest`` words with a count a of ``least`` or more; the cut with the lowest score counts
    (of equal ones the first), and candidates that stand inside a longer one with ``inside`` percent of their count are dropped.
    """
    phrases = stage(counted_phrases(docs, longest, least))
    counts = phrases.filter(F.size("words") > 0).select("lang", F.array_join("words", " ").alias("part"), "f")
    total = phrases.filter(F.size("words") == 0).agg(F.sum("f")).first()[0] or 0
    cands = phrases.filter(F.size("words") > 1).select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a"))
    halves = """flatten(transform(sequence(1, size(words) - 1), k -> array(
        named_struct('k', k, 'side', 0, 'part', array_join(slice(words, 1, k), ' ')),
        named_struct('k', k, 'side', 1, 'part', array_join(slice(words, k + 1, size(words)), ' ')))))"""
    parts = cands.select("lang", "phrase", "a", F.expr(f"inline({halves})"))
    cut = _looked_up(parts, counts, total).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("low")
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")

    subs = """flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))"""
    longer = cands.filter(F.size("words") > 2).select("lang", F.explode(F.expr(subs)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.filter(F.col("rank") <= best).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    n = phrases.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM p, (VALUES (1), (2), (3)) AS t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m >= 2 AND f >= 10),
k AS (SELECT lang, m, phrase, w, a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.phrase = array_to_string(w[1:k.k], ' ')
    JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.phrase = array_to_string(w[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE m = 3),
d AS (SELECT lang, phrase, max(a) AS most FROM h GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase AND b.m = 2 WHERE d.most IS NULL OR 100 * d.most < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""
