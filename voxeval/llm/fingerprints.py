"""Document fingerprints as invertible Bloom lookup sketches.

A document is the set of digests of its paragraphs (lines, and the sentences of a line). Its sketch is a table of cells;
each digest enters three of them, which hold a count, the exclusive or of digests and the exclusive or of their checks. Two
versions subtract cell by cell: what they share cancels, and a cell with one digest left gives it away. Peeling takes such
digests out of their other cells until the table is empty, which recovers exactly the paragraphs that differ. A table that
does not empty is too small: digests are then dealt into shards, as many as the paragraphs need, and a shard whose table does
not empty takes ever larger ones. The likeness is the Jaccard similarity of the paragraph sets.

All of it is column expressions of one row; only the texts of a document and its successor are brought together.
Defined cases: a null or blank text has no paragraphs; two such texts have likeness 1, one and another 0; a repeated paragraph
counts once; equal texts have equal fingerprints; repeated rows follow each other in the order of their places; a
null doc_id comes last; a single document is its own successor; an empty table has an empty result; other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxeval.session import stage

from .base import files_only, full_text, located

#: Cells of a third of the fingerprint, and of a third of the tables that a shard tries one after the other.
BASE_THIRD, SHARD_THIRDS = 5, (5, 20, 96, 384, 1536)
#: Digests of both versions together that a shard takes on average.
LOAD = 7
ROUNDS = 10
#: Shards that are dealt out in one step; more than that are dealt in two.
INNER = 64
PARAGRAPHS = r"(?<=[.!?])\s+|[\r\n]+"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    parts = F.filter(F.transform(F.split(text, PARAGRAPHS), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(k: str) -> str:
    return f"(xxhash64({k}, 99) & 4294967295L)"


def _entry(k: str, count: str, third: int, salt: int) -> str:
    """A digest with its check, its sign and its cell in each third of the table."""
    at = [f"cast(pmod(shiftright(xxhash64({k}, {salt}), {20 * t}), {third}) as int)" for t in range(3)]
    return f"named_struct('k', {k}, 'h', {_check(k)}, 'c', {count}, 'p0', {at[0]}, 'p1', {at[1]}, 'p2', {at[2]})"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cells_sql(keys: str, third: int, salt: int) -> str:
    """Cells (c, k, h) of an array of digests."""
    one = "named_struct('c', s.c + 1, 'k', s.k ^ e.k, 'h', s.h ^ e.h)"
    zero = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
    parts = [f"transform(sequence(0, {third - 1}), i -> aggregate(filter(es, e -> e.p{t} = i), {zero}, (s, e) -> {one}))" for t in range(3)]
    return _let("es", f"transform({keys}, d -> {_entry('d', '1', third, salt)})", f"concat({', '.join(parts)})")


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel_sql(cells: str, third: int, salt: int) -> str:
    """The digests in which two versions differ, or null if the table does not empty."""
    pure = f"array_distinct(transform(filter(st.cells, x -> abs(x.c) = 1 and x.h = {_check('x.k')}), x -> {_entry('x.k', 'x.c', third, salt)}))"
    less = "named_struct('c', s.c - q.c, 'k', s.k ^ q.k, 'h', s.h ^ q.h)"
    parts = [f"transform(slice(st.cells, {t * third + 1}, {third}), (x, i) -> aggregate(filter(ps, q -> q.p{t} = i), x, (s, q) -> {less}))" for t in range(3)]
    after = f"concat({', '.join(parts)})"
    stop = "named_struct('cells', st.cells, 'got', st.got, 'stop', true)"
    nxt = f"if(size(ps) = 0, {stop}, named_struct('cells', {after}, 'got', concat(st.got, transform(ps, q -> q.k)), 'stop', false))"
    start = f"named_struct('cells', {cells}, 'got', cast(array() as array<bigint>), 'stop', false)"
    done = f"aggregate(sequence(1, {ROUNDS}), {start}, (st, n) -> if(st.stop, st, {_let('ps', pure, nxt)}))"
    return _let("fin", done, "if(exists(fin.cells, x -> x.c != 0 or x.k != 0 or x.h != 0), cast(null as array<bigint>), fin.got)")


def larger_sql(a: str, b: str) -> str:
    """Number of differing digests by tables that grow with the paragraphs, or null.

    Digests are dealt into shards by their hash; a shard whose table does not empty takes the next larger one. Shards are
    dealt in two steps, so that a long document is not filtered once per shard.
    """
    shards = f"cast(ceil((size({a}) + size({b})) / {LOAD}) as int)"
    inner = f"least({INNER}, greatest(1, {shards}))"
    outer = f"greatest(1, cast(ceil({shards} / {INNER}) as int))"
    group, shard = "pmod(xxhash64(d, 1), go)", "pmod(xxhash64(d, 2), si)"
    tries = [f"array_size({peel_sql(subtract_sql(cells_sql('sa', t, 10 + n), cells_sql('sb', t, 10 + n)), t, 10 + n)})" for n, t in enumerate(SHARD_THIRDS)]
    one = _let("sa", f"filter(ga, d -> {shard} = j)", _let("sb", f"filter(gb, d -> {shard} = j)", f"coalesce({', '.join(tries)})"))
    parts = f"transform(sequence(0, si - 1), j -> {one})"
    groups = f"transform(sequence(0, go - 1), g -> {_let('ga', f'filter({a}, d -> {group} = g)', _let('gb', f'filter({b}, d -> {group} = g)', parts))})"
    every = _let("si", inner, _let("go", outer, f"flatten({groups})"))
    return _let("ns", every, "if(exists(ns, x -> x is null), cast(null as int), aggregate(ns, 0, (s, x) -> s + x))")


def differing_sql(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """Number of digests that only one version has: by the fingerprints, then by larger tables if they are too small."""
    first = _let("got", peel_sql(subtract_sql(cells_a, cells_b), BASE_THIRD, 0), "if(got is null, cast(null as int), size(got))")
    return f"coalesce({first}, {larger_sql(a, b)})"


def likeness_sql(a: str, b: str, differ: str) -> str:
    total = f"(size({a}) + size({b}))"
    return f"if({total} = 0, 1D, ({total} - {differ}) / cast({total} + {differ} as double))"


def sketch_text(keys: str, cells: str) -> str:
    """The fingerprint: number of digests, then count:digests:checks of each cell in hexadecimal."""
    return f"concat(size({keys}), '|', array_join(transform({cells}, x -> concat(x.c, ':', lower(hex(x.k)), ':', lower(hex(x.h)))), ','))"


def successors(slim: DataFrame) -> DataFrame:
    """_file, _row, next_file, next_row: the next row by descending doc_id (then by place); the last one's is the first.

    Rows are ordered by range partitioning; only the first row of each partition is looked at together.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("_file"), F.col("_row")]
    ranged = stage(slim.select("doc_id", "_file", "_row").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    place = F.struct("_file", "_row")
    rows = ranged.select("part", "_file", "_row", F.row_number().over(inside).alias("n"), F.lead(place).over(inside).alias("follow"))
    heads = rows.filter("n = 1").select("part", place.alias("head"))
    parts = Window.orderBy("part")  # one row per partition
    nexts = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("jump"))
    joined = rows.join(nexts, "part").withColumn("f", F.coalesce("follow", "jump"))
    return joined.select("_file", "_row", F.col("f._file").alias("next_file"), F.col("f._row").alias("next_row"))


def versions(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited text's sha, and the paragraph digests own, edited and following."""
    docs = files_only(docs, ["doc_id", "text"])
    body = full_text()
    slim = stage(located(docs).select("doc_id", "_file", "_row", F.char_length(body).cast("long").alias("n_chars")))
    wanted = slim.join(successors(slim), ["_file", "_row"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # each row is the successor of one other, which asks for the start of its text
    asked = wanted.select(F.col("next_file").alias("_f"), F.col("next_row").alias("_r"), F.col("_file").alias("by_file"), F.col("_row").alias("by_row"),
                          F.col("doc_id").alias("by_id"), third.alias("need"))
    texts = located(docs).select("_file", "_row", body.alias("body"))  # the same columns in both joins: one exchange serves both
    held = texts.join(asked, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")))
    gifts = held.select("by_file", "by_row", "by_id", F.expr("left(body, need)").alias("start"), digests(F.col("body")).alias("following"))
    both = texts.join(gifts, (F.col("_file") == F.col("by_file")) & (F.col("_row") == F.col("by_row")))
    n = F.char_length("body")
    edited = F.concat(F.expr("left(body, char_length(body) - cast(floor(char_length(body) / 3) as int))"), "start")
    both = both.select(F.col("by_id").alias("doc_id"), n.cast("long").alias("n_chars"), digests(F.col("body")).alias("own"), edited.alias("edited"), "following")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), "following")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = stage(versions(docs))
    for name in ("own", "changed", "following"):
        rows = rows.withColumn(f"cells_{name}", F.expr(cells_sql(name, BASE_THIRD, 0)))
    rows = rows.withColumn("d_edited", F.expr(differing_sql("own", "changed", "cells_own", "cells_changed")))
    rows = rows.withColumn("d_next", F.expr(differing_sql("own", "following", "cells_own", "cells_following")))
    failed = F.raise_error(F.lit("a sketch did not empty in its largest table"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(sketch_text("own", "cells_own")).alias("fingerprint"), F.expr(sketch_text("changed", "cells_changed")).alias("edited_fingerprint"),
        F.when(F.col("d_edited").isNull(), failed).otherwise(F.expr(likeness_sql("own", "changed", "d_edited"))).alias("near_edited"),
        F.when(F.col("d_next").isNull(), failed).otherwise(F.expr(likeness_sql("own", "following", "d_next"))).alias("near_next"),
    )
