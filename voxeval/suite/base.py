"""Registry, comparison rules, and the SQL text of the fixtures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Spec = list[tuple[str, str]]


def parse(spec: str) -> Spec:
    return [tuple(item.split(":")) for item in spec.split()]


def finish(df: DataFrame, spec: Spec) -> DataFrame:
    """Declared columns and types; doubles rounded, minus zero removed."""
    def one(name, kind):
        c = F.col(name)
        if kind == "s":
            return c.cast("string").alias(name)
        if kind == "i":
            return c.cast("long").alias(name)
        if kind == "b":
            return c.cast("boolean").alias(name)
        return (F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, k) for n, k in spec])


def finish_sql(spec: Spec) -> str:
    def one(name, kind):
        if kind == "s":
            return f"CAST({name} AS VARCHAR) AS {name}"
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind == "b":
            return f"CAST({name} AS BOOLEAN) AS {name}"
        return f"round(CAST({name} AS DOUBLE), {kind[1:] or 6}) + 0.0 AS {name}"

    return ", ".join(one(n, k) for n, k in spec)


def u(*parts: str) -> str:
    """Hashed uniform; parts are SQL text, quoted literals included."""
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296e0)"


def hash_int(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT)"


def fold_sql(strata: Sequence[str], k: str, seed: str, uid: str = "uid") -> str:
    by = ", ".join(strata)
    start = hash_int(*[f"({s})::VARCHAR" for s in strata], seed)
    return f"((row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('-', {uid}, {seed})), {uid}) - 1 + {start} % {k}) % {k})"


def sig(z: str) -> str:
    return f"(1e0 / (1e0 + exp(-({z}))))"


def clip(p: str, lo: str, hi: str) -> str:
    return f"least(greatest({p}, {lo}), {hi})"


def loss(y: str, p: str) -> str:
    q = clip(p, "1e-15", "(1e0 - 1e-15)")
    return f"(-(({y}) * ln({q}) + (1e0 - ({y})) * ln(1e0 - {q})))"


def _voxel_cte(uid: str, z: str, y: str, x: str) -> str:
    return (
        f"SELECT {uid} AS uid, label, ({z})::INTEGER AS z, ({y})::INTEGER AS y, ({x})::INTEGER AS x, "
        "greatest(0e0, 1e0 + e::DOUBLE * 4e0) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, "
        "generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"
    )


_SLOPES = "(VALUES ('cnn1', 2e0), ('cnn2', 18e-1), ('gbm', 15e-1), ('lr', 12e-1)) f(family, slope)"

# name: (needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "subjects": ((), f"""SELECT *, CASE WHEN x + ({u("uid", "'y'")} - 5e-1) * 2e0 > 0 THEN 1 ELSE 0 END AS y FROM (
        SELECT o_orderkey::VARCHAR AS uid, (o_totalprice - 250000e0) / 144000e0 AS x, 15e-1 + 1e-1 * c_nationkey AS zoom,
        (round_even((15e-1 + 1e-1 * c_nationkey) * 10e0, 0) / 10e0)::VARCHAR AS zfam, concat_ws('_', c_mktsegment, c_nationkey::VARCHAR) AS grp,
        o_custkey::VARCHAR AS cust, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey)"""),
    "scans": (("subjects",), f"""SELECT uid, pos, y, CASE WHEN {u("uid", "'ok'")} < 1e-2 THEN 0 ELSE 1 END AS ok, zoom AS zoom_x, zoom AS zoom_y,
        2e0 + (pos % 3) * 5e-1 AS zoom_z, 64 + 32 * (pos % 3) AS shape_x, 64 + 32 * (pos % 3) AS shape_y, 48 + 8 * (pos % 3) AS shape_z,
        CASE WHEN {u("uid", "'note'")} < 2e-2 THEN 2 ELSE 0 END AS loc_note FROM subjects"""),
    "folded": (("subjects",), f"""SELECT *, {fold_sql(["run", "y"], "k", "split::VARCHAR")}::INTEGER AS fold FROM subjects,
        (VALUES ('a', 2026, 5), ('b', 7, 5), ('c', 2026, 10)) r(run, split, k)"""),
    "raw_oof": (("folded",), f"""SELECT uid, y, grp, run, split, k, fold, family, seed, family || '_s' || seed || '_f' || fold AS file,
        slope * x + ({u("uid", "run", "family", "seed::VARCHAR")} - 5e-1) * 15e-1 AS z FROM folded, {_SLOPES}, (VALUES (0), (1), (2)) s(seed)"""),
    "wide_oof": (("raw_oof", "folded"), """SELECT w.*, s.x, s.zoom, s.zfam, s.pos, (cnn1 + cnn2) / 2e0 AS cnn FROM (
        SELECT uid, any_value(y) AS y, any_value(grp) AS grp, any_value(fold) AS fold, avg(z) FILTER (family = 'cnn1') AS cnn1,
        avg(z) FILTER (family = 'cnn2') AS cnn2, avg(z) FILTER (family = 'gbm') AS gbm, avg(z) FILTER (family = 'lr') AS lr
        FROM raw_oof WHERE run = 'a' GROUP BY uid) w JOIN folded s ON s.uid = w.uid AND s.run = 'a'"""),
    "voxels": ((), _voxel_cte("vec_id", "p // 16", "(p // 4) % 4", "p % 4")),
    "planes": ((), _voxel_cte("vec_id", "0", "p // 8", "p % 8")),
    "stack16": ((), _voxel_cte("vec_id // 16", "vec_id % 16", "p // 8", "p % 8")),
    "cube16": ((), _voxel_cte("vec_id // 64", "(vec_id % 64 * 64 + p) // 256", "((vec_id % 64 * 64 + p) // 16) % 16", "(vec_id % 64 * 64 + p) % 16")),
    "stored": ((), """SELECT c // 358400 AS uid, ((c % 358400) // 6400)::INTEGER AS z, (((c % 358400) // 80) % 80)::INTEGER AS y, (c % 80)::INTEGER AS x, v FROM (
        SELECT (l_orderkey * 8 + l_linenumber) * 3 + i AS c, max(v) AS v FROM (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS i, unnest([l_extendedprice::DOUBLE / 1e4,
        l_quantity::DOUBLE / 10e0, l_discount::DOUBLE * 10e0 + l_tax::DOUBLE]) AS v FROM lineitem) GROUP BY 1)"""),
    "frames": (("voxels",), f"""SELECT uid, t, z, y, x, CASE WHEN r < 1e-2 THEN 'NaN'::DOUBLE WHEN r < 2e-2 THEN 'Infinity'::DOUBLE
        WHEN r < 5e-2 THEN -w - 5e0 ELSE w END AS v FROM (SELECT uid, t, z, y, x, v * (1e0 + 1e-1 * t) AS w,
        {u("uid::VARCHAR", "t::VARCHAR", "z::VARCHAR", "y::VARCHAR", "x::VARCHAR", "'bad'")} AS r FROM voxels, (VALUES (0), (1), (2)) f(t))"""),
    "atlas4": (("voxels",), """SELECT DISTINCT z, y, x, CASE WHEN z = 0 THEN 9 WHEN x < 2 THEN (y * 3) // 4 + 1 ELSE (y * 3) // 4 + 4 END AS code
        FROM voxels"""),
    "shifts": ((), f"""SELECT user_id::VARCHAR AS uid, event_type AS kind, CASE WHEN {u("event_id::VARCHAR", "'n'")} >= 2e-2 THEN value END AS mm
        FROM events"""),
    "features": ((), f"""SELECT d.doc_id::VARCHAR AS uid, quality AS y, source AS grp, lang AS zfam, ln(n_chars::DOUBLE) AS f_len,
        ln(words) AS f_words, n_chars / words / 10e0 AS f_ratio,
        CASE WHEN {u("d.doc_id::VARCHAR", "'nan'")} < 5e-2 THEN 'NaN'::DOUBLE ELSE ln(words) END AS f_spare,
        15e-1 + {u("d.doc_id::VARCHAR", "'zoom'")} * 2e0 AS zoom, (d.doc_id % 5)::INTEGER AS fold
        FROM (SELECT *, len(string_split(text, ' '))::DOUBLE AS words FROM documents) d JOIN labels l ON l.doc_id = d.doc_id"""),
}


def with_clause(needs: Sequence[str], extra: Sequence[tuple[str, str]] = (), recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n):
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({t})" if recursive and n.startswith("reach") else f"{n} AS MATERIALIZED ({t})" for n, t in extra]
    if not parts:
        return ""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def query(name: str, spec: str, body: str | None = None, needs: Sequence[str] = (), extra: Sequence[tuple[str, str]] = (), recursive: bool = False):
    """Register a query; ``body`` is the SQL whose rows it must equal, ``extra`` further CTEs."""
    cols = parse(spec)

    def deco(fn):
        QUERIES[name] = lambda spark, sf: finish(fn(spark, sf), cols)
        if body is not None:
            ORACLES[name] = with_clause(needs, extra, recursive) + f"SELECT {finish_sql(cols)} FROM ({body}) _q"
        return fn

    return deco


def auc_sql(src: str, by: Sequence[str], y: str = "y", z: str = "z") -> str:
    """Tie-averaged rank form of the area."""
    keys = ", ".join(by)
    part = f"PARTITION BY {keys} " if by else ""
    tie = f"PARTITION BY {', '.join([*by, z])}"
    lead = f"{keys}, " if by else ""
    group = f" GROUP BY {keys}" if by else ""
    return (
        f"SELECT {lead}(sum(r) FILTER ({y} = 1) - p * (p + 1e0) / 2e0) / (p * q) AS auc FROM (SELECT {lead}{y}, "
        f"rank() OVER ({part}ORDER BY {z}) + (count(*) OVER ({tie}) - 1) / 2e0 AS r, "
        f"sum({y}) OVER ({part.strip()})::DOUBLE AS p, sum(1 - {y}) OVER ({part.strip()})::DOUBLE AS q FROM {src}){group}"
        f"{', p, q' if by else ' GROUP BY p, q'}"
    )


def newton_ctes(p: str, src: str, xcols: Sequence[str], configs: str, keys: Sequence[str], cond: str, lam: Sequence[str], y: str = "y",
                center: Sequence[str] | None = None, per_row: bool = False, w: str = "1e0", iters: int = 10) -> list[tuple[str, str]]:
    """Unrolled Newton iterations of a penalised logistic fit; the last CTE is ``<p>_b<iters>``."""
    d = len(xcols) + 1
    center = list(center or ["0e0"] * d)
    xs = [f"r.{c}" for c in xcols] + ["1e0"]
    k = ", ".join(keys)
    out = [(f"{p}_b0", f"SELECT {k}, {', '.join(f'{center[j]} AS b{j}' for j in range(d))} FROM ({configs})")]
    for i in range(1, iters + 1):
        b = f"{p}_b{i - 1}"
        z = " + ".join(f"c.b{j} * {xs[j]}" for j in range(d))
        gs = [f"sum(w * (p - y) * x{j}) AS g{j}" for j in range(d)]
        hs = [f"sum(w * p * (1e0 - p) * x{a} * x{c}) AS h{a}_{c}" for a in range(d) for c in range(a, d)]
        inner = f"SELECT {', '.join('c.' + q for q in keys)}, ({y})::DOUBLE AS y, {w} AS w, {sig(z)} AS p, " + ", ".join(
            f"{xs[j]} AS x{j}" for j in range(d)) + f" FROM {src} r JOIN {b} c ON {cond}"
        out.append((f"{p}_s{i}", f"SELECT {k}, sum(w) AS n, {', '.join(gs + hs)} FROM ({inner}) GROUP BY {k}"))
        lams = [f"({v}){' * s.n' if per_row else ''}" for v in lam]
        cells = []
        for a in range(d):
            for c in range(d):
                h = f"s.h{min(a, c)}_{max(a, c)}" + (f" + {lams[a]}" if a == c else "")
                cells.append(f"{h} AS m{a}_{c}")
            cells.append(f"-(s.g{a} + {lams[a]} * (c.b{a} - ({center[a]}))) AS m{a}_{d}")
        bs = ", ".join(f"b{j}" for j in range(d))
        on = " AND ".join(f"s.{q} = c.{q}" for q in keys)
        sql = f"SELECT {', '.join('c.' + q for q in keys)}, {', '.join('c.b%d' % j for j in range(d))}, {', '.join(cells)} FROM {p}_s{i} s JOIN {b} c ON {on}"
        for piv in range(d):
            rows = []
            for a in range(d):
                for c in range(d + 1):
                    e = f"m{a}_{c}" if a == piv else f"m{a}_{c} - m{a}_{piv} / m{piv}_{piv} * m{piv}_{c}"
                    rows.append(f"{e} AS m{a}_{c}")
            sql = f"SELECT {k}, {bs}, {', '.join(rows)} FROM ({sql})"
        out.append((f"{p}_b{i}", f"SELECT {k}, {', '.join(f'b{j} + m{j}_{d} / m{j}_{j} AS b{j}' for j in range(d))} FROM ({sql})"))
    return out
