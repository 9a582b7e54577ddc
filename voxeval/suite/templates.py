"""Templates, alignment, atlases: R18-R25."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxeval import fixtures as fx
from voxeval.operators import templates as T
from voxeval.session import stage
from voxeval.suite.base import query
from voxeval.suite.masks import dilate_sql
from voxeval.suite.rasters import blur_sql

_NORMAL = "SELECT uid, z, y, x, v FROM voxels WHERE label < 5"
_MEAN = "SELECT z, y, x, avg(v) AS t FROM n GROUP BY z, y, x"


def sym_sql(src: str, w: int = 3) -> str:
    return f"SELECT a.z, a.y, a.x, (a.t + b.t) / 2e0 AS t FROM {src} a JOIN {src} b ON a.z = b.z AND a.y = b.y AND b.x = {w} - a.x"


def normals(spark, sf):
    return fx.voxels(spark, sf).where("label < 5").drop("label")


def template4(spark, sf):
    return stage(T.symmetrize(T.template_mean(normals(spark, sf)), 4))


@query("r18_template_mean", "z:i y:i x:i t:d6", _MEAN, ["voxels"], [("n", _NORMAL)])
def r18(spark, sf):
    return T.template_mean(normals(spark, sf))


@query("r19_symmetrize", "z:i y:i x:i t:d6", sym_sql("m"), ["voxels"], [("n", _NORMAL), ("m", _MEAN)])
def r19(spark, sf):
    return T.symmetrize(T.template_mean(normals(spark, sf)), 4)


_TPL = [("n", _NORMAL), ("m", _MEAN), ("tpl", sym_sql("m"))]
_R = "(sum(v * t) - sum(v) * sum(t) / count(*)) / (sqrt(sum(v * v) - sum(v) * sum(v) / count(*)) * sqrt(sum(t * t) - sum(t) * sum(t) / count(*)) + 1e-6)"


@query("r20_ncc", "uid:i ncc:d6", f"SELECT uid, {_R} AS ncc FROM voxels JOIN tpl USING (z, y, x) GROUP BY uid", ["voxels"], _TPL)
def r20(spark, sf):
    return T.ncc(fx.voxels(spark, sf), template4(spark, sf))


def moves_sql(src: str, tpl: str, flips: str, steps: str = "(-1), (0), (1)", start: str | None = None) -> str:
    """Best move per uid, zeros where a move leaves nothing, ties to nine digits by order; ``start`` holds earlier moves to refine."""
    frm, flip, add = f"{src} s, (VALUES {flips}) f(flip)", "flip", ("dz", "dy", "dx")
    if start:
        frm, flip, add = f"{src} s JOIN {start} f ON f.uid = s.uid", "f.flip", ("f.dz + i.dz", "f.dy + j.dy", "f.dx + k.dx")
    return f"""SELECT uid, flip, dz, dy, dx, ncc FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ncc DESC, flip, dz, dy, dx) AS r FROM (
        SELECT uid, flip, dz, dy, dx, round((ab - a * b / 64e0) / (sqrt(aa - a * a / 64e0) * sqrt(bb - b * b / 64e0) + 1e-6), 9) AS ncc FROM (
        SELECT m.uid, flip, dz, dy, dx, sum(v) AS a, sum(v * v) AS aa, sum(v * t) AS ab, any_value(b) AS b, any_value(bb) AS bb FROM (
        SELECT uid, flip, dz, dy, dx, z + dz AS z, y + dy AS y, CASE WHEN flip = 1 THEN 3 - x ELSE x END + dx AS x, v FROM (
        SELECT s.uid, s.z, s.y, s.x, s.v, {flip} AS flip, {add[0]} AS dz, {add[1]} AS dy, {add[2]} AS dx FROM {frm},
        (VALUES {steps}) i(dz), (VALUES {steps}) j(dy), (VALUES {steps}) k(dx))) m
        JOIN {tpl} p ON p.z = m.z AND p.y = m.y AND p.x = m.x, (SELECT sum(t) AS b, sum(t * t) AS bb FROM {tpl}) GROUP BY m.uid, flip, dz, dy, dx))) WHERE r = 1"""


def _smooth(src: str, sigma: float, keys: tuple, val: str) -> str:
    blurred = blur_sql(src, (sigma,) * 3, (4, 4, 4), "replicate", keys, val)
    return f"SELECT {''.join(k + ', ' for k in keys)}z, y, x, least(greatest(v, 0e0), 10e0) AS {val} FROM ({blurred})"


STEPS = ((-1, 0, 1),) * 3


@query("r21_align", "uid:i flip:i dz:i dy:i dx:i ncc:d6", moves_sql("voxels", "tpl", "(0), (1)"), ["voxels"], _TPL)
def r21(spark, sf):
    return T.align(fx.voxels(spark, sf), template4(spark, sf), fx.GRID4, T.shift_grid(STEPS))


@query("r21_aligned_ncc", "uid:i ncc:d6", f"SELECT uid, ncc FROM ({moves_sql('voxels', 'tpl', '(0), (1)')})", ["voxels"], _TPL)
def r21n(spark, sf):
    """The moved volume correlates with the template as its alignment says."""
    vox, tpl = fx.voxels(spark, sf).drop("label"), template4(spark, sf)
    moved = T.apply_moves(vox, stage(T.align(vox, tpl, fx.GRID4, T.shift_grid(STEPS))), fx.GRID4)
    return T.ncc(moved, tpl).withColumn("ncc", F.round("ncc", T.TIE_DIGITS))


@query("r21_align_two_levels", "uid:i flip:i dz:i dy:i dx:i ncc:d6", "SELECT * FROM fine_", ["voxels"], [
    *_TPL, ("v1", _smooth("voxels", 1.0, ("uid",), "v")), ("v2", _smooth("voxels", 0.5, ("uid",), "v")), ("t1", _smooth("tpl", 1.0, (), "t")), ("t2", _smooth("tpl", 0.5, (), "t")),
    ("coarse_", moves_sql("v1", "t1", "(0)", "(-2), (0), (2)")), ("fine_", moves_sql("v2", "t2", "", start="coarse_"))])
def r21f(spark, sf):
    """Blurred coarse moves of two voxels, refined by single steps on a sharper blur."""
    coarse = T.shift_grid(((-2, 0, 2), (-2, 0, 2), (-2, 0, 2)), (0,))
    return T.align(fx.voxels(spark, sf).drop("label"), template4(spark, sf), fx.GRID4, coarse, STEPS, (1.0, 0.5))


SCALES = (1.0, 0.8, 1.25)


def _scale_rows() -> str:
    """(scale, o, i, w) along one axis of four cells."""
    rows = []
    for c, f in enumerate(SCALES):
        for o in range(4):
            at = min(max((o - 1.5) / f + 1.5, 0.0), 3.0)
            low = int(at)
            rows += [f"({c}, {o}, {i}, {w!r}::DOUBLE)" for i, w in ((low, 1.0 - (at - low)), (low + 1, at - low)) if i < 4]
    return "(VALUES " + ", ".join(rows) + ")"


def _scored(src: str, tpl: str, n: int, moves: str, keep: int) -> str:
    """The best moves of each uid: volumes ``src`` (uid, scale, z, y, x, v) of n cells a side, ``moves`` (uid, scale, flip, dz, dy, dx)."""
    cells = f"{n ** 3}e0"
    return f"""SELECT uid, scale, flip, dz, dy, dx, ncc FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ncc DESC, scale, flip, dz, dy, dx) AS r FROM (
        SELECT uid, scale, flip, dz, dy, dx, round((ab - a * b / {cells}) / (sqrt(greatest(aa - a * a / {cells}, 0e0)) * sqrt(bb - b * b / {cells}) + 1e-6), 9) AS ncc FROM (
        SELECT m.uid, m.scale, flip, dz, dy, dx, sum(v) AS a, sum(v * v) AS aa, sum(v * t) AS ab FROM {src} s JOIN ({moves}) m ON m.uid = s.uid AND m.scale = s.scale
        JOIN {tpl} p ON p.z = s.z + dz AND p.y = s.y + dy AND p.x = CASE WHEN flip = 1 THEN {n - 1} - s.x ELSE s.x END + dx GROUP BY m.uid, m.scale, flip, dz, dy, dx),
        (SELECT sum(t) AS b, sum(t * t) AS bb FROM {tpl}))) WHERE r <= {keep}"""


_STEP = "(VALUES (-1), (0), (1))"
_ALL = f"SELECT DISTINCT uid, scale, flip, dz, dy, dx FROM sv, (VALUES (0), (1)) f(flip), {_STEP} i(dz), {_STEP} j(dy), {_STEP} k(dx)"
_NEXT = f"SELECT DISTINCT uid, scale, flip, 2 * b.dz + i.d AS dz, 2 * b.dy + j.d AS dy, 2 * b.dx + k.d AS dx FROM beam b, {_STEP} i(d), {_STEP} j(d), {_STEP} k(d)"


@query("r21_align_pyramid", "uid:i scale:i flip:i dz:i dy:i dx:i ncc:d6", "SELECT * FROM fine_", ["voxels"], [
    *_TPL, ("sw", f"SELECT * FROM {_scale_rows()} t(scale, o, i, w)"),
    ("sv", """SELECT v.uid, a.scale, a.o AS z, b.o AS y, c.o AS x, sum(v.v * a.w * b.w * c.w) AS v FROM voxels v JOIN sw a ON a.i = v.z
        JOIN sw b ON b.i = v.y AND b.scale = a.scale JOIN sw c ON c.i = v.x AND c.scale = a.scale GROUP BY v.uid, a.scale, a.o, b.o, c.o"""),
    ("sb", "SELECT uid, scale, z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM sv GROUP BY ALL"), ("tb", "SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(t) AS t FROM tpl GROUP BY ALL"),
    ("beam", _scored("sb", "tb", 2, _ALL, 3)), ("fine_", _scored("sv", "tpl", 4, _NEXT, 1))])
def r21p(spark, sf):
    """Three scales, flips and shifts on half resolution, three kept, refined at full resolution."""
    coarse = T.shift_grid(STEPS)
    return T.align_pyramid(fx.voxels(spark, sf).drop("label"), template4(spark, sf), fx.GRID4, coarse, STEPS, SCALES)


def _rounds(n: int) -> list[tuple[str, str]]:
    """Unrolled rounds of align, mean, symmetrise from ``tpl`` to ``tpl<n>``."""
    out, now = [], "tpl"
    for i in range(1, n + 1):
        out += [(f"mv{i}", moves_sql("n", now, "(0)")), (f"m{i}", f"""SELECT g.z, g.y, g.x, coalesce(s, 0e0) / (SELECT count(DISTINCT uid) FROM n) AS t FROM {now} g LEFT JOIN (
            SELECT n.z + dz AS z, n.y + dy AS y, n.x + dx AS x, sum(v) AS s FROM n JOIN mv{i} m ON m.uid = n.uid GROUP BY 1, 2, 3) a
            ON a.z = g.z AND a.y = g.y AND a.x = g.x"""), (f"tpl{i}", sym_sql(f"m{i}"))]
        now = f"tpl{i}"
    return out


@query("r22_build_template", "z:i y:i x:i t:d6", "SELECT * FROM tpl3", ["voxels"], [*_TPL, *_rounds(3)])
def r22(spark, sf):
    """Three rounds of align, mean, symmetrise."""
    return T.build_template(normals(spark, sf), fx.GRID4, T.shift_grid(STEPS, (0,)))


_T16 = "SELECT z, y, x, avg(v) AS t FROM stack16 GROUP BY z, y, x"
REACH = (6, 3, 3.6)
N_SIDE = 40


def _top(src: str) -> str:
    return f"""SELECT side, z, y, x, t FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY t DESC, z, y, x) AS r FROM (
        SELECT *, CASE WHEN x < 4 THEN 0 ELSE 3 END AS side FROM {src} WHERE abs(z - 8e0) < 6 AND abs(y - 4e0) < 3 AND abs(x - 4e0) < 36e-1)) WHERE r <= {N_SIDE}"""


def _lloyd(pts: str, iters: int = 20) -> list[tuple[str, str]]:
    """Unrolled two-means over (side, p, q)."""
    out = [("a0", f"SELECT *, CASE WHEN p < median(p) OVER (PARTITION BY side) THEN 0 ELSE 1 END AS k FROM {pts}")]
    for i in range(iters + 1):
        prev = f"SELECT side, k, cp, cq FROM c{i - 1}" if i else "SELECT NULL::INTEGER AS side, NULL::INTEGER AS k, NULL::DOUBLE AS cp, NULL::DOUBLE AS cq"
        out.append((f"c{i}", f"SELECT side, k, avg(p) AS cp, avg(q) AS cq FROM a{i} GROUP BY side, k UNION ALL SELECT * FROM ({prev}) o WHERE side IS NOT NULL "
                             f"AND NOT EXISTS (SELECT 1 FROM a{i} e WHERE e.side = o.side AND e.k = o.k)"))
        if i < iters:
            out.append((f"a{i + 1}", f"""SELECT t.side, t.z, t.y, t.x, t.p, t.q, CASE WHEN power(t.p - l.cp, 2e0) + power(t.q - l.cq, 2e0)
                <= power(t.p - h.cp, 2e0) + power(t.q - h.cq, 2e0) THEN 0 ELSE 1 END AS k FROM {pts} t JOIN c{i} l ON l.side = t.side AND l.k = 0
                JOIN c{i} h ON h.side = t.side AND h.k = 1"""))
    out.append(("fin", f"""SELECT a.*, a.k = (CASE WHEN l.cp - 5e-1 * l.cq <= h.cp - 5e-1 * h.cq THEN 0 ELSE 1 END) AS first FROM a{iters} a
        JOIN c{iters} l ON l.side = a.side AND l.k = 0 JOIN c{iters} h ON h.side = a.side AND h.k = 1"""))
    return out


def _points(src: str) -> str:
    return f"SELECT side, z, y, x, abs(x - 35e-1) AS p, y::DOUBLE AS q FROM ({_top(src)})"


def template16(spark, sf):
    return T.template_mean(fx.stack16(spark, sf))


@query("r23_topn_region", "side:i z:i y:i x:i t:d6", _top("t16"), ["stack16"], [("t16", _T16)])
def r23(spark, sf):
    return T.topn_region(template16(spark, sf), fx.STACK16, N_SIDE, REACH)


@query("r24_grouped_2means", "side:i z:i y:i x:i k:i first:b", "SELECT * FROM fin", ["stack16"], [("t16", _T16), ("pts", _points("t16")), *_lloyd("pts")])
def r24(spark, sf):
    top = T.topn_region(template16(spark, sf), fx.STACK16, N_SIDE, REACH)
    return T.grouped_2means(top.select("side", "z", "y", "x", F.abs(F.col("x") - 3.5).alias("p"), F.col("y").cast("double").alias("q")))


@query("r25_build_atlas", "z:i y:i x:i code:i", """SELECT z, y, x, code FROM zones UNION ALL SELECT z, y, x, 9 FROM far
    WHERE (SELECT count(*) FROM far WHERE strict) < 10 OR strict""", ["stack16"], [
    ("t0", _T16), ("t16", blur_sql("t0", (0.7, 0.7, 0.7), (16, 8, 8), "reflect", (), "t")),
    ("t", "SELECT z, y, x, v AS t FROM t16"), ("pts", _points("t")), *_lloyd("pts"),
    ("zones", """SELECT z, y, x, side + CASE WHEN first THEN 1 WHEN y >= ym THEN 2 ELSE 3 END AS code FROM fin
        LEFT JOIN (SELECT side AS s, median(y) AS ym FROM fin WHERE NOT first GROUP BY side) ON s = side"""),
    *[(f"near{i}" if i < 4 else "near", dilate_sql(f"near{i - 1}" if i > 1 else "(SELECT 0 AS uid, z, y, x FROM zones)")) for i in range(1, 5)],
    ("far", """SELECT z, y, x, y < 24e-1 AND abs(z - 8e0) < 6 AS strict FROM t WHERE t > 7e-1 AND t < (SELECT quantile_cont(t, 9e-1) FROM t)
        AND NOT EXISTS (SELECT 1 FROM near n WHERE n.z = t.z AND n.y = t.y AND n.x = t.x)"""),
])
def r25(spark, sf):
    return T.build_atlas(template16(spark, sf), fx.STACK16, N_SIDE, REACH, ref_depth=6.0, ref_least=10)
