"""Templates, alignment scores and atlases."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxeval.operators.joins import argbest_candidate, mirror_mean
from voxeval.operators.masks import dilate
from voxeval.operators.rasters import AXES, Grid, gaussian_blur, inside
from voxeval.plans.bounded import lookup_join, with_grid
from voxeval.plans.ranking import top_k
from voxeval.plans.volumes import Arrays, coordinates, dense, per_volume, sampled
from voxeval.session import stage

# Fixed values of scores and of the atlas.
NCC_GUARD = 1e-6
TIE_DIGITS = 9  # scores equal to nine digits are ties: a symmetric template cannot tell mirrored moves apart
ZONES = {1: "caud", 2: "put_ant", 3: "put_post"}
REFERENCE = 9
SECOND_SIDE = 3


def template_mean(voxels: DataFrame) -> DataFrame:
    """Voxel-wise mean over volumes (R18); filter the volumes first, e.g. to training normals."""
    return voxels.groupBy(*AXES).agg(F.avg("v").alias("t"))


def symmetrize(template: DataFrame, width: int) -> DataFrame:
    """Half the template plus half its mirror."""
    return mirror_mean(template.withColumnRenamed("t", "v"), width, ()).withColumnRenamed("v", "t")


def _ncc(n: Column, a: Column, aa: Column, b: Column, bb: Column, ab: Column) -> Column:
    va, vb = F.greatest(aa - a * a / n, F.lit(0.0)), F.greatest(bb - b * b / n, F.lit(0.0))
    return (ab - a * b / n) / (F.sqrt(va) * F.sqrt(vb) + NCC_GUARD)


def ncc(voxels: DataFrame, template: DataFrame) -> DataFrame:
    """Normalised cross correlation of each volume with a template (R20), one pass of sums."""
    j = lookup_join(voxels, template, list(AXES))
    v, t = F.col("v"), F.col("t")
    g = j.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("a"), F.sum(v * v).alias("aa"), F.sum(t).alias("b"), F.sum(t * t).alias("bb"), F.sum(v * t).alias("ab")
    )
    return g.select("uid", _ncc(*[F.col(c) for c in ("n", "a", "aa", "b", "bb", "ab")]).alias("ncc"))


def shift_grid(steps: Sequence[Sequence[int]], flips: Sequence[int] = (0, 1)) -> list[dict]:
    """Candidate moves in a fixed order: for each flip, every (dz, dy, dx)."""
    moves = [(f, a, b, c) for f in flips for a in steps[0] for b in steps[1] for c in steps[2]]
    return [{"cand": i, "flip": f, "dz": a, "dy": b, "dx": c} for i, (f, a, b, c) in enumerate(moves)]


MOVE = ("flip", "dz", "dy", "dx")


def _moved(rows: DataFrame, grid: Grid, keep: Sequence[str]) -> DataFrame:
    x = F.when(F.col("flip") == 1, F.lit(grid[2] - 1) - F.col("x")).otherwise(F.col("x"))
    at = [F.col("z") + F.col("dz"), F.col("y") + F.col("dy"), x + F.col("dx")]
    return rows.select(*keep, *[a.alias(c) for a, c in zip(at, AXES)], "v").where(inside(grid))


def _score_moves(rows: DataFrame, template: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """NCC per uid and candidate; places a move leaves empty are zeros, so their sums are known."""
    n = grid[0] * grid[1] * grid[2]
    tot = template.agg(F.sum("t").alias("b"), F.sum(F.col("t") * F.col("t")).alias("bb")).first()
    j = lookup_join(_moved(rows, grid, keys), template, list(AXES))
    v, t = F.col("v"), F.col("t")
    g = j.groupBy(*keys).agg(F.sum(v).alias("a"), F.sum(v * v).alias("aa"), F.sum(v * t).alias("ab"))
    score = _ncc(F.lit(float(n)), F.col("a"), F.col("aa"), F.lit(tot["b"]), F.lit(tot["bb"]), F.col("ab"))
    return g.select(*keys, F.round(score, TIE_DIGITS).alias("ncc"))


def align(voxels: DataFrame, template: DataFrame, grid: Grid, coarse: Sequence[dict], fine: Sequence[Sequence[int]] | None = None,
          sigmas: tuple[float, float] | None = None) -> DataFrame:
    """Best scoring flip and shift of each volume (R21): uid, flip, dz, dy, dx, ncc.

    Candidates meet the template inside the scan stage (size-checked lookup) and collapse to
    three sums per uid and candidate before any shuffle. The optional second level refines
    the winner by small steps; blurs of the two levels are clipped to [0, 10].
    """
    def smooth(df, col, sigma, keys):
        b = gaussian_blur(df.withColumnRenamed(col, "v"), (sigma,) * 3, grid, "replicate", keys)
        return b.select(*keys, *AXES, F.least(F.greatest("v", F.lit(0.0)), F.lit(10.0)).alias(col))

    vox, tpl = (voxels, template) if sigmas is None else (smooth(voxels, "v", sigmas[0], ["uid"]), stage(smooth(template, "t", sigmas[0], [])))
    keys = ["uid", "cand", *MOVE]
    best = argbest_candidate(_score_moves(with_grid(vox, coarse), tpl, grid, keys), "ncc", "cand")
    if fine is None:
        return best.select("uid", *MOVE, "ncc")
    best = stage(best)
    if sigmas is not None:
        vox, tpl = smooth(voxels, "v", sigmas[1], ["uid"]), stage(smooth(template, "t", sigmas[1], []))
    deltas = [{"cand": i, "ez": a, "ey": b, "ex": c} for i, (a, b, c) in enumerate((a, b, c) for a in fine[0] for b in fine[1] for c in fine[2])]
    rows = with_grid(vox.join(best.select("uid", *MOVE), "uid"), deltas)
    for c in AXES:
        rows = rows.withColumn(f"d{c}", F.col(f"d{c}") + F.col(f"e{c}"))
    return argbest_candidate(_score_moves(rows, tpl, grid, keys), "ncc", "cand").select("uid", *MOVE, "ncc")


def scaled(voxels: DataFrame, grid: Grid, scales: Sequence[float]) -> DataFrame:
    """Each volume at every scale about the grid's centre (column ``scale``: its number), with the border going on beyond the grid."""
    mid = [(n - 1) / 2.0 for n in grid]

    def every(a: Arrays) -> Arrays:
        v, parts = dense(a, grid), []
        for f in scales:
            offset = np.array([m - m / f for m in mid])
            parts.append((v if f == 1.0 else sampled(v, np.eye(3) / f, offset, grid, "nearest")).ravel())
        at = coordinates(np.tile(np.arange(v.size), len(scales)), grid)
        return {"scale": np.repeat(np.arange(len(scales)), v.size)} | at | {"v": np.concatenate(parts)}

    return per_volume(voxels.select("uid", *AXES, "v"), every, [("scale", "int"), *[(c, "int") for c in AXES], ("v", "double")])


def beam(scores: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best moves of each volume; equal scores in the order of scale, flip and shifts."""
    order = [F.desc("ncc"), *[F.asc(c) for c in ("scale", *MOVE)]]
    return top_k(scores, ["uid"], order, keep).drop("_r")


def align_pyramid(voxels: DataFrame, template: DataFrame, grid: Grid, coarse: Sequence[dict], fine: Sequence[Sequence[int]], scales: Sequence[float] = (1.0,),
                  factor: int = 2, keep: int = 3) -> DataFrame:
    """Best scale, flip and shift of each volume by a beam search over two resolutions (R21): uid, scale, flip, dz, dy, dx, ncc.

    All scales x ``coarse`` moves are scored on block means of ``factor`` cells (shifts in blocks), so a move costs factor^3
    times less there; the ``keep`` best go on to full resolution, each with all ``fine`` steps around it. A move that two of
    them reach is scored once. ``scale`` is the number of the scale.
    """
    moved = stage(scaled(voxels, grid, scales))
    blocks = [F.floor(F.col(c) / F.lit(factor)).cast("int").alias(c) for c in AXES]
    small = moved.groupBy("uid", "scale", *blocks).agg(F.avg("v").alias("v"))
    tiny = stage(template.groupBy(*blocks).agg(F.avg("t").alias("t")))
    keys = ["uid", "scale", *MOVE]
    low = tuple(-(-n // factor) for n in grid)
    best = beam(_score_moves(with_grid(small, coarse), tiny, low, keys), keep)
    steps = [{"ez": a, "ey": b, "ex": c} for a in fine[0] for b in fine[1] for c in fine[2]]
    tried = with_grid(best.select(*keys), steps)
    tried = tried.select("uid", "scale", "flip", *[(F.col(f"d{c}") * factor + F.col(f"e{c}")).alias(f"d{c}") for c in AXES]).distinct()
    return beam(_score_moves(moved.join(tried, ["uid", "scale"]), template, grid, keys), 1)


def apply_moves(voxels: DataFrame, moves: DataFrame, grid: Grid) -> DataFrame:
    """Voxels at their aligned position; the places that the move leaves empty are zeros, as ``align`` scores them."""
    moves = moves.select("uid", *MOVE)
    d, h, w = grid
    at = F.explode(F.sequence(F.lit(0), F.lit(d * h * w - 1)))
    cells = moves.select("uid", *MOVE, at.alias("_p")).select("uid", *MOVE, *[e.alias(c) for c, e in zip(AXES, (
        F.floor(F.col("_p") / (h * w)).cast("int"), F.floor(F.col("_p") / w).cast("int") % h, F.col("_p") % w))])
    kept = [(F.col(c) - F.col(f"d{c}")).between(0, n - 1) for c, n in zip(AXES, grid)]
    emptied = cells.where(~(kept[0] & kept[1] & kept[2])).select("uid", *AXES, F.lit(0.0).alias("v"))
    return _moved(voxels.join(moves, "uid"), grid, ["uid"]).unionByName(emptied)


def build_template(voxels: DataFrame, grid: Grid, candidates: Sequence[dict], n_iter: int = 3) -> DataFrame:
    """Mean, symmetrise, then align, mean and symmetrise again n_iter times (R22); staged per round."""
    n = voxels.select("uid").distinct().count()
    tpl = stage(symmetrize(template_mean(voxels), grid[2]))
    for _ in range(n_iter):
        moved = apply_moves(voxels, align(voxels, tpl, grid, candidates), grid)
        sums = moved.groupBy(*AXES).agg(F.sum("v").alias("_s"))
        mean = tpl.join(sums, list(AXES), "left").select(*AXES, (F.coalesce("_s", F.lit(0.0)) / F.lit(float(n))).alias("t"))
        tpl = stage(symmetrize(mean, grid[2]))
    return tpl


def side_of(width: int) -> Column:
    return F.when(F.col("x") < width // 2, 0).otherwise(SECOND_SIDE)


def topn_region(template: DataFrame, grid: Grid, n: int, reach: tuple[float, float, float] = (12, 20, 22)) -> DataFrame:
    """The n brightest voxels of each half inside a central box, ties by coordinate."""
    box = F.lit(True)
    for c, size, r in zip(AXES, grid, reach):
        box = box & (F.abs(F.col(c) - size / 2) < r)
    rows = template.where(box).withColumn("side", side_of(grid[2]))
    return top_k(rows, ["side"], [F.col("t").desc(), *[F.col(c) for c in AXES]], n).drop("_r")


def grouped_2means(points: DataFrame, by: str = "side", p: str = "p", q: str = "q", iters: int = 20) -> DataFrame:
    """Two clusters per group on (p, q), started at the median of p (R24): adds ``k`` and ``first``.

    Ties go to cluster 0, an empty cluster keeps its centre, and rounds stop when nothing
    moves. ``first`` marks the cluster with the smaller p - q/2. Only centres reach the driver.
    """
    pts = stage(points)
    med = stage(pts.groupBy(by).agg(F.percentile(p, F.lit(0.5)).alias("_m")))
    low = lookup_join(pts, med, by).withColumn("k", F.when(F.col(p) < F.col("_m"), 0).otherwise(1))
    assigned, centres = low, {}
    for i in range(iters + 1):
        got = {(r[by], r["k"]): (r["cp"], r["cq"]) for r in assigned.groupBy(by, "k").agg(F.avg(p).alias("cp"), F.avg(q).alias("cq")).collect()}
        new = {**centres, **got}
        if new == centres:
            break
        centres = new
        if i == iters:
            break
        k = F.lit(None).cast("int")
        for g in sorted({key[0] for key in centres}):
            d = [_sq(p, q, centres[g, i]) if (g, i) in centres else F.lit(float("inf")) for i in (0, 1)]
            k = F.when(F.col(by) == g, F.when(d[0] <= d[1], 0).otherwise(1)).otherwise(k)
        assigned = pts.withColumn("k", k)
    first = F.lit(None).cast("int")
    for g in sorted({key[0] for key in centres}):
        score = [centres[g, i][0] - 0.5 * centres[g, i][1] if (g, i) in centres else float("inf") for i in (0, 1)]
        first = F.when(F.col(by) == g, F.lit(0 if score[0] <= score[1] else 1)).otherwise(first)
    return assigned.withColumn("first", F.col("k") == first)


def _sq(p: str, q: str, c: tuple[float, float]) -> Column:
    return (F.col(p) - F.lit(c[0])) * (F.col(p) - F.lit(c[0])) + (F.col(q) - F.lit(c[1])) * (F.col(q) - F.lit(c[1]))


def build_atlas(template: DataFrame, grid: Grid, n_side: int = 700, reach: tuple[float, float, float] = (12, 20, 22), grow: int = 4,
                ref_depth: float = 14.0, ref_least: int = 100, sigma: float = 0.7) -> DataFrame:
    """Zone codes (R25): per half 1 medial cluster, 2 anterior and 3 posterior part of the other (+3 for the
    second half), 9 reference. The template is one bounded grid."""
    d, h, w = grid
    t = stage(gaussian_blur(template.withColumnRenamed("t", "v"), (sigma,) * 3, grid, "reflect", []).withColumnRenamed("v", "t"))
    region = topn_region(t, grid, n_side, reach)
    pts = region.select("side", *AXES, F.abs(F.col("x") - (w - 1) / 2.0).alias("p"), F.col("y").cast("double").alias("q"))
    zones = stage(grouped_2means(pts))
    split = zones.where(~F.col("first")).groupBy("side").agg(F.percentile("y", F.lit(0.5)).alias("_ym"))
    zones = lookup_join(zones, stage(split), "side", "left")
    part = F.when(F.col("first"), 1).when(F.col("y") >= F.coalesce("_ym", F.lit(h / 2)), 2).otherwise(3)
    zones = zones.select(*AXES, (F.col("side") + part).alias("code"))
    near = dilate(zones.withColumn("uid", F.lit("t")), grow, grid).drop("uid") if grow else zones
    p90 = t.agg(F.percentile("t", F.lit(0.9))).first()[0]
    far = stage(t.join(near.select(*AXES), list(AXES), "left_anti").where((F.col("t") > 0.7) & (F.col("t") < F.lit(p90))))
    strict = far.where((F.col("y") < h * 0.3) & (F.abs(F.col("z") - d / 2) < ref_depth))
    ref = strict if strict.count() >= ref_least else far
    return zones.unionByName(ref.select(*AXES, F.lit(REFERENCE).alias("code")))
