"""Operators on long voxel tables (uid, z, y, x, v): R1-R3, R12-R17, R26-R30.

A volume is bounded by its grid, so windows and sorts per uid are bounded too; everything
that spans volumes is a plain partial aggregate. Per-volume statistics are windows over uid:
one exchange by uid serves a whole chain of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.functions.scalars import clean_value, clip, uniform
from voxeval.plans.bounded import struct_array, struct_array_sql
from voxeval.plans.volumes import Arrays, Grid, coordinates, dense, per_volume, sampled, volume_tasks

AXES = ("z", "y", "x")

# Fixed values of the grids and of localisation.
SPACING = 2.0
COARSE = 4.0
STORE_GRID: Grid = (56, 80, 80)
NET_GRID: Grid = (48, 64, 64)
TRIM = (25.0, 85.0)
NORMALIZED_MAX = 40.0


def inside(grid: Grid, names: Sequence[str] = AXES) -> Column:
    out = F.lit(True)
    for c, n in zip(names, grid):
        out = out & (F.col(c) >= 0) & (F.col(c) < n)
    return out


def offset_rows(df: DataFrame, offsets: Sequence[Sequence[int]], grid: Grid | None = None) -> DataFrame:
    """Every row once per coordinate offset, clipped to the grid."""
    lits = struct_array([{f"d{c}": int(v) for c, v in zip(AXES, o)} for o in offsets])
    keep = [c for c in df.columns if c not in AXES]
    moved = df.withColumn("_o", F.explode(lits)).select(*keep, *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in AXES], "_o")
    moved = moved.withColumn("own", (F.col("_o.dz") == 0) & (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)).drop("_o")
    return moved if grid is None else moved.where(inside(grid))


def volume_violations(voxels: DataFrame, grid: Grid) -> DataFrame:
    """Per uid: voxels outside the grid, repeated coordinates, and missing ones."""
    n = grid[0] * grid[1] * grid[2]
    cells = voxels.groupBy("uid", *AXES).agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("uid").agg(
        F.count_if(~inside(grid)).alias("outside"), F.sum(F.col("_n") - 1).alias("repeated"),
        (F.lit(n) - F.count_if(inside(grid))).alias("missing"),
    )


def frame_mean(frames: DataFrame) -> DataFrame:
    """Mean over extra axes, then cleaned."""
    return frames.groupBy("uid", *AXES).agg(clean_value(F.avg("v")).alias("v"))


def downsample(voxels: DataFrame, f: int) -> DataFrame:
    """Block means on a grid f times coarser (R2)."""
    blocks = [F.floor(F.col(c) / F.lit(f)).cast("int").alias(c) for c in AXES]
    return voxels.groupBy("uid", *blocks).agg(F.avg("v").alias("v"))


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(k) for v in k]


def source_index(i: int, n: int, edge: str) -> int:
    """Grid index that stands in for position i beyond an edge."""
    if edge == "replicate":
        return min(max(i, 0), n - 1)
    m = i % (2 * n)  # reflect: the edge value is repeated
    return m if m < n else 2 * n - 1 - m


def blur_radius(sigma: float, edge: str) -> int:
    """Kernel reach of the two conventions in use: replicate 2.5 sigma, reflect 4 sigma."""
    return math.ceil(2.5 * sigma) if edge == "replicate" else int(4.0 * sigma + 0.5)


def axis_weights(sigma: float, n: int, edge: str) -> list[list[tuple[int, float]]]:
    """For each input index the outputs it adds to, and with what weight."""
    r = blur_radius(sigma, edge)
    kernel = gaussian_weights(sigma, r)
    sends: list[dict[int, float]] = [{} for _ in range(n)]
    for out in range(n):
        for k, w in zip(range(-r, r + 1), kernel):
            src = sends[source_index(out + k, n, edge)]
            src[out] = src.get(out, 0.0) + w
    return [sorted(s.items()) for s in sends]


def apply_axis(voxels: DataFrame, axis: str, sends: Sequence[Sequence[tuple[int, float]]], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """A linear operator along one axis; its sparse matrix is a literal of axis length x reach."""
    table = F.expr("array(" + ", ".join(struct_array_sql([{"o": int(o), "w": float(w)} for o, w in row]) for row in sends) + ")")
    rest = [c for c in AXES if c != axis]
    rows = voxels.select(*keys, *rest, "v", F.explode(F.get(table, F.col(axis))).alias("_s"))
    return rows.groupBy(*keys, *rest, F.col("_s.o").alias(axis)).agg(F.sum(F.col("v") * F.col("_s.w")).alias("v"))


def gaussian_blur(voxels: DataFrame, sigmas: Sequence[float], grid: Grid, edge: str = "replicate", keys: Sequence[str] = ("uid",),
                  tasks: int | None = None) -> DataFrame:
    """Separable, anisotropic blur: three passes of 2r+1, not one of (2r+1)^3.

    Volumes are brought together by uid once, so the passes themselves do not shuffle. ``tasks``: partitions, see ``volume_tasks``.
    """
    out = voxels.select(*keys, *AXES, "v")
    if keys:
        out = out.repartition(*[tasks] if tasks else [], *keys)
    for axis, sigma, n in zip(AXES, sigmas, grid):
        if sigma > 0.05:
            out = apply_axis(out, axis, axis_weights(sigma, n, edge), keys)
    return out.select(*keys, *AXES, "v")


SPACINGS = ("sz", "sy", "sx")
SHAPE = ("nz", "ny", "nx")


def axis_matrix(sigma: float, n: int, edge: str) -> np.ndarray:
    """The blur along one axis as an n x n matrix."""
    m = np.zeros((n, n))
    for i, sends in enumerate(axis_weights(sigma, n, edge)):
        for o, w in sends:
            m[o, i] = w
    return m


def blurred(v: np.ndarray, sigmas: Sequence[float], edge: str) -> np.ndarray:
    for axis, sigma in enumerate(sigmas):
        if sigma > 0.0:
            v = np.moveaxis(np.tensordot(axis_matrix(float(sigma), v.shape[axis], edge), v, (1, axis)), 0, axis)
    return v


def gaussian_blur_each(voxels: DataFrame, sigmas: DataFrame, grid: Grid, edge: str = "reflect") -> DataFrame:
    """Separable blur with each volume's own deviations (R3): columns sz, sy, sx per uid, 0 for none."""
    def blur(a: Arrays) -> Arrays:
        return _all_cells(blurred(dense(a, grid), [a[c][0] for c in SPACINGS], edge))

    return per_volume(voxels.select("uid", *AXES, "v"), blur, CELL, sigmas.select("uid", *SPACINGS))


def coarse_shape(shape: Sequence[int], spacing: Sequence[float], to: float) -> Grid:
    """Cells of a volume at another spacing, to the nearest even on ties."""
    return tuple(max(1, round(float(n) * float(s) / to)) for n, s in zip(shape, spacing))


def downsample_each(voxels: DataFrame, scans: DataFrame, to: float = COARSE, blur: bool = True) -> DataFrame:
    """Each volume on a grid of spacing ``to`` (R2), from its own spacing (sz, sy, sx in mm) and shape (nz, ny, nx).

    Axes that get coarser are blurred first, by half the new step less 0.35 voxels (reflected edges); then the first and last
    cells of the two grids are laid over each other and values between cells are interpolated linearly.
    """
    def small(a: Arrays) -> Arrays:
        shape, spacing = [int(a[c][0]) for c in SHAPE], [float(a[c][0]) for c in SPACINGS]
        v = dense(a, tuple(shape))
        sigmas = [max(0.0, 0.5 * to / s - 0.35) for s in spacing]
        if blur and max(sigmas) > 0.05:
            v = blurred(v, sigmas, "reflect")
        out = coarse_shape(shape, spacing, to)
        step = [(n - 1) / (m - 1) if m > 1 else 1.0 for n, m in zip(shape, out)]
        return _all_cells(sampled(v, np.diag(step), np.zeros(3), out, "nearest"))

    return per_volume(voxels.select("uid", *AXES, "v"), small, CELL, scans.select("uid", *SPACINGS, *SHAPE))


def center_of_mass(rows: DataFrame, weight: str | None = None, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Mean member coordinate, optionally weighted."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(*keys).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}") for c in AXES])


def constrained_peak(voxels: DataFrame, mask: DataFrame, centre: DataFrame, reach: tuple[float, float], coarse: float = COARSE,
                     least: int = 10) -> DataFrame:
    """Brightest voxel of the mask within reach of its centre, else of the whole mask.

    ``reach``: mm along y and x. Ties go to the lowest (x, y, z).
    """
    rows = mask.select("uid", *AXES).join(voxels, ["uid", *AXES]).join(centre.select("uid", "cy", "cx"), "uid")
    near = (F.abs(F.col("y") - F.col("cy")) * coarse <= reach[0]) & (F.abs(F.col("x") - F.col("cx")) * coarse <= reach[1])
    at = F.struct(*AXES, "v")
    order = F.struct(F.col("v"), -F.col("x"), -F.col("y"), -F.col("z"))
    g = rows.groupBy("uid").agg(
        F.count_if(near).alias("n_near"),
        F.max_by(F.when(near, at), F.when(near, order)).alias("_a"), F.max_by(at, order).alias("_b"),
    )
    enough = F.col("n_near") >= least
    pick = F.when(enough, F.col("_a")).otherwise(F.col("_b"))
    return g.select("uid", *[pick[c].alias(c) for c in AXES], pick["v"].alias("peak"), F.when(enough, 0).otherwise(2).alias("note"))


def trimmed_mean(rows: DataFrame, lo: float = TRIM[0], hi: float = TRIM[1]) -> DataFrame:
    """Mean of the values within two inclusive percentiles of each volume.

    Not positive: mean plus 1e-6. The percentile buffer holds distinct values of one volume.
    """
    w = W.partitionBy("uid")
    q = F.percentile("v", F.array(F.lit(lo / 100), F.lit(0.5), F.lit(hi / 100))).over(w)
    g = rows.withColumn("_q", q).groupBy("uid").agg(
        F.avg(F.when(F.col("v").between(F.col("_q")[0], F.col("_q")[2]), F.col("v"))).alias("_m"),
        F.first(F.col("_q")[1]).alias("_med"), F.avg("v").alias("_all"),
    )
    bg = F.coalesce("_m", "_med")
    return g.select("uid", F.when(bg <= 1e-6, F.col("_all") + 1e-6).otherwise(bg).alias("bg"))


def normalize(voxels: DataFrame, background: DataFrame) -> DataFrame:
    """Background units, limited to [0, 40]."""
    return voxels.join(background, "uid").select("uid", *AXES, clip(F.col("v") / F.col("bg"), 0.0, NORMALIZED_MAX).alias("v"))


def affine_resample(voxels: DataFrame, matrix: Sequence[Sequence[float]], offset: Sequence[float], grid: Grid, out: Grid, edge: str = "zero") -> DataFrame:
    """Linear interpolation at ``matrix @ o + offset`` for every output index o (R16), one transform for all volumes.

    Volumes meet by uid once; see ``sampled`` for the passes and the edge rules.
    """
    m, t = np.array(matrix, float), np.array(offset, float)
    return per_volume(voxels.select("uid", *AXES, "v"), lambda a: _all_cells(sampled(dense(a, grid), m, t, out, edge)), CELL)


def affine_resample_each(voxels: DataFrame, thetas: DataFrame, grid: Grid, out: Grid, edge: str = "zero") -> DataFrame:
    """As above with one transform per uid: columns m00..m22 and t0..t2."""
    names = [f"m{i}{j}" for i in range(3) for j in range(3)] + [f"t{i}" for i in range(3)]

    def moved(a: Arrays) -> Arrays:
        p = np.array([float(a[n][0]) for n in names])
        return _all_cells(sampled(dense(a, grid), p[:9].reshape(3, 3), p[9:], out, edge))

    return per_volume(voxels.select("uid", *AXES, "v"), moved, CELL, thetas.select("uid", *names))


CELL = [*[(c, "int") for c in AXES], ("v", "double")]


def _all_cells(v: np.ndarray) -> Arrays:
    return coordinates(np.arange(v.size), v.shape) | {"v": v.ravel()}


def rotation(angle_deg: float, axes: tuple[int, int], grid: Grid) -> tuple[list[list[float]], list[float]]:
    """Index transform of a rotation about the grid centre in a plane of two axes."""
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    m = [[float(i == j) for j in range(3)] for i in range(3)]
    i, j = axes
    m[i][i], m[i][j], m[j][i], m[j][j] = c, s, -s, c
    mid = [(n - 1) / 2.0 for n in grid]
    return m, [mid[a] - sum(m[a][b] * mid[b] for b in range(3)) for a in range(3)]


def center_crop(voxels: DataFrame, grid: Grid, to: Grid) -> DataFrame:
    """Central sub-grid, starting at (a - b) // 2."""
    start = [(a - b) // 2 for a, b in zip(grid, to)]
    keep = F.lit(True)
    for c, s, n in zip(AXES, start, to):
        keep = keep & F.col(c).between(s, s + n - 1)
    rest = [c for c in voxels.columns if c not in AXES]
    return voxels.where(keep).select(*rest, *[(F.col(c) - s).alias(c) for c, s in zip(AXES, start)])


def slab_means(voxels: DataFrame, n: int, k: int, depth: int) -> DataFrame:
    """Central n slabs of k slices, averaged over z."""
    s0 = depth // 2 - n * k // 2
    slab = F.floor((F.col("z") - s0) / F.lit(k)).cast("int")
    rows = voxels.where(F.col("z").between(s0, s0 + n * k - 1))
    return rows.groupBy("uid", slab.alias("slab"), "y", "x").agg(F.avg("v").alias("v"))


def tri_plane(voxels: DataFrame, grid: Grid, half: int = 6) -> DataFrame:
    """Axial, coronal and sagittal central slabs in one pass."""
    def plane(name, axis, a, b):
        n = grid[AXES.index(axis)]
        keep = F.col(axis).between(n // 2 - half, n // 2 + half - 1)
        return F.when(keep, F.struct(F.lit(name).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b")))

    views = F.array_compact(F.array(plane("axial", "z", "y", "x"), plane("coronal", "y", "z", "x"), plane("sagittal", "x", "z", "y")))
    rows = voxels.select("uid", "v", F.explode(views).alias("_w"))
    return rows.groupBy("uid", "_w.plane", "_w.a", "_w.b").agg(F.avg("v").alias("v"))


def slice_windows(voxels: DataFrame, depth: int, half: int = 8, step: int = 2) -> DataFrame:
    """Rolling means of 2 and 6 slices at every step-th slice about the centre."""
    w = W.partitionBy("uid", "y", "x").orderBy("z")
    c = depth // 2
    rows = voxels.select(
        "uid", "z", "y", "x", F.avg("v").over(w.rangeBetween(-1, 0)).alias("thin"), F.avg("v").over(w.rangeBetween(-3, 2)).alias("thick")
    )
    return rows.where(F.col("z").between(c - half, c + half) & ((F.col("z") - c + half) % step == 0)).withColumn("off", F.col("z") - c)


def self_normalize(voxels: DataFrame, q: float = 0.99, centred: bool = True, guard: float = 1e-3) -> DataFrame:
    """Division by the volume's own quantile.

    ``centred``: the input is already (I - 1) / 2 and is divided as it is; otherwise the
    positive image is restored, divided, and centred again.
    """
    val = F.col("v") if centred else F.greatest(F.col("v") * 2.0 + 1.0, F.lit(0.0))
    rows = voxels.withColumn("_r", val)
    p = F.greatest(F.percentile("_r", F.lit(q)).over(W.partitionBy("uid")), F.lit(guard))
    out = F.col("_r") / p
    return rows.select("uid", *AXES, (out if centred else out * 2.0 - 1.0).alias("v"))


def corruptions(grid: Grid, edge: int, cut: int, hot: dict) -> dict[str, Callable[[], Column]]:
    """Registry of pointwise corruptions; blur and tilt are R3 and R16."""
    z, y, x, v = (F.col(c) for c in (*AXES, "v"))
    d, _, w = grid
    box = z.between(*hot["z"]) & y.between(*hot["y"]) & x.between(*hot["x"])
    noise = uniform(F.col("uid").cast("string"), z.cast("string"), y.cast("string"), x.cast("string"), "noise") - 0.5
    return {
        "clean": lambda: v,
        "crop edges": lambda: F.when(z.between(edge, d - 1 - edge), v).otherwise(0.0),
        "top cut": lambda: F.when(z < d - cut, v).otherwise(0.0),
        "bottom cut": lambda: F.when(z >= cut, v).otherwise(0.0),
        "lateral cut": lambda: F.when(x.between(cut, w - 1 - cut), v).otherwise(0.0),
        "hot spot": lambda: F.when(box, F.col("_top") * 1.6).otherwise(v),
        "intensity": lambda: v * 0.7,
        "noise": lambda: F.greatest(v + F.col("_mean") * 0.6 * noise, F.lit(0.0)),
    }


def corrupt(voxels: DataFrame, registry: dict[str, Callable[[], Column]], kinds: Sequence[str] | None = None) -> DataFrame:
    """Voxels once per corruption kind."""
    w = W.partitionBy("uid")
    rows = voxels.withColumn("_top", F.percentile("v", F.lit(0.999)).over(w)).withColumn("_mean", F.avg("v").over(w))
    made = F.array(*[F.struct(F.lit(k).alias("kind"), registry[k]().cast("double").alias("v")) for k in kinds or list(registry)])
    return rows.select("uid", *AXES, F.explode(made).alias("_c")).select("uid", "_c.kind", *AXES, "_c.v")


MOVED = ("blur", "tilt", "shift")


def corrupt_moved(voxels: DataFrame, grid: Grid, fwhm: float = 8.0, angle: float = 12.0, shift: Sequence[float] = (0.0, 5.0, 5.0), spacing: float = SPACING) -> DataFrame:
    """Voxels once per corruption that mixes cells (R29): a blur of ``fwhm`` mm, a turn in the z-y plane, a shift in cells; 0 from outside."""
    m, t = rotation(angle, (0, 1), grid)

    def every(a: Arrays) -> Arrays:
        v = dense(a, grid)
        made = [
            blurred(v, (fwhm / spacing / 2.355,) * 3, "reflect"), sampled(v, np.array(m), np.array(t), grid, "outside_zero"),
            sampled(v, np.eye(3), -np.array(shift), grid, "outside_zero"),
        ]
        at = coordinates(np.tile(np.arange(v.size), len(made)), grid)
        return {"k": np.repeat(np.arange(len(made)), v.size)} | at | {"v": np.concatenate([x.ravel() for x in made])}

    rows = per_volume(voxels.select("uid", *AXES, "v"), every, [("k", "int"), *CELL])
    return rows.select("uid", F.element_at(F.array(*map(F.lit, MOVED)), F.col("k") + 1).alias("kind"), *AXES, "v")


def harmonize_blur(voxels: DataFrame, zooms: DataFrame, c: float, grid: Grid, spacing: float = SPACING) -> DataFrame:
    """Blur each volume up to a common resolution, with its own sigma.

    Reflecting edges: a symmetric kernel may be sent out and folded back at the borders, so the
    kernel is an expression of the row's own sigma. ``zooms`` has a row per uid; it is counted, so that the cells of a task
    stay the same however many volumes there are.
    """
    mm = F.sqrt(F.greatest(F.lit((c * 4.0) ** 2) - F.pow(F.col("zoom") * F.lit(c), F.lit(2.0)), F.lit(0.0)))
    sigma = F.when(mm > 0.1, mm / F.lit(spacing)).otherwise(F.lit(0.0))
    reach = F.floor(F.col("_sg") * 4.0 + 0.5).cast("int")
    kernel = F.transform(F.sequence(-reach, reach), lambda k: F.when(F.col("_sg") > 0, F.exp(F.lit(-0.5) * F.pow(k / F.col("_sg"), F.lit(2.0)))).otherwise(1.0))
    per = zooms.select("uid", sigma.alias("_sg")).withColumn("_k", kernel)
    total = F.aggregate("_k", F.lit(0.0), lambda a, b: a + b)
    per = per.select("uid", F.transform("_k", lambda v: v / total).alias("_k"))
    tasks = volume_tasks(zooms, grid)
    out = voxels.repartition(tasks, "uid").join(per.repartition(tasks, "uid"), "uid")
    for axis, n in zip(AXES, grid):
        rest = [a for a in AXES if a != axis]
        rows = out.select("uid", "_k", *rest, "v", axis, F.posexplode("_k").alias("_i", "_w"))
        at = F.pmod(F.col(axis) + F.col("_i") - F.floor(F.size("_k") / F.lit(2)), F.lit(2 * n))
        fold = F.when(at < n, at).otherwise(F.lit(2 * n - 1) - at).cast("int")
        out = rows.groupBy("uid", "_k", *rest, fold.alias(axis)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return out.select("uid", *AXES, "v")
