"""Left/right-invariant features per volume."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.operators.masks import dilate, erode
from voxeval.operators.rasters import AXES, Grid
from voxeval.operators.templates import side_of
from voxeval.plans.bounded import lookup_join
from voxeval.plans.ranking import exact_quantiles
from voxeval.session import stage

# Fixed values of the feature definitions.
QUANTILES = (50, 90, 99, 99.9)
TOPS = (30, 125, 400, 1000)
VOLUME_LEVELS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
HOT_LEVELS = (0.5, 0.7)
PROFILE_LEVEL = 0.4
BOX_TOP = 60
ASYM_EPS = 1e-6
ZONE_ASYM_EPS = 1e-3
REF_GUARD = 1e-3
RATIO_OFFSET = 0.05


def _side() -> W:
    return W.partitionBy("uid", "side")


def quantile_features(voxels: DataFrame, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Percentiles and the guarded maximum of each volume (F1), one aggregate."""
    q = F.percentile("v", F.array(*[F.lit(p / 100) for p in probs]))
    g = voxels.groupBy("uid").agg(q.alias("_q"), (F.max("v") + 1e-6).alias("g_max"))
    return g.select("uid", *[F.col("_q")[i].alias(f"g_p{p}") for i, p in enumerate(probs)], "g_max")


def split_sides(voxels: DataFrame, grid: Grid, half: tuple[int, int, int] = (12, 20, 20), carry: Sequence[str] = ()) -> DataFrame:
    """Central box in two halves, the second mirrored so that both run lateral to medial (F2).

    Adds ``side`` R or L and ``gmax``, the guarded maximum of the whole volume.
    """
    w = W.partitionBy("uid")
    rows = voxels.withColumn("gmax", F.max("v").over(w) + 1e-6)
    keep = F.lit(True)
    for c, n, r in zip(AXES, grid, half):
        keep = keep & F.col(c).between(n // 2 - r, n // 2 + r - 1)
    z, y, x = (F.col(c) - (n // 2 - r) for c, n, r in zip(AXES, grid, half))
    first = x < half[2]
    side = F.when(first, F.lit("R")).otherwise(F.lit("L"))
    return rows.where(keep).select(
        "uid", side.alias("side"), z.alias("z"), y.alias("y"),
        F.when(first, x).otherwise(F.lit(2 * half[2] - 1) - x).alias("x"), "v", "gmax", *carry,
    )


def _topk_aggs(ks: Sequence[int] = TOPS) -> list[Column]:
    return [F.max("v").alias("max"), *[F.avg(F.when(F.col("_r") <= k, F.col("v"))).alias(f"top{k}") for k in ks]]


def topk_mean(sides: DataFrame, ks: Sequence[int] = TOPS, by: Sequence[str] = ("uid", "side")) -> DataFrame:
    """Maximum and means of the k largest values, all k in one pass.

    Spark cuts each task's rows to the largest k per side before they travel, so what meets in one task is tasks x k values.
    """
    w = W.partitionBy(*by).orderBy(F.col("v").desc())
    rows = sides.select(*by, "v", F.row_number().over(w).alias("_r")).where(F.col("_r") <= max(ks))
    return rows.groupBy(*by).agg(*_topk_aggs(ks))


def volume_aggs(voxel_ml: float, levels: Sequence[float] = VOLUME_LEVELS) -> list[Column]:
    """Volume above fixed levels in ml."""
    return [(F.count_if(F.col("v") > t) * F.lit(voxel_ml)).alias(f"vol{t}") for t in levels]


def hot(frac: float) -> Column:
    return F.col("v") > F.lit(frac) * F.col("gmax")


def hot_extent_aggs(frac: float, voxel_ml: float, spacing: float) -> list[Column]:
    """Size and p5-p95 extent of the hot set per axis; fewer than 3 voxels give 0."""
    n = F.count_if(hot(frac))
    out = [(n * F.lit(voxel_ml)).alias(f"n{frac}")]
    for c in ("y", "z", "x"):
        q = F.percentile(F.when(hot(frac), F.col(c)), F.array(F.lit(0.05), F.lit(0.95)))
        out.append(F.when(n >= 3, (q[1] - q[0]) * spacing).otherwise(0.0).alias(f"{c}ext{frac}"))
    return out


def hot_centroid_aggs(frac: float, box_height: int, spacing: float) -> list[Column]:
    """Value-weighted centre of the hot set: y from the box centre, x from its lateral edge."""
    n, v = F.count_if(hot(frac)), F.when(hot(frac), F.col("v"))
    y, x = F.sum(v * F.col("y")) / F.nullif(F.sum(v), F.lit(0.0)), F.sum(v * F.col("x")) / F.nullif(F.sum(v), F.lit(0.0))
    return [
        F.when(n >= 3, (y - box_height / 2) * spacing).otherwise(0.0).alias(f"ycen{frac}"),
        F.when(n >= 3, x * spacing).otherwise(0.0).alias(f"xcen{frac}"),
    ]


def eigen_ratio(xx, yy, zz, xy, xz, yz) -> Column:
    """sqrt of the first over the second eigenvalue of a symmetric 3x3 matrix, trigonometric form."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + off * 2.0) / 6.0)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.least(F.greatest(det / F.nullif(p * p * p * 2.0, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    phi = F.acos(F.coalesce(r, F.lit(1.0))) / 3.0
    e1 = q + p * 2.0 * F.cos(phi)
    e3 = q + p * 2.0 * F.cos(phi + 2.0 * math.pi / 3.0)
    e2 = q * 3.0 - e1 - e3
    return F.sqrt(e1 / F.greatest(e2, F.lit(1e-6)))


def elongation_aggs(frac: float) -> list[Column]:
    """Shape of the hot set: eigenvalues of its sample covariance plus 1e-6."""
    x, y, z = (F.when(hot(frac), F.col(c).cast("double")) for c in ("x", "y", "z"))
    cov = [F.covar_samp(a, b) for a, b in ((x, x), (y, y), (z, z), (x, y), (x, z), (y, z))]
    eig = eigen_ratio(*[c + 1e-6 for c in cov[:3]], *cov[3:])
    return [F.when(F.count_if(hot(frac)) >= 3, eig).otherwise(0.0).alias(f"elong{frac}")]


def _with_thirds(sides: DataFrame, level: float) -> DataFrame:
    """Adds ``_h``, hot or not, and ``_t``, the third of the hot y range a row lies in."""
    y_hot = F.when(hot(level), F.col("y"))
    rows = sides.withColumn("_h", hot(level)).withColumn("_y0", F.min(y_hot).over(_side())).withColumn("_y1", F.max(y_hot).over(_side()))
    n = F.col("_y1") - F.col("_y0") + 1
    size, more, o = F.floor(n / F.lit(3)), n % 3, F.col("y") - F.col("_y0")
    big = more * (size + 1)
    third = F.when(o < big, F.floor(o / (size + 1))).otherwise(more + F.floor((o - big) / F.greatest(size, F.lit(1))))
    return rows.withColumn("_t", third)


def _third_aggs() -> list[Column]:
    sums = [F.sum(F.when(F.col("_h") & (F.col("_t") == i), F.col("v")).otherwise(0.0)).alias(f"_s{i}") for i in range(3)]
    counts = [F.count_if(F.col("_h") & (F.col("_t") == i)).alias(f"_c{i}") for i in range(3)]
    return [F.count_if("_h").alias("_n"), *sums, *counts]


def _gradients() -> list[Column]:
    m = [F.col(f"_s{i}") / F.greatest(F.col(f"_c{i}"), F.lit(1)) for i in range(3)]
    enough = F.col("_n") > 5
    return [F.when(enough, m[i] / (m[2] + 1e-6)).otherwise(0.0).alias(n) for i, n in ((0, "post_ant"), (1, "mid_ant"))]


def ap_gradient(sides: DataFrame, level: float = PROFILE_LEVEL) -> DataFrame:
    """Mean hot uptake per third of its y range: posterior and middle over anterior (F8).

    Thirds of n rows: the first n mod 3 parts have one row more.
    """
    return _with_thirds(sides, level).groupBy("uid", "side").agg(*_third_aggs()).select("uid", "side", *_gradients())


def _with_boxes(sides: DataFrame, box_height: int, net_height: int) -> DataFrame:
    """Adds ``_box``, before or behind the side's peak, and ``_rb``, the rank of the value in its box."""
    order = F.struct(F.col("v"), -F.col("z"), -F.col("y"), -F.col("x"))
    rows = sides.withColumn("_p", F.max_by(F.struct("z", "y"), order).over(_side()))
    dz, y, py = F.col("z") - F.col("_p.z"), F.col("y"), F.col("_p.y")
    near = dz.between(-3, 3)
    ant = near & (y >= F.least(py + 2, F.lit(net_height))) & (y < F.least(py + 9, F.lit(box_height)))
    post = near & (y >= F.greatest(py - 12, F.lit(0))) & (y < F.greatest(py - 3, F.lit(1)))
    rows = rows.withColumn("_box", F.when(ant, F.lit("ant")).when(post, F.lit("post")))
    return rows.withColumn("_rb", F.row_number().over(W.partitionBy("uid", "side", "_box").orderBy(F.col("v").desc())))


def _box_aggs(k: int = BOX_TOP) -> list[Column]:
    return [
        F.coalesce(F.avg(F.when((F.col("_box") == b) & (F.col("_rb") <= k), F.col("v"))), F.lit(0.0)).alias(f"box_{b}") for b in ("post", "ant")
    ]


def peak_boxes(sides: DataFrame, box_height: int, net_height: int, k: int = BOX_TOP) -> DataFrame:
    """Means of the brightest k voxels in boxes before and behind the side's peak, and their ratio."""
    g = _with_boxes(sides, box_height, net_height).groupBy("uid", "side").agg(*_box_aggs(k))
    return g.withColumn("box_ratio", F.col("box_post") / (F.col("box_ant") + 1e-6))


def fold_sides(df: DataFrame, cols: Sequence[str], sides: tuple = ("R", "L"), eps: float = ASYM_EPS, prefix: str = "",
               keys: Sequence[str] = ("uid",), mean: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Two side rows to min, max, mean and relative difference of each column."""
    pair = [(c, *[F.max(F.when(F.col("side") == s, F.col(f"`{c}`"))).alias(f"_{i}{c}") for i, s in enumerate(sides)]) for c in cols]
    g = df.groupBy(*keys).agg(*[e for p in pair for e in p[1:]], *[F.max(c).alias(c) for c in carry])
    outs = [F.col(c) for c in carry]
    for c in cols:
        a, b = F.col(f"`_0{c}`"), F.col(f"`_1{c}`")
        outs += [F.least(a, b).alias(f"{prefix}{c}_min"), F.greatest(a, b).alias(f"{prefix}{c}_max")]
        if mean:
            outs.append(((a + b) / 2).alias(f"{prefix}{c}_mean"))
        outs.append((F.abs(a - b) / (F.abs(a) + F.abs(b) + eps)).alias(f"{prefix}{c}_asym"))
    return g.select(*keys, *outs)


def side_features(sides: DataFrame, box: Grid, net_height: int, spacing: float = 2.0, carry: Sequence[str] = ()) -> DataFrame:
    """All side statistics, F3 to F9, per (uid, side) in one aggregate.

    Ranks, thirds and boxes are windows on the partitioning by uid that ``split_sides`` made, so
    voxels are exchanged once. ``carry`` keeps columns that are constant per uid.
    """
    ml = spacing**3 / 1000.0
    aggs = [*_topk_aggs(), *volume_aggs(ml), *_third_aggs(), *_box_aggs()]
    for f in HOT_LEVELS:
        aggs += hot_extent_aggs(f, ml, spacing) + hot_centroid_aggs(f, box[1], spacing) + elongation_aggs(f)
    rows = _with_boxes(_with_thirds(sides, PROFILE_LEVEL), box[1], net_height)
    rows = rows.withColumn("_r", F.row_number().over(_side().orderBy(F.col("v").desc())))
    g = rows.groupBy("uid", "side").agg(*aggs, *[F.max(c).alias(c) for c in carry])
    names = [c for c in g.columns if not c.startswith("_")]
    return g.select(*[F.col(f"`{c}`") for c in names], *_gradients(), (F.col("box_post") / (F.col("box_ant") + 1e-6)).alias("box_ratio"))


def scan_features(voxels: DataFrame, grid: Grid, half: tuple[int, int, int] = (12, 20, 20), spacing: float = 2.0) -> DataFrame:
    """The complete wide feature row of each (already smoothed) volume: global and folded side features.

    One exchange by uid carries the whole of it.
    """
    q = F.percentile("v", F.array(*[F.lit(p / 100) for p in QUANTILES])).over(W.partitionBy("uid"))
    rows = voxels.select("uid", *AXES, "v", q.alias("_q"))
    names = [f"g_p{p}" for p in QUANTILES]
    rows = rows.select("uid", *AXES, "v", *[F.col("_q")[i].alias(f"g{i}") for i in range(len(names))])
    carry = [f"g{i}" for i in range(len(names))]
    sides = split_sides(rows, grid, half, carry)
    per = side_features(sides, (2 * half[0], 2 * half[1], half[2]), grid[1], spacing, [*carry, "gmax"])
    cols = [c for c in per.columns if c not in ("uid", "side", "gmax", *carry)]
    wide = fold_sides(per, cols, carry=[*carry, "gmax"])
    renamed = {**dict(zip(carry, names)), "gmax": "g_max"}
    return wide.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in wide.columns])


def zonal_means(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Reference-relative mean and top-quarter mean per zone (F11): uid, side, zone, sbr, top, ref."""
    rows = lookup_join(voxels, atlas, list(AXES))
    by = W.partitionBy("uid", "code")
    r = F.row_number().over(by.orderBy(F.col("v").desc()))
    n = F.count(F.lit(1)).over(by)
    rows = rows.select("uid", "code", "v", r.alias("_r"), n.alias("_n"))
    quarter = F.greatest(F.lit(5), F.floor(F.col("_n") / F.lit(4)))
    z = rows.groupBy("uid", "code").agg(
        F.avg("v").alias("m"), F.avg(F.when(F.col("_r") <= quarter, F.col("v"))).alias("t"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")
    )
    ref = F.max(F.when(F.col("code") == 9, F.col("m"))).over(W.partitionBy("uid")) + REF_GUARD
    z = z.withColumn("ref", ref).where(F.col("code") != 9)
    side = F.when(F.col("code") <= 3, "a").otherwise("b")
    zone = F.when((F.col("code") - 1) % 3 == 0, "caud").when((F.col("code") - 1) % 3 == 1, "put_ant").otherwise("put_post")
    return z.select(
        "uid", side.alias("side"), zone.alias("zone"), (F.col("m") / F.col("ref") - 1).alias("sbr"),
        (F.col("t") / F.col("ref") - 1).alias("top"), "s", "n", "ref",
    )


def zonal_ratio(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Zone features per (uid, side): each zone, both posterior zones together, all zones."""
    z = zonal_means(voxels, atlas)

    def of(zone, c):
        return F.max(F.when(F.col("zone") == zone, F.col(c)))

    put = F.col("zone") != "caud"
    return z.groupBy("uid", "side").agg(
        *[of(n, c).alias(f"{n}_{c}") for n in ("caud", "put_ant", "put_post") for c in ("sbr", "top")],
        (F.sum(F.when(put, F.col("s"))) / F.sum(F.when(put, F.col("n"))) / F.max("ref") - 1).alias("put_sbr"),
        (F.sum("s") / F.sum("n") / F.max("ref") - 1).alias("str_sbr"), F.max("ref").alias("ref"),
    )


def zone_ratios(zones: DataFrame) -> DataFrame:
    """Quotients of zone ratios, both offset by 0.05."""
    def over(a, b):
        return (F.col(f"{a}_sbr") + RATIO_OFFSET) / (F.col(f"{b}_sbr") + RATIO_OFFSET)

    return (zones.withColumn("put_caud", over("put", "caud")).withColumn("post_ant", over("put_post", "put_ant"))
            .withColumn("post_caud", over("put_post", "caud")))


def zone_features(voxels: DataFrame, atlas: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Wide zone features, sides folded, with the reference level and the alignment score."""
    z = zone_ratios(zonal_ratio(voxels, atlas))
    cols = [c for c in z.columns if c not in ("uid", "side", "ref")]
    out = fold_sides(z, cols, ("a", "b"), ZONE_ASYM_EPS, "v_").join(z.groupBy("uid").agg(F.max("ref").alias("v_ref")), "uid")
    return out if scores is None else out.join(scores.select("uid", F.col("ncc").alias("v_ncc")), "uid")


def profile_bins_slope(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Profile along y of the two lateral zones per side: quartile-bin means, top third, slope."""
    rows = lookup_join(voxels, atlas, list(AXES))
    w = W.partitionBy("uid")
    ref = F.avg(F.when(F.col("code") == 9, F.col("v"))).over(w) + REF_GUARD
    rows = rows.withColumn("_x", F.col("v") / ref - 1).where((F.col("code") != 9) & ((F.col("code") - 1) % 3 != 0))
    rows = rows.withColumn("side", F.when(F.col("code") <= 3, "a").otherwise("b"))
    ws = W.partitionBy("uid", "side")
    rows = rows.withColumn("_q", F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(ws))
    rows = rows.withColumn("_b", F.size(F.filter("_q", lambda q: q <= F.col("y"))))
    rows = rows.withColumn("_r", F.row_number().over(ws.orderBy(F.col("_x").desc()))).withColumn("_n", F.count(F.lit(1)).over(ws))
    third = F.floor(F.col("_n") / F.lit(3))
    return rows.groupBy("uid", "side").agg(
        *[F.avg(F.when(F.col("_b") == b, F.col("_x"))).alias(f"p{b}") for b in range(4)],
        F.avg(F.when(F.col("_r") <= third, F.col("_x"))).alias("p_top"), F.regr_slope("_x", F.col("y").cast("double")).alias("slope"),
    )


def multi_reference(voxels: DataFrame, atlas: DataFrame, brain: DataFrame, occipital: DataFrame) -> DataFrame:
    """Zone means over three references: background 1, posterior mean, upper quartile of the rest.

    ``brain`` and ``occipital`` are coordinate sets outside the zones; one lookup tags all sets.
    """
    tags = (
        atlas.select(*AXES, "code", F.lit(False).alias("b"), F.lit(False).alias("o"))
        .unionByName(brain.select(*AXES, F.lit(0).alias("code"), F.lit(True).alias("b"), F.lit(False).alias("o")))
        .unionByName(occipital.select(*AXES, F.lit(0).alias("code"), F.lit(False).alias("b"), F.lit(True).alias("o")))
        .groupBy(*AXES).agg(F.max("code").alias("code"), F.max("b").alias("b"), F.max("o").alias("o"))
    )
    rows = lookup_join(voxels, stage(tags), list(AXES))
    code, v = F.col("code"), F.col("v")

    def mean(*codes):
        return F.avg(F.when(code.isin(list(codes)), v))

    g = rows.groupBy("uid").agg(
        (F.avg(F.when(F.col("o"), v)) + REF_GUARD).alias("occ"), (F.percentile(F.when(F.col("b"), v), F.lit(0.75)) + REF_GUARD).alias("p75"),
        mean(3).alias("pp0"), mean(6).alias("pp1"), mean(2, 3).alias("pu0"), mean(5, 6).alias("pu1"),
        mean(1).alias("ca0"), mean(4).alias("ca1"), mean(1, 2, 3, 4, 5, 6).alias("st"),
    )
    outs = [(F.col("occ") / F.col("p75")).alias("r_occ_p75"), F.col("occ").alias("r_occ_bg"), F.col("p75").alias("r_p75_bg")]
    for name, rv in (("bg", F.lit(1.0)), ("occ", F.col("occ")), ("p75", F.col("p75"))):
        outs += [
            (F.least("pp0", "pp1") / rv).alias(f"m_{name}_postput_min"), ((F.col("pu0") + F.col("pu1")) / 2 / rv).alias(f"m_{name}_put_mean"),
            ((F.col("ca0") + F.col("ca1")) / 2 / rv).alias(f"m_{name}_caud_mean"), (F.col("st") / rv).alias(f"m_{name}_stri_mean"),
        ]
    return g.select("uid", *outs)


def integrated_excess(voxels: DataFrame, atlas: DataFrame, grid: Grid, grows: Sequence[int] = (0, 2, 4), voxel_ml: float = 0.008) -> DataFrame:
    """Volume-weighted uptake above background inside grown zones, sides folded."""
    zone = atlas.where(F.col("code").between(1, 6)).select(F.lit("t").alias("uid"), *AXES)
    sets = None
    for k in grows:
        part = (dilate(zone, k, grid) if k else zone).select(*AXES, F.lit(k).alias("k"))
        sets = part if sets is None else sets.unionByName(part)
    sets = sets.groupBy(*AXES).agg(F.collect_set("k").alias("_ks"))  # at most len(grows) entries
    rows = lookup_join(voxels, stage(sets), list(AXES)).select("uid", F.explode("_ks").alias("k"), side_of(grid[2]).alias("side"), "v")
    g = rows.groupBy("uid", "k").agg(*[
        (F.sum(F.when(F.col("side") == s, F.greatest(F.col("v") - 1.0, F.lit(0.0))).otherwise(0.0)) * F.lit(voxel_ml)).alias(n)
        for n, s in (("a", 0), ("b", 3))
    ])
    a, b = F.col("a"), F.col("b")
    return g.select("uid", "k", F.least(a, b).alias("i_min"), F.greatest(a, b).alias("i_max"), (F.abs(a - b) / (a + b + ZONE_ASYM_EPS)).alias("i_asym"))


def context_features(voxels: DataFrame, mask: DataFrame, spacing: float = 4.0, band: tuple[float, float] = (110.0, 20.0), shrink: int = 3,
                     top: int = 300, least: int = 50) -> DataFrame:
    """Size, shape and tone of the head band, from values in background units (F16).

    The band runs from 110 to 20 mm below the vertex; tone uses its eroded interior unless that is too small.
    """
    w = W.partitionBy("uid")
    t = F.col("_t")
    lo, hi = F.greatest(t - int(band[0] / spacing), F.lit(0)), F.greatest(t - int(band[1] / spacing), F.lit(1))
    brain = mask.withColumn("_t", F.max("z").over(w)).where((F.col("z") >= lo) & (F.col("z") < hi)).select("uid", *AXES)
    rows = brain.join(voxels, ["uid", *AXES])
    inner = erode(brain, shrink).withColumn("_i", F.lit(True))
    rows = rows.join(inner, ["uid", *AXES], "left").withColumn("_i", F.coalesce("_i", F.lit(False)))
    rows = rows.withColumn("_ni", F.count_if("_i").over(w)).withColumn("_use", F.col("_i") | (F.col("_ni") <= least))
    med = {c: F.percentile(c, F.lit(0.5)).over(w) for c in ("y", "z")}
    rows = rows.withColumn("_up", F.col("y") > med["y"]).withColumn("_hi", F.col("z") > med["z"])
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy(F.col("v").desc())))
    v, iv = F.col("v"), F.when(F.col("_use"), F.col("v"))
    q = F.percentile(iv, F.array(*[F.lit(p) for p in (0.10, 0.25, 0.75, 0.90)]))
    g = rows.groupBy("uid").agg(
        (F.count(F.lit(1)) * F.lit(spacing**3 / 1000.0)).alias("c_vol_ml"),
        *[((F.max(c) - F.min(c) + 1) * F.lit(spacing)).alias(f"c_ext_{c}") for c in ("x", "y", "z")],
        F.avg((iv < 0.4).cast("double")).alias("c_low04"), F.avg((iv < 0.6).cast("double")).alias("c_low06"), q.alias("_q"),
        (F.stddev_pop(iv) / (F.avg(iv) + 1e-6)).alias("c_cv"),
        (F.avg(F.when(F.col("_up"), v)) / (F.avg(F.when(~F.col("_up"), v)) + 1e-6)).alias("c_ant_post"),
        (F.avg(F.when(F.col("_hi"), v)) / (F.avg(F.when(~F.col("_hi"), v)) + 1e-6)).alias("c_sup_inf"),
        F.avg(F.when(F.col("_r") <= top, v)).alias("c_top_mean"),
    )
    return g.select(
        *[c for c in g.columns if c != "_q"], (F.col("_q")[2] - F.col("_q")[1]).alias("c_iqr"), F.col("_q")[0].alias("c_p10"), F.col("_q")[3].alias("c_p90")
    )


def signed_asymmetry(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """(a - b) / (a + b) of the two sides' zone means."""
    rows = lookup_join(voxels, atlas.where(F.col("code").between(1, 6)), list(AXES))
    g = rows.groupBy("uid").agg(
        F.avg(F.when(F.col("code") <= 3, F.col("v"))).alias("a"), F.avg(F.when(F.col("code") > 3, F.col("v"))).alias("b"))
    return g.select("uid", ((F.col("a") - F.col("b")) / F.nullif(F.col("a") + F.col("b"), F.lit(0.0))).alias("asym"))


def asymmetry_subsets(asym: DataFrame) -> DataFrame:
    """Volumes split at the median absolute asymmetry: bilateral, or one side reduced.

    The median spans all volumes and is an exact distributed quantile.
    """
    mags = asym.where(F.col("asym").isNotNull()).select(F.abs("asym").alias("m"))
    q = exact_quantiles(mags, [], "m", [0.5]).first()["q0"]
    subset = F.when(F.abs("asym") < F.lit(q), "bilateral").when(F.col("asym") < -F.lit(q), "a_reduced").when(F.col("asym") > F.lit(q), "b_reduced")
    return asym.withColumn("subset", subset)

