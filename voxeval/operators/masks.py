"""Thresholds, morphology and components on sparse masks (uid, z, y, x): R4-R11."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.operators.rasters import AXES, COARSE, Grid, offset_rows
from voxeval.plans.volumes import Arrays, coordinates, per_volume, placed, run_labels

# Fixed values of the head mask.
OTSU_BINS = 256
CAP_Q = 0.995
REL_THRESHOLD = 0.08
TINY_MASK = 200
TINY_Q = 0.60
BAND_MM = (125.0, 25.0)
SMALL_BAND = 50

CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def otsu(voxels: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """Threshold that best separates two classes of a 256-bin histogram.

    The largest value falls into the last bin; a constant volume gives its value.
    """
    w = W.partitionBy("uid")
    rows = voxels.select("uid", "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    hist = rows.groupBy("uid", "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = F.col("lo") + (F.col("bin") + 0.5) * width / bins
    up = W.partitionBy("uid").orderBy("bin")
    hist = hist.withColumn("c", c).select(
        "uid", "lo", "hi", "bin", "c",
        F.sum("n").over(up).alias("w0"), F.sum("n").over(w).alias("w"),
        F.sum(F.col("n") * F.col("c")).over(up).alias("m0"), F.sum(F.col("n") * F.col("c")).over(w).alias("m"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / F.nullif(w1, F.lit(0.0))
    between = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    hist = hist.withColumn("_b", between)
    g = hist.groupBy("uid", "lo", "hi").agg(F.max_by("c", F.struct("_b", -F.col("bin"))).alias("_c"))
    return g.select("uid", F.when(F.col("hi") > F.col("lo"), F.col("_c")).otherwise(F.col("lo")).alias("thr"))


def foreground_mask(voxels: DataFrame, tiny: int = TINY_MASK) -> DataFrame:
    """Voxels above max(otsu, 8 % of p99.5) of the capped volume; a tiny mask falls back to above p60."""
    w = W.partitionBy("uid")
    rows = voxels.select("uid", *AXES, "v", F.percentile("v", F.array(F.lit(CAP_Q), F.lit(TINY_Q))).over(w).alias("_q"))
    capped = rows.withColumn("_v", F.least("v", F.col("_q")[0]))
    thr = otsu(capped.select("uid", F.col("_v").alias("v")))
    j = capped.join(thr, "uid").withColumn("_in", F.col("_v") > F.greatest(F.col("thr"), F.col("_q")[0] * REL_THRESHOLD))
    j = j.withColumn("_n", F.count_if("_in").over(w))
    keep = F.when(F.col("_n") < tiny, F.col("v") > F.col("_q")[1]).otherwise(F.col("_in"))
    return j.where(keep).select("uid", *AXES)


def with_fallback(mask: DataFrame, voxels: DataFrame, tiny: int = TINY_MASK) -> DataFrame:
    """The mask, or the voxels above p60 for volumes of which fewer than ``tiny`` are left.

    For masks that morphology may have worn away: take ``foreground_mask`` with ``tiny=0``, clean it, then call this.
    """
    w = W.partitionBy("uid")
    rows = voxels.select("uid", *AXES, "v").join(mask.select("uid", *AXES, F.lit(True).alias("_in")), ["uid", *AXES], "left")
    rows = rows.withColumn("_n", F.count("_in").over(w)).withColumn("_q", F.percentile("v", F.lit(TINY_Q)).over(w))
    return rows.where(F.when(F.col("_n") < tiny, F.col("v") > F.col("_q")).otherwise(F.col("_in").isNotNull())).select("uid", *AXES)


def _together(mask: DataFrame) -> DataFrame:
    return mask.select("uid", *AXES).repartition("uid")


def erode(mask: DataFrame, n: int = 1) -> DataFrame:
    """Members whose six neighbours are members; outside the grid counts as empty."""
    out = _together(mask)
    for _ in range(n):
        hits = offset_rows(out, CROSS).groupBy("uid", *AXES).agg(F.count(F.lit(1)).alias("_n"))
        out = hits.where(F.col("_n") == len(CROSS)).select("uid", *AXES)
    return out


def dilate(mask: DataFrame, n: int, grid: Grid) -> DataFrame:
    """Members and their six neighbours, inside the grid."""
    out = _together(mask)
    for _ in range(n):
        out = offset_rows(out, CROSS, grid).select("uid", *AXES).distinct()
    return out


def open_(mask: DataFrame, n: int, grid: Grid) -> DataFrame:
    return dilate(erode(mask, n), n, grid)


def close_(mask: DataFrame, n: int, grid: Grid) -> DataFrame:
    """Dilation then erosion; the border erodes, as its outside is empty."""
    return erode(dilate(mask, n, grid), n)


PLACE = [(c, "int") for c in AXES]


def components(mask: DataFrame, grid: Grid) -> DataFrame:
    """Six-connected components, each named by its lowest row-major index (column ``lab``): runs of each line, joined inside a uid."""
    def label(a: Arrays) -> Arrays:
        at = np.unique(placed(a, grid))
        return coordinates(at, grid) | {"lab": run_labels(at, grid)}

    return per_volume(mask.select("uid", *AXES), label, [*PLACE, ("lab", "long")])


def largest_component(mask: DataFrame, grid: Grid) -> DataFrame:
    """The biggest component of each mask, the first one on ties."""
    def largest(a: Arrays) -> Arrays:
        at = np.unique(placed(a, grid))
        _, part, size = np.unique(run_labels(at, grid), return_inverse=True, return_counts=True)
        return coordinates(at[part == size.argmax()], grid)

    return per_volume(mask.select("uid", *AXES), largest, PLACE)


def fill_holes(mask: DataFrame, volume: DataFrame, grid: Grid, own_border: bool = False) -> DataFrame:
    """Mask plus the background that no path connects to the border.

    ``volume``: all coordinates of each uid. The border is that of ``grid``, or each volume's own: the cells from which a step leaves it.
    """
    def filled(a: Arrays) -> Arrays:
        at, member = placed(a, grid), a["member"] == 1
        kept = np.unique(at[member])
        back = np.setdiff1d(at[~member], kept)
        names, part = np.unique(run_labels(back, grid), return_inverse=True)
        own = np.zeros([n + 2 for n in grid], bool)
        own[a["z"] + 1, a["y"] + 1, a["x"] + 1] = True
        if not own_border:
            own[1:-1, 1:-1, 1:-1] = True
        enclosed = np.logical_and.reduce([np.roll(own, step, axis) for axis in range(3) for step in (-1, 1)])[1:-1, 1:-1, 1:-1]
        reached = np.bincount(part, ~enclosed.ravel()[back], len(names)) > 0
        return coordinates(np.concatenate([kept, back[~reached[part]]]), grid)

    both = volume.select("uid", *AXES, F.lit(0).alias("member")).unionByName(mask.select("uid", *AXES, F.lit(1).alias("member")))
    return per_volume(both, filled, PLACE)


def extent(mask: DataFrame) -> DataFrame:
    """First and last occupied index per axis and the vertex, the highest slice."""
    aggs = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("first", F.min), ("last", F.max))]
    return mask.groupBy("uid").agg(*aggs, F.count(F.lit(1)).alias("n")).withColumn("vertex", F.col("last_z"))


def vertex_band(mask: DataFrame, coarse: float = COARSE, least: int = SMALL_BAND) -> DataFrame:
    """Mask members 25 to 125 mm below the vertex; the whole mask with note 1 if that is too few."""
    w = W.partitionBy("uid")
    top = F.col("_t")
    lo = F.greatest(F.bround(top - F.lit(BAND_MM[0] / coarse)), F.lit(0.0))
    hi = F.greatest(F.bround(top - F.lit(BAND_MM[1] / coarse)), lo + 1)
    rows = mask.withColumn("_t", F.max("z").over(w).cast("double")).withColumn("_b", F.col("z").between(lo, hi))
    rows = rows.withColumn("_n", F.count_if("_b").over(w))
    keep = F.col("_b") | (F.col("_n") < least)
    return rows.where(keep).select("uid", *AXES, F.when(F.col("_n") < least, 1).otherwise(0).alias("note"))


