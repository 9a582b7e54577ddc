"""From a whole scan to a crop in background units: localisation, background and cropping, composed of the raster operators.

Every step works on all volumes of a table, whatever their spacing and shape; volumes stay together by uid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxeval.operators import masks as K
from voxeval.operators.rasters import (
    AXES, CELL, COARSE, SHAPE, SPACING, SPACINGS, STORE_GRID, Grid, _all_cells, blurred, center_of_mass, downsample_each, normalize, trimmed_mean,
)
from voxeval.plans.volumes import Arrays, dense, per_volume, sampled
from voxeval.session import stage

#: Notes on how the peak was found.
FOUND, NO_BAND, NOT_NEAR, ANYWHERE = 0, 1, 2, 3
EMPTY = "empty volume"


@dataclass(frozen=True)
class Limits:
    """Fixed values of localisation: cells that each step needs before it falls back, and reaches."""

    tiny: int = K.TINY_MASK
    band: int = K.SMALL_BAND
    near: int = 10
    midline: int = 50
    slab: int = 200
    reach_y: float = 50.0
    reach_x: float = 35.0
    midline_z: tuple[int, int] = (5, 5)
    slab_z: tuple[int, int] = (12, 12)
    mask_blur: float = 1.0
    peak_blur: float = 1.5


def smoothed(voxels: DataFrame, sigma: float) -> DataFrame:
    """Blur of whole volumes of any shape, edges reflected."""
    def blur(a: Arrays) -> Arrays:
        shape = tuple(int(a[c].max()) + 1 for c in AXES)
        return _all_cells(blurred(dense(a, shape), (sigma,) * 3, "reflect"))

    return per_volume(voxels.select("uid", *AXES, "v"), blur, CELL)


def head_mask(sm: DataFrame, cells: Grid, limits: Limits = Limits()) -> DataFrame:
    """Threshold, opening, largest part, closing, holes filled; a tiny rest falls back to the brightest 40 %.

    ``cells``: a grid that holds every volume.
    """
    own = sm.select("uid", *AXES)

    def grown(mask: DataFrame, n: int) -> DataFrame:
        return K.dilate(mask, n, cells).join(own, ["uid", *AXES], "left_semi")

    opened = grown(K.erode(K.foreground_mask(sm, 0), 1), 1)
    closed = stage(K.erode(grown(K.largest_component(opened, cells), 2), 2))
    return K.with_fallback(K.fill_holes(closed, own, cells, own_border=True), sm, limits.tiny)


def _peaks(mask: DataFrame, band: DataFrame, sm2: DataFrame, limits: Limits, anywhere: bool) -> DataFrame:
    """uid, pz, py, px, peak and note: the brightest cell of the band near its centre, or of the whole mask; ties by x, y, z."""
    centre = center_of_mass(band)
    rows = mask.select("uid", *AXES).join(sm2, ["uid", *AXES])
    if anywhere:
        inner = K.erode(mask, 2).select("uid", *AXES, F.lit(True).alias("near"))
        rows = rows.join(inner, ["uid", *AXES], "left").withColumn("note", F.lit(ANYWHERE))
    else:
        rows = rows.join(band.select("uid", *AXES, "note"), ["uid", *AXES], "left").join(centre, "uid")
        near = (F.abs(F.col("x") - F.col("cx")) * COARSE <= limits.reach_x) & (F.abs(F.col("y") - F.col("cy")) * COARSE <= limits.reach_y)
        rows = rows.withColumn("near", F.col("note").isNotNull() & near)
    at, order = F.struct(*AXES, "v"), F.struct(F.col("v"), -F.col("x"), -F.col("y"), -F.col("z"))
    got = rows.groupBy("uid").agg(
        F.count_if("near").alias("n"), F.max("note").alias("note"), F.max_by(F.when(F.col("near"), at), F.when(F.col("near"), order)).alias("a"), F.max_by(at, order).alias("b")
    )
    enough = F.col("n") >= limits.near
    pick = F.when(enough, F.col("a")).otherwise(F.col("b"))
    note = F.when(enough | F.lit(anywhere), F.col("note")).otherwise(F.lit(NOT_NEAR))
    return got.join(centre, "uid").select("uid", *[pick[c].alias(f"p{c}") for c in AXES], pick["v"].alias("peak"), note.alias("note"), "cx")


def localise(small: DataFrame, cells: Grid, limits: Limits = Limits(), anywhere: bool = False) -> DataFrame:
    """Per volume of the coarse grid: top, peak, midline, background and note. Volumes without signal are left out."""
    sm = stage(smoothed(small, limits.mask_blur))
    cap = F.percentile("v", F.lit(K.CAP_Q)).over(W.partitionBy("uid"))
    sm = stage(sm.withColumn("_q", cap).where((F.col("_q") > 0) & (F.col("_q") < float("inf"))).drop("_q"))
    mask = stage(head_mask(sm, cells, limits))
    band = stage(K.vertex_band(mask, COARSE, limits.band))
    peaks = stage(_peaks(mask, band, smoothed(small, limits.peak_blur), limits, anywhere))

    rows = mask.join(sm, ["uid", *AXES]).join(peaks.select("uid", "pz"), "uid")
    def level(reach: tuple[int, int]):
        return F.col("z").between(F.greatest(F.col("pz") - reach[0], F.lit(0)), F.col("pz") + reach[1])

    rows = rows.withColumn("mid", level(limits.midline_z)).withColumn("slab", level(limits.slab_z))
    rows = rows.withColumn("wide", F.count_if("slab").over(W.partitionBy("uid")) > limits.slab)
    about = rows.groupBy("uid").agg(F.max("z").alias("top"), F.count_if("mid").alias("n"), F.avg(F.when(F.col("mid"), F.col("x"))).alias("mx"))
    bg = trimmed_mean(rows.where(F.col("slab") | ~F.col("wide")).select("uid", "v"))
    midline = F.when(F.col("n") > limits.midline, F.col("mx")).otherwise(F.col("cx")).alias("cx")
    return peaks.join(about, "uid").join(bg, "uid").select("uid", "top", "pz", "py", "px", "peak", "note", midline, "bg")


def crops(voxels: DataFrame, scans: DataFrame, found: DataFrame, out: Grid = STORE_GRID) -> DataFrame:
    """The grid ``out`` of 2 mm about each volume's midline and peak, straight from its voxels, in background units."""
    def cut(a: Arrays) -> Arrays:
        shape, spacing = [int(a[c][0]) for c in SHAPE], np.array([float(a[c][0]) for c in SPACINGS])
        v = dense(a, tuple(shape))
        if (spacing < 0.8 * SPACING).any():
            v = blurred(v, np.maximum(0.0, 0.5 * SPACING / spacing - 0.35), "reflect")
        coarse = [max(1, round(n * float(s) / COARSE)) for n, s in zip(shape, spacing)]
        middle = np.array([a[c][0] for c in ("pz", "py", "cx")]) * [(n - 1) / max(m - 1, 1) for n, m in zip(shape, coarse)]
        step = SPACING / spacing
        return _all_cells(sampled(v, np.diag(step), middle - step * (np.array(out) - 1) / 2.0, out, "outside_zero"))

    params = scans.select("uid", *SPACINGS, *SHAPE).join(found.select("uid", "pz", "py", "cx"), "uid")
    return normalize(per_volume(voxels.select("uid", *AXES, "v"), cut, CELL, params), found.select("uid", "bg"))


def preprocess(voxels: DataFrame, scans: DataFrame, cells: Grid, out: Grid = STORE_GRID, limits: Limits = Limits(), anywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """Crops (uid, z, y, x, v) and metadata of every scan.

    ``scans``: uid, spacing (sz, sy, sx) and shape (nz, ny, nx); ``cells``: a grid that holds every volume at 4 mm. The metadata keep
    each scan: one without signal has ok 0 and its error, and no crop. ``anywhere`` looks for the peak in the whole eroded mask.
    """
    small = stage(downsample_each(voxels, scans))
    found = stage(localise(small, cells, limits, anywhere))
    meta = scans.join(found, "uid", "left").select(
        "uid", F.when(F.col("bg").isNull(), 0).otherwise(1).alias("ok"), F.when(F.col("bg").isNull(), F.lit(EMPTY)).alias("err"), *SPACINGS, *SHAPE,
        (F.col("peak") / (F.col("bg") + 1e-6)).alias("peak_bg"), ((F.col("top") - F.col("pz")) * F.lit(COARSE)).alias("top_to_peak_mm"),
        ((F.col("px") - F.col("cx")) * F.lit(COARSE)).alias("peak_off_x_mm"), F.col("note").alias("loc_note"),
    )
    return crops(voxels, scans, found, out), meta
