"""Voxel operators against dense numpy arrays."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxeval.operators import features as X
from voxeval.operators import joins as J
from voxeval.operators import masks as K
from voxeval.operators import preprocess as P
from voxeval.operators import rasters as R
from voxeval.operators import templates as T
from voxeval.plans import volumes as V

GRID = (5, 6, 8)


def long(v, uid="u"):
    z, y, x = np.meshgrid(*[np.arange(n) for n in v.shape], indexing="ij")
    return pd.DataFrame({"uid": uid, "z": z.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": v.ravel()})


def dense(pdf, grid=GRID, col="v"):
    out = np.zeros(grid)
    out[pdf.z, pdf.y, pdf.x] = pdf[col]
    return out


@pytest.fixture(scope="module")
def vols():
    rng = np.random.default_rng(3)
    return {"a": rng.gamma(2.0, 0.6, GRID), "b": rng.gamma(2.0, 0.5, GRID)}


@pytest.fixture(scope="module")
def vox(spark, vols):
    return spark.createDataFrame(pd.concat([long(v, k) for k, v in vols.items()])).cache()


def split(df, grid=GRID):
    p = df.toPandas()
    return {k: dense(d, grid) for k, d in p.groupby("uid")}


@pytest.mark.parametrize("edge,mode", [("replicate", "edge"), ("reflect", "symmetric")])
def test_blur(vox, vols, edge, mode):
    sig = (0.8, 1.1, 0.0)
    got = split(R.gaussian_blur(vox, sig, GRID, edge))
    for k, v in vols.items():
        want = v
        for axis, s in enumerate(sig):
            if s:
                r = R.blur_radius(s, edge)
                w = R.gaussian_weights(s, r)
                pad = np.pad(want, [(r, r) if a == axis else (0, 0) for a in range(3)], mode=mode)
                want = sum(w[i] * np.take(pad, np.arange(i, i + want.shape[axis]), axis) for i in range(2 * r + 1))
        assert np.allclose(got[k], want)


def test_harmonize_equals_reflecting_blur(spark, vox):
    zooms = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "uid string, zoom double")
    got = split(R.harmonize_blur(vox, zooms, 0.8, GRID))
    sigma = np.sqrt(3.2**2 - 1.6**2) / 2
    want = split(R.gaussian_blur(vox, (sigma,) * 3, GRID, "reflect"))
    raw = split(vox)
    assert np.allclose(got["a"], want["a"]) and np.allclose(got["b"], raw["b"])


def test_mirror_twice_is_identity(vox):
    m = J.mirror_mean(vox, GRID[2])
    again = J.mirror_mean(m, GRID[2])
    a, b = split(m), split(again)
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_resample_identity_and_flip(spark, vox, vols):
    eye = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    assert np.allclose(split(R.affine_resample(vox, eye, [0, 0, 0], GRID, GRID))["a"], vols["a"])
    flip = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, -1.0]]
    assert np.allclose(split(R.affine_resample(vox, flip, [0, 0, GRID[2] - 1], GRID, GRID))["b"], vols["b"][:, :, ::-1])
    half = split(R.affine_resample(vox, eye, [0, 0, 0.5], GRID, GRID))["a"]
    want = 0.5 * (vols["a"] + np.pad(vols["a"][:, :, 1:], [(0, 0), (0, 0), (0, 1)]))
    assert np.allclose(half, want)


def neighbours(m):
    p = np.pad(m, 1)
    return [p[1 + a: 1 + a + m.shape[0], 1 + b: 1 + b + m.shape[1], 1 + c: 1 + c + m.shape[2]] for _, a, b, c in
            ((0, 0, 0, 0), *((0, *d) for d in K.CROSS[1:]))]


def mask_of(df, uid="a"):
    out = np.zeros(GRID, bool)
    p = df.where(F.col("uid") == uid).toPandas()
    out[p.z, p.y, p.x] = True
    return out


def test_morphology(vox, vols):
    m = vox.where("v > 0.5").select("uid", "z", "y", "x")
    a = vols["a"] > 0.5
    assert (mask_of(K.erode(m)) == np.all(neighbours(a), axis=0)).all()
    assert (mask_of(K.dilate(m, 1, GRID)) == np.any(neighbours(a), axis=0)).all()
    e, d = mask_of(K.erode(m)), mask_of(K.dilate(m, 1, GRID))
    assert (e <= a).all() and (a <= d).all()


def flood(m):
    lab, n = np.full(m.shape, -1), 0
    for start in zip(*np.nonzero(m)):
        if lab[start] >= 0:
            continue
        todo = [start]
        lab[start] = n
        while todo:
            c = todo.pop()
            for o in K.CROSS[1:]:
                t = tuple(np.add(c, o))
                if all(0 <= t[i] < m.shape[i] for i in range(3)) and m[t] and lab[t] < 0:
                    lab[t] = n
                    todo.append(t)
        n += 1
    return lab, n


def test_components_and_holes(spark, vox, vols):
    m = vox.where("v > 1.1").select("uid", "z", "y", "x")
    got = K.components(m, GRID).toPandas()
    for k, v in vols.items():
        lab, n = flood(v > 1.1)
        d = got[got.uid == k]
        assert d.lab.nunique() == n
        assert (d.groupby(lab[d.z, d.y, d.x]).lab.nunique() == 1).all()
        best = np.argmax(np.bincount(lab[lab >= 0]))
        assert (mask_of(K.largest_component(m, GRID), k) == (lab == best)).all()
    closed = vox.where("v > 0.6").select("uid", "z", "y", "x")
    lab, n = flood(~(vols["a"] > 0.6))
    rim = np.ones(GRID, bool)
    rim[1:-1, 1:-1, 1:-1] = False
    outside = np.isin(lab, np.unique(lab[rim & (lab >= 0)])) & (lab >= 0)
    assert (mask_of(K.fill_holes(closed, vox, GRID)) == ~outside).all()


def test_long_snake_is_one_component(spark):
    """A path through the whole grid, the hardest shape for label passing."""
    path = [(0, y, x) for y in range(0, 9, 2) for x in (range(9) if y % 4 == 0 else reversed(range(9)))]
    links = [(0, y + 1, 8 if y % 4 == 0 else 0) for y in range(0, 8, 2)]
    df = spark.createDataFrame([("s", *p) for p in path + links], "uid string, z int, y int, x int")
    assert K.components(df, (1, 9, 9)).select("lab").distinct().count() == 1


def test_otsu_matches_histogram(vox, vols):
    got = {r.uid: r.thr for r in K.otsu(vox).collect()}
    for k, v in vols.items():
        hist, edges = np.histogram(v, 256, (v.min(), v.max()))
        c, h = (edges[:-1] + edges[1:]) / 2, hist.astype(float)
        w0, m0 = np.cumsum(h), np.cumsum(h * c)
        with np.errstate(all="ignore"):
            vb = np.nan_to_num(w0 * (w0[-1] - w0) * (m0 / w0 - (m0[-1] - m0) / (w0[-1] - w0)) ** 2)
        assert got[k] == pytest.approx(c[np.argmax(vb)])


def test_constant_volume(spark):
    df = spark.createDataFrame(long(np.full((2, 2, 2), 3.0)))
    assert K.otsu(df).first().thr == 3.0


def test_ncc_of_itself_is_one(vox):
    t = vox.where("uid = 'a'").select("z", "y", "x", F.col("v").alias("t"))
    got = {r.uid: r.ncc for r in T.ncc(vox, t).collect()}
    assert got["a"] == pytest.approx(1.0, abs=1e-6) and abs(got["b"]) < 0.5


def test_two_level_alignment_finds_a_shift(spark):
    z, y, x = np.meshgrid(*[np.arange(n) for n in (8, 9, 10)], indexing="ij")
    base = np.exp(-((z - 4) ** 2 + (y - 4) ** 2 / 2 + (x - 5) ** 2 / 3) / 3.0)
    moved = np.roll(base, (1, -1, 2), (0, 1, 2))
    t = spark.createDataFrame(long(base)).select("z", "y", "x", F.col("v").alias("t"))
    got = T.align(spark.createDataFrame(long(moved)), t, (8, 9, 10), T.shift_grid(((-2, 0, 2),) * 3, (0,)), ((-1, 0, 1),) * 3, (1.0, 0.5)).first()
    assert (got.dz, got.dy, got.dx) == (-1, 1, -2) and got.ncc > 0.95


def test_scan_features_against_numpy(spark, vols):
    grid, half = (8, 10, 12), (4, 4, 5)
    rng = np.random.default_rng(5)
    v = rng.gamma(2.0, 0.7, grid)
    got = X.scan_features(spark.createDataFrame(long(v)), grid, half).first().asDict()
    gmax = v.max() + 1e-6
    assert got["g_max"] == pytest.approx(gmax) and got["g_p99.9"] == pytest.approx(np.percentile(v, 99.9))
    sb = v[0:8, 1:9, 1:11]
    sides = [sb[:, :, :5], sb[:, :, 5:][:, :, ::-1]]
    tops, exts, elong, cen = [], [], [], []
    for h in sides:
        tops.append(np.sort(h.ravel())[::-1][:125].mean())
        hot = np.argwhere(h > 0.5 * gmax).astype(float)
        w = h[h > 0.5 * gmax]
        exts.append((np.percentile(hot[:, 1], 95) - np.percentile(hot[:, 1], 5)) * 2)
        cen.append((np.average(hot[:, 1], weights=w) - 4) * 2)
        ev = np.sort(np.linalg.eigvalsh(np.cov(hot[:, ::-1].T) + 1e-6 * np.eye(3)))[::-1]
        elong.append(np.sqrt(ev[0] / ev[1]))
    for name, pair in (("top125", tops), ("yext0.5", exts), ("ycen0.5", cen), ("elong0.5", elong)):
        assert got[f"{name}_min"] == pytest.approx(min(pair)) and got[f"{name}_mean"] == pytest.approx(np.mean(pair))
        assert got[f"{name}_asym"] == pytest.approx(abs(pair[0] - pair[1]) / (abs(pair[0]) + abs(pair[1]) + 1e-6))


def test_side_features_do_not_depend_on_orientation(spark):
    rng = np.random.default_rng(6)
    grid, half = (8, 10, 12), (4, 4, 5)
    v = rng.gamma(2.0, 0.7, grid)
    both = spark.createDataFrame(pd.concat([long(v, "a"), long(v[:, :, ::-1].copy(), "b")]))
    rows = [r.asDict() for r in X.scan_features(both, grid, half).orderBy("uid").collect()]
    assert all(rows[0][k] == pytest.approx(rows[1][k]) for k in rows[0] if k != "uid")


def test_volume_violations(spark, vols):
    bad = long(vols["a"]).iloc[1:]
    bad = pd.concat([bad, bad.iloc[[0]], bad.iloc[[0]].assign(x=99)])
    row = R.volume_violations(spark.createDataFrame(bad), GRID).first()
    assert (row.outside, row.repeated, row.missing) == (1, 1, 1)


def test_clusters_ties_and_empty(spark):
    pts = [(s, float(p), float(q)) for s, p, q in itertools.chain(((0, p, q) for p in (1, 2, 8, 9) for q in (3, 4)), ((3, 5, 5) for _ in range(4)))]
    got = T.grouped_2means(spark.createDataFrame(pts, "side int, p double, q double")).toPandas()
    assert got[got.side == 0].groupby("p").k.first().to_dict() == {1.0: 0, 2.0: 0, 8.0: 1, 9.0: 1}
    assert (got[got.side == 3].k == got[got.side == 3].k.iloc[0]).all()


def trilinear(v, at, edge):
    """Value at one real place."""
    if edge == "outside_zero" and any(p < 0 or p > n - 1 for p, n in zip(at, v.shape)):
        return 0.0
    if edge != "zero":
        at = [min(max(p, 0), n - 1) for p, n in zip(at, v.shape)]
    total = 0.0
    for bits in itertools.product((0, 1), repeat=3):
        place = [int(np.floor(p)) + b for p, b in zip(at, bits)]
        weight = np.prod([p - np.floor(p) if b else 1 - (p - np.floor(p)) for p, b in zip(at, bits)])
        if all(0 <= c < n for c, n in zip(place, v.shape)):
            total += weight * v[tuple(place)]
    return total


@pytest.mark.parametrize("edge", ["zero", "nearest", "outside_zero"])
@pytest.mark.parametrize("matrix", [((0.8, 0, 0), (0, -1.1, 0), (0, 0, 1.3)), ((0, 0, 0.7), (1.2, 0, 0), (0, -0.6, 0)), ((0.9, 0.2, 0), (-0.2, 0.9, 0.1), (0, 0.05, 1.0))])
def test_sampling_against_single_places(vols, edge, matrix):
    """Axes apart, swapped and mixed: passes and gathers give the same as place by place."""
    v, m, t, out = vols["a"], np.array(matrix, float), np.array([0.3, 4.1, -0.6]), (4, 7, 6)
    got = V.sampled(v, m, t, out, edge)
    want = np.array([trilinear(v, m @ np.array(o) + t, edge) for o in np.ndindex(*out)]).reshape(out)
    assert np.allclose(got, want)


def test_resampling_needs_one_exchange(spark, vox):
    plan = R.affine_resample(vox.select("*"), np.eye(3), (0, 0, 0), GRID, GRID)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("density", [0.2, 0.35, 0.6, 0.95])
def test_runs_against_flooding(density):
    """Labels of random masks, single cells, full lines and planes."""
    rng = np.random.default_rng(int(density * 100))
    for grid in ((6, 7, 9), (1, 5, 5), (4, 1, 6), (3, 4, 1)):
        m = rng.random(grid) < density
        want = np.full(grid, -1)
        for start in np.ndindex(*grid):
            if m[start] and want[start] < 0:
                todo, name = [start], np.ravel_multi_index(start, grid)
                want[start] = name
                while todo:
                    at = todo.pop()
                    for axis in range(3):
                        for step in (-1, 1):
                            c = list(at)
                            c[axis] += step
                            if 0 <= c[axis] < grid[axis] and m[tuple(c)] and want[tuple(c)] < 0:
                                want[tuple(c)] = name
                                todo.append(tuple(c))
        at = np.flatnonzero(m.ravel())
        assert (V.run_labels(at, grid) == want.ravel()[at]).all()


def test_components_need_one_exchange(spark, vox):
    mask = vox.where("v > 1").select("uid", "z", "y", "x")
    for df in (K.largest_component(mask, GRID), K.fill_holes(mask, vox, GRID)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_real_spacing_against_scipy_rules(spark, vols):
    """Two spacings and shapes in one table: blurred by their own steps, first and last cells laid over each other."""
    spacing = {"a": (2.0, 3.0, 2.5), "b": (5.0, 1.0, 4.0)}
    scans = spark.createDataFrame([(k, *s, *GRID) for k, s in spacing.items()], "uid string, sz double, sy double, sx double, nz int, ny int, nx int")
    got = R.downsample_each(spark.createDataFrame(pd.concat([long(v, k) for k, v in vols.items()])), scans, 4.0).toPandas()
    for k, v in vols.items():
        out = R.coarse_shape(GRID, spacing[k], 4.0)
        for axis, s in enumerate(spacing[k]):
            if (sigma := max(0.0, 2.0 / s - 0.35)) > 0:
                r = R.blur_radius(sigma, "reflect")
                w = R.gaussian_weights(sigma, r)
                pad = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
                v = sum(w[i] * np.take(pad, np.arange(i, i + GRID[axis]), axis) for i in range(2 * r + 1))
        want = np.array([trilinear(v, [i * (n - 1) / (m - 1) if m > 1 else 0.0 for i, n, m in zip(o, GRID, out)], "nearest") for o in np.ndindex(*out)]).reshape(out)
        assert np.allclose(dense(got[got.uid == k], out), want)


def test_beam_keeps_three_and_tries_each_move_once(spark, vols):
    """Half-resolution winners are refined together; a shifted, enlarged template is found again."""
    grid = (8, 8, 8)
    z, y, x = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    t = np.exp(-((z - 3.0) ** 2 + (y - 4.0) ** 2 / 2 + (x - 2.5) ** 2) / 3.0)
    moved = np.zeros(grid)
    moved[1:, :-1, 2:] = t[:-1, 1:, :-2]
    tpl = spark.createDataFrame(long(t).drop(columns="uid").rename(columns={"v": "t"}))
    vox = spark.createDataFrame(pd.concat([long(moved, "m"), long(t, "t")]))
    coarse, steps = T.shift_grid(((-1, 0, 1),) * 3), ((-1, 0, 1),) * 3
    got = {r["uid"]: r for r in T.align_pyramid(vox, tpl, grid, coarse, steps, (1.0, 1.3)).collect()}
    assert [got["m"][c] for c in ("scale", "flip", "dz", "dy", "dx")] == [0, 0, -1, 1, -2] and got["m"]["ncc"] > 0.99
    assert [got["t"][c] for c in ("scale", "flip", "dz", "dy", "dx")] == [0, 0, 0, 0, 0]
    rows = T.scaled(vox, grid, (1.0, 1.3))
    scores = T._score_moves(T.with_grid(rows, coarse), tpl, grid, ["uid", "scale", *T.MOVE])
    assert scores.count() == 2 * 2 * len(coarse)
    best = T.beam(scores, 3)
    assert [r["count"] for r in best.groupBy("uid").count().collect()] == [3, 3]


def test_preprocess_keeps_scans_without_signal_and_looks_anywhere(spark):
    """A bright cell beside a broad head; one volume of zeros, one table without rows."""
    grid = (14, 14, 14)
    z, y, x = np.meshgrid(*[np.arange(14)] * 3, indexing="ij")
    head = 1.0 * ((z - 7) ** 2 + (y - 6) ** 2 + (x - 7) ** 2 < 30) + 2.0 * ((z - 8) ** 2 + (y - 6) ** 2 + (x - 8) ** 2 < 4)
    vox = spark.createDataFrame(pd.concat([long(head, "a"), long(np.zeros(grid), "b")]))
    scans = spark.createDataFrame([(u, 4.0, 4.0, 4.0, *grid) for u in "ab"], "uid string, sz double, sy double, sx double, nz int, ny int, nx int")
    for anywhere, note in ((False, 0), (True, 3)):
        crops, meta = P.preprocess(vox, scans, grid, (20, 20, 20), P.Limits(tiny=20, near=5), anywhere)
        meta = {r["uid"]: r for r in meta.collect()}
        assert (meta["b"]["ok"], meta["b"]["err"]) == (0, P.EMPTY) and meta["a"]["ok"] == 1 and meta["a"]["loc_note"] == note
        got = crops.toPandas()
        assert set(got.uid) == {"a"} and len(got) == 20**3
        peak = dense(got, (20, 20, 20))
        bright = np.argwhere(peak > 0.9 * peak.max()).mean(axis=0)  # the middle of the bright part
        deep = 9.5 if anywhere else 15.5  # 25 mm below the top at most, the bright part lies higher
        assert np.abs(bright - (deep, 9.5, 11.5)).max() <= 2.0 and meta["a"]["peak_bg"] > 1.2
    crops, meta = P.preprocess(vox.where("uid = 'z'"), scans.where("uid = 'z'"), grid, (4, 4, 4))
    assert crops.count() == 0 and meta.count() == 0
