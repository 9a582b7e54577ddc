"""Calibration fits and sensitivity grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxeval.functions.scalars import LOSS_EPS, clip, hash_hex, row_logloss, sigmoid
from voxeval.operators.folds import inner_folds, outer_training_rows
from voxeval.operators.metrics import mid_ranks
from voxeval.plans.bounded import lookup_join, with_grid
from voxeval.plans.newton import Fit, fit_many, ridge
from voxeval.plans.ranking import top_k
from voxeval.session import stage

# Fixed values of the grids.
TEMPS = tuple(round(1.0 + 0.05 * i, 2) for i in range(13))
FLOORS = (0.0, 0.005, 0.01, 0.015, 0.02, 0.03)
TEMP_RANGE = (0.5, 3.0)
PRIOR_PULL = 2e-3  # twice 1e-3: penalties here multiply half the square
AFFINE_BOUNDS = [(0.2, 5.0), (-3.0, 3.0)]
BETA_BOUNDS = [(0.0, 10.0), (0.0, 10.0), (-5.0, 5.0)]


def tempered_loss(y, z, temp, floor) -> Column:
    return floored_loss(y, sigmoid(z / temp), floor)


def floored_loss(y, p, floor) -> Column:
    e = F.greatest(floor, F.lit(LOSS_EPS))
    return row_logloss(y, F.least(F.greatest(p, e), F.lit(1.0) - e))


def temperature_floor_grid(df: DataFrame, temps: Sequence[float] = TEMPS, floors: Sequence[float] = FLOORS, by: Sequence[str] = (),
                           y: str = "y", z: str = "z") -> DataFrame:
    """Mean loss of every temperature and floor.

    Rows are repeated per temperature only; floors are columns of the same aggregate and become
    rows afterwards, so a task hands on one row per temperature.
    """
    rows = with_grid(df.select(*by, F.col(y).alias("_y"), F.col(z).alias("_z")), [{"temp": float(t)} for t in temps])
    rows = rows.withColumn("_p", sigmoid(F.col("_z") / F.col("temp")))
    cells = rows.groupBy(*by, "temp").agg(*[F.avg(floored_loss(F.col("_y"), F.col("_p"), F.lit(float(e)))).alias(f"_l{i}") for i, e in enumerate(floors)])
    table = F.array(*[F.struct(F.lit(float(e)).alias("floor"), F.col(f"_l{i}").alias("loss")) for i, e in enumerate(floors)])
    return cells.select(*by, "temp", F.explode(table).alias("_c")).select(*by, "temp", "_c.floor", "_c.loss")


def grid_best(table: DataFrame, params: Sequence[str], loss: str = "loss", by: Sequence[str] = ()) -> DataFrame:
    """First strict minimum in parameter order."""
    order = F.struct(loss, *params)
    return table.groupBy(*by).agg(F.min(order).alias("_m")).select(*by, *[f"_m.{p}" for p in params], f"_m.{loss}")


def floor_scan(df: DataFrame, floors: Sequence[float] = (0.0, 0.002, 0.005, 0.01), y: str = "y", p: str = "p") -> DataFrame:
    """Mean loss of a probability floor alone."""
    rows = with_grid(df.select(F.col(y).alias("_y"), F.col(p).alias("_p")), [{"floor": float(e)} for e in floors])
    q = F.least(F.greatest(F.col("_p"), F.col("floor")), F.lit(1.0) - F.col("floor"))
    return rows.groupBy("floor").agg(F.avg(row_logloss(F.col("_y"), q)).alias("loss"))


def _temp_losses(df: DataFrame, temps: Sequence[float], y: str, z: str) -> DataFrame:
    rows = with_grid(df.select(F.col(y).alias("_y"), F.col(z).alias("_z")), [{"temp": float(t)} for t in temps])
    return rows.groupBy("temp").agg(F.avg(row_logloss(F.col("_y"), sigmoid(F.col("_z") / F.col("temp")))).alias("loss"))


def fit_temperature(df: DataFrame, y: str = "y", z: str = "z", coarse: float = 0.05, fine: float = 0.001) -> tuple[float, float]:
    """Best temperature in [0.5, 3]: a coarse grid, then a fine one about its minimum."""
    lo, hi = TEMP_RANGE
    n = round((hi - lo) / coarse)
    first = grid_best(_temp_losses(df, [round(lo + coarse * i, 6) for i in range(n + 1)], y, z), ["temp"]).first()["temp"]
    m = round(coarse / fine)
    temps = [round(first + fine * i, 6) for i in range(-m, m + 1)]
    got = grid_best(_temp_losses(df, [t for t in temps if lo <= t <= hi], y, z), ["temp"]).first()
    return got["temp"], got["loss"]


def affine_fit(name: tuple, **kw) -> Fit:
    return Fit(name, penalty=[PRIOR_PULL, PRIOR_PULL], center=[1.0, 0.0], bounds=AFFINE_BOUNDS, per_row=True, **kw)


def beta_fit(name: tuple, **kw) -> Fit:
    return Fit(name, penalty=[PRIOR_PULL] * 3, center=[1.0, 1.0, 0.0], bounds=BETA_BOUNDS, per_row=True, **kw)


def beta_terms(z: str, eps: float = 1e-6) -> tuple[Column, Column]:
    p = clip(sigmoid(z), eps, 1 - eps)
    return F.log(p), -F.log(F.lit(1.0) - p)


def fit_affine(df: DataFrame, y: str = "y", z: str = "z") -> dict:
    """sigma(a z + b), pulled to (1, 0) and bounded (C4)."""
    m = fit_many(df, [z], [affine_fit(("affine",))], y=y)[0]
    return {"a": m.coef[0], "b": m.b}


def fit_beta(df: DataFrame, y: str = "y", z: str = "z") -> dict:
    """a ln p - b ln(1-p) + c, pulled to (1, 1, 0) and bounded."""
    u, v = beta_terms(z)
    m = fit_many(df.select(y, u.alias("_u"), v.alias("_v")), ["_u", "_v"], [beta_fit(("beta",))], y=y)[0]
    return {"a": m.coef[0], "b": m.coef[1], "c": m.b}


def _pick(values: dict[int, Column], by: str) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(by) == k, v).otherwise(out)
    return out


def _lin(cols, m) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(cols, m.coef)), F.lit(float(m.b)))


def inner_stack_scores(df: DataFrame, cols: Sequence[str], k: int, inner_k: int = 5, seed_base: int = 10, c: float = 0.1) -> DataFrame:
    """Inner held-out stack logits of every outer training row: columns outer_fold, inner_fold, s.

    All outer x inner fits run together; each row is read once per outer fold.
    """
    rows = stage(inner_folds(df.select("uid", "y", "fold", *cols), k, inner_k, seed_base))
    fits = [Fit((o, i), held=i, part=o, penalty=ridge(c, len(cols))) for o in range(k) for i in range(inner_k)]
    fitted = {m.name: m for m in fit_many(rows, cols, fits, fold="inner_fold", part="outer_fold")}
    s = F.lit(None).cast("double")
    for (o, i), m in fitted.items():
        s = F.when((F.col("outer_fold") == o) & (F.col("inner_fold") == i), _lin(cols, m)).otherwise(s)
    return rows.withColumn("s", s)


#: Largest logit over temperature at which the mean loss is sure to be convex: beyond it losses are cut.
UNCUT = 34.0


def best_temperatures(rows: DataFrame, temps: Sequence[float], stride: int = 10) -> dict[int, float]:
    """First temperature of the sorted list with the least mean loss of ``s``, per ``part`` (a whole number from 0).

    The loss is convex in 1 / temperature, so it falls and then rises along the list: every ``stride``-th one is tried, then those
    between the neighbours of the best. If a logit is so large that losses are cut, all are tried.
    """
    def losses(grid: dict[int | None, list[float]]) -> DataFrame:
        arrays = {k: F.array(*[F.lit(float(t)) for t in ts]) for k, ts in grid.items()}
        tried = arrays[None] if None in arrays else F.element_at(F.create_map(*[c for k, a in arrays.items() for c in (F.lit(k), a)]), F.col("part").cast("int"))
        long = rows.select("part", "y", "s", F.explode(tried).alias("temp"))
        return long.groupBy("part", "temp").agg(F.avg(row_logloss("y", sigmoid(F.col("s") / F.col("temp")))).alias("loss"), F.max(F.abs("s")).alias("_far"))

    coarse = losses({None: list(temps[::stride])}).collect()  # parts x len(temps) / stride rows
    best: dict[int, tuple[float, float]] = {}
    for r in coarse:
        best[r["part"]] = min(best.get(r["part"], (float("inf"), 0.0)), (r["loss"], r["temp"]))
    if max(r["_far"] for r in coarse) / temps[0] >= UNCUT:
        near = {None: [t for i, t in enumerate(temps) if i % stride]}
    else:
        at = {k: list(temps).index(t) for k, (_, t) in best.items()}
        near = {k: [t for i, t in enumerate(temps) if 0 < abs(i - m) < stride and i % stride] for k, m in at.items()}
    for r in losses(near).collect():
        best[r["part"]] = min(best[r["part"]], (r["loss"], r["temp"]))
    return {k: t for k, (_, t) in best.items()}


def doubly_nested_calibration(df: DataFrame, cols: Sequence[str], k: int, inner_k: int = 5, c: float = 0.1) -> DataFrame:
    """Held-out loss of identity, temperature, affine and beta calibration.

    Calibrators of an outer fold see only inner held-out logits of its training rows.
    """
    inner = stage(inner_stack_scores(df, cols, k, inner_k, 10, c))
    outer = {m.name[0]: m for m in fit_many(df, cols, [Fit((f,), held=f, penalty=ridge(c, len(cols))) for f in range(k)], fold="fold")}
    lo, hi = TEMP_RANGE
    temps = [round(lo + 0.025 * i, 6) for i in range(round((hi - lo) / 0.025) + 1)]
    best_t = best_temperatures(inner.select(F.col("outer_fold").alias("part"), "y", "s"), temps)
    aff = {m.name[0]: m for m in fit_many(inner, ["s"], [affine_fit((f,), part=f) for f in range(k)], part="outer_fold")}
    u, v = beta_terms("s")
    terms = inner.select("outer_fold", "y", u.alias("_u"), v.alias("_v"))
    bet = {m.name[0]: m for m in fit_many(terms, ["_u", "_v"], [beta_fit((f,), part=f) for f in range(k)], part="outer_fold")}
    held = df.select("y", "fold", _pick({f: _lin(cols, m) for f, m in outer.items()}, "fold").alias("s"))
    held = held.withColumn("_u", u).withColumn("_v", v)
    kinds = {
        "identity": F.col("s"),
        "temperature": _pick({f: F.col("s") / F.lit(t) for f, t in best_t.items()}, "fold"),
        "affine": _pick({f: _lin(["s"], m) for f, m in aff.items()}, "fold"),
        "beta": _pick({f: _lin(["_u", "_v"], m) for f, m in bet.items()}, "fold"),
    }
    one = held.agg(F.count(F.lit(1)).alias("n"), *[F.avg(row_logloss("y", sigmoid(e))).alias(n) for n, e in kinds.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("logloss")) for n in kinds])
    return one.select("n", F.explode(rows).alias("r")).select("r.kind", "n", "r.logloss")


def shrink_alpha(v0, v1, d) -> Column:
    """Share given to the prior, at most one half."""
    return F.lit(0.5) * sigmoid(v0 + v1 * d)


def prior_shrink(df: DataFrame, k: int, v0s: Sequence[float], v1s: Sequence[float], y: str = "y", p: str = "p", d: str = "d",
                 fold: str = "fold") -> DataFrame:
    """Chosen (v0, v1) of every outer fold, from its training rows only, and the held-out loss.

    The prior of a fold is the label rate outside it, from per-fold totals.
    """
    tot = {r[fold]: (r["n"], r["s"]) for r in df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s")).collect()}
    n, s = sum(t[0] for t in tot.values()), sum(t[1] for t in tot.values())
    prior = {f: (s - t[1]) / (n - t[0]) for f, t in tot.items()}
    grid = [{"v0": float(a), "v1": float(b)} for a in v0s for b in v1s]
    base = df.select(F.col(y).alias("y"), F.col(p).alias("p"), F.col(d).alias("d"), F.col(fold).alias("fold"))
    rows = with_grid(outer_training_rows(base, k), grid)
    pi = _pick({f: F.lit(float(v)) for f, v in prior.items()}, "outer_fold")

    def mixed(v0, v1, pi):
        a = shrink_alpha(v0, v1, F.col("d"))
        return (F.lit(1.0) - a) * F.col("p") + a * pi

    loss = rows.groupBy("outer_fold", "v0", "v1").agg(F.avg(row_logloss("y", mixed(F.col("v0"), F.col("v1"), pi))).alias("loss"))
    pen = F.lit(1e-3) * (F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1"))
    best = grid_best(loss.withColumn("objective", F.col("loss") + pen), ["v0", "v1"], "objective", ["outer_fold"]).collect()  # k rows
    v0 = _pick({r["outer_fold"]: F.lit(r["v0"]) for r in best}, "fold")
    v1 = _pick({r["outer_fold"]: F.lit(r["v1"]) for r in best}, "fold")
    pi_f = _pick({f: F.lit(float(v)) for f, v in prior.items()}, "fold")
    held = base.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(row_logloss("y", "p")).alias("plain"),
        F.avg(row_logloss("y", mixed(v0, v1, pi_f))).alias("shrunk"),
    )
    return held.select("fold", "n", v0.alias("v0"), v1.alias("v1"), "plain", "shrunk")


def flip_sets(df: DataFrame, scenarios: dict[str, Column], ks: Sequence[int], reps: int, uid: str = "uid", z: str = "z",
              y: str = "y") -> DataFrame:
    """Rows whose label is flipped, per scenario, repeat and k: the k smallest hashes.

    Hashes are even, so a bound that some three times max(ks) rows of a repeat fall below is known from the number of rows: only
    those are ranked. Should a repeat have too few below it (odds far below one in 10^15), all rows are ranked.
    """
    kmax = max(ks)
    src = df.select(F.col(uid).alias("uid"), F.col(z).alias("z"), F.col(y).alias("y"), *[c.alias(f"_in{i}") for i, c in enumerate(scenarios.values())])
    sizes = src.agg(*[F.count_if(f"_in{i}").alias(f"n{i}") for i in range(len(scenarios))]).first()

    def smallest(bounded: bool) -> DataFrame:
        parts = None
        for i, name in enumerate(scenarios):
            rows = with_grid(src.where(f"_in{i}").select("uid", "z", "y"), [{"rep": r} for r in range(reps)])
            rows = rows.withColumn("_h", hash_hex(F.col("uid"), F.lit(name), F.col("rep").cast("string")))
            share = (3 * kmax + 60) / max(1, sizes[f"n{i}"])
            if bounded and share < 1:
                rows = rows.where(F.col("_h") < f"{int(share * 16**12):012x}")
            got = top_k(rows, ["rep"], [F.col("_h"), F.col("uid")], kmax).withColumn("scenario", F.lit(name))
            parts = got if parts is None else parts.unionByName(got)
        return stage(parts.select("scenario", "rep", "uid", "z", "y", "_r"))

    flips = smallest(True)
    if flips.count() < reps * sum(min(kmax, n or 0) for n in sizes):
        flips = smallest(False)
    return with_grid(flips, [{"k": int(k)} for k in ks]).where(F.col("_r") <= F.col("k"))


def label_flip_sensitivity(df: DataFrame, scenarios: dict[str, Column], ks: Sequence[int], reps: int, temps: Sequence[float] = TEMPS,
                           floors: Sequence[float] = FLOORS, uid: str = "uid", y: str = "y", z: str = "z") -> DataFrame:
    """Mean loss, AUC and best (temperature, floor) after k label flips.

    The full table is read once for grid sums and once for score ranks. A flip changes one
    loss term and one rank contribution, so each repeat is the base plus at most k deltas.
    """
    base = df.select(F.col(uid).alias("uid"), F.col(y).cast("double").alias("y"), F.col(z).alias("z"))
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.avg(row_logloss("y", sigmoid("z"))).alias("l")).first()
    n, p, plain = sizes["n"], sizes["p"], sizes["l"]
    ranks = stage(mid_ranks(base, y="y"))
    rank_sum = ranks.agg(F.sum(F.col("pos") * F.col("rank"))).first()[0]
    grid = stage(temperature_floor_grid(base, temps, floors))
    flips = stage(flip_sets(base, scenarios, [k for k in ks if k > 0], reps))
    up = F.lit(1.0) - F.col("y") * 2.0  # +1 where a 0 becomes 1
    ranked = lookup_join(ranks.select("z", "rank"), flips, "z")  # flips are the small side
    one = ranked.groupBy("scenario", "k", "rep").agg(
        F.sum(up).alias("dp"), F.sum(up * F.col("rank")).alias("dr"),
        F.sum(row_logloss(F.lit(1.0) - F.col("y"), sigmoid("z")) - row_logloss("y", sigmoid("z"))).alias("dl"),
    )
    pos = F.lit(p) + F.col("dp")
    area = (F.lit(rank_sum) + F.col("dr") - pos * (pos + 1) / 2) / (pos * (F.lit(float(n)) - pos))
    means = one.groupBy("scenario", "k").agg(F.avg(F.lit(plain) + F.col("dl") / n).alias("logloss"), F.avg(area).alias("auc"))
    t, e = F.col("temp"), F.col("floor")
    cells = with_grid(flips, [{"temp": float(a), "floor": float(b)} for a in temps for b in floors])
    d = tempered_loss(F.lit(1.0) - F.col("y"), F.col("z"), t, e) - tempered_loss(F.col("y"), F.col("z"), t, e)
    cell = cells.groupBy("scenario", "k", "temp", "floor").agg((F.sum(d) / F.lit(float(n * reps))).alias("d"))
    cell = lookup_join(cell, grid, ["temp", "floor"]).withColumn("loss", F.col("loss") + F.col("d"))
    best = grid_best(cell, ["temp", "floor"], by=["scenario", "k"]).withColumnRenamed("loss", "best_loss")
    out = means.join(best, ["scenario", "k"])
    if 0 in ks:
        top = grid_best(grid, ["temp", "floor"]).withColumnRenamed("loss", "best_loss")
        base_auc = (rank_sum - p * (p + 1) / 2) / (p * (n - p))
        zero = with_grid(top, [{"scenario": s, "k": 0} for s in scenarios]).select(
            "scenario", "k", F.lit(plain).alias("logloss"), F.lit(base_auc).alias("auc"), "temp", "floor", "best_loss")
        out = out.unionByName(zero)
    return out


def match_observed(table: DataFrame, target: float, tol: float = 0.004) -> DataFrame:
    """Flip counts whose simulated loss reproduces an observed score."""
    return table.where(F.abs(F.col("logloss") - F.lit(float(target))) < F.lit(float(tol)))
