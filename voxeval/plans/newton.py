"""Many small penalised logistic fits together: one aggregate per Newton step for all of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxeval.functions.scalars import CLIP_SD, ZOOM_DEFAULT
from voxeval.plans.bounded import struct_array_sql
from voxeval.session import stage


@dataclass
class Fit:
    """One fit: rows of ``part`` (if set) outside fold ``held`` (if set)."""

    name: tuple
    held: int | None = None
    part: int | None = None
    penalty: Sequence[float] = ()  # per coefficient, intercept last; multiplies (b - center)^2 / 2
    center: Sequence[float] = ()
    bounds: Sequence[tuple[float, float]] | None = None
    per_row: bool = False  # penalties are per training row (mean loss) instead of per fit
    adj: Sequence[Sequence[float]] | None = None  # 3 x d trend in (1, zoom, zoom^2), removed first
    mu: Sequence[float] | None = None  # then standardised with mu, sd and clipped
    sd: Sequence[float] | None = None


@dataclass
class Fitted:
    name: tuple
    coef: list[float]
    b: float
    n: int
    loss: float  # sum over the training rows
    gradient: float  # largest absolute entry before the last, negligible step
    iterations: int


def ridge(c: float, d: int) -> list[float]:
    """Penalties of ``C``: 1/C on coefficients, none on the intercept."""
    return [1.0 / c] * d + [0.0]


def _config(i: int, fit: Fit, beta: np.ndarray) -> dict:
    values = {f"b{j}": v for j, v in enumerate(beta)}
    if fit.mu is not None:
        values |= {f"u{j}": v for j, v in enumerate(fit.mu)} | {f"s{j}": v for j, v in enumerate(fit.sd)}
    if fit.adj is not None:
        values |= {f"a{k}_{j}": v for k, row in enumerate(fit.adj) for j, v in enumerate(row)}
    return {"i": i, "held": -1 if fit.held is None else int(fit.held)} | {k: float(v) for k, v in values.items()}


def _input(j: int, fit: Fit) -> str:
    """Column j as this kind of fit sees it, as SQL."""
    x = f"_x{j}"
    if fit.adj is not None:
        x = f"({x} - (_c.a0_{j} + _c.a1_{j} * _zoom + _c.a2_{j} * _zoom * _zoom))"
    return x if fit.mu is None else f"least(greatest(({x} - _c.u{j}) / _c.s{j}, -{CLIP_SD}D), {CLIP_SD}D)"


def _pass(data: DataFrame, d: int, todo: list[tuple[int, Fit, np.ndarray]]) -> dict[int, dict]:
    """Count, loss, gradient and Hessian sums of every open fit.

    Written as SQL expressions: a step differs from the last one in its literals only.
    """
    parts: dict[int | None, list] = {}
    for i, fit, beta in todo:
        parts.setdefault(fit.part, []).append(_config(i, fit, beta))
    if list(parts) == [None]:
        grid = struct_array_sql(parts[None])
    else:
        grid = "element_at(map(" + ", ".join(f"{key}, {struct_array_sql(cfgs)}" for key, cfgs in parts.items()) + "), _part)"
    kind, n = todo[0][1], d + 1
    xs = [f"_x{j}" for j in range(d)]
    one = [*xs, "1.0D"]
    rows = data.selectExpr("_y", "_w", "_fold", "_zoom", *xs, f"explode({grid}) AS _c").where("_c.held <> _fold")
    rows = rows.selectExpr("_c", "_y", "_w", *[f"{_input(j, kind)} AS _x{j}" for j in range(d)])
    z = " + ".join([f"_c.b{d}", *[f"_c.b{j} * _x{j}" for j in range(d)]])
    rows = rows.selectExpr("_c.i AS i", "_y", "_w", *xs, f"{z} AS _z").selectExpr("*", "1.0D / (1.0D + exp(-_z)) AS _p")
    rows = rows.selectExpr(
        "i", "_w", *xs, "_w * (_p - _y) AS _r", "_w * _p * (1.0D - _p) AS _h",
        "_w * (greatest(_z, 0.0D) + log1p(exp(-abs(_z))) - _y * _z) AS _l",
    )
    sums = ["count(1) AS n", "sum(_w) AS w", "sum(_l) AS l", *[f"sum(_r * {one[j]}) AS g{j}" for j in range(n)]]
    sums += [f"sum(_h * {one[j]} * {one[k]}) AS h{j}_{k}" for j in range(n) for k in range(j, n)]
    return {r["i"]: r.asDict() for r in rows.groupBy("i").agg(*[F.expr(e) for e in sums]).collect()}  # one row per fit


def _project(fit: Fit, beta: np.ndarray) -> np.ndarray:
    if fit.bounds is None:
        return beta
    lo, hi = np.array(fit.bounds).T
    return np.clip(beta, lo, hi)


def _step(fit: Fit, beta: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton step on the coordinates not held at a bound, and the size of their gradient."""
    free = np.ones(len(beta), bool)
    if fit.bounds is not None:
        lo, hi = np.array(fit.bounds).T
        free = ~(((beta <= lo) & (g > 0)) | ((beta >= hi) & (g < 0)))
    step = np.zeros_like(beta)
    if free.any():
        hf = h[np.ix_(free, free)]
        step[free] = -np.linalg.solve(hf + 1e-12 * np.trace(hf) * np.eye(free.sum()), g[free])
    return step, float(np.abs(g[free]).max()) if free.any() else 0.0


def fit_many(df: DataFrame, xcols: Sequence[str], fits: Sequence[Fit], *, y: str = "y", fold: str | None = None,
             part: str | None = None, weight: str | None = None, zoom: str | None = None, max_iter: int = 40,
             tol: float = 1e-9) -> list[Fitted]:
    """Fit every configuration on its rows (L4); meant for up to some thirty columns.

    The input is staged once, narrow; each step reads it once for all open fits and returns
    (d+1)(d+4)/2 sums per fit. Only those sums reach the driver. On many rows the steps start
    from the fits of a share of them, which leaves three passes or so.
    """
    d = len(xcols)
    data = stage(df.select(
        F.col(y).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold"),
        (F.col(part).cast("int") if part else F.lit(0)).alias("_part"),
        (F.coalesce(F.col(zoom).cast("double"), F.lit(ZOOM_DEFAULT)) if zoom else F.lit(0.0)).alias("_zoom"),
        *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(xcols)],
    ))
    center = [_project(f, np.array(f.center or [0.0] * (d + 1), float)) for f in fits]
    if data.count() >= WARM_ROWS:
        try:
            return _solve(data, d, fits, _warm(data, d, fits, center), 1.0, max_iter, tol)
        except (RuntimeError, np.linalg.LinAlgError):
            pass  # a start may be too far out; the centres are the safe one
    return _solve(data, d, fits, center, 1.0, max_iter, tol)


#: From this many rows on, fits start from those of every WARM_SHARE-th row.
WARM_ROWS, WARM_SHARE = 500_000, 32


def _warm(data: DataFrame, d: int, fits: Sequence[Fit], center: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Where Newton steps start: the fits of a hashed share of the rows, or the centres if those fail.

    Only the start: all steps that count, and the test of convergence, read every row.
    """
    some = stage(data.where(F.pmod(F.xxhash64(*data.columns), F.lit(WARM_SHARE)) == 0))
    try:
        got = _solve(some, d, fits, center, 1.0 / WARM_SHARE, 25, 1e-6)
    except (RuntimeError, ValueError, np.linalg.LinAlgError):
        return list(center)
    return [np.array([*m.coef, m.b]) for m in got]


def _solve(data: DataFrame, d: int, fits: Sequence[Fit], start: Sequence[np.ndarray], share: float, max_iter: int, tol: float) -> list[Fitted]:
    """Newton steps from ``start`` until none moves; sum penalties are taken at ``share``."""
    center = {i: np.array(f.center or [0.0] * (d + 1)) for i, f in enumerate(fits)}
    beta = {i: _project(f, start[i].copy()) for i, f in enumerate(fits)}
    last: dict[int, tuple] = {}
    done: dict[int, Fitted] = {}
    open_ids = set(range(len(fits)))
    for it in range(1, max_iter + 1):
        got = _pass(data, d, [(i, fits[i], beta[i]) for i in sorted(open_ids)])
        for i in sorted(open_ids):
            fit, row = fits[i], got.get(i)
            if row is None:
                raise ValueError(f"fit {fit.name} has no rows")
            lam = np.array(fit.penalty or [0.0] * (d + 1)) * (row["w"] if fit.per_row else share)
            off = beta[i] - center[i]
            obj = row["l"] + 0.5 * float(lam @ off**2)
            if i in last and obj > last[i][1] + 1e-9 * abs(last[i][1]):
                old, _, step = last[i]  # overshoot: half the step from the last good point
                last[i] = (old, last[i][1], step / 2)
                beta[i] = _project(fit, old + step / 2)
                continue
            g = np.array([row[f"g{j}"] for j in range(d + 1)]) + lam * off
            h = np.diag(lam).astype(float)
            for j in range(d + 1):
                for k in range(j, d + 1):
                    h[j, k] += row[f"h{j}_{k}"]
                    if j != k:
                        h[k, j] += row[f"h{j}_{k}"]
            step, gmax = _step(fit, beta[i], g, h)
            new = _project(fit, beta[i] + step)
            if np.abs(new - beta[i]).max() < tol * (1.0 + np.abs(beta[i]).max()):
                done[i] = Fitted(fit.name, new[:-1].tolist(), float(new[-1]), row["n"], row["l"], gmax, it)
                continue
            last[i] = (beta[i], obj, step)
            beta[i] = new
        open_ids -= set(done)
        if not open_ids:
            break
    if open_ids:
        raise RuntimeError(f"no convergence of {[fits[i].name for i in sorted(open_ids)]}")
    return [done[i] for i in range(len(fits))]
