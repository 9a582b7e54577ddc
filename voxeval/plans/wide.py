"""Linear fits over hundreds of columns: array-valued sums, one array per task and fit, with L-BFGS on the driver.

A pass reads the staged rows once for all open fits. A task turns its rows into blocks (a matrix of features) and keeps one
running array per fit, so a pass costs rows x columns x fits and sends columns x fits numbers per task; no
expression and no shuffled row grows with the square of the columns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxeval.functions.scalars import CLIP_SD, ZOOM_DEFAULT
from voxeval.plans.newton import Fit, Fitted
from voxeval.plans.sums import collected, task_sums
from voxeval.session import stage

#: Steps that the curvature estimate of a fit remembers, and halvings of a step before a fit counts as settled.
MEMORY, HALVINGS = 20, 30


@dataclass
class Block:
    """Some rows of a task."""

    y: np.ndarray
    w: np.ndarray
    fold: np.ndarray
    zoom: np.ndarray
    x: np.ndarray


def packed(df: DataFrame, cols: Sequence[str], y: str = "y", fold: str | None = None, weight: str | None = None, zoom: str | None = None) -> DataFrame:
    """The staged input of every pass: label, weight, fold, zoom and one array of features; a null or NaN feature is 0."""
    def number(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))

    return stage(df.select(
        F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"),
        (F.coalesce(F.col(zoom).cast("double"), F.lit(ZOOM_DEFAULT)) if zoom else F.lit(0.0)).alias("zoom"), F.array(*[number(c) for c in cols]).alias("x"),
    ))


def summed(data: DataFrame, partial: Callable[[Block], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all blocks of the arrays that ``partial`` makes of each, by fit."""
    def block(p: pa.RecordBatch) -> dict[int, np.ndarray]:
        rest = [p.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        return partial(Block(*rest, p.column(4).flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1)))

    return collected(task_sums(data.select("y", "w", "fold", "zoom", "x"), block))


def inputs(fit: Fit, x: np.ndarray, zoom: np.ndarray) -> np.ndarray:
    """Features as a fit sees them: without its trend, standardised and clipped."""
    if fit.adj is not None:
        x = x - np.stack([np.ones(len(zoom)), zoom, zoom * zoom], axis=1) @ np.asarray(fit.adj)
    return x if fit.mu is None else np.clip((x - np.asarray(fit.mu)) / np.asarray(fit.sd), -CLIP_SD, CLIP_SD)


class Descent:
    """L-BFGS of one fit; values and gradients come from outside, one point at a time."""

    def __init__(self, start: np.ndarray):
        self.at, self.value, self.gradient = start, None, None
        self.trial, self.step, self.pairs, self.cuts = start, None, deque(maxlen=MEMORY), 0

    def _direction(self, scale: np.ndarray) -> np.ndarray:
        q, used = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        q = q * ((self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 1.0 / scale)
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += (a - (y @ q) / (s @ y)) * s
        return -q

    def seen(self, value: float, gradient: np.ndarray, scale: np.ndarray, tol: float) -> bool:
        """Take in the value at ``trial``; true if the fit has settled, else ``trial`` is the next point."""
        if self.value is None or value <= self.value + 1e-4 * (self.gradient @ (self.trial - self.at)) + 1e-14 * abs(self.value):
            if self.value is not None:
                s, y = self.trial - self.at, gradient - self.gradient
                if s @ y > 1e-14 * (y @ y):
                    self.pairs.append((s, y))
            self.at, self.value, self.gradient, self.cuts = self.trial, value, gradient, 0
            if np.abs(gradient).max() <= tol:
                return True
            self.step = self._direction(scale)
        else:
            self.cuts += 1
            self.step = self.step / 2
            if self.cuts > HALVINGS:
                return True  # no smaller value can be told apart from rounding
        self.trial = self.at + self.step
        return False


def fit_wide(data: DataFrame, fits: Sequence[Fit], tol: float = 1e-6, max_iter: int = 500) -> list[Fitted]:
    """Every fit on its rows of ``packed`` data (L4): penalties and centres as in ``fit_many``, no bounds, no parts.

    ``tol``: largest entry of the gradient.
    """
    d = len(data.select("x").first()["x"])
    penalty = [np.array(f.penalty or [0.0] * (d + 1)) for f in fits]
    center = [np.array(f.center or [0.0] * (d + 1)) for f in fits]
    search = [Descent(c.copy()) for c in center]
    done: dict[int, Fitted] = {}
    for it in range(1, max_iter + 1):
        todo = [(i, fits[i], search[i].trial) for i in range(len(fits)) if i not in done]

        def partial(b: Block, todo=todo) -> dict[int, np.ndarray]:
            out = {}
            for i, fit, beta in todo:
                use = np.ones(len(b.y), bool) if fit.held is None else b.fold != fit.held
                x, y, w = inputs(fit, b.x[use], b.zoom[use]), b.y[use], b.w[use]
                z = x @ beta[:-1] + beta[-1]
                r = w * (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y)
                loss = w @ (np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - y * z)
                out[i] = np.concatenate([[use.sum(), w.sum(), loss], r @ x, [r.sum()]])
            return out

        got = summed(data, partial)
        for i, fit, beta in todo:
            if i not in got or not got[i][0]:
                raise ValueError(f"fit {fit.name} has no rows")
            n, w, loss = got[i][:3]
            lam = penalty[i] * (w if fit.per_row else 1.0)
            off = beta - center[i]
            gradient = got[i][3:] + lam * off
            if not np.isfinite(gradient).all():
                raise ValueError(f"fit {fit.name} met values that are not finite")
            if search[i].seen(float(loss + 0.5 * lam @ off**2), gradient, 0.25 * w + lam, tol):
                at = search[i].at
                done[i] = Fitted(fit.name, at[:-1].tolist(), float(at[-1]), int(n), float(loss), float(np.abs(search[i].gradient).max()), it)
        if len(done) == len(fits):
            return [done[i] for i in range(len(fits))]
    raise RuntimeError(f"no convergence of {[fits[i].name for i in range(len(fits)) if i not in done]}")


def trends(data: DataFrame, folds: Sequence[int]) -> dict[int, np.ndarray]:
    """Least squares of every feature on (1, z, z^2) over the normals outside each fold: 3 x d per fold (L1)."""
    mid = float(data.agg(F.avg("zoom")).first()[0] or 0.0)  # powers of centred values keep their digits

    def partial(b: Block) -> dict[int, np.ndarray]:
        out = {}
        for f in np.unique(b.fold):
            use = (b.fold == f) & (b.y == 0)
            basis = np.stack([np.ones(use.sum()), b.zoom[use] - mid, (b.zoom[use] - mid) ** 2], axis=1)
            out[int(f)] = np.concatenate([(basis.T @ basis).ravel(), (basis.T @ b.x[use]).ravel()])
        return out

    sums = summed(data, partial)
    total = sum(sums.values())
    out = {}
    for f in folds:
        rest = total - sums.get(f, 0.0)
        c = np.linalg.solve(rest[:9].reshape(3, 3), rest[9:].reshape(3, -1))
        out[f] = np.stack([c[0] - c[1] * mid + c[2] * mid * mid, c[1] - 2.0 * mid * c[2], c[2]])
    return out


def scales(data: DataFrame, folds: Sequence[int], adj: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation (+1e-6) of every feature outside each fold, without the fold's trend (L2); two passes."""
    def of(make: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        def partial(b: Block) -> dict[int, np.ndarray]:
            out = {}
            for f in folds:
                use = b.fold != f
                x = inputs(Fit((f,), adj=adj.get(f)), b.x[use], b.zoom[use])
                out[f] = np.concatenate([[use.sum()], make(f, x)])
            return out

        return {f: v[1:] / v[0] for f, v in summed(data, partial).items()}

    mean = of(lambda f, x: x.sum(axis=0))
    var = of(lambda f, x: ((x - mean[f]) ** 2).sum(axis=0))
    return {f: (mean[f], np.sqrt(var[f]) + 1e-6) for f in folds}
