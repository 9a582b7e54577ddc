"""Work inside one volume: the rows of a uid meet in one task, once, as arrays. A volume is bounded by its grid.

For steps that follow a volume's cells to their neighbours or between grids, where joins would exchange several rows a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Grid = tuple[int, int, int]
Arrays = dict[str, np.ndarray]
#: Cells a task takes where the rows of volumes meet by uid: its sorts and hash maps hold all of them.
TASK_CELLS = 1 << 17
KINDS = {"int": (T.IntegerType(), pa.int32()), "long": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64())}


def volume_tasks(volumes: DataFrame, grid: Grid) -> int:
    """Partitions by uid that leave a task some TASK_CELLS cells, one volume at least; ``volumes`` has a row per uid.

    A fixed number of partitions, or one joined up to a size in bytes, would give a task more cells the more volumes there are.
    """
    each = max(1, TASK_CELLS // math.prod(grid))
    return max(volumes.sparkSession.sparkContext.defaultParallelism, math.ceil(volumes.count() / each))


def per_volume(rows: DataFrame, fn: Callable[[Arrays], Arrays], out: Sequence[tuple[str, str]], params: DataFrame | None = None) -> DataFrame:
    """uid and what ``fn`` makes of each volume's columns; ``params`` (one row per uid) travels to it apart, as one-row columns.

    One exchange by uid. With ``params``, a uid that only one of the two has gives no rows.
    """
    cols = [c for c in rows.columns if c != "uid"]
    schema = T.StructType([rows.schema["uid"], *[T.StructField(n, KINDS[k][0]) for n, k in out]])

    def named(table: pa.Table, uid_type: pa.DataType, result: Arrays) -> pa.Table:
        n = len(next(iter(result.values())))
        uid = table.column("uid")[0].as_py()
        arrays = [pa.array([uid], uid_type).take(pa.array(np.zeros(n, np.int64))), *[pa.array(result[c], KINDS[k][1]) for c, k in out]]
        return pa.Table.from_arrays(arrays, names=["uid", *[c for c, _ in out]])

    def one(table: pa.Table) -> pa.Table:
        return named(table, table.column("uid").type, fn({c: table.column(c).to_numpy() for c in cols}))

    if params is None:
        return rows.groupBy("uid").applyInArrow(one, schema)
    extra = [c for c in params.columns if c != "uid"]

    def both(table: pa.Table, given: pa.Table) -> pa.Table:
        uid_type = table.column("uid").type
        if not table.num_rows or not given.num_rows:
            empty = [pa.array([], uid_type), *[pa.array([], KINDS[k][1]) for _, k in out]]
            return pa.Table.from_arrays(empty, names=["uid", *[c for c, _ in out]])
        return named(table, uid_type, fn({c: table.column(c).to_numpy() for c in cols} | {c: given.column(c).to_numpy() for c in extra}))

    return rows.groupBy("uid").cogroup(params.groupBy("uid")).applyInArrow(both, schema)


def run_labels(at: np.ndarray, grid: Grid) -> np.ndarray:
    """Six-connected components of the members at sorted row-major places: per member the lowest place of its component.

    Members of a line that follow each other are one run. Runs of neighbouring lines touch if their spans overlap; touching runs
    take the lower label until none changes, with labels of labels followed at once.
    """
    if not len(at):
        return at
    _, h, w = grid
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (at[1:] % w == 0)]))
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last]
    pairs = []
    for step, inside in ((w, (start // w) % h < h - 1), (h * w, np.ones(len(start), bool))):
        run = np.flatnonzero(inside)
        a, z = np.searchsorted(end, start[run] + step), np.searchsorted(start, end[run] + step, side="right")
        n = np.maximum(z - a, 0)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs.append((np.repeat(run, n), np.repeat(a, n) + nth))
    one, two = (np.concatenate(p) for p in zip(*pairs))
    label = np.arange(len(start))
    while (label[one] != label[two]).any():
        low = np.minimum(label[one], label[two])
        for side in (one, two):
            np.minimum.at(label, label[side], low)  # the tree's top goes below the lower one
        while (label != label[label]).any():
            label = label[label]
    return np.repeat(start[label], last - first + 1)


def placed(a: Arrays, grid: Grid) -> np.ndarray:
    """Row-major places of coordinates."""
    return (a["z"].astype(np.int64) * grid[1] + a["y"]) * grid[2] + a["x"]


def coordinates(at: np.ndarray, grid: Grid) -> Arrays:
    _, h, w = grid
    return {"z": at // (h * w), "y": at // w % h, "x": at % w}


def dense(a: Arrays, grid: Grid, value: str = "v") -> np.ndarray:
    """The volume as an array; a cell without a row is 0."""
    out = np.zeros(grid)
    out[a["z"], a["y"], a["x"]] = a[value]
    return out


def sampled(v: np.ndarray, matrix: np.ndarray, offset: np.ndarray, out: Grid, edge: str = "zero") -> np.ndarray:
    """Linear interpolation of ``v`` at ``matrix @ o + offset`` for every output place o.

    A transform whose axes stay apart is three one-dimensional passes; another one gathers eight corners, plane by plane. Edge
    rules: ``zero``, what lies outside counts 0; ``nearest``, the border goes on; ``outside_zero``, places outside the grid are 0.
    """
    axis = np.abs(matrix).argmax(axis=0)  # the source axis that each output axis moves along
    if np.count_nonzero(matrix) <= 3 and sorted(axis) == [0, 1, 2] and all(matrix[axis[j], j] != 0 for j in range(3)):
        order = np.argsort(axis)  # output axis of each source axis
        for i in range(3):
            j = order[i]
            v = _along(v, i, matrix[i, j] * np.arange(out[j]) + offset[i], edge)
        return v.transpose(axis)
    grid, made = v.shape, np.zeros(out)
    oy, ox = np.meshgrid(np.arange(out[1]), np.arange(out[2]), indexing="ij")
    for oz in range(out[0]):
        at = [matrix[i, 0] * oz + matrix[i, 1] * oy + matrix[i, 2] * ox + offset[i] for i in range(3)]
        keep = np.ones(oy.shape, bool)
        if edge != "zero":
            keep = np.logical_and.reduce([(p >= 0) & (p <= n - 1) for p, n in zip(at, grid)]) if edge == "outside_zero" else keep
            at = [np.clip(p, 0, n - 1) for p, n in zip(at, grid)]
        low = [np.floor(p).astype(np.int64) for p in at]
        total = np.zeros(oy.shape)
        for bits in np.ndindex(2, 2, 2):
            weight, place = np.ones(oy.shape), []
            for b, p, f, n in zip(bits, at, low, grid):
                c = f + b
                weight = weight * (p - f if b else 1.0 - (p - f)) * ((c >= 0) & (c < n))
                place.append(np.clip(c, 0, n - 1))
            total += weight * v[tuple(place)]
        made[oz] = np.where(keep, total, 0.0)
    return made


def _along(v: np.ndarray, axis: int, at: np.ndarray, edge: str) -> np.ndarray:
    """Linear interpolation along one axis."""
    n = v.shape[axis]
    keep = np.ones(len(at), bool)
    if edge != "zero":
        keep = (at >= 0) & (at <= n - 1) if edge == "outside_zero" else keep
        at = np.clip(at, 0, n - 1)
    low = np.floor(at).astype(np.int64)
    shape = [-1 if k == axis else 1 for k in range(3)]
    made = 0.0
    for c, weight in ((low, 1.0 - (at - low)), (low + 1, at - low)):
        weight = weight * ((c >= 0) & (c < n)) * keep
        made = made + np.take(v, np.clip(c, 0, n - 1), axis) * weight.reshape(shape)
    return made
