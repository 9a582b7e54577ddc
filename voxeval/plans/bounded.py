"""Small tables next to big ones: literal grids, and broadcasts behind a size check."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that is sent to every task at most; an atlas of the largest stored grid (358,400 voxels) has some 10 MB.
BROADCAST_BYTES = 64 << 20


def _sql_literal(v, wide: bool) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)}')"
    return f"{v}L" if wide else str(v)


def struct_array_sql(rows: Sequence[dict]) -> str:
    """SQL text of an array of structs with the same fields: one parsed expression instead of thousands of column calls."""
    real = {k for k in rows[0] if any(isinstance(r[k], float) for r in rows)}
    wide = {k for k in rows[0] if any(isinstance(r[k], int) and abs(r[k]) >= 2**31 for r in rows)}
    cells = [
        "named_struct(" + ", ".join(f"'{k}', {_sql_literal(float(v) if k in real else v, k in wide)}" for k, v in r.items()) + ")" for r in rows
    ]
    return f"array({', '.join(cells)})"


def struct_array(rows: Sequence[dict]) -> Column:
    return F.expr(struct_array_sql(rows))


def with_grid(df: DataFrame, rows: Sequence[dict], name: str = "_g") -> DataFrame:
    """Every row once per parameter row.

    The grid is a literal known when the plan is built, so this is a generator of fixed
    fan-out inside the scan stage: no join, no shuffle. Aggregate right after it.
    """
    if not rows:
        raise ValueError("empty parameter grid")
    out = df.withColumn(name, F.explode(struct_array(rows)))
    return out.select(*df.columns, *[F.col(f"{name}.{k}").alias(k) for k in rows[0]])


def held_bytes(df: DataFrame) -> int:
    """Bytes of a table's values, from one pass: 8 per number and entry, the length of texts."""
    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType):
                return F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0)) + 8
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 8
        if isinstance(kind, T.StructType):
            return sum((width(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with a table that is normally small.

    Its bytes are summed first: up to the limit the small side is broadcast and the big side
    stays where it is; beyond it Spark's shuffle join (with runtime skew splitting) takes over.
    Pass a staged or file-backed ``small``, which is read for the sum and again for the join.
    """
    if held_bytes(small) <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)
