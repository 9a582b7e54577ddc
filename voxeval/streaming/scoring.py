"""Stateless stream scoring (ST1) and an external batch scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.functions.scalars import fill_features, finalize_probability, linear_score
from voxeval.session import fresh_path


def score_rows(rows: DataFrame, models: Sequence[tuple[dict, float]], *, eps: float, prior: float, temp: float = 1.0,
               keep: Sequence[str] = ("uid",), ok: str = "ok") -> DataFrame:
    """Features to probability with literal parameters: no statistics of the scored rows, hence no state.

    ``models``: linear parameters and their ensemble weight.
    """
    cols = sorted({c for m, _ in models for c in m["cols"]})
    filled = fill_features(rows, cols, [*keep, ok])
    total = float(sum(w for _, w in models))
    z = sum((linear_score(m) * F.lit(float(w)) for m, w in models), F.lit(0.0)) / F.lit(total)
    return filled.select(*keep, z.alias("z"), ok).select(*keep, finalize_probability("z", ok, eps=eps, prior=prior, temp=temp).alias("p"))


def score_stream(stream: DataFrame, models: Sequence[tuple[dict, float]], **kw) -> DataFrame:
    """The same plan on a stream, append mode (ST1)."""
    return score_rows(stream, models, **kw)


def run_available(stream: DataFrame, out: str | None = None, progress: str | None = None) -> str:
    """Process what is there now into the parquet folder ``out``; returns its path.

    A later call with the same ``out`` and ``progress`` goes on where the last one ended. Without them a new folder below the
    shared root is used, for a single run.
    """
    out = out or fresh_path(stream.sparkSession, "scores")
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", progress or f"{out.rstrip('/')}-progress").start(out)
    )
    query.awaitTermination()
    return out


def batch_score(df: DataFrame, loader: Callable[[], Callable[[pd.DataFrame], Sequence[float]]], cols: Sequence[str], keys: Sequence[str] = ("uid",),
                name: str = "z", prior: float | None = None, batch: int = 64) -> DataFrame:
    """Score batches of at most ``batch`` rows with an external model that is loaded once per task.

    Adds ``name``, ``ok`` and ``err``. The rows of a batch that fails are scored one by one, so only rows that fail alone
    have a null score (or the prior, if one is given), with the error's text. A model that can't be loaded fails every row.
    """
    names = [*keys, *cols]
    extra = [T.StructField(name, T.DoubleType()), T.StructField("ok", T.BooleanType()), T.StructField("err", T.StringType())]
    schema = T.StructType([df.schema[k] for k in keys] + extra)

    def score(model, rows: pd.DataFrame) -> list[tuple]:
        try:
            got = [float(v) for v in model(rows[list(cols)])]
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} scores for {len(rows)} rows")
            return [(v, True, None) for v in got]
        except Exception as e:  # the model is the caller's
            if len(rows) > 1:
                return [r for i in range(len(rows)) for r in score(model, rows.iloc[i : i + 1])]
            return [(None, False, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        for pdf in batches:
            if model is None and broken is None:
                try:
                    model = loader()
                except Exception as e:  # so is the loader
                    broken = f"{type(e).__name__}: {e}"
            out = pdf[list(keys)].copy()
            if broken is not None:
                got = [(None, False, broken)] * len(pdf)
            else:
                got = [r for i in range(0, len(pdf), batch) for r in score(model, pdf.iloc[i : i + batch])]
            for j, f in enumerate(extra):
                out[f.name] = pd.Series([r[j] for r in got], index=pdf.index, dtype=("float64", "object", "object")[j])
            yield out

    scored = df.select(*names).mapInPandas(run, schema)
    if prior is None:
        return scored
    return scored.withColumn(name, F.coalesce(F.nanvl(F.col(name), F.lit(None).cast("double")), F.lit(float(prior))))
