"""Column functions: cleaning, keys, link functions, row losses, linear scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on them.
SPACING_DEFAULT = 2.0
SPACING_RANGE = (0.3, 20.0)
ZOOM_DEFAULT = 2.4
LOSS_EPS = 1e-15
LOGIT_EPS = 1e-6
DEPLOY_FLOOR = 1e-3
CLIP_SD = 6.0
NON_FEATURES = (
    "uid", "ok", "err", "shape_x", "shape_y", "shape_z", "zoom_x", "zoom_y", "zoom_z", "loc_note", "top_to_peak_mm", "peak_off_x_mm",
    "label", "group", "fold",
)

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def clip(c: Column | str, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def clean_value(c: Column | str) -> Column:
    """Non-finite values become 0 and negatives are raised to 0."""
    c = col(c)
    return F.when(is_finite(c), F.greatest(c, F.lit(0.0))).otherwise(F.lit(0.0))


def sane_spacing(c: Column | str) -> Column:
    """Grid spacing if it is plausible, else the default."""
    c = col(c)
    lo, hi = SPACING_RANGE
    return F.when(is_finite(c) & (c > lo) & (c < hi), c).otherwise(F.lit(SPACING_DEFAULT))


def group_key(ok, sx, sy, sz, zoom_x) -> Column:
    """Acquisition group: grid shape and spacing, or ``fail``."""
    key = F.format_string("%dx%dx%d_%.2f", col(sx), col(sy), col(sz), col(zoom_x))
    return F.when(col(ok) == 1, key).otherwise(F.lit("fail"))


def family_key(zoom: Column | str) -> Column:
    """Spacing rounded half-even to one decimal, as text; missing is ``na``."""
    return F.coalesce((F.rint(col(zoom) * 10.0) / 10.0).cast("string"), F.lit("na"))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def logit(p: Column | str, eps: float = LOGIT_EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def row_logloss(y: Column | str, p: Column | str) -> Column:
    """Cross entropy of one row."""
    y, q = col(y), clip(p, LOSS_EPS, 1.0 - LOSS_EPS)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def softplus(z: Column | str) -> Column:
    z = col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def standardize_clip(x, mu, sd, bound: float = CLIP_SD) -> Column:
    """(x - mu) / sd limited to +-bound; ``sd`` already holds its guard."""
    return clip((col(x) - mu) / sd, -bound, bound)


def linear_score(params: dict, zoom: Column | str | None = None) -> Column:
    """Score of a fitted linear model over named columns.

    ``params``: ``cols, mu, sd, coef, b`` and optional ``adj``, the three trend
    coefficients (1, z, z^2) of each column.
    """
    z = F.coalesce(col(zoom).cast("double"), F.lit(ZOOM_DEFAULT)) if zoom is not None else F.lit(ZOOM_DEFAULT)
    total = F.lit(float(params["b"]))
    adj = params.get("adj")
    for j, name in enumerate(params["cols"]):
        x = F.col(name)
        if adj is not None:
            a0, a1, a2 = (float(row[j]) for row in adj)
            x = x - (F.lit(a0) + F.lit(a1) * z + F.lit(a2) * z * z)
        x = standardize_clip(x, F.lit(float(params["mu"][j])), F.lit(float(params["sd"][j])))
        total = total + x * F.lit(float(params["coef"][j]))
    return total


def fill_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("uid",)) -> DataFrame:
    """Declared features in declared order; absent, null or NaN is 0."""
    have = set(df.columns)

    def one(c: str) -> Column:
        if c not in have:
            return F.lit(0.0).alias(c)
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)

    return df.select(*keep, *[one(c) for c in cols])


def feature_columns(df: DataFrame, contains: Sequence[str] = (), prefixes: Sequence[str] = ()) -> list[str]:
    """Feature names of a table: all but the bookkeeping ones, optionally one family (P10)."""
    names = [c for c in df.columns if c not in NON_FEATURES]
    if contains:
        names = [c for c in names if any(s in c for s in contains)]
    if prefixes:
        names = [c for c in names if c.startswith(tuple(prefixes))]
    return names


def replace_columns(left: DataFrame, right: DataFrame, key: str = "uid") -> DataFrame:
    """Attach ``right``; where both have a column, the right one stays."""
    overlap = [c for c in right.columns if c in left.columns and c != key]
    return left.drop(*overlap).join(right, key)


def finalize_probability(z, ok, *, eps: float, prior: float, temp: float = 1.0) -> Column:
    """Deployed probability: tempered, floored at no less than 1e-3, prior where failed."""
    floor = max(eps, DEPLOY_FLOOR)
    z = col(z)
    p = clip(sigmoid(z / F.lit(float(temp))), floor, 1.0 - floor)
    usable = (col(ok) == 1) & z.isNotNull() & ~F.isnan(z)
    return F.when(usable, p).otherwise(F.lit(float(prior)))


def noisy_or_logit(l1: Column | str, l2: Column | str) -> Column:
    """Logit of "either side abnormal" from two side logits."""
    both_normal = clip(-softplus(l1) - softplus(l2), -30.0, -1e-6)
    return F.log1p(-F.exp(both_normal)) - both_normal


def center_scale(plane: Column | str) -> Column:
    """Network input scaling of a plane, (v - 1) / 2."""
    return F.transform(col(plane), lambda v: (v.cast("double") - 1.0) / 2.0)


def gain(plane: Column | str, g: float) -> Column:
    """Contrast about the background level 1."""
    return F.transform(col(plane), lambda v: F.lit(1.0) + (v.cast("double") - 1.0) * F.lit(float(g)))


def scale(plane: Column | str, s: float) -> Column:
    return F.transform(col(plane), lambda v: v.cast("double") * F.lit(float(s)))


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by '-': the portable source of every random choice."""
    return F.md5(F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_int(*parts) -> Column:
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Hashed uniform in [0, 1); the same in any engine that has md5."""
    return hash_int(*parts).cast("double") / F.lit(4294967296.0)
