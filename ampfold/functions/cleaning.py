"""Null / NaN / infinity rules as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampfold.functions.common import as_col



def POS_INF() -> Column:  # noqa: N802 - constant-like
    return F.lit(float("inf"))


def NEG_INF() -> Column:  # noqa: N802
    return F.lit(float("-inf"))


def nan_to_null(c) -> Column:
    """NaN -> null, so that aggregates skip it the way pandas skips NaN."""
    c = as_col(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def fill_nonfinite(c, nan: float = 0.0, posinf: float = 1.0, neginf: float = -1.0) -> Column:
    """Replace null/NaN, +inf and -inf by fixed numbers (NumPy ``nan_to_num`` with explicit values)."""
    c = as_col(c).cast("double")
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(float(nan)))
        .when(c == POS_INF(), F.lit(float(posinf)))
        .when(c == NEG_INF(), F.lit(float(neginf)))
        .otherwise(c)
    )


def clamp_min(c, lo: float = 0.0) -> Column:
    """``max(c, lo)`` that keeps null as null and NaN as NaN (``greatest`` would turn null into ``lo``)."""
    c = as_col(c)
    return F.when(c < F.lit(lo), F.lit(lo)).otherwise(c)


def safe_double(c) -> Column:
    """Text -> double with pandas-like tokens: ``inf``/``-inf``/``Infinity`` are numbers, junk is null."""
    s = F.trim(as_col(c).cast("string"))
    low = F.lower(s)
    return (
        F.when(low.isin("inf", "+inf", "infinity", "+infinity"), POS_INF())
        .when(low.isin("-inf", "-infinity"), NEG_INF())
        .otherwise(nan_to_null(s.try_cast("double")))
    )


def error_pct(actual, predicted) -> Column:
    """abs(actual - predicted) / actual * 100, +inf when actual is 0."""
    a, p = as_col(actual), as_col(predicted)
    return F.when(a != 0, F.abs(a - p) / a * 100.0).otherwise(POS_INF())
