"""Aggregate Column builders for per-group signal features.

All of them are plain Spark aggregates (partial aggregation before the shuffle, so a hot
group is pre-reduced in every map task). Inputs are expected NaN-free: call
``cleaning.nan_to_null`` first so that NaN behaves like a missing value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampfold.functions.common import as_col


def _pairs_clean(y: Column, x: Column) -> Column:
    return y.isNotNull() & x.isNotNull()


def _has_inf(y: Column, x: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.count_if(_pairs_clean(y, x) & ((F.abs(x) == inf) | (F.abs(y) == inf)))


def fit_slope(y, x) -> Column:
    """Least-squares slope of y on x over the rows where both are present.

    Fewer than two pairs, a constant x, or a failed fit (infinite input) give 0.
    """
    y, x = as_col(y), as_col(x)
    slope = F.regr_slope(y, x)
    return (
        F.when((F.regr_count(y, x) < 2) | (_has_inf(y, x) > 0), F.lit(0.0))
        .when(F.regr_sxx(y, x) == 0, F.lit(0.0))
        .when(slope.isNull() | F.isnan(slope), F.lit(0.0))
        .otherwise(slope)
    )


def fit_r2(y, x) -> Column:
    """Coefficient of determination of that fit.

    Fewer than two pairs or a failed fit give 0; a constant y is fitted exactly (1);
    a constant x with a varying y explains nothing (0).
    """
    y, x = as_col(y), as_col(x)
    r2 = F.regr_r2(y, x)
    return (
        F.when((F.regr_count(y, x) < 2) | (_has_inf(y, x) > 0), F.lit(0.0))
        .when(F.regr_sxx(y, x) == 0, F.when(F.regr_syy(y, x) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(F.regr_syy(y, x) == 0, F.lit(1.0))
        .when(r2.isNull() | F.isnan(r2), F.lit(0.0))
        .otherwise(r2)
    )


def n_unique(c) -> Column:
    """Number of distinct values, where "missing" counts as one value of its own."""
    c = as_col(c)
    return (F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("long")


def value_at_first_max(x, y, order: Sequence[str]) -> Column:
    """x of the first row (in ``order``) where y reaches its maximum; rows with missing y are skipped."""
    x, y = as_col(x), as_col(y)
    key = F.when(y.isNotNull(), F.struct((-y).alias("neg_y"), *[F.col(o) for o in order]))
    return F.min_by(x, key)
