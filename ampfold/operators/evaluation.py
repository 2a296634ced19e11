"""Evaluation tables: regression metrics, per-row errors, plot ranges, feature importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.functions.cleaning import error_pct


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       n_features: int | None = None) -> DataFrame:
    """One row: n_samples, [n_features], rmse, mae, r2 (one pass: SS_tot = n * var_pop).

    r2 when the actual values are constant: 1 for a perfect prediction, else 0.
    """
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = a - p
    agg = df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(e * e).alias("_mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_ss_res"),
        (F.var_pop(a) * F.count(a)).alias("_ss_tot"),
    )
    r2 = (F.when(F.col("_ss_tot") == 0, F.when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot")))
    cols = [F.col("n_samples").cast("long").alias("n_samples")]
    if n_features is not None:
        cols.append(F.lit(int(n_features)).alias("n_features"))
    cols += [F.sqrt("_mse").alias("rmse"), F.col("mae"), r2.alias("r2")]
    return agg.select(*cols)


def prediction_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Adds abs_error, error_pct (+inf when actual is 0) and residual = actual - predicted."""
    a, p = F.col(actual), F.col(predicted)
    return df.withColumn("abs_error", F.abs(a - p)).withColumn("error_pct", error_pct(a, p)).withColumn(
        "residual", a - p)


def plot_ranges(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Identity-line range of the actual-vs-predicted scatter and the residual range (the plot's data)."""
    a, p = F.col(actual), F.col(predicted)
    return df.agg(
        F.least(F.min(a), F.min(p)).alias("line_min"),
        F.greatest(F.max(a), F.max(p)).alias("line_max"),
        F.min(a - p).alias("residual_min"),
        F.max(a - p).alias("residual_max"),
    )


def importance_table(spark: SparkSession, importances: Sequence[float], names: Sequence[str],
                     indices: Sequence[int] | None = None) -> DataFrame:
    """``feature_idx, feature_name, importance`` from a fitted model's importances (model-sized input).

    ``indices`` maps the model's inputs back to positions in ``names`` (after a feature mask).
    """
    idx = list(indices) if indices is not None else list(range(len(importances)))
    rows = [(int(i), str(names[i]), float(v)) for i, v in zip(idx, importances)]
    schema = T.StructType([T.StructField("feature_idx", T.IntegerType()), T.StructField("feature_name", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def top_features(importances: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features (ties by feature index)."""
    return importances.orderBy(F.desc("importance"), F.asc("feature_idx")).limit(k)


def prediction_sample(predictions: DataFrame, k: int = 10, order: str = "battery_id") -> DataFrame:
    """The first k rows of the error table in id order (the printed sample; the limit is the feature)."""
    return predictions.orderBy(order).limit(k)
