"""Access to the driver's tables and the derived signal views used by the query catalogue.

The views map the charging-log vocabulary onto the given tables:

* a *session* / *battery* = ``events.user_id`` (time order ``ts, event_id``), or
  ``lineitem.l_suppkey`` (x = quantity, y = extended price), or ``orders.o_custkey``
  (short series of 1..25 rows);
* a *missing reading* = an ``error`` event (its value is null).

Each view is a projection of the whole table, so work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_hours(ts: str = "ts") -> Column:
    """Hours since 1970-01-01 of a wall-clock timestamp (time-zone free)."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / F.lit(3.6e9)


def reading(value: str = "value", kind: str = "event_type") -> Column:
    """The event value, missing for error events."""
    return F.when(F.col(kind) == F.lit("error"), F.lit(None).cast("double")).otherwise(F.col(value))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: user_id, ts, event_id, reading, level, hours, prop_k."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id",
        "ts",
        "event_id",
        "event_type",
        "value",
        reading().alias("reading"),
        F.floor(F.col("value") / F.lit(50.0)).cast("double").alias("level"),
        epoch_hours().alias("hours"),
        F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("double").alias("prop_k"),
    )


# SQL twin of ``signals`` for the DuckDB oracle.
SIGNALS_SQL = """(SELECT user_id, ts, event_id, event_type, value,
        CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading,
        CAST(floor(value / 50.0) AS DOUBLE) AS level,
        epoch_us(ts) / 3.6e9 AS hours,
        TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS prop_k
   FROM events)"""


def r6(c) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (same on the oracle side)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])
