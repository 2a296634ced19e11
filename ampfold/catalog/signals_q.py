"""Catalogue entries for the per-group signal operators (A-01..A-12, W-*, P-02/03, S2-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampfold.catalog.registry import register
from ampfold.catalog.tables import SIGNALS_SQL, rounded, signals, table
from ampfold.functions.cleaning import fill_nonfinite
from ampfold.operators import signals as ops

ORDER = ["ts", "event_id"]


def _r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


# --- linear fit: lineitem per supplier, extended price on quantity ----------------------

_SLOPE = """CASE WHEN regr_count(l_extendedprice, l_quantity) < 2 THEN 0.0
                 WHEN regr_sxx(l_extendedprice, l_quantity) = 0 THEN 0.0
                 ELSE regr_slope(l_extendedprice, l_quantity) END"""
_R2 = """CASE WHEN regr_count(l_extendedprice, l_quantity) < 2 THEN 0.0
              WHEN regr_sxx(l_extendedprice, l_quantity) = 0 THEN
                   CASE WHEN regr_syy(l_extendedprice, l_quantity) = 0 THEN 1.0 ELSE 0.0 END
              WHEN regr_syy(l_extendedprice, l_quantity) = 0 THEN 1.0
              ELSE regr_r2(l_extendedprice, l_quantity) END"""


@register("linear_fit", sql=f"""
SELECT l_suppkey, {_r(_SLOPE)} AS slope, {_r(_R2)} AS r2, {_r('avg(l_extendedprice)')} AS y_mean
FROM lineitem GROUP BY l_suppkey""")
def q_linear_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = ops.linear_fit(li, "l_suppkey", x="l_quantity", y="l_extendedprice")
    return rounded(out, ["slope", "r2", "y_mean"])


# --- distinct values with "missing" as a value: events per user -----------------------

@register("unique_values", sql=f"""
SELECT user_id,
       CAST(count(DISTINCT lv) + max(CASE WHEN lv IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique
FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE level END AS lv FROM {SIGNALS_SQL})
GROUP BY user_id""")
def q_unique_values(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("lv", F.when(F.col("event_type") == "error", None).otherwise(F.col("level")))
    return ops.unique_values(s, "user_id", "lv", name="n_unique")


# --- smallest mode: lineitem quantity per supplier --------------------------------------

@register("value_mode", sql="""
SELECT l_suppkey, l_quantity AS mode FROM (
  SELECT l_suppkey, l_quantity,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS rn
  FROM lineitem WHERE l_quantity IS NOT NULL AND NOT isnan(l_quantity)
  GROUP BY l_suppkey, l_quantity) WHERE rn = 1""")
def q_value_mode(spark, sf_dir):
    return ops.value_mode(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", name="mode")


# --- jump counts in time order: events per user -----------------------------------------

@register("value_jumps", sql=f"""
SELECT user_id,
       CAST(coalesce(sum(CASE WHEN abs(reading - pr) > 0.1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS jumps,
       CAST(coalesce(sum(CASE WHEN abs(level - pl) > 0.1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS level_jumps
FROM (SELECT user_id, reading, level,
             lag(reading) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pr,
             lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pl
      FROM {SIGNALS_SQL})
GROUP BY user_id""")
def q_value_jumps(spark, sf_dir):
    s = signals(spark, sf_dir)
    return ops.jump_counts(s, "user_id", ORDER, {"jumps": "reading", "level_jumps": "level"}, threshold=0.1)


# --- maximum and its first position: events per user ------------------------------------

@register("peak_location", sql=f"""
SELECT m.user_id, {_r('m.y_max')} AS y_max, CAST(f.event_id AS DOUBLE) AS x_at_max
FROM (SELECT user_id, max(reading) AS y_max FROM {SIGNALS_SQL} GROUP BY user_id) m
LEFT JOIN (SELECT user_id, event_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY reading DESC, ts, event_id) AS rn
           FROM {SIGNALS_SQL} WHERE reading IS NOT NULL) f
  ON f.user_id = m.user_id AND f.rn = 1""")
def q_peak_location(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("x", F.col("event_id").cast("double"))
    out = ops.peak_location(s, "user_id", ORDER, x="x", y="reading")
    return rounded(out, ["y_max"])


# --- trapezoid areas: events per user, x = hours, y = reading - 100 --------------------

_PTS = f"""(SELECT user_id, event_id, hours AS x, reading - 100.0 AS y FROM {SIGNALS_SQL}
           WHERE hours IS NOT NULL AND reading IS NOT NULL)"""


def _area_sql(where: str, name: str) -> str:
    return f"""
SELECT user_id, {_r('coalesce(sum((x - lx) * (y + ly) / 2.0), 0.0)')} AS {name}
FROM (SELECT user_id, x, y,
             lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id) AS lx,
             lag(y) OVER (PARTITION BY user_id ORDER BY x, event_id) AS ly
      FROM {_PTS} WHERE {where})
GROUP BY user_id"""


def _area_input(spark, sf_dir):
    return signals(spark, sf_dir).select("user_id", "event_id", F.col("hours").alias("x"),
                                         (F.col("reading") - F.lit(100.0)).alias("y"))


@register("curve_area", sql=_area_sql("TRUE", "area"))
def q_curve_area(spark, sf_dir):
    out = ops.curve_area(_area_input(spark, sf_dir), "user_id", x="x", y="y", tie="event_id", name="area")
    return rounded(out, ["area"])


@register("positive_area", sql=_area_sql("y > 0", "positive_area"))
def q_positive_area(spark, sf_dir):
    out = ops.positive_area(_area_input(spark, sf_dir), "user_id", x="x", y="y", tie="event_id")
    return rounded(out, ["positive_area"])


@register("curve_areas", sql=f"""
SELECT a.user_id, a.area, coalesce(p.positive_area, 0.0) AS positive_area
FROM ({_area_sql('TRUE', 'area')}) a LEFT JOIN ({_area_sql('y > 0', 'positive_area')}) p USING (user_id)""")
def q_curve_areas(spark, sf_dir):
    out = ops.curve_areas(_area_input(spark, sf_dir), "user_id", x="x", y="y", tie="event_id")
    return rounded(out, ["area", "positive_area"])


# --- non-finite replacement: event values with injected NaN / +inf / -inf --------------

@register("nonfinite_fill", sql="""
SELECT event_id,
       CASE WHEN v IS NULL OR isnan(v) THEN 0.0 WHEN v = CAST('Infinity' AS DOUBLE) THEN 1.0
            WHEN v = CAST('-Infinity' AS DOUBLE) THEN -1.0 ELSE v END AS filled
FROM (SELECT event_id,
             CASE event_type WHEN 'error' THEN CAST('NaN' AS DOUBLE)
                             WHEN 'signup' THEN CAST('Infinity' AS DOUBLE)
                             WHEN 'click' THEN CAST('-Infinity' AS DOUBLE)
                             ELSE value END AS v
      FROM events)""")
def q_nonfinite_fill(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    v = (F.when(F.col("event_type") == "error", F.lit(float("nan")))
         .when(F.col("event_type") == "signup", F.lit(float("inf")))
         .when(F.col("event_type") == "click", F.lit(float("-inf")))
         .otherwise(F.col("value")))
    return ev.select("event_id", fill_nonfinite(v).alias("filled"))


# --- peaks: events per user, y = level (many plateaus) -----------------------------------

_PEAK_CANDIDATES = f"""s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, level AS y
           FROM {SIGNALS_SQL}),
c AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY user_id ORDER BY pos) IS NOT DISTINCT FROM y THEN 0 ELSE 1 END AS chg
      FROM s),
r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT user_id, run, min(pos) AS lo, max(pos) AS hi, min(y) AS y FROM r GROUP BY user_id, run),
n AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY run) AS py,
                lead(y) OVER (PARTITION BY user_id ORDER BY run) AS ny FROM g),
m AS (SELECT user_id, max(level) AS mx FROM {SIGNALS_SQL} GROUP BY user_id),
cand AS (SELECT user_id, CAST((lo + hi) // 2 AS BIGINT) AS position, y AS height
         FROM n JOIN m USING (user_id) WHERE py < y AND ny < y AND y >= mx * 0.1)"""


@register("peak_candidates", sql=f"WITH {_PEAK_CANDIDATES} SELECT * FROM cand")
def q_peak_candidates(spark, sf_dir):
    return ops.peak_candidates(signals(spark, sf_dir), "user_id", ORDER, "level", rel_height=0.1)


# Distance rule as a recursive walk in priority order (height, then the later position): a
# candidate is kept when no already-kept peak of its user lies closer than the distance.
@register("peak_detection", sql=f"""
WITH RECURSIVE {_PEAK_CANDIDATES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY height DESC, position DESC) AS rk FROM cand),
walk(user_id, rk, kept) AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ranked
    UNION ALL
    SELECT w.user_id, q.rk,
           CASE WHEN len(list_filter(w.kept, lambda k: abs(k - q.position) < 5)) = 0
                THEN list_append(w.kept, q.position) ELSE w.kept END
    FROM walk w JOIN ranked q ON q.user_id = w.user_id AND q.rk = w.rk + 1),
fin AS (SELECT user_id, kept FROM walk QUALIFY rk = max(rk) OVER (PARTITION BY user_id))
SELECT q.user_id, q.position, q.height FROM ranked q JOIN fin f USING (user_id)
WHERE list_contains(f.kept, q.position)""")
def q_peak_detection(spark, sf_dir):
    return ops.peak_detection(signals(spark, sf_dir), "user_id", ORDER, "level", rel_height=0.1, distance=5)
