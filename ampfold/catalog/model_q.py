"""Catalogue entries for Stage 2/3: design matrix, scaling, target transform, metrics, model operators."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ampfold.catalog import fixtures
from ampfold.catalog.cycles_q import early_stats_sql
from ampfold.catalog.registry import register
from ampfold.catalog.sessions_q import FEATURES_SQL, _features
from ampfold.catalog.tables import SIGNALS_SQL, rounded, signals, table
from ampfold.functions.naming import feature_names, positional_series
from ampfold.operators import evaluation, modeling, scaling
from ampfold.operators import sessions as ses
from ampfold.operators.cycles import dataset_profile, early_cycle_stats
from ampfold.operators.selection import RecursiveFeatureElimination
from ampfold.plans import life
from ampfold.plans.staging import stage
from ampfold.session import checkpoint_dir, scratch_path


def _r(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) + 0.0"


# --- design matrix from positional cycle files ------------------------------------------

_KINDS = ["click", "error", "purchase", "signup", "view"]
_CYCLE_EXPR = ["value", "ln(1 + value)", "prop_k", "CAST(hour(ts) AS DOUBLE)", "CAST(minute(ts) AS DOUBLE)", "level",
               "reading", "value / 97.0", "sqrt(value)", "CAST(day(ts) AS DOUBLE)",
               *[f"CASE WHEN event_type = '{k}' THEN 1.0 ELSE 0.0 END" for k in _KINDS]]
_CYCLE_SOURCE = f"""(SELECT 'battery=' || CAST(user_id AS VARCHAR) AS battery_id, ts, event_id,
        {', '.join(f'{e} AS c{i}' for i, e in enumerate(_CYCLE_EXPR))}
   FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_type FROM {SIGNALS_SQL})
   WHERE first_type <> 'error')"""
_SERIES = positional_series()


def _design(spark, sf_dir):
    root = fixtures.cycle_tree(spark, sf_dir)
    design, _ = life.design_from_folder(spark, root, id_from="dir", recursive=True)
    return design


@register("design_matrix", sql=early_stats_sql(_CYCLE_SOURCE, "battery_id", "ts, event_id",
                                                {s: f"c{i}" for i, s in enumerate(_SERIES)}))
def q_design_matrix(spark, sf_dir):
    d = _design(spark, sf_dir).drop("features")
    return rounded(d, [c for c in d.columns if c not in ("battery_id", "final_cycles")])


@register("dataset_profile", sql=f"""
WITH d AS ({early_stats_sql(SIGNALS_SQL, 'user_id', 'ts, event_id', {'reading': 'reading', 'prop_k': 'prop_k'})})
SELECT 'final_cycles' AS "column", CAST(count(final_cycles) AS BIGINT) AS n, {_r('min(final_cycles)')} AS min,
       {_r('max(final_cycles)')} AS max, {_r('avg(final_cycles)')} AS mean, {_r('stddev_pop(final_cycles)')} AS std FROM d
UNION ALL
SELECT 'reading_Mean', CAST(count(reading_Mean) AS BIGINT), {_r('min(reading_Mean)')}, {_r('max(reading_Mean)')},
       {_r('avg(reading_Mean)')}, {_r('stddev_pop(reading_Mean)')} FROM d
UNION ALL
SELECT 'prop_k_Slope', CAST(count(prop_k_Slope) AS BIGINT), {_r('min(prop_k_Slope)')}, {_r('max(prop_k_Slope)')},
       {_r('avg(prop_k_Slope)')}, {_r('stddev_pop(prop_k_Slope)')} FROM d""")
def q_dataset_profile(spark, sf_dir):
    s = signals(spark, sf_dir)
    d = early_cycle_stats(s, "user_id", ["ts", "event_id"], ["reading", "prop_k"], n=40)
    d = rounded(d, [c for c in d.columns if c not in ("user_id", "final_cycles")])
    p = dataset_profile(d, ["final_cycles", "reading_Mean", "prop_k_Slope"])
    return rounded(p, ["min", "max", "mean", "std"])


# --- scaling ------------------------------------------------------------------------------

@register("minmax_scale", sql=f"""
SELECT c_custkey,
       {_r('(c_acctbal - min(c_acctbal) OVER ()) / CASE WHEN max(c_acctbal) OVER () = min(c_acctbal) OVER () THEN 1.0 ELSE max(c_acctbal) OVER () - min(c_acctbal) OVER () END')} AS s_acctbal,
       CAST(0.0 AS DOUBLE) AS s_const,
       {_r('(c_nationkey - min(c_nationkey) OVER ()) / CASE WHEN max(c_nationkey) OVER () = min(c_nationkey) OVER () THEN 1.0 ELSE max(c_nationkey) OVER () - min(c_nationkey) OVER () END')} AS s_nation
FROM customer""")
def q_minmax_scale(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    v = VectorAssembler(inputCols=["c_acctbal", "_one", "c_nationkey"], outputCol="features").transform(
        c.withColumn("_one", F.lit(1.0)))
    m = scaling.ZeroSafeMinMaxScaler(inputCol="features", outputCol="scaled").fit(v)
    a = vector_to_array(F.col("scaled"))
    out = m.transform(v).select("c_custkey", a[0].alias("s_acctbal"), a[1].alias("s_const"), a[2].alias("s_nation"))
    return rounded(out, ["s_acctbal", "s_const", "s_nation"])


_SCALED = ("reading", "level", "prop_k")


@register("merged_scaler_state", sql=" UNION ALL ".join(f"""
SELECT user_id, '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, {_r(f'avg({c})')} AS mean, {_r(f'stddev_pop({c})')} AS std,
       {_r(f'min({c})')} AS lo, {_r(f'max({c})')} AS hi FROM {SIGNALS_SQL} GROUP BY user_id""" for c in _SCALED))
def q_merged_scaler_state(spark, sf_dir):
    """Scaler statistics per user, merged from those of five parts of the rows."""
    s = signals(spark, sf_dir)
    kinds = ("click", "error", "purchase", "signup", "view")
    parts = [scaling.scaler_state(s.where(F.col("event_type") == k), _SCALED, "user_id") for k in kinds]
    parts.append(scaling.scaler_state(s.where(~F.col("event_type").isin(*kinds) | F.col("event_type").isNull()), _SCALED, "user_id"))
    merged = scaling.merge_scaler_states(parts, "user_id").withColumn("std", F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0))))
    return rounded(merged.drop("m2"), ["mean", "std", "lo", "hi"])


@register("normalize_sessions", sql=FEATURES_SQL + f"""
SELECT vehicle, session,
  {_r(f'({ses.F_V_MEAN} - min({ses.F_V_MEAN}) OVER ()) / CASE WHEN max({ses.F_V_MEAN}) OVER () = min({ses.F_V_MEAN}) OVER () THEN 1.0 ELSE max({ses.F_V_MEAN}) OVER () - min({ses.F_V_MEAN}) OVER () END')} AS v_mean_global,
  {_r(f'({ses.F_V_MEAN} - min({ses.F_V_MEAN}) OVER (PARTITION BY vehicle)) / CASE WHEN max({ses.F_V_MEAN}) OVER (PARTITION BY vehicle) = min({ses.F_V_MEAN}) OVER (PARTITION BY vehicle) THEN 1.0 ELSE max({ses.F_V_MEAN}) OVER (PARTITION BY vehicle) - min({ses.F_V_MEAN}) OVER (PARTITION BY vehicle) END')} AS v_mean_vehicle,
  {_r(f'({ses.F_C_UNIQUE} - min({ses.F_C_UNIQUE}) OVER ()) / CASE WHEN max({ses.F_C_UNIQUE}) OVER () = min({ses.F_C_UNIQUE}) OVER () THEN 1.0 ELSE max({ses.F_C_UNIQUE}) OVER () - min({ses.F_C_UNIQUE}) OVER () END')} AS c_unique_global
FROM features""")
def q_normalize_sessions(spark, sf_dir):
    f = rounded(_features(spark, sf_dir), [ses.F_V_MEAN])
    g = scaling.normalize_columns(f, [ses.F_V_MEAN, ses.F_C_UNIQUE], suffix="_g")
    v = scaling.normalize_columns(g, [ses.F_V_MEAN], group="vehicle", suffix="_v")
    out = v.select("vehicle", "session", F.col(ses.F_V_MEAN + "_g").alias("v_mean_global"),
                   F.col(ses.F_V_MEAN + "_v").alias("v_mean_vehicle"), F.col(ses.F_C_UNIQUE + "_g").alias("c_unique_global"))
    return rounded(out, ["v_mean_global", "v_mean_vehicle", "c_unique_global"])


@register("target_roundtrip", sql=f"""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
s AS (SELECT avg(ln(1 + n)) AS m, CASE WHEN stddev_pop(ln(1 + n)) = 0 THEN 1.0 ELSE stddev_pop(ln(1 + n)) END AS sd FROM n)
SELECT o_custkey, CAST(n AS BIGINT) AS n, {_r('(ln(1 + n) - m) / sd')} AS z,
       {_r('greatest(exp(((ln(1 + n) - m) / sd) * sd + m) - 1, 0.0)')} AS back
FROM n CROSS JOIN s""")
def q_target_roundtrip(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    m = scaling.LogStandardTarget(inputCol="n", outputCol="z").fit(n)
    out = m.transform(n).withColumn("back", m.inverse(F.col("z"))).select("o_custkey", "n", "z", "back")
    return rounded(out, ["z", "back"])


# --- metrics and error tables (prediction = mean order price of the customer) ----------------

_PRED_SQL = """(SELECT o_orderkey, o_custkey, o_totalprice AS actual,
                avg(o_totalprice) OVER (PARTITION BY o_custkey) AS predicted FROM orders)"""


def _preds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("predicted"))
    return o.join(m, "o_custkey").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("actual"), "predicted")


@register("regression_metrics", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS n_samples, {_r('sqrt(avg((actual - predicted) * (actual - predicted)))')} AS rmse,
       {_r('avg(abs(actual - predicted))')} AS mae,
       {_r('1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(actual))')} AS r2
FROM {_PRED_SQL}""")
def q_regression_metrics(spark, sf_dir):
    return rounded(evaluation.regression_metrics(_preds(spark, sf_dir)), ["rmse", "mae", "r2"])


@register("prediction_errors", sql=f"""
SELECT o_orderkey, {_r('actual')} AS actual, {_r('predicted')} AS predicted, {_r('abs(actual - predicted)')} AS abs_error,
       {_r("CASE WHEN actual <> 0 THEN abs(actual - predicted) / actual * 100 ELSE CAST('Infinity' AS DOUBLE) END")} AS error_pct,
       {_r('actual - predicted')} AS residual
FROM {_PRED_SQL}""")
def q_prediction_errors(spark, sf_dir):
    e = evaluation.prediction_errors(_preds(spark, sf_dir)).drop("o_custkey")
    return rounded(e, ["actual", "predicted", "abs_error", "error_pct", "residual"])


@register("plot_ranges", sql=f"""
SELECT {_r('least(min(actual), min(predicted))')} AS line_min, {_r('greatest(max(actual), max(predicted))')} AS line_max,
       {_r('min(actual - predicted)')} AS residual_min, {_r('max(actual - predicted)')} AS residual_max
FROM {_PRED_SQL}""")
def q_plot_ranges(spark, sf_dir):
    return rounded(evaluation.plot_ranges(_preds(spark, sf_dir)), ["line_min", "line_max", "residual_min", "residual_max"])


@register("loo_split", sql=f"""
WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey),
t AS (SELECT sum(m) AS s, count(*) AS n FROM m)
SELECT l_suppkey, CAST(n - 1 AS BIGINT) AS train_size, {_r('CASE WHEN n > 1 THEN (s - m) / (n - 1) END')} AS others_mean
FROM m CROSS JOIN t""")
def q_loo_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("m"))
    out = modeling.leave_one_out_aggregates(m, "l_suppkey", "m")
    return rounded(out, ["others_mean"])


@register("schema_union", sql=f"""
SELECT user_id, {_r('slope')} AS slope, {_r('r2')} AS r2, {_r('y_mean')} AS y_mean, {_r('mode')} AS mode FROM (
  SELECT user_id,
    CASE WHEN regr_count(value, hours) < 2 THEN 0.0 WHEN regr_sxx(value, hours) = 0 THEN 0.0 ELSE regr_slope(value, hours) END AS slope,
    CASE WHEN regr_count(value, hours) < 2 THEN 0.0 WHEN regr_sxx(value, hours) = 0 THEN
         (CASE WHEN regr_syy(value, hours) = 0 THEN 1.0 ELSE 0.0 END) WHEN regr_syy(value, hours) = 0 THEN 1.0
         ELSE regr_r2(value, hours) END AS r2,
    avg(value) AS y_mean, CAST(NULL AS DOUBLE) AS mode
  FROM {SIGNALS_SQL} GROUP BY user_id
  UNION ALL
  SELECT user_id, NULL, NULL, NULL, level FROM (
    SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, level) AS rn
    FROM {SIGNALS_SQL} GROUP BY user_id, level) WHERE rn = 1)""")
def q_schema_union(spark, sf_dir):
    from ampfold.operators import signals as ops

    s = signals(spark, sf_dir)
    a = ops.linear_fit(s, "user_id", x="hours", y="value")
    b = ops.value_mode(s, "user_id", "level", name="mode")
    return rounded(ses.schema_union([a, b]), ["slope", "r2", "y_mean", "mode"])


# --- model operators ----------------------------------------------------------------------
# Trees are random by nature, so the SQL twins check what is not: folds, training sizes, actual values, widths,
# and that a stored model scores like the fitted one. Full presets throughout. Leave-one-out fits a forest of 500
# trees per battery, and elimination one of 200 per battery and feature count, so those run on small but complete
# fleets: every nation, and every region, is one battery whose cycles are all its orders. Elimination takes all 112
# features, a fifth of them at a time (its step; one at a time takes some 670 forests); else as the preset has it. The
# fleet of all users is cross-validated in five folds.

_FLEETS = {"nation": "c_nationkey", "region": "n_regionkey"}
_FITTED: dict[tuple, object] = {}


def _once(spark, sf_dir, kind, make):
    """What one application fits once for several queries."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _fleet(spark, sf_dir, by):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    price, date = F.col("o_totalprice"), F.col("o_orderdate")
    series = [price, F.log1p(price), F.sqrt(price), price / 97.0, F.month(date), F.dayofmonth(date), F.year(date), F.dayofyear(date),
              F.col("o_custkey"), F.col("c_acctbal"), F.pmod("o_orderkey", F.lit(7)), F.pmod("o_custkey", F.lit(11)),
              F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0), F.floor(price / 1000), F.pmod("o_orderkey", F.lit(64))]
    rows = orders.select(F.col(_FLEETS[by]).alias("battery_id"), "o_orderdate", "o_orderkey",
                         *[c.cast("double").alias(f"c{i}") for i, c in enumerate(series)])
    return _once(spark, sf_dir, f"fleet-{by}", lambda: stage(
        life.design_matrix(rows, order=("o_orderdate", "o_orderkey")).coalesce(1), f"fleet-{by}"))  # one row per battery


def _fleet_sql(by: str) -> str:
    return (f"(SELECT {_FLEETS[by]} AS battery_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
            f"JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)")


def _final(spark, sf_dir):
    design = _once(spark, sf_dir, "design", lambda: stage(_design(spark, sf_dir), "design"))
    return design, _once(spark, sf_dir, "final", lambda: modeling.fit_final(design, preset="reference"))


@register("forest_fit", sql="SELECT 500 AS n_trees, 112 AS n_features, 1.0::DOUBLE AS importance_sum, TRUE AS within_depth")
def q_forest_fit(spark, sf_dir):
    """The final forest of all batteries: its size, and its importances in total."""
    forest = modeling.forest_stage(_final(spark, sf_dir)[1])
    importances = forest.featureImportances.toArray()
    deepest = max(t.depth for t in forest.trees)
    return spark.createDataFrame([(len(forest.trees), len(importances), round(float(importances.sum()), 6), deepest <= 20)],
                                 "n_trees int, n_features int, importance_sum double, within_depth boolean")


@register("top_features")
def q_top_features(spark, sf_dir):
    importances = modeling.forest_stage(_final(spark, sf_dir)[1]).featureImportances.toArray().tolist()
    return evaluation.top_features(evaluation.importance_table(spark, importances, feature_names()), k=20)


@register("loo_folds", sql="""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS fold, o_totalprice, o_custkey FROM orders""")
def q_loo_folds(spark, sf_dir):
    """Leave-one-out folds of a large table: one per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return modeling.with_folds(orders, "o_orderkey", "loo")


def _loo(spark, sf_dir):
    return _once(spark, sf_dir, "loo", lambda: modeling.cross_validated_predictions(_fleet(spark, sf_dir, "nation"), preset="reference", folds="loo"))


@register("loocv_predictions", sql=f"""
SELECT battery_id, CAST(row_number() OVER (ORDER BY battery_id) - 1 AS BIGINT) AS fold, CAST(count(*) OVER () - 1 AS BIGINT) AS train_size,
       CAST(n AS DOUBLE) AS actual, TRUE AS predicted_in_range
FROM {_fleet_sql('nation')}""")
def q_loocv_predictions(spark, sf_dir):
    """One fold per battery, a forest of 500 trees each; a mean of leaves lies within the actual values."""
    preds = evaluation.prediction_errors(_loo(spark, sf_dir))
    total = preds.agg(F.count("*").alias("n"), F.min("actual").alias("low"), F.max("actual").alias("high")).first()
    inside = F.col("predicted").between(total["low"] - 1e-6, total["high"] + 1e-6)
    return preds.select("battery_id", "fold", F.lit(total["n"] - 1).cast("long").alias("train_size"), "actual", inside.alias("predicted_in_range"))


@register("prediction_sample")
def q_prediction_sample(spark, sf_dir):
    return evaluation.prediction_sample(evaluation.prediction_errors(_loo(spark, sf_dir)), k=10)


@register("cv_metrics")
def q_cv_metrics(spark, sf_dir):
    return evaluation.regression_metrics(_loo(spark, sf_dir), n_features=len(feature_names()))


@register("score_new", sql=f"""
SELECT 'battery=' || CAST(user_id AS VARCHAR) AS battery_id, TRUE AS stored_scores_alike, TRUE AS not_negative
FROM (SELECT DISTINCT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_type FROM events) WHERE first_type <> 'error'""")
def q_score_new(spark, sf_dir):
    """Scores of the stored and reloaded model, against those of the fitted one."""
    design, model = _final(spark, sf_dir)
    path = scratch_path(spark, "model")
    modeling.save_model(model, path)
    new = modeling.score(modeling.load_model(path), design.drop("final_cycles")).select("battery_id", "prediction")
    own = modeling.score(model, design).select("battery_id", F.col("prediction").alias("_own"))
    return new.join(own, "battery_id").select("battery_id", (F.abs(F.col("prediction") - F.col("_own")) < 1e-9).alias("stored_scores_alike"),
                                              (F.col("prediction") >= 0).alias("not_negative"))


@register("kfold_predictions")
def q_kfold_predictions(spark, sf_dir):
    """Every user battery predicted by a forest of 500 trees that has not seen its fold (five, by hash), with the errors."""
    design = _once(spark, sf_dir, "design", lambda: stage(_design(spark, sf_dir), "design"))
    preds = _once(spark, sf_dir, "kfold", lambda: modeling.cross_validated_predictions(design, preset="reference", folds=5, parallelism=2))
    return evaluation.prediction_errors(preds)


@register("importance_of_features")
def q_importance_of_features(spark, sf_dir):
    """The importances of all features in the final forest."""
    importances = modeling.forest_stage(_final(spark, sf_dir)[1]).featureImportances.toArray().tolist()
    return evaluation.importance_table(spark, importances, feature_names())


def _rfe(spark, sf_dir):
    def fit():
        design = _fleet(spark, sf_dir, "region")
        t = scaling.LogStandardTarget(inputCol="final_cycles", outputCol="_target").fit(design)
        p = modeling.PRESETS["selection"]
        rfe = RecursiveFeatureElimination(featuresCol="features", labelCol="_target", step=0.2, folds="loo", numTrees=p["numTrees"],
                                          maxDepth=p["maxDepth"], seed=p["seed"], parallelism=spark.sparkContext.defaultParallelism,
                                          ledger=f"{checkpoint_dir(spark)}/ampfold-rfe-ledger")
        return design, rfe.fit(t.transform(design))

    return _once(spark, sf_dir, "rfe", fit)


@register("rfe_ranking")
def q_rfe_ranking(spark, sf_dir):
    """Ranks of all 112 features: leave-one-out, a fifth of them a step, 200 trees each."""
    _, model = _rfe(spark, sf_dir)
    return model.ranking_table(spark, feature_names())


@register("feature_mask", sql=f"SELECT battery_id, TRUE AS width_as_ranked, TRUE AS values_as_ranked FROM {_fleet_sql('region')}")
def q_feature_mask(spark, sf_dir):
    """The masked vectors hold the features of rank 1, in their order."""
    design, model = _rfe(spark, sf_dir)
    first = [i for i, r in enumerate(model.getRanking()) if r == 1]
    kept, whole = vector_to_array(F.col("selected")), vector_to_array(F.col("features"))
    want = F.array(*[whole[i] for i in first])
    return model.transform(design).select("battery_id", (F.size(kept) == len(first)).alias("width_as_ranked"), (kept == want).alias("values_as_ranked"))
