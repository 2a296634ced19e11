"""Catalogue entries for the early-cycle statistics (A-13, A-14, T-03, W-02, W-03, S2-04, F-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampfold.catalog.registry import register
from ampfold.catalog.tables import SIGNALS_SQL, rounded, signals, table
from ampfold.functions.naming import CYCLE_SERIES, STATISTICS
from ampfold.operators.cycles import early_cycle_stats
from ampfold.plans.maintained import MaintainedDesign
from ampfold.session import scratch_path


def _fill_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 WHEN {c} = CAST('Infinity' AS DOUBLE) THEN 1.0 "
            f"WHEN {c} = CAST('-Infinity' AS DOUBLE) THEN -1.0 ELSE {c} END")


def _stat_sql(s: str) -> list[str]:
    slope = f"regr_slope({s}, cyc)"
    exprs = [
        f"avg({s})",
        f"coalesce(stddev_pop({s}), 0.0)",
        f"min({s})",
        f"max({s})",
        f"arg_min({s}, cyc)",
        f"arg_max({s}, cyc)",
        f"CASE WHEN {slope} IS NULL OR isnan({slope}) THEN 0.0 ELSE {slope} END",
    ]
    return [f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {s}_{st}" for e, st in zip(exprs, STATISTICS)]


def early_stats_sql(source: str, group: str, order: str, cols: dict[str, str], n: int = 40) -> str:
    """DuckDB twin of ``early_cycle_stats``: ``cols`` maps series name -> SQL expression."""
    filled = ", ".join(f"{_fill_sql(expr)} AS {name}" for name, expr in cols.items())
    series = [*cols, CYCLE_SERIES]
    stats = ",\n       ".join(x for s in series for x in _stat_sql(s))
    return f"""
WITH e AS (SELECT {group}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS cyc, {filled}
           FROM {source}),
     f AS (SELECT *, CAST(cyc AS DOUBLE) AS {CYCLE_SERIES} FROM e WHERE cyc <= {n}),
     lab AS (SELECT {group}, count(*) AS final_cycles FROM {source} GROUP BY {group})
SELECT {group}, CAST(lab.final_cycles AS BIGINT) AS final_cycles,
       {stats}
FROM f JOIN lab USING ({group})
GROUP BY {group}, lab.final_cycles"""


@register("early_cycle_stats", sql=early_stats_sql(SIGNALS_SQL, "user_id", "ts, event_id",
                                                    {"reading": "reading", "prop_k": "prop_k"}))
def q_early_cycle_stats(spark, sf_dir):
    s = signals(spark, sf_dir)
    out = early_cycle_stats(s, "user_id", ["ts", "event_id"], ["reading", "prop_k"], n=40)
    return rounded(out, [c for c in out.columns if c not in ("user_id", "final_cycles")])


@register("early_cycle_stats_short", sql=early_stats_sql(
    "orders", "o_custkey", "o_orderdate, o_orderkey", {"totalprice": "o_totalprice"}))
def q_early_cycle_stats_short(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = early_cycle_stats(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"],
                            series_names=["totalprice"], n=40)
    return rounded(out, [c for c in out.columns if c not in ("o_custkey", "final_cycles")])


@register("maintained_design", sql=early_stats_sql(SIGNALS_SQL, "user_id", "ts, event_id", {"reading": "reading", "prop_k": "prop_k"}))
def q_maintained_design(spark, sf_dir):
    """The same design, kept up to date by three batches that come out of order; the second comes twice."""
    s = signals(spark, sf_dir)
    kept = MaintainedDesign(spark, scratch_path(spark, "design"), "user_id", ["ts", "event_id"], ["reading", "prop_k"])
    for part in (2, 0, 0, 1):
        kept.append(s.where(F.pmod(F.day("ts"), F.lit(3)) == part), f"days-{part}")
    out = kept.design()
    return rounded(out, [c for c in out.columns if c not in ("user_id", "final_cycles")])
