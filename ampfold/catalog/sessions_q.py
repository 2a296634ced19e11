"""Catalogue entries for Stage 1 (session CSV tree -> session features) and the positional reader.

The CSV trees are written from ``events`` (see :mod:`ampfold.catalog.fixtures`); the DuckDB
twins compute the same numbers straight from ``events``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ampfold.catalog import fixtures
from ampfold.catalog.registry import register
from ampfold.catalog.tables import SIGNALS_SQL, rounded
from ampfold.functions.paths import group_dir_of, path_datetime, report_datetime
from ampfold.operators import sessions as ses
from ampfold.plans.union_files import union_of_files
from ampfold.sources import cycle_csv, session_csv
from ampfold.sources.session_csv import CAPACITY, CURRENT, DQDV, DURATION, TEMPERATURE, VOLTAGE



def SESSION_OF():  # noqa: N802
    return F.regexp_extract("session_file", r"/(session=[^/]+)/[^/]+$", 1)


def _features(spark, sf_dir, extractors=()):
    found = fixtures.open_sessions(spark, sf_dir).features(extractors)
    return ses.valid_sessions(found).withColumn("session", SESSION_OF())


def _r(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) + 0.0"


# --- SQL twin of the session tree and of its 15 features --------------------------------

RAW_SQL = f"""(SELECT user_id, event_type, ts, event_id,
        'vehicle=' || CAST(user_id AS VARCHAR) AS vehicle,
        'session=' || strftime(min(ts) OVER (PARTITION BY user_id, event_type), '%Y%m%d_%H%M%S') || '_' || event_type AS session,
        date_trunc('second', min(ts) OVER (PARTITION BY user_id, event_type)) AS st,
        hours AS cap, reading AS volt, level AS cur,
        CASE WHEN event_type = 'view' THEN NULL ELSE prop_k END AS temp,
        value * 7.0 AS dur, reading - 100.0 AS q
   FROM {SIGNALS_SQL})"""


# The odd session files of the fixture: their rows as read, and the features of those without rows or fits.
_ODD_USERS = "(SELECT DISTINCT user_id FROM events)"


def _odd(kind: int) -> str:
    return f"20200101_00000{kind}_{fixtures.ODD_FILES[kind][0]}"


ODD_NAMES_SQL = " UNION ALL ".join(
    f"SELECT 'vehicle=' || CAST(user_id AS VARCHAR) AS vehicle, 'session={_odd(k)}' AS session, {k} AS kind, "
    f"TIMESTAMP '2020-01-01 00:00:0{k}' AS st FROM {_ODD_USERS} WHERE user_id % 8 = {k}" for k in fixtures.ODD_FILES)
_N = "CAST(NULL AS DOUBLE)"
ODD_ROWS_SQL = " UNION ALL ".join(
    f"SELECT vehicle, session, {cap} AS cap, {volt}.0 AS volt, {cur} AS cur, {temp}.0 AS temp, 7.0 AS dur, {q} AS q FROM ({ODD_NAMES_SQL}) WHERE kind = {kind}"
    for kind, cap, volt, cur, temp, q in (
        (1, "1.0", 10, "5.0", 20, "1.0"), (1, "2.0", 30, "5.0", 21, "3.0"), (2, "1.0", 10, _N, 20, "1.0"), (2, "2.0", 30, "5.0", 21, "3.0"),
        (3, "1.0", 10, "5.0", 20, "1.0"), (3, "2.0", 30, "5.0", 21, "3.0"),
        (6, "1.0", 10, "5.0", 20, "1.0"), (6, "2.0", 30, "5.0", 21, "3.0"), (5, "1.0", 10, "5.0", 20, "1.0"), (5, "2.0", 30, "5.0", 21, "3.0"),
        (4, _N, 10, "5.0", 20, _N), (4, "2.0", 30, "5.0", 20, _N)))
_NL = "CAST(NULL AS BIGINT)"
_EMPTY = f"0, TRUE, 0.0, 0.0, {_N}, 0, {_N}, 0, 0, {_N}, 0, 0.0, {_N}, {_N}, {_N}, {_N}, {_N}"
_FULL = "2, FALSE, 20.0, 1.0, 20.0, 1, 5.0, 0, 2, 20.0, 1, 0.0, 7.0, 3.0, 2.0, 2.0, 2.0"
_NO_FIT = f"2, FALSE, 0.0, 0.0, 20.0, 1, 5.0, 0, 1, 20.0, 0, 0.0, 7.0, {_N}, {_N}, {_N}, {_N}"
ODD_FEATURES_SQL = " UNION ALL ".join(
    f"SELECT vehicle, session, strftime(st, '%Y-%m-%d %H:%M:%S'), st, {values} FROM ({ODD_NAMES_SQL}) WHERE kind = {kind}"
    for kind, values in ((0, _EMPTY), (7, _EMPTY), (3, _FULL), (5, _FULL), (4, _NO_FIT)))


def _slope(y, x):
    return f"CASE WHEN regr_count({y},{x}) < 2 THEN 0.0 WHEN regr_sxx({y},{x}) = 0 THEN 0.0 ELSE regr_slope({y},{x}) END"


def _r2(y, x):
    return (f"CASE WHEN regr_count({y},{x}) < 2 THEN 0.0 WHEN regr_sxx({y},{x}) = 0 THEN "
            f"(CASE WHEN regr_syy({y},{x}) = 0 THEN 1.0 ELSE 0.0 END) WHEN regr_syy({y},{x}) = 0 THEN 1.0 "
            f"ELSE regr_r2({y},{x}) END")


def _mode_cte(col: str) -> str:
    return f"""(SELECT vehicle, session, v FROM (
      SELECT vehicle, session, {col} AS v,
             row_number() OVER (PARTITION BY vehicle, session ORDER BY count(*) DESC, {col}) AS rn
      FROM raw WHERE {col} IS NOT NULL GROUP BY vehicle, session, {col}) WHERE rn = 1)"""


def _area_cte(where: str) -> str:
    return f"""(SELECT vehicle, session, sum((cap - lc) * (q + lq) / 2.0) AS a FROM (
      SELECT vehicle, session, cap, q,
             lag(cap) OVER (PARTITION BY vehicle, session ORDER BY cap, ts, event_id) AS lc,
             lag(q) OVER (PARTITION BY vehicle, session ORDER BY cap, ts, event_id) AS lq
      FROM raw WHERE cap IS NOT NULL AND q IS NOT NULL AND {where}) GROUP BY vehicle, session)"""


FEATURES_SQL = f"""
WITH raw AS {RAW_SQL},
lagged AS (SELECT vehicle, session,
       CASE WHEN abs(cur - lag(cur) OVER w) > 0.1 THEN 1 ELSE 0 END AS jc,
       CASE WHEN abs(temp - lag(temp) OVER w) > 0.1 THEN 1 ELSE 0 END AS jt
    FROM raw WINDOW w AS (PARTITION BY vehicle, session ORDER BY ts, event_id)),
jumps AS (SELECT vehicle, session, sum(jc) AS jc, sum(jt) AS jt FROM lagged GROUP BY vehicle, session),
peak AS (SELECT vehicle, session, cap FROM (
    SELECT vehicle, session, cap, row_number() OVER (PARTITION BY vehicle, session ORDER BY q DESC, ts, event_id) AS rn
    FROM raw WHERE q IS NOT NULL) WHERE rn = 1),
mc AS {_mode_cte('cur')},
mt AS {_mode_cte('temp')},
area AS {_area_cte('TRUE')},
parea AS {_area_cte('q > 0')},
base AS (SELECT vehicle, session, min(st) AS st, count(*) AS n_rows, bool_or(event_type = 'view') AS is_view,
       {_slope('volt', 'cap')} AS v_slope, {_r2('volt', 'cap')} AS v_r2, avg(volt) AS v_mean,
       count(DISTINCT cur) + max(CASE WHEN cur IS NULL THEN 1 ELSE 0 END) AS c_unique,
       count(DISTINCT temp) + max(CASE WHEN temp IS NULL THEN 1 ELSE 0 END) AS t_unique,
       {_slope('dur', 'cap')} AS d_slope, avg(dur) AS d_mean, max(q) AS q_max, count(q) AS q_n
    FROM raw GROUP BY vehicle, session),
features AS (
SELECT b.vehicle, b.session, strftime(b.st, '%Y-%m-%d %H:%M:%S') AS session_time, b.st,
       CAST(b.n_rows AS BIGINT) AS n_rows,
       (b.q_n = 0) AS dqdv_all_missing,
       {_r('b.v_slope')} AS {ses.F_V_SLOPE},
       {_r('b.v_r2')} AS {ses.F_V_R2},
       {_r('b.v_mean')} AS {ses.F_V_MEAN},
       CAST(b.c_unique AS BIGINT) AS {ses.F_C_UNIQUE},
       {_r('mc.v')} AS {ses.F_C_MODE},
       CAST(j.jc AS BIGINT) AS {ses.F_C_JUMPS},
       CAST(CASE WHEN b.is_view THEN NULL ELSE b.t_unique END AS BIGINT) AS {ses.F_T_UNIQUE},
       {_r('CASE WHEN b.is_view THEN NULL ELSE mt.v END')} AS {ses.F_T_MODE},
       CAST(CASE WHEN b.is_view THEN NULL ELSE j.jt END AS BIGINT) AS {ses.F_T_JUMPS},
       {_r('b.d_slope')} AS {ses.F_D_SLOPE},
       {_r('b.d_mean')} AS {ses.F_D_MEAN},
       {_r('CASE WHEN b.q_n > 0 THEN b.q_max END')} AS {ses.F_Q_MAX},
       {_r('CASE WHEN b.q_n > 0 THEN p.cap END')} AS {ses.F_Q_PEAK},
       {_r('CASE WHEN b.q_n > 0 THEN coalesce(a.a, 0.0) END')} AS {ses.F_Q_AREA},
       {_r('CASE WHEN b.q_n > 0 THEN coalesce(pa.a, 0.0) END')} AS {ses.F_Q_POS}
FROM base b
LEFT JOIN jumps j USING (vehicle, session) LEFT JOIN peak p USING (vehicle, session)
LEFT JOIN mc USING (vehicle, session) LEFT JOIN mt USING (vehicle, session)
LEFT JOIN area a USING (vehicle, session) LEFT JOIN parea pa USING (vehicle, session)
UNION ALL {ODD_FEATURES_SQL})"""

FEATURE_COLS = ["vehicle", "session", "session_time", "n_rows", *ses.FEATURES]


@register("session_features", sql=FEATURES_SQL + f"\nSELECT {', '.join(FEATURE_COLS)} FROM features")
def q_session_features(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("session_time", report_datetime("session_ts"))
    dbl = [c for c in ses.FEATURES if c not in ses.LONG_FEATURES]
    return rounded(f.select(*FEATURE_COLS), dbl)


MISSING_COLS = ["vehicle", "session", "has_temperature", ses.F_T_UNIQUE, ses.F_T_MODE, ses.F_T_JUMPS,
                ses.F_V_SLOPE, ses.F_V_R2, ses.F_V_MEAN]


@register("missing_column_rules", sql=FEATURES_SQL + f"""
SELECT vehicle, session, ({ses.F_T_UNIQUE} IS NOT NULL) AS has_temperature, {', '.join(MISSING_COLS[3:])}
FROM features""")
def q_missing_column_rules(spark, sf_dir):
    f = _features(spark, sf_dir).withColumn("has_temperature", F.col(f"has_{TEMPERATURE}"))
    return rounded(f.select(*MISSING_COLS), [ses.F_T_MODE, ses.F_V_SLOPE, ses.F_V_R2, ses.F_V_MEAN])


_ALL_SESSIONS = f"(SELECT vehicle, session, st FROM ({ODD_NAMES_SQL}) UNION SELECT DISTINCT vehicle, session, st FROM raw)"


@register("session_timeline", sql=f"""
WITH raw AS {RAW_SQL}
SELECT vehicle, session, CAST(row_number() OVER (PARTITION BY vehicle ORDER BY st, session) - 1 AS BIGINT) AS position
FROM {_ALL_SESSIONS}""")
def q_session_timeline(spark, sf_dir):
    """All session files in time order, from their paths alone."""
    files = fixtures.open_sessions(spark, sf_dir, read=False).sessions().withColumn("session", SESSION_OF())
    return ses.session_timeline(files).select("vehicle", "session", "position")


@register("feature_timeline", sql=FEATURES_SQL + f"""
SELECT vehicle, session, CAST(row_number() OVER (PARTITION BY vehicle ORDER BY st, session) - 1 AS BIGINT) AS position,
       {', '.join(ses.FEATURES)} FROM features""")
def q_feature_timeline(spark, sf_dir):
    """The usable sessions in time order with all their features."""
    f = ses.session_timeline(_features(spark, sf_dir))
    return rounded(f.select("vehicle", "session", "position", *ses.FEATURES), [c for c in ses.FEATURES if c not in ses.LONG_FEATURES])


@register("run_summary", sql=FEATURES_SQL + f"""
SELECT vehicle, CAST(count(*) AS BIGINT) AS n_files, CAST(count(DISTINCT vehicle) AS BIGINT) AS n_groups,
       CAST({' + '.join(f'max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)' for c in ses.FEATURES)} AS BIGINT) AS n_features,
       strftime(min(st), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(st), '%Y-%m-%d %H:%M:%S') AS last_time
FROM features GROUP BY ROLLUP (vehicle)""")
def q_run_summary(spark, sf_dir):
    return ses.run_summary(_features(spark, sf_dir))


@register("rejected_files", sql=FEATURES_SQL + f"""
SELECT vehicle, session, 'dqdv_all_missing' AS reason, 'warn' AS severity FROM features WHERE dqdv_all_missing
UNION ALL SELECT vehicle, session, CASE kind WHEN 2 THEN 'non_numeric' ELSE 'ragged' END, 'error' FROM ({ODD_NAMES_SQL}) WHERE kind IN (1, 2, 6)""")
def q_rejected_files(spark, sf_dir):
    rej = fixtures.open_sessions(spark, sf_dir).rejected()
    return rej.select(F.regexp_extract("path", r"/(vehicle=[^/]+)/", 1).alias("vehicle"),
                      F.regexp_extract("path", r"/(session=[^/]+)/[^/]+$", 1).alias("session"), "reason", "severity")


@register("session_scan", sql=f"""
WITH raw AS (SELECT vehicle, session, cap, volt, cur, temp, dur, q FROM {RAW_SQL} UNION ALL {ODD_ROWS_SQL})
SELECT vehicle, session, CAST(count(*) AS BIGINT) AS n_rows,
       {_r('sum(cap)')} AS cap_sum, CAST(count(volt) AS BIGINT) AS volt_n, {_r('sum(volt)')} AS volt_sum,
       {_r('sum(cur)')} AS cur_sum, CAST(count(temp) AS BIGINT) AS temp_n, {_r('sum(temp)')} AS temp_sum,
       {_r('sum(dur)')} AS dur_sum, CAST(count(q) AS BIGINT) AS q_n, {_r('sum(q)')} AS q_sum
FROM raw GROUP BY vehicle, session""")
def q_session_scan(spark, sf_dir):
    r = fixtures.open_sessions(spark, sf_dir).rows
    out = r.groupBy("session_file", "_root").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(CAPACITY).alias("cap_sum"),
        F.count(VOLTAGE).alias("volt_n"), F.sum(VOLTAGE).alias("volt_sum"), F.sum(CURRENT).alias("cur_sum"),
        F.count(TEMPERATURE).alias("temp_n"), F.sum(TEMPERATURE).alias("temp_sum"),
        F.sum(DURATION).alias("dur_sum"), F.count(DQDV).alias("q_n"), F.sum(DQDV).alias("q_sum"))
    out = out.select(group_dir_of("session_file", "_root").alias("vehicle"), SESSION_OF().alias("session"),
                     *[c for c in out.columns if c not in ("session_file", "_root")])
    return rounded(out, ["cap_sum", "volt_sum", "cur_sum", "temp_sum", "dur_sum", "q_sum"])


_HEADER = ",".join(session_csv.SESSION_COLUMNS)
_HEADER_REV = ",".join(reversed(session_csv.SESSION_COLUMNS))
_HEADER_ODD = ",".join(c for c in session_csv.SESSION_COLUMNS if c != DQDV)
_HEADER_VIEW = ",".join(c for c in session_csv.SESSION_COLUMNS if c != TEMPERATURE)


@register("file_profile", sql=f"""
WITH raw AS {RAW_SQL}
SELECT vehicle, session,
       CAST(CASE WHEN min(event_type) = 'view' THEN 5 ELSE 6 END AS INTEGER) AS n_cols,
       CAST(count(*) AS BIGINT) AS n_rows,
       CASE min(event_type) WHEN 'click' THEN '{_HEADER_REV}' WHEN 'view' THEN '{_HEADER_VIEW}' ELSE '{_HEADER}' END AS header
FROM raw GROUP BY vehicle, session
UNION ALL SELECT vehicle, session, CASE kind WHEN 4 THEN 5 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 6 ELSE 7 END,
       CASE kind WHEN 0 THEN 0 WHEN 7 THEN 0 WHEN 3 THEN 3 WHEN 6 THEN 3 ELSE 2 END,
       CASE kind WHEN 4 THEN '{_HEADER_ODD}' WHEN 3 THEN '{_HEADER},note' WHEN 6 THEN '{_HEADER},note' WHEN 5 THEN '{_HEADER},note' WHEN 7 THEN '{_HEADER},' || repeat('x', 70000)
       ELSE '{_HEADER}' END FROM ({ODD_NAMES_SQL})""")
def q_file_profile(spark, sf_dir):
    p = fixtures.open_sessions(spark, sf_dir).profile
    return p.select("vehicle", F.regexp_extract("file", r"/(session=[^/]+)/[^/]+$", 1).alias("session"),
                    "n_cols", "n_rows", F.array_join("columns", ",").alias("header"))


@register("charset_profile", sql=f"""
WITH raw AS {RAW_SQL}
SELECT DISTINCT vehicle, session, TRUE AS utf8, 'UTF-8' AS charset FROM raw
UNION ALL SELECT vehicle, session, kind <> 5, CASE kind WHEN 5 THEN 'ISO-8859-1' ELSE 'UTF-8' END FROM ({ODD_NAMES_SQL})""")
def q_charset_profile(spark, sf_dir):
    root = fixtures.session_tree(spark, sf_dir)
    p = session_csv.charset_profile(spark, root)
    return p.select(F.regexp_extract("file", r"/(vehicle=[^/]+)/", 1).alias("vehicle"),
                    F.regexp_extract("file", r"/(session=[^/]+)/[^/]+$", 1).alias("session"), "utf8", "charset")


@register("custom_extractor", sql=f"""
WITH raw AS (SELECT vehicle, session, volt, q FROM {RAW_SQL} UNION ALL SELECT vehicle, session, volt, q FROM ({ODD_ROWS_SQL}))
SELECT vehicle, session, {_r('max(volt) - min(volt)')} AS voltage_range, {_r('median(q)')} AS dqdv_median, {_r('median(q)')} AS shared
FROM raw WHERE session NOT LIKE '%_ragged' AND session NOT LIKE '%_text' GROUP BY vehicle, session
UNION ALL SELECT vehicle, session, NULL, NULL, NULL FROM ({ODD_NAMES_SQL}) WHERE kind IN (0, 7)""")
def q_custom_extractor(spark, sf_dir):
    def dqdv_median(pdf):
        return {"dqdv_median": pdf[DQDV].median(), "shared": pdf[DQDV].median()}

    extractors = [  # both kinds give ``shared``: the last wins
        ses.ColumnExtractor("voltage_range", lambda: {"voltage_range": F.max(VOLTAGE) - F.min(VOLTAGE), "shared": F.max(VOLTAGE)}),
        ses.PandasExtractor("dqdv_median", dqdv_median, columns=(DQDV,)),
    ]
    f = _features(spark, sf_dir, extractors)
    out = f.select("vehicle", "session", *[F.col("custom")[c].alias(c) for c in ("voltage_range", "dqdv_median", "shared")])
    return rounded(out, ["voltage_range", "dqdv_median", "shared"])


def longest_steady_current() -> ses.MergeableExtractor:
    """The longest stretch of rows with one charge current. State: rows, the first and the last value, the lengths of the
    stretches at either end, the longest."""
    def update(state, pdf):
        v = pdf[CURRENT].to_numpy()
        ends = [*(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        lengths = [end - begin for begin, end in zip([0, *ends], ends, strict=False)]  # in the order of the rows
        return merge(state, (len(v), v[0], v[-1], lengths[0], lengths[-1], max(lengths)))

    def merge(a, b):
        if a is None or b is None:
            return b if a is None else a
        joint = a[4] + b[3] if a[2] == b[1] else 0
        head = a[0] + b[3] if joint and a[3] == a[0] else a[3]
        tail = b[0] + a[4] if joint and b[4] == b[0] else b[4]
        return (a[0] + b[0], a[1], b[2], head, tail, max(a[5], b[5], joint))

    return ses.MergeableExtractor("steady_rows", lambda: None, update, merge, lambda s: s[5], (CURRENT,))


_STEADY = "CASE WHEN cur IS NOT DISTINCT FROM lag(cur) OVER (PARTITION BY vehicle, session ORDER BY ts, event_id) THEN 0 ELSE 1 END"


@register("mergeable_extractor", sql=f"""
WITH raw AS {RAW_SQL},
steps AS (SELECT vehicle, session, ts, event_id, {_STEADY} AS step FROM raw),
runs AS (SELECT vehicle, session, sum(step) OVER (PARTITION BY vehicle, session ORDER BY ts, event_id) AS run FROM steps),
lengths AS (SELECT vehicle, session, run, count(*) AS n FROM runs GROUP BY vehicle, session, run)
SELECT vehicle, session, CAST(max(n) AS DOUBLE) AS steady_rows FROM lengths GROUP BY vehicle, session
UNION ALL SELECT vehicle, session, CASE WHEN kind IN (3, 4, 5) THEN 2.0 END FROM ({ODD_NAMES_SQL}) WHERE kind IN (0, 3, 4, 5, 7)""")
def q_mergeable_extractor(spark, sf_dir):
    """A custom feature that depends on the rows' order, from states of the file splits."""
    f = _features(spark, sf_dir, [longest_steady_current()])
    return f.select("vehicle", "session", F.col("custom")["steady_rows"].alias("steady_rows"))


_PLAIN = "2 * (SELECT count(*) FROM odd WHERE kind IN (2, 3, 4, 5))"
_UNION = {CAPACITY: ("string", f"(SELECT count(cap) FROM raw) + {_PLAIN}"), VOLTAGE: ("double", f"(SELECT count(volt) FROM raw) + {_PLAIN}"),
          CURRENT: ("string", f"(SELECT count(cur) FROM raw) + {_PLAIN}"), TEMPERATURE: ("double", f"(SELECT count(temp) FROM raw) + {_PLAIN}"),
          DURATION: ("double", f"(SELECT count(dur) FROM raw) + {_PLAIN}"),
          DQDV: ("double", "(SELECT count(q) FROM raw) + 2 * (SELECT count(*) FROM odd WHERE kind IN (2, 3, 5))"),
          "note": ("string", "2 * (SELECT count(*) FROM odd WHERE kind IN (3, 5))"), "x" * 40: ("double", "0")}


@register("schema_union_files", sql=f"""
WITH raw AS {RAW_SQL}, odd AS ({ODD_NAMES_SQL})
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, CAST({n} AS BIGINT) AS n_values""" for c, (t, n) in _UNION.items()))
def q_schema_union_files(spark, sf_dir):
    """Every column of all session files as one table: its type and how many values it has."""
    table = union_of_files(spark, fixtures.session_tree(spark, sf_dir))
    found = [F.struct(F.lit(c[:40]).alias("column"), F.lit(t).alias("type"), F.col(f"_n{i}").alias("n_values")) for i, (c, t) in enumerate(table.dtypes[3:])]
    counts = table.agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(table.columns[3:])])
    return counts.select(F.inline(F.array(*found)))


# --- datetime in paths -------------------------------------------------------------------

def _paths_spark(ev):
    d = lambda fmt: F.date_format("ts", fmt)
    u = F.concat(F.lit("v"), F.col("user_id").cast("string"), F.lit("/"))
    k = F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("int")
    path = (F.when((F.col("event_type") == "click") & (k < 50), F.concat(u, F.lit("b_"), d("yyyyMMdd_HHmmss"), F.lit(".csv")))
            .when(F.col("event_type") == "click", F.concat(u, d("yyyyMMdd_HHmmss"), F.lit("/a.csv")))
            .when(F.col("event_type") == "error", F.concat(u, d("yyyy"), F.lit("13"), d("dd"), F.lit("_"), d("HHmmss"), F.lit(".csv")))
            .when(F.col("event_type") == "signup", F.concat(u, F.lit("plain_"), F.col("event_id").cast("string"), F.lit(".csv")))
            .when(F.col("event_type") == "purchase", F.concat(u, d("yyyyMMdd"), F.lit("_"), d("HHmm"), F.lit("60.csv")))
            .otherwise(F.concat(u, F.lit("20230229_"), d("HHmmss"), F.lit(".csv"))))
    return ev.select("event_id", path.alias("path"))


_PATHS_SQL = """(SELECT event_id, CASE
    WHEN event_type = 'click' AND TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) < 50
         THEN 'v' || CAST(user_id AS VARCHAR) || '/b_' || strftime(ts, '%Y%m%d_%H%M%S') || '.csv'
    WHEN event_type = 'click' THEN 'v' || CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y%m%d_%H%M%S') || '/a.csv'
    WHEN event_type = 'error' THEN 'v' || CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y') || '13' || strftime(ts, '%d') || '_' || strftime(ts, '%H%M%S') || '.csv'
    WHEN event_type = 'signup' THEN 'v' || CAST(user_id AS VARCHAR) || '/plain_' || CAST(event_id AS VARCHAR) || '.csv'
    WHEN event_type = 'purchase' THEN 'v' || CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y%m%d') || '_' || strftime(ts, '%H%M') || '60.csv'
    ELSE 'v' || CAST(user_id AS VARCHAR) || '/20230229_' || strftime(ts, '%H%M%S') || '.csv' END AS path
  FROM events)"""


@register("path_datetime", sql=f"""
SELECT event_id, path, strftime(coalesce(CASE WHEN m <> '' AND TRY_CAST(substr(m, 14, 2) AS INTEGER) < 60
                                              THEN try_strptime(m, '%Y%m%d_%H%M%S') END,
                                         TIMESTAMP '0001-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS session_time
FROM (SELECT event_id, path, regexp_extract(path, '(\\d{{8}})_(\\d{{6}})', 0) AS m FROM {_PATHS_SQL})""")
def q_path_datetime(spark, sf_dir):
    from ampfold.catalog.tables import table

    p = _paths_spark(table(spark, sf_dir, "events"))
    return p.select("event_id", "path", report_datetime(path_datetime("path")).alias("session_time"))


# --- positional per-battery files (Stage 2 input) ----------------------------------------

_CYC_SQL = f"""(SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_type FROM {SIGNALS_SQL})"""


@register("vehicle_scan", sql=f"""
SELECT 'battery=' || CAST(user_id AS VARCHAR) AS battery_id, CAST(count(*) AS BIGINT) AS n_rows,
       {_r('sum(value)')} AS c0_sum, {_r('sum(reading)')} AS c6_sum,
       {_r("sum(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END)")} AS c14_sum
FROM {_CYC_SQL} WHERE first_type <> 'error' GROUP BY user_id""")
def q_vehicle_scan(spark, sf_dir):
    root = fixtures.cycle_tree(spark, sf_dir)
    good, _ = cycle_csv.usable_cycles(spark, root, id_from="dir", recursive=True)
    out = good.groupBy("battery_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c0").alias("c0_sum"),
                                         F.sum("c6").alias("c6_sum"), F.sum("c14").alias("c14_sum"))
    return rounded(out, ["c0_sum", "c6_sum", "c14_sum"])


@register("vehicle_rejects", sql=f"""
SELECT DISTINCT 'battery=' || CAST(user_id AS VARCHAR) AS battery_id, 'too_few_columns' AS reason, 'error' AS severity
FROM {_CYC_SQL} WHERE first_type = 'error'
UNION ALL SELECT DISTINCT 'battery=odd-' || CAST(user_id AS VARCHAR), CASE user_id % 5 {' '.join(f"WHEN {k} THEN '{v[0]}'" for k, v in fixtures.ODD_CYCLES.items())} END, 'error'
FROM events""")
def q_vehicle_rejects(spark, sf_dir):
    root = fixtures.cycle_tree(spark, sf_dir)
    _, rej = cycle_csv.usable_cycles(spark, root, id_from="dir", recursive=True)
    return rej.select(F.regexp_extract("path", r"/(battery=[^/]+)/", 1).alias("battery_id"), "reason", "severity")


@register("session_features_stream", sql=FEATURES_SQL + f"\nSELECT {', '.join(FEATURE_COLS)} FROM features")
def q_session_features_stream(spark, sf_dir):
    """The same features computed incrementally: file-source stream over the tree, availableNow."""
    from ampfold.session import scratch_path
    from ampfold.streaming.sessions import read_features, start_session_features

    out = scratch_path(spark, "stream-features")
    q = start_session_features(spark, fixtures.session_tree(spark, sf_dir), out, max_files_per_trigger=2000)
    q.awaitTermination()
    f = read_features(spark, out).withColumn("session", SESSION_OF()).withColumn("session_time",
                                                                                  report_datetime("session_ts"))
    f = ses.valid_sessions(f)
    dbl = [c for c in ses.FEATURES if c not in ses.LONG_FEATURES]
    return rounded(f.select(*FEATURE_COLS), dbl)


@register("feature_store", sql=FEATURES_SQL + f"\nSELECT {', '.join(FEATURE_COLS)} FROM features")
def q_feature_store(spark, sf_dir):
    """The same features from a store that first knew a part of the files and then all of them."""
    from ampfold.plans.feature_store import FeatureStore
    from ampfold.session import scratch_path

    root, path = fixtures.session_tree(spark, sf_dir), scratch_path(spark, "feature-store")
    FeatureStore(spark, root, path, glob="part-0000[0-3]*.csv").refresh()
    store = FeatureStore(spark, root, path)
    store.refresh()
    f = ses.valid_sessions(store.features()).withColumn("session", SESSION_OF()).withColumn("session_time", report_datetime("session_ts"))
    return rounded(f.select(*FEATURE_COLS), [c for c in ses.FEATURES if c not in ses.LONG_FEATURES])


@register("feature_csv_roundtrip", sql=FEATURES_SQL + f"""
SELECT vehicle, CAST(row_number() OVER (PARTITION BY vehicle ORDER BY st, session) - 1 AS BIGINT) AS position,
       {ses.F_V_MEAN}, {ses.F_C_UNIQUE}, {ses.F_Q_AREA}
FROM features""")
def q_feature_csv_roundtrip(spark, sf_dir):
    """Write the features as one time-ordered CSV tree per vehicle (keys dropped), read back by file order."""
    from ampfold.plans.ordered import dense_positions
    from ampfold.session import scratch_path
    from ampfold.sinks.writers import write_feature_csv
    from ampfold.sources.session_csv import read_feature_csv

    out = scratch_path(spark, "feature-csv")
    write_feature_csv(_features(spark, sf_dir), out, ses.FEATURES)
    rows = read_feature_csv(spark, out, ses.FEATURES)
    back = rows.select("vehicle", "_f", "_bs", "_mid", F.col(ses.F_V_MEAN).try_cast("double").alias(ses.F_V_MEAN),
                       F.col(ses.F_C_UNIQUE).try_cast("long").alias(ses.F_C_UNIQUE), F.col(ses.F_Q_AREA).try_cast("double").alias(ses.F_Q_AREA))
    pos = dense_positions(back, "vehicle", ["_f", "_bs", "_mid"], name="position")
    return rounded(pos.select("vehicle", "position", ses.F_V_MEAN, ses.F_C_UNIQUE, ses.F_Q_AREA),
                   [ses.F_V_MEAN, ses.F_Q_AREA])
