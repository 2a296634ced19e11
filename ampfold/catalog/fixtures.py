"""CSV trees derived from the driver tables (written once per session under the shared scratch folder).

Session tree (``events``): vehicle = user, one session = the events of one type of that user,
session folder ``session=<first event time YYYYMMDD_HHMMSS>_<type>``. Telemetry columns:

    available_capacity        = hours since epoch (x)
    max_cell_voltage          = value (missing for error events)
    charge_current            = floor(value / 50)
    max_temperature           = props.k
    charging_duration_seconds = 7 * value
    interpolated_dqdv         = value - 100 (missing for error events)

Headers differ on purpose: ``click`` sessions are written with the columns reversed, ``view``
sessions without ``max_temperature``. ``error`` sessions therefore have no voltage or dQ/dV
readings at all (fewer than two pairs, all-missing dQ/dV).

Every user has one more session file, of the kind ``user_id % 8``, as a tree in the field has them: without data
rows (0; with a header of over 64 KiB: 7), with a row of more cells than the header (1), with text among the
numbers (2), with a cell over two lines (3), with text in the capacities and no dQ/dV (4), with a Latin-1 cell (5),
with a cell over two lines and a row of more cells than the header (6).

Cycle tree (``events``): one file per user (battery), rows in time order, 15 numeric columns
plus a text column at the end, which runs over two lines in the files of every eighth user; users whose first event
is an error get a 14-column file. Every user has one more file that cannot be used, of the kind ``user_id % 5`` of
``ODD_CYCLES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.catalog.tables import signals
from ampfold.operators.sessions import SessionTree
from ampfold.session import scratch_path
from ampfold.sinks.writers import local_folder, write_lines, write_session_tree
from ampfold.sources.session_csv import (CAPACITY, CURRENT, DQDV, DURATION, SESSION_COLUMNS, TEMPERATURE,
                                         VOLTAGE)

_CACHE: dict[tuple, str] = {}
_OPEN: dict[tuple, SessionTree] = {}


def _key(spark: SparkSession, sf_dir: str, kind: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    starts = s.groupBy("user_id", "event_type").agg(F.min("ts").alias("_start"))
    rows = s.join(starts, ["user_id", "event_type"])
    return rows.select(
        F.col("user_id").alias("vehicle"),
        F.concat(F.date_format("_start", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_type")).alias("session"),
        "event_type", "ts", "event_id",
        F.col("hours").alias(CAPACITY),
        F.col("reading").alias(VOLTAGE),
        F.col("level").alias(CURRENT),
        F.col("prop_k").alias(TEMPERATURE),
        (F.col("value") * F.lit(7.0)).alias(DURATION),
        (F.col("reading") - F.lit(100.0)).alias(DQDV),
    )


def _header(columns) -> str:
    return ",".join(columns)


_NO_DQDV = [c for c in SESSION_COLUMNS if c != DQDV]
#: The lines of each kind of odd session file; the columns are in the order of SESSION_COLUMNS.
ODD_FILES = {
    0: ("header", [_header(SESSION_COLUMNS)]),
    1: ("ragged", [_header(SESSION_COLUMNS), "1,10,5,20,7,1", "2,30,5,21,7,3,99"]),
    2: ("text", [_header(SESSION_COLUMNS), "1,10,abc,20,7,1", "2,30,5,21,7,3"]),
    3: ("lines", [_header([*SESSION_COLUMNS, "note"]), '1,10,5,20,7,1,"two', 'lines"', "2,30,5,21,7,3,one"]),
    4: ("capacity", [_header(_NO_DQDV), "x,10,5,20,7", "2,30,5,20,7"]),
    5: ("latin", [_header([*SESSION_COLUMNS, "note"]), "1,10,5,20,7,1,caf\u00e9", "2,30,5,21,7,3,b"]),
    6: ("folded_ragged", [_header([*SESSION_COLUMNS, "note"]), '1,10,5,20,7,1,"two', 'lines"', "2,30,5,21,7,3,one,99"]),
    7: ("wide", [_header([*SESSION_COLUMNS, "x" * 70_000])]),
}


def write_odd_sessions(spark: SparkSession, sf_dir: str, root: str) -> None:
    users = signals(spark, sf_dir).select(F.col("user_id").alias("vehicle")).distinct()
    local = local_folder(spark, root)
    if local is not None:
        lines = _odd_lines(users, "vehicle", {k: [_encoded(name, x) for x in lines] for k, (name, lines) in ODD_FILES.items()})
        names = F.create_map(*[F.lit(x) for k, (name, _) in ODD_FILES.items() for x in (k, f"20200101_00000{k}_{name}")])
        write_lines(lines.withColumn("session", names[F.col("_kind")]), local, "vehicle", "session", ["_n"])
        return
    users = users.repartition("vehicle")
    for kind, (name, lines) in ODD_FILES.items():
        rows = users.where(F.pmod("vehicle", F.lit(8)) == kind)
        rows = rows.withColumn("session", F.lit(f"20200101_00000{kind}_{name}"))
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, lines))).alias("_n", "line")).sortWithinPartitions("vehicle", "_n").drop("_n")
        (rows.write.mode("append").partitionBy("vehicle", "session").option("sep", "\u0001").option("quote", "\u0000")
         .option("encoding", "ISO-8859-1" if name == "latin" else "UTF-8").csv(root))


def _encoded(name: str, line: str) -> bytes:
    return line.encode("latin-1" if name == "latin" else "utf-8")


def _odd_lines(users: DataFrame, user: str, kinds: dict[int, list[bytes]]) -> DataFrame:
    """The lines of each user's odd file, of the kind of the user's number: ``_kind, _n, _line``."""
    rows = users.where(F.col(user).isNotNull()).withColumn("_kind", F.pmod(user, F.lit(len(kinds))).cast("int"))
    lines = F.create_map(*[x for k, own in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, own)))])
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size(lines[F.col("_kind")]) - 1)).alias("_n"))
    return rows.withColumn("_line", F.get(lines[F.col("_kind")], F.col("_n")))


def open_sessions(spark: SparkSession, sf_dir: str, read: bool = True) -> SessionTree:
    """The session tree, read and staged once per application (``read``: now, else when a query asks for content)."""
    key = _key(spark, sf_dir, "open")
    if key not in _OPEN:
        _OPEN[key] = SessionTree(spark, session_tree(spark, sf_dir), lazy=True)
    return _OPEN[key].read() if read else _OPEN[key]


def session_tree(spark: SparkSession, sf_dir: str) -> str:
    key = _key(spark, sf_dir, "sessions")
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "sessions")
    rows = session_rows(spark, sf_dir)
    order = ["ts", "event_id"]
    kind = F.col("event_type")
    normal = [c for c in SESSION_COLUMNS]
    write_session_tree(rows.where(kind == "click"), root, "vehicle", "session", order, list(reversed(normal)))
    write_session_tree(rows.where(kind == "view"), root, "vehicle", "session", order,
                       [c for c in normal if c != TEMPERATURE])
    write_session_tree(rows.where(~kind.isin("click", "view")), root, "vehicle", "session", order, normal)
    write_odd_sessions(spark, sf_dir, root)
    _CACHE[key] = root
    return root


# Positional cycle files -------------------------------------------------------------------

CYCLE_COLS = [f"c{i}" for i in range(15)]


def cycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    kinds = ["click", "error", "purchase", "signup", "view"]
    feats = [
        F.col("value"),
        F.log1p(F.col("value")),
        F.col("prop_k"),
        F.hour("ts").cast("double"),
        F.minute("ts").cast("double"),
        F.col("level"),
        F.col("reading"),
        F.col("value") / F.lit(97.0),
        F.sqrt(F.col("value")),
        F.dayofmonth("ts").cast("double"),
        *[(F.col("event_type") == F.lit(k)).cast("double") for k in kinds],
    ]
    return s.select(F.col("user_id").alias("battery"), "ts", "event_id", "event_type",
                    *[f.alias(c) for f, c in zip(feats, CYCLE_COLS)])


_CYCLE_HEADER, _CYCLE_ROW = _header([*CYCLE_COLS, "note"]), ",".join(["1"] * 15)
#: The lines of each kind of cycle file that cannot be used, by its reason.
ODD_CYCLES = {
    0: ("empty", [_CYCLE_HEADER]),
    1: ("ragged", [_CYCLE_HEADER, _CYCLE_ROW + ',"two', 'lines"', _CYCLE_ROW + ",one,99"]),
    2: ("non_numeric", [_CYCLE_HEADER, "abc" + _CYCLE_ROW[1:] + ",one"]),
    3: ("unclosed", [_CYCLE_HEADER, _CYCLE_ROW + ',"one', _CYCLE_ROW + ",two"]),
    4: ("too_few_columns", [_header(CYCLE_COLS[:3]), "1,2,3"]),
}


def write_odd_cycles(spark: SparkSession, sf_dir: str, root: str) -> None:
    users = signals(spark, sf_dir).select("user_id").distinct()
    local = local_folder(spark, root)
    if local is not None:
        lines = _odd_lines(users, "user_id", {k: [x.encode() for x in lines] for k, (_, lines) in ODD_CYCLES.items()})
        lines = lines.withColumns({"battery": F.concat(F.lit("odd-"), F.col("user_id").cast("string")), "run": F.lit("all")})
        write_lines(lines, local, "battery", "run", ["_n"])
        return
    users = users.repartition("user_id")
    for kind, (_, lines) in ODD_CYCLES.items():
        rows = users.where(F.pmod("user_id", F.lit(len(ODD_CYCLES))) == kind)
        rows = rows.select(F.concat(F.lit("odd-"), F.col("user_id").cast("string")).alias("battery"), F.lit("all").alias("run"),
                           F.posexplode(F.array(*map(F.lit, lines))).alias("_n", "line")).sortWithinPartitions("battery", "_n").drop("_n")
        rows.write.mode("append").partitionBy("battery", "run").option("sep", "\u0001").option("quote", "\u0000").csv(root)


def cycle_tree(spark: SparkSession, sf_dir: str) -> str:
    """``<root>/battery=<user>/run=all/part-*.csv``; users whose first event is an error get 14 columns."""
    key = _key(spark, sf_dir, "cycles")
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "cycles")
    folded = F.when(F.pmod("battery", F.lit(8)) == 3, "evt\n, ").otherwise("evt-")
    rows = cycle_rows(spark, sf_dir).withColumn("note", F.concat(folded, F.col("event_id").cast("string")))
    first = rows.groupBy("battery").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("_first"))
    rows = rows.join(first, "battery")
    order = ["ts", "event_id"]
    narrow = rows.where(F.col("_first") == "error")
    wide = rows.where(F.col("_first") != "error")
    write_session_tree(wide.withColumn("run", F.lit("all")), root, "battery", "run", order, [*CYCLE_COLS, "note"])
    write_session_tree(narrow.withColumn("run", F.lit("all")), root, "battery", "run", order, CYCLE_COLS[:14])
    write_odd_cycles(spark, sf_dir, root)
    _CACHE[key] = root
    return root
