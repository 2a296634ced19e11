"""CSV records of files that a line-by-line CSV source cannot take: cells over line ends, text in other charsets.

A file stays splittable though a quoted cell may run over line ends. What a line does to the state *inside a quoted
cell or not* is a function on two values; such functions compose, so a split's lines give one function, the splits'
functions in file order give the state at each split's start (one small row a split), and from there every line knows
whether it begins a record. Only then are the lines of a record joined. No file is read by a single task.

Quotes count as in the pandas convention: they open a cell at its start alone, are doubled inside it, and are text
elsewhere. A file whose last quoted cell is never closed has no records; :func:`unclosed` names it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ampfold.plans.staging import FILE_PATH, file_hash

FILE = "file"
#: Classes of paths by hash; scans of some files are cut to the classes of these (as many numbers at most in a condition).
CLASSES = 4096

# A quoted cell at the start of a line or after a comma; an opened one; a cell of a record that has a comma before it.
_QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
_OPENED = r'(^|,)"'
_CELL = r'(?s),("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_QUOTES = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'


def file_class(path: str | Column = FILE_PATH) -> Column:
    return F.pmod(file_hash(path), F.lit(CLASSES)).cast("int")


def classes_of(files: DataFrame) -> list[int]:
    """The classes of the paths of a table: at most ``CLASSES`` numbers, however many files it has."""
    return sorted(r["c"] for r in files.select(file_class(FILE).alias("c")).distinct().collect())


def of_files(rows: DataFrame, files: DataFrame, classes: list[int], key: str = FILE) -> DataFrame:
    """The rows of the files of a table, whose ``classes`` are known."""
    return rows.where(file_class(key).isin(classes)).join(files.select(F.col(FILE).alias(key)), key, "left_semi")


def without_files(rows: DataFrame, files: DataFrame, classes: list[int], key: str = FILE) -> DataFrame:
    """The rows of all other files; only those in the same classes are compared with the table."""
    if not classes:
        return rows
    near = rows.where(file_class(key).isin(classes)).join(files.select(F.col(FILE).alias(key)), key, "left_anti")
    return rows.where(~file_class(key).isin(classes)).unionByName(near.select(*rows.columns))


def _ends_open(line: Column) -> Column:
    return F.regexp_replace(line, _QUOTED, "$1x").rlike(_OPENED)


def _effects(lines: DataFrame) -> DataFrame:
    """Per line what the lines before it in its split do to the state: ``_odd`` (how often it is turned over) and
    ``_set`` (the state that a line has fixed, as it was before the turns, or null); and the same with the line: ``_odd_after``, ``_set_after``."""
    quoted = F.contains("value", F.lit('"'))
    outside = F.when(quoted, _ends_open(F.col("value"))).otherwise(False)
    inside = F.when(quoted, _ends_open(F.concat(F.lit('"'), F.col("value")))).otherwise(True)
    rows = lines.withColumns({"_from_out": outside, "_from_in": inside})
    turns = (F.col("_from_out") & ~F.col("_from_in")).cast("int")
    fixes = F.when(F.col("_from_out") == F.col("_from_in"), F.col("_from_out").cast("int"))
    order = Window.partitionBy(FILE, "_bs").orderBy("_mid")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_turns": turns, "_odd": F.coalesce(F.sum(turns).over(before), F.lit(0))})
    rows = rows.withColumn("_fix", F.pmod(fixes + F.col("_odd"), F.lit(2)))
    return rows.withColumns({
        "_set": F.last("_fix", ignorenulls=True).over(before), "_set_after": F.last("_fix", ignorenulls=True).over(upto),
        "_odd_after": F.col("_odd") + F.col("_turns"),
    })


def _split_states(effects: DataFrame) -> DataFrame:
    """``file, _bs, _begin, _end``: the state at each split's start and end (one row a split)."""
    per = effects.groupBy(FILE, "_bs").agg(F.max_by("_set_after", "_mid").alias("_set"), F.max_by("_odd_after", "_mid").alias("_odd"))
    before = Window.partitionBy(FILE).orderBy("_bs").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_turned", F.coalesce(F.sum("_odd").over(before), F.lit(0)))
    per = per.withColumn("_key", F.pmod(F.col("_set") + F.col("_turned"), F.lit(2)))
    begin = F.pmod(F.coalesce(F.last("_key", ignorenulls=True).over(before), F.lit(0)) + F.col("_turned"), F.lit(2))
    per = per.withColumn("_begin", begin)
    return per.select(FILE, "_bs", "_begin", F.pmod(F.coalesce("_set", "_begin") + F.col("_odd"), F.lit(2)).alias("_end"))


def unclosed(lines: DataFrame) -> DataFrame:
    """The files (``file``) whose last quoted cell is never closed."""
    last = _split_states(_effects(lines)).groupBy(FILE).agg(F.max_by("_end", "_bs").alias("_end"))
    return last.where("_end = 1").select(FILE)


def joined_records(lines: DataFrame) -> DataFrame:
    """``file, _bs, _mid, value``: the records of lines ``file, _bs, _mid, value`` (split offset, ascending number in the
    split), at the place of their first line, with line feeds for the line ends inside cells. Blank lines between
    records are left out. ``lines`` should be a written table, since it is read more than once."""
    rows = _effects(lines)
    states = _split_states(rows)
    bad = states.groupBy(FILE).agg(F.max_by("_end", "_bs").alias("_end")).where("_end = 1").select(FILE)
    rows = rows.join(states.select(FILE, "_bs", "_begin"), [FILE, "_bs"]).join(bad, FILE, "left_anti")
    begins = F.pmod(F.coalesce("_set", "_begin") + F.col("_odd"), F.lit(2)) == 0
    rows = rows.withColumn("_start", F.when(begins, F.col("_mid")))
    splits = rows.groupBy(FILE, "_bs").agg(F.max("_start").alias("_start"))
    before = Window.partitionBy(FILE).orderBy("_bs").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_start").isNotNull(), F.struct(F.col("_bs").alias("bs"), F.col("_start").alias("mid")))
    carried = splits.select(FILE, "_bs", F.last(place, ignorenulls=True).over(before).alias("_carried"))
    rows = rows.join(carried, [FILE, "_bs"])
    upto = Window.partitionBy(FILE, "_bs").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("_start", ignorenulls=True).over(upto)
    rows = rows.withColumn("_own", own).withColumn(
        "_at", F.when(F.col("_own").isNotNull(), F.struct(F.col("_bs").alias("bs"), F.col("_own").alias("mid"))).otherwise(F.col("_carried")))
    parts = F.array_sort(F.collect_list(F.struct("_bs", "_mid", "value")))
    made = rows.groupBy(FILE, "_at").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return made.where(F.trim("value") != "").select(FILE, F.col("_at.bs").alias("_bs"), F.col("_at.mid").alias("_mid"), "value")


def cells(record: Column) -> Column:
    """The cells of a record, without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))

    def bare(cell: Column) -> Column:  # what follows the closing quote is taken as it is
        inside = F.replace(F.regexp_extract(cell, _QUOTES, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(inside, F.regexp_extract(cell, _QUOTES, 2))).otherwise(cell)

    plain = F.transform(found, bare)
    return F.when(F.contains(record, F.lit('"')), plain).otherwise(F.split(record, ",", -1))


@F.pandas_udf(StringType())
def _from_gbk(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decoded(value: Column, charset: Column) -> Column:
    """Text of bytes that a source took as they are. Bytes of GBK go through a Python worker, in batches; no others do."""
    raw = value.cast("binary")
    gbk = _from_gbk(F.when(charset == "GBK", raw))
    return F.when(charset == "GBK", gbk).when(charset == "ISO-8859-1", F.decode(raw, "ISO-8859-1")).otherwise(value)
