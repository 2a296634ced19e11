"""One table of CSV files with different columns: a union by name, typed as a union of data frames would be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.functions.cleaning import safe_double
from ampfold.plans.staging import all_but, stage, stage_readable
from ampfold.sources import session_csv
from ampfold.sources.archives import damaged_archives
from ampfold.sources.session_csv import NA_TOKENS, ORDER

_INTEGER = "^[+-]?[0-9]{1,18}$"


def union_of_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """``file, _bs, _mid`` (the row's place) and all columns of all files, in the order in which they first appear when
    the files are read in the order of their paths.

    A cell that is missing, or whose file lacks the column, is null. A column of integers is ``bigint`` if no row lacks
    a value, else ``double`` as other numbers are; one with any text is ``string``, one without a value ``double``. Of
    columns with one name in a file the first counts; columns without a name, ragged files, files with a quoted cell that
    never ends and unreadable ones are left out. However many headers there are, the files are read by one scan (after that of the
    profile), with one expression for each column; the driver holds the column names alone.
    """
    listing = session_csv.file_tree(spark, root, glob)
    damaged = damaged_archives(spark, root, glob, listing=listing)
    profile, unread = stage_readable(lambda only: session_csv.file_profile(spark, root, glob, only=only, listing=listing), listing, "union-profile", left_out=damaged)
    if profile.isEmpty():
        raise ValueError(f"no readable file below {root}")
    lines, more = stage_readable(lambda only: session_csv.text_lines(spark, root, glob, only, listing=listing), listing, "union-lines", left_out=[*damaged, *unread])
    made = session_csv.odd_records(lines, profile.where(all_but(more, "file")).select("file", "multiline", "charset"))
    files = stage(session_csv.odd_profile(made).where(F.col("max_cells") <= F.col("n_cols")), "union-files")

    names = files.select("file", F.posexplode("columns").alias("_at", "_name")).where("_name <> ''").groupBy("_name")
    first = names.agg(F.min(F.struct("file", "_at")).alias("_first")).orderBy("_first")
    columns = [r["_name"] for r in first.collect()]
    if not columns:
        return files.limit(0).select("file", *[F.lit(0).cast("long").alias(c) for c in ORDER])

    def cell(name: str) -> Column:
        value = F.get("cells", (F.array_position("columns", name) - 1).cast("int"))
        return F.when(~F.trim(value).isin(*NA_TOKENS), value)

    rows = made.where(~F.col("header")).join(files.select("file", "columns"), "file")
    texts = stage(rows.select("file", *ORDER, *[cell(c).alias(f"_c{i}") for i, c in enumerate(columns)]), "union-rows")

    seen = [F.struct(F.count(c).alias("n"), F.count_if(F.trim(c).rlike(_INTEGER)).alias("whole"),
                     F.count_if(safe_double(c).isNotNull()).alias("numbers")).alias(c) for c in texts.columns[3:]]
    counts = texts.agg(F.count(F.lit(1)).alias("rows"), *seen).first()

    def typed(i: int, name: str) -> Column:
        c, n = f"_c{i}", counts[f"_c{i}"]
        if n["whole"] == n["n"] == counts["rows"] and n["n"]:
            return F.trim(c).cast("long").alias(name)
        return (safe_double(c) if n["numbers"] == n["n"] else F.col(c)).alias(name)

    return texts.select("file", *ORDER, *[typed(i, c) for i, c in enumerate(columns)])
