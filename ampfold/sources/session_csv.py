"""Session CSV tree reader: ``<root>/<group>/**/<...YYYYMMDD_HHMMSS...>.csv``, one file = one session.

Headers differ between files (order, missing columns), so values are matched **by name**:
the CSV source returns each record as one VARIANT (``singleVariantColumn``) and every wanted
column is pulled out with ``try_variant_get``. An empty cell is a variant null, an absent
column is a SQL null, so the same scan also tells which columns a file has.

Row order inside a file is ``(_bs, _mid)`` = (split start offset, monotonically increasing id
taken in the scan projection, before any shuffle). Files stay splittable; the split is also a
natural contiguous chunk for the ordered operators (no range shuffle needed).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.functions.cleaning import nan_to_null, safe_double
from ampfold.functions.paths import group_dir, group_dir_of, path_datetime, root_prefix
from ampfold.session import load_files, load_listed
from ampfold.sources import records
from ampfold.sources.listing import by_driver, contents, file_tree, source_of

# The telemetry columns a session file may carry.
CAPACITY = "available_capacity"
VOLTAGE = "max_cell_voltage"
CURRENT = "charge_current"
TEMPERATURE = "max_temperature"
DURATION = "charging_duration_seconds"
DQDV = "interpolated_dqdv"
SESSION_COLUMNS = [CAPACITY, VOLTAGE, CURRENT, TEMPERATURE, DURATION, DQDV]

# Cell texts that a CSV reader in the pandas convention treats as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ORDER = ["_bs", "_mid"]

#: Files up to this size (and named ``.csv``, so that no source unpacks them) are taken whole by the binary source, which
#: opens a file in a tenth of the time that the line and CSV sources need; larger ones are split.
SMALL_BYTES = 1 << 20
#: Header cells up to which a small file's rows are told apart by a plain split.
MOST_NAMES = 1000


def _json_path(col: str) -> str:
    return "$['" + col.replace("\\", "\\\\").replace("'", "\\'") + "']"


def raw_cell(col: str, v: str = "_v") -> Column:
    return F.expr(f"try_variant_get({v}, \"{_json_path(col)}\", 'string')")


def number_cell(col: str, v: str = "_v") -> Column:
    """The cell as DOUBLE: numbers, ``inf``/``-inf``/``Infinity`` (any case); NaN and missing tokens -> null."""
    return nan_to_null(F.expr(f"try_variant_get({v}, \"{_json_path(col)}\", 'double')"))


def has_column(col: str, v: str = "_v") -> Column:
    return F.expr(f"variant_get({v}, \"{_json_path(col)}\") IS NOT NULL")


def non_numeric(raw: Column) -> Column:
    """A present cell that is neither a number nor a missing-value token."""
    t = F.trim(raw)
    text = raw.isNotNull() & ~t.isin(*NA_TOKENS) & safe_double(raw).isNull() & ~F.lower(t).isin("nan", "-nan", "+nan")
    return F.when(raw.try_cast("double").isNotNull(), False).otherwise(text)  # most cells are numbers


def csv_tree(spark: SparkSession, root: str | Sequence[str], glob: str = "*.csv", encoding: str = "UTF-8",
             multiline: bool = False, only: Column | None = None, literal: bool = False) -> DataFrame:
    """Every record of the files (below a folder, or listed; ``literal``: paths that are no patterns) as one variant; ``only``: of those that meet a condition
    on ``_metadata.file_path``. A read error fails the task: no file is taken in part (see
    :func:`ampfold.plans.staging.stage_readable`).
    ``multiline``: cells may hold line ends (files are then not split)."""
    reader = (
        spark.read.format("csv")
        .option("header", True)
        .option("singleVariantColumn", "_v")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("multiLine", multiline)
        .option("inputBufferSize", 1 << 16)  # a parser's own 2 MB, for each file, take longer to make than a small file to read
        .option("ignoreCorruptFiles", False)
    )
    load = load_files if isinstance(root, str) or not literal else load_listed
    return only_files(load(reader, spark, root), only)


def only_files(raw: DataFrame, only: Column | None) -> DataFrame:
    """A file scan of the files that meet a condition on their path; the others are not opened."""
    return raw if only is None else raw.where(only)


def read_sessions(spark: SparkSession, root: str, columns: Sequence[str] = SESSION_COLUMNS,
                  glob: str = "*.csv", encoding: str = "UTF-8", path_columns: bool = False,
                  files: Sequence[str] | None = None, multiline: bool = False, only: Column | None = None, literal: bool = False) -> DataFrame:
    """Rows of all session files below ``root`` (or of the listed ``files`` of that tree), ``only`` as in :func:`csv_tree`.

    Columns: ``session_file, _root, _bs, _mid, <col> DOUBLE..., _has_<col>, _bad_<col>``; with
    ``path_columns`` also ``vehicle`` and ``session_ts`` per row. Path-derived values are
    per-file constants, so :func:`ampfold.operators.sessions.session_features` derives them once
    per session instead of once per row. The per-cell work is one variant lookup as DOUBLE; the
    text check runs only for cells that did not convert.
    """
    source = list(files) if files is not None else root
    return parse_session_rows(csv_tree(spark, source, glob, encoding, multiline, only, literal), root, columns, path_columns)


def parse_session_rows(raw: DataFrame, root: str, columns: Sequence[str] = SESSION_COLUMNS,
                       path_columns: bool = False) -> DataFrame:
    """Rows from a variant CSV frame that carries ``_metadata`` (hidden in a batch scan, an explicit
    column in a streaming micro-batch); shared by the batch and the streaming reader."""
    v = {c: number_cell(c) for c in columns}
    out = raw.select(
        F.col("_metadata.file_path").alias("session_file"),
        F.lit(root_prefix(root)).alias("_root"),
        F.col("_metadata.file_block_start").alias("_bs"),
        F.monotonically_increasing_id().alias("_mid"),
        *[v[c].alias(c) for c in columns],
        *[has_column(c).alias(f"_has_{c}") for c in columns],
        *[F.when(v[c].isNull(), non_numeric(raw_cell(c))).otherwise(F.lit(False)).alias(f"_bad_{c}") for c in columns],
    )
    return with_path_columns(out) if path_columns else out


def with_path_columns(rows: DataFrame) -> DataFrame:
    """Add ``vehicle`` (first folder below the root, '' for root files) and ``session_ts`` per row."""
    return rows.withColumn("vehicle", group_dir_of("session_file", "_root")).withColumn(
        "session_ts", path_datetime("session_file"))


def file_listing(spark: SparkSession, root: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """All matching files with size and modification time (metadata only, content not read); paths as the scans have them."""
    return _named(file_tree(spark, root, glob))


def _named(listing: DataFrame) -> DataFrame:
    return listing.select(F.col("_metadata.file_path").alias("file"), F.col("length"), F.col("modificationTime").alias("modified"))


def is_small(spark: SparkSession) -> Column:
    """Whether a listed file is taken whole (never one that Spark would split); a condition on its path and size, so the
    others are not opened."""
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return (F.col("_metadata.file_size") <= min(SMALL_BYTES, split)) & F.lower(F.col("_metadata.file_path")).endswith(".csv")


def _lines_of(content: Column) -> Column:
    """The lines of a file's bytes as the line source has them (:func:`_without_mark`)."""
    text, ends = content.cast("string"), "\r\n|\r|\n"
    as_text = F.when(F.contains(text, F.lit("\r")), F.split(text, ends, -1)).otherwise(F.split(text, "\n", -1))
    as_bytes = F.transform(F.split(F.decode(content, "ISO-8859-1"), ends, -1), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    lines = F.when(F.is_valid_utf8(text), as_text).otherwise(as_bytes)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def _without_mark(content: Column) -> Column:
    """Bytes without the mark of the byte order in UTF-8, which the line source leaves out."""
    return F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)


def small_files(listing: DataFrame, only: Column | None = None) -> DataFrame:
    """``file, length, content, lines`` of the small files of a listing (see :func:`file_tree`), a row each. A condition on
    ``lines`` is computed by Spark beside them, so all lines are split twice: explode them first."""
    found = contents(listing, is_small(listing.sparkSession) if only is None else is_small(listing.sparkSession) & only)
    found = found.select("file", "length", _without_mark(F.col("content")).alias("content"))
    return found.withColumn("lines", _lines_of(F.col("content")))


def has_large_files(listing: DataFrame) -> bool:
    """Whether a listing has files that are split (no file is opened if it has none)."""
    return not listing.where(~is_small(listing.sparkSession)).select("length").isEmpty()


def exploded_lines(files: DataFrame) -> DataFrame:
    """The ``lines`` of whole files as of :func:`text_lines`."""
    lines = files.select("file", F.explode_outer("lines").alias("value")).where("value IS NOT NULL")
    return lines.select("file", F.lit(0).cast("long").alias("_bs"), F.monotonically_increasing_id().alias("_mid"), "value")


def text_lines(spark: SparkSession, root: str | Sequence[str], glob: str = "*.csv", only: Column | None = None,
               recursive: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """``file, _bs, _mid, value``: the lines of all files (``only``: of those that meet a condition on their path) as
    bytes, with the offset of their split and an ascending number in it. A read error fails the task, as in :func:`csv_tree`.
    ``listing``: the same files as :func:`file_tree` has them; the small ones are then read faster."""
    if listing is not None:
        lines = exploded_lines(small_files(listing, only))
        if not has_large_files(listing):
            return lines
        large = ~is_small(spark) if only is None else only & ~is_small(spark)
        return lines.unionByName(large_lines(spark, root, glob, large, recursive, listing))
    reader = (
        spark.read.format("text")
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", False)
    )
    return _as_lines(only_files(load_files(reader, spark, root), only))


def _as_lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_bs"),
                      F.monotonically_increasing_id().alias("_mid"), F.col("value"))


def large_lines(spark: SparkSession, root: str | Sequence[str], glob: str, only: Column, recursive: bool, listing: DataFrame) -> DataFrame:
    """:func:`text_lines` of files that are split. Of a tree of many files the driver lists these alone."""
    if by_driver(listing):
        return text_lines(spark, root, glob, only, recursive)
    paths = source_of(listing, root, only)
    if not paths:
        return spark.createDataFrame([], "file string, _bs long, _mid long, value string")
    return _as_lines(only_files(load_listed(spark.read.format("text").option("ignoreCorruptFiles", False), spark, paths), only))


def header_names(header: Column) -> Column:
    return F.transform(F.split(header, ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))


#: Fixed value: the two-byte sequences of GBK, as the code points that ISO-8859-1 gives the bytes.
_GBK_PAIR = "[\\x81-\\xfe][\\x40-\\x7e\\x80-\\xfe]"


def _is_gbk(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return ~F.regexp_replace(F.decode(value.cast("binary"), "ISO-8859-1"), _GBK_PAIR, "").rlike("[\\x80-\\xff]")


def _charset(utf8: str, gbk: str) -> Column:
    return F.when(F.col(utf8), "UTF-8").when(F.col(gbk), "GBK").otherwise("ISO-8859-1")


def _unquoted(line: Column) -> Column:
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)


def _n_cells(unquoted: Column) -> Column:
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1


def _places(columns: Sequence[str]) -> Column:
    """The places of columns in a small file's header, from 0 (-1: absent)."""
    names = F.split(F.get("lines", F.lit(0)), ",", -1)
    return F.array(*[(F.array_position(names, c) - 1).cast("int") for c in columns])


def is_plain(columns: Sequence[str] = SESSION_COLUMNS) -> Column:
    """Whether a split at every comma gives the cells of a small file (:func:`small_files`) as the CSV source has them:
    UTF-8 without quotes, backslashes and control characters, under a header of different names, and without cells
    that it takes as truth values or times in the ``columns``."""
    text, names = F.col("content").cast("string"), F.split(F.lower(F.get("lines", F.lit(0))), ",", -1)
    named = (F.size(names) <= MOST_NAMES) & (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(names, lambda n: F.trim(n) == "")
    typed = "(?i):|true|false"

    def has_typed(line: Column) -> Column:
        cells = F.split(line, ",", -1)
        return line.rlike(typed) & F.exists(_places(columns), lambda i: F.coalesce(F.get(cells, i).rlike(typed), F.lit(False)))

    lower = F.lower(text)
    may_be = F.contains(text, F.lit(":")) | F.contains(lower, F.lit("true")) | F.contains(lower, F.lit("false"))
    untyped = F.when(may_be, ~F.exists("lines", has_typed)).otherwise(True)
    return F.coalesce(F.is_valid_utf8(text) & ~text.rlike(r'["\\\x00-\x08\x0b\x0c\x0e-\x1f]') & named & untyped, F.lit(False))


def _small_profile(files: DataFrame) -> DataFrame:
    """The profile of whole files, and their lines: a row each, so nothing is shuffled. What the whole text tells is not asked of its lines."""
    valid = lambda x: F.is_valid_utf8(x)
    whole, quoted = F.is_valid_utf8(F.col("content").cast("string")), F.contains(F.col("content").cast("string"), F.lit('"'))
    cells = lambda of: F.array_max(F.transform("lines", lambda x: _n_cells(of(x))))
    return files.where(F.length("content") > 0).select(
        "file", F.get("lines", F.lit(0)).alias("header"),
        F.size(F.filter("lines", lambda x: F.trim(x) != F.lit(""))).cast("long").alias("_lines"),
        F.when(quoted, cells(_unquoted)).otherwise(cells(lambda x: x)).alias("max_cells"),
        F.when(quoted, F.exists("lines", lambda x: F.contains(_unquoted(x), F.lit('"')))).otherwise(False).alias("multiline"),
        F.when(whole, True).otherwise(F.forall("lines", valid)).alias("_utf8"),
        F.when(whole, True).otherwise(F.forall("lines", lambda x: F.when(valid(x), True).otherwise(_is_gbk(x)))).alias("_gbk"),
        is_plain().alias("plain"), "lines")


def file_profile(spark: SparkSession, root: str, glob: str = "*.csv", files: Sequence[str] | None = None, only: Column | None = None,
                 listing: DataFrame | None = None, with_lines: bool = False) -> DataFrame:
    """Per file (``only``: those that meet a condition on their path): group, header column names, number of columns, number of data rows (blank lines skipped), the
    most cells of any line, whether a quoted cell runs over a line end, and the first of UTF-8, GBK and ISO-8859-1 in which all lines are valid.

    Read with the text source, so large files are split; the header is the first line of the split at offset 0,
    found with ``min_by`` on the scan-time row id (no window, no per-file task). Empty files yield no row. Only lines
    with quotes, or with bytes beyond ASCII that are no UTF-8, are looked into. A read error fails the task, as in :func:`csv_tree`.

    ``listing``: the same files as :func:`file_tree` has them; the small ones are then read whole, and ``plain`` tells
    which of those :func:`plain_rows` reads (of the others it is false). ``with_lines``: their ``lines``, too (of the others
    null), so that a written profile spares a second reading.
    """
    if listing is None:
        txt = text_lines(spark, root if files is None else files, glob, only)
    else:
        large = ~is_small(spark) if only is None else only & ~is_small(spark)
        txt = large_lines(spark, root if files is None else files, glob, large, True, listing) if has_large_files(listing) else None
    if txt is None:
        prof = _small_profile(small_files(listing, only))
    else:
        unquoted, utf8 = _unquoted(F.col("value")), F.expr("is_valid_utf8(value)")
        prof = txt.groupBy("file").agg(
            F.min_by(F.when(F.col("_bs") == 0, F.col("value")), F.when(F.col("_bs") == 0, F.col("_mid"))).alias("header"),
            F.count_if(F.trim(F.col("value")) != F.lit("")).alias("_lines"),
            F.max(_n_cells(unquoted)).alias("max_cells"),
            F.bool_or(F.contains(unquoted, F.lit('"'))).alias("multiline"),
            F.bool_and(utf8).alias("_utf8"), F.bool_and(F.when(utf8, True).otherwise(_is_gbk("value"))).alias("_gbk"),
        ).withColumns({"plain": F.lit(False), "lines": F.lit(None).cast("array<string>")})
        if listing is not None:
            prof = prof.unionByName(_small_profile(small_files(listing, only)))
    prof = prof.withColumn("charset", _charset("_utf8", "_gbk"))
    cols = header_names(F.when(F.col("charset") == "ISO-8859-1", F.decode(F.col("header").cast("binary"), "ISO-8859-1")).otherwise(F.col("header")))
    return prof.select(
        group_dir("file", root).alias("vehicle"),
        "file",
        cols.alias("columns"),
        F.size(cols).alias("n_cols"),
        (F.col("_lines") - F.lit(1)).cast("long").alias("n_rows"),
        F.col("max_cells").cast("int").alias("max_cells"),
        "multiline",
        "charset",
        *(["plain"] if listing is not None else []), *(["lines"] if with_lines else []),
    )


def plain_rows(listing: DataFrame, root: str, columns: Sequence[str] = SESSION_COLUMNS, only: Column | None = None) -> DataFrame:
    """Rows as of :func:`read_sessions`, of the small files that are plain (:func:`is_plain`) alone."""
    return rows_of_lines(small_files(listing, only), root, columns, is_plain(columns))


def rows_of_lines(files: DataFrame, root: str, columns: Sequence[str] = SESSION_COLUMNS, plain: str | Column = "plain") -> DataFrame:
    """Rows as of :func:`read_sessions`, of the ``lines`` of whole files that are ``plain`` (:func:`is_plain`)."""
    data = F.when(F.col(plain) if isinstance(plain, str) else plain, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))
    rows = files.select("file", _places(columns).alias("_at"), F.explode_outer(data).alias("_line")).where(F.col("_line").rlike(r"[^\x00-\x20]"))
    rows = rows.select("file", "_at", F.split("_line", ",", -1).alias("_cells"))
    raw = {c: F.when(F.get("_cells", F.col("_at")[i]) != "", F.get("_cells", F.col("_at")[i])) for i, c in enumerate(columns)}
    v = {c: nan_to_null(raw[c].try_cast("double")) + F.lit(0.0) for c in columns}  # no zero below zero, as the source's own numbers
    return rows.select(
        F.col("file").alias("session_file"), F.lit(root_prefix(root)).alias("_root"), F.lit(0).cast("long").alias("_bs"),
        F.monotonically_increasing_id().alias("_mid"),
        *[v[c].alias(c) for c in columns],
        *[F.get("_cells", F.col("_at")[i]).isNotNull().alias(f"_has_{c}") for i, c in enumerate(columns)],
        *[F.when(v[c].isNull(), non_numeric(raw[c])).otherwise(F.lit(False)).alias(f"_bad_{c}") for c in columns],
    )


def odd_records(lines: DataFrame, odd: DataFrame) -> DataFrame:
    """``file, _bs, _mid, cells, header``: all records of the lines of the ``odd`` files (``file, multiline, charset``), which a
    source of lines in UTF-8 cannot read, in their own charset; ``header`` marks each file's first one."""
    whole = records.joined_records(records.of_files(lines, odd.where("multiline"), records.classes_of(odd.where("multiline"))))
    plain = lines.where(F.trim("value") != "").join(odd.where(~F.col("multiline")).select("file"), "file", "left_semi")
    made = whole.unionByName(plain.select(*whole.columns)).join(odd.select("file", "charset"), "file")
    made = made.withColumn("cells", records.cells(records.decoded(F.col("value"), F.col("charset")))).select("file", *ORDER, "cells")
    first = made.groupBy("file").agg(F.min(F.struct(*ORDER)).alias("_first"))
    return made.join(first, "file").select("file", *ORDER, "cells", (F.struct(*ORDER) == F.col("_first")).alias("header"))


def odd_profile(made: DataFrame) -> DataFrame:
    """``file, columns, n_cols, n_records, max_cells`` of the files of :func:`odd_records` (those without records have no row)."""
    names = F.transform(F.max(F.when(F.col("header"), F.col("cells"))), lambda c: F.trim(c))
    per = made.groupBy("file").agg(names.alias("columns"), (F.count(F.lit(1)) - 1).alias("n_records"), F.max(F.size("cells")).alias("max_cells"))
    return per.select("file", "columns", F.size("columns").alias("n_cols"), "n_records", "max_cells")


def odd_rows(made: DataFrame, profile: DataFrame, root: str, columns: Sequence[str] = SESSION_COLUMNS) -> DataFrame:
    """Rows as of :func:`read_sessions`, of the records of :func:`odd_records`; cells are found by the file's own header."""
    rows = made.where(~F.col("header")).join(profile.select("file", "columns"), "file")
    raw = {c: F.get("cells", (F.array_position("columns", c) - 1).cast("int")) for c in columns}  # an absent column: null
    v = {c: safe_double(raw[c]) for c in columns}
    return rows.select(
        F.col("file").alias("session_file"), F.lit(root_prefix(root)).alias("_root"), *ORDER,
        *[v[c].alias(c) for c in columns],
        *[F.array_contains("columns", c).alias(f"_has_{c}") for c in columns],
        *[F.when(v[c].isNull(), F.coalesce(non_numeric(raw[c]), F.lit(False))).otherwise(F.lit(False)).alias(f"_bad_{c}") for c in columns],
    )


def session_headers(profile: DataFrame, root: str) -> DataFrame:
    """``session_file, _root, columns, n_rows`` of every profiled file: how files without data rows, of any size,
    are still reported (they give no row in the CSV scan)."""
    return profile.select(F.col("file").alias("session_file"), F.lit(root_prefix(root)).alias("_root"), "columns", "n_rows")


def broken(profile: DataFrame) -> DataFrame:
    """``file, reason`` of profiled files that cannot be taken: ``unclosed`` (a quoted cell that never ends) and ``ragged``
    (a row with more cells than the header)."""
    reason = F.when(F.col("columns").isNull() & F.col("multiline"), "unclosed").when(F.col("max_cells") > F.col("n_cols"), "ragged")
    return profile.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())


def file_problems(spark: SparkSession, root: str | Sequence[str], profile: DataFrame, glob: str = "*.csv", listing: DataFrame | None = None) -> DataFrame:
    """``path, reason, severity`` of files that cannot be taken: those of :func:`broken`, and ``unreadable`` ones
    (listed, but not in the profile: it could not be read to its end, or has no line).
    ``root``: a folder, or the files (``listing``: as :func:`file_tree` has them, where it is at hand). Spark's sources do not list files without any byte, so those are in no table."""
    listed = _named(file_tree(spark, root, glob) if listing is None else listing).select("file")
    known = profile.select("file", F.lit(True).alias("_known")).join(broken(profile), "file", "left")
    reason = F.when(F.col("_known").isNull(), "unreadable").otherwise(F.col("reason"))
    out = listed.join(known, "file", "left").select(F.col("file").alias("path"), reason.alias("reason"), F.lit("error").alias("severity"))
    return out.where(F.col("reason").isNotNull())


def charset_profile(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Per file the first of UTF-8, GBK and ISO-8859-1 in which all its lines are valid.

    Small files are taken whole. Of larger ones the text source keeps each line's raw bytes, so the check is per line on
    splittable input and reduced per file by a partial aggregate (no large file is ever loaded as one record).
    """
    listing = file_tree(spark, root, glob)
    valid = lambda x: F.is_valid_utf8(x)
    small = small_files(listing).where(F.length("content") > 0).select(
        "file", "length", F.forall("lines", valid).alias("utf8"), F.forall("lines", lambda x: F.when(valid(x), True).otherwise(_is_gbk(x))).alias("_gbk"))
    if not has_large_files(listing):
        return small.select("file", "length", "utf8", _charset("utf8", "_gbk").alias("charset"))
    reader = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    source = source_of(listing, root, ~is_small(spark))
    lines = (load_files if isinstance(source, str) else load_listed)(reader, spark, source).where(~is_small(spark))
    utf8 = F.expr("is_valid_utf8(value)")
    txt = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
                       utf8.alias("_ok"), F.when(utf8, True).otherwise(_is_gbk("value")).alias("_gbk"))
    per = txt.groupBy("file").agg(F.max("length").alias("length"), F.bool_and("_ok").alias("utf8"), F.bool_and("_gbk").alias("_gbk")).unionByName(small)
    return per.select("file", "length", "utf8", _charset("utf8", "_gbk").alias("charset"))


def read_feature_csv(spark: SparkSession, root: str, columns: Sequence[str], group: str = "vehicle") -> DataFrame:
    """``group, _f, _bs, _mid`` (file name and place in it) and the ``columns``, as text, of a tree that
    :func:`ampfold.sinks.writers.write_feature_csv` has written: one header for all files."""
    lines = text_lines(spark, root, listing=file_tree(spark, root))
    header, cells = ",".join(columns), F.from_csv("value", ", ".join(f"`{c}` string" for c in columns))
    named = F.regexp_extract("file", f"/{re.escape(group)}=([^/]*)/[^/]*$", 1)

    def unquoted(c: Column) -> Column:
        return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    value = unquoted(unquoted(named))  # of the path as listed, and of the folder's name
    return lines.where(F.col("value") != header).select(
        F.when(value != "__HIVE_DEFAULT_PARTITION__", value).alias(group), F.regexp_extract("file", "([^/]*)$", 1).alias("_f"), *ORDER, cells.alias("_c")
    ).select(group, "_f", *ORDER, "_c.*")
