"""Path-derived columns: group directory and session datetime."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampfold.functions.common import as_col

# The datetime pattern searched in a session path, its text format, and the
# value used when a path carries no valid datetime.
PATH_DATETIME_PATTERN = r"(\d{8})_(\d{6})"
PATH_DATETIME_FORMAT = "yyyyMMdd_HHmmss"
SENTINEL_DATETIME = "0001-01-01 00:00:00"
REPORT_DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def strip_scheme(path) -> Column:
    """``file:/a/b`` or ``hdfs://nn/a/b`` -> ``/a/b``."""
    return F.regexp_replace(as_col(path), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def root_prefix(root: str) -> str:
    """Normalised form of a root folder as it appears in ``_metadata.file_path`` (scheme stripped)."""
    r = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    return "/" + r.strip("/") if r else ""


def relative_path(path, root: str) -> Column:
    """Path below ``root`` ('' when the file is not below it)."""
    prefix = re.escape(root_prefix(root))
    return F.regexp_extract(strip_scheme(path), f"^{prefix}/(.*)$", 1)


def group_dir(path, root: str) -> Column:
    """First directory below ``root``; '' for files directly in the root."""
    return F.regexp_extract(relative_path(path, root), r"^([^/]+)/", 1)


def group_dir_of(path, root_prefix_col) -> Column:
    """Like :func:`group_dir`, with the (scheme-free) root as a column; plain string functions."""
    p = strip_scheme(path)
    r = as_col(root_prefix_col)
    inside = p.startswith(F.concat(r, F.lit("/")))
    rel = p.substr(F.length(r) + F.lit(2), F.lit(1 << 30))
    return F.when(inside & (F.instr(rel, "/") > 0), F.substring_index(rel, "/", 1)).otherwise(F.lit(""))


def path_datetime(path) -> Column:
    """First ``YYYYMMDD_HHMMSS`` anywhere in the path as TIMESTAMP_NTZ; the sentinel when absent or invalid."""
    p = as_col(path)
    m = F.regexp_extract(p, PATH_DATETIME_PATTERN, 0)
    part = lambda a, b: F.substring(m, a, b).cast("int")
    year, month, day = part(1, 4), part(5, 2), part(7, 2)
    hour, minute, sec = part(10, 2), part(12, 2), part(14, 2)
    ok = (m != F.lit("")) & (year >= 1) & (sec < 60)
    ts = F.when(ok, F.try_make_timestamp_ntz(year, month, day, hour, minute, sec.cast("decimal(8,6)")))
    return F.coalesce(ts, F.lit(SENTINEL_DATETIME).cast("timestamp_ntz"))


def report_datetime(ts) -> Column:
    return F.date_format(as_col(ts), REPORT_DATETIME_FORMAT)
