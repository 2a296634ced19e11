"""Folders that are replaced as a whole: readers see the last complete version, or the one before it, never a part.

A version is written to a folder of its own. Only when all of it stands, an empty marker file with the version's number
and name appears in ``_published``; making such a file is one step in every file system. What a stopped writer left has
no marker and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKERS = "_published"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(spark: SparkSession, out: str) -> list[str]:
    at, fs = _folder(spark, f"{out}/{MARKERS}")
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def current_version(spark: SparkSession, out: str) -> str | None:
    """The folder of the last complete version; None if there is none."""
    done = _published(spark, out.rstrip("/"))
    return f"{out.rstrip('/')}/version-{done[-1].split('-')[1]}" if done else None


def publish(spark: SparkSession, out: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Runs ``write`` on the folder of a new version and makes it the current one; an error leaves the former in place.

    The last ``keep`` versions stay (two, so that readers of the one before can end). There should be one
    writer at a time; of two, the later marker wins and both versions are whole.
    """
    out = out.rstrip("/")
    done = _published(spark, out)
    name = uuid.uuid4().hex
    path = f"{out}/version-{name}"
    write(path)
    number = int(done[-1].split("-")[0]) + 1 if done else 1
    marker, fs = _folder(spark, f"{out}/{MARKERS}/{number:012d}-{name}")
    if not fs.createNewFile(marker):
        raise FileExistsError(marker.toString())
    for old in done[: max(0, len(done) + 1 - keep)]:
        for gone in (f"{out}/{MARKERS}/{old}", f"{out}/version-{old.split('-')[1]}"):  # the marker first: it must not name what is gone
            at, fs = _folder(spark, gone)
            fs.delete(at, True)
    return path
