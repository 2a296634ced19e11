"""Land an intermediate DataFrame once as Parquet in the shared checkpoint folder and read it back.

Used where one expensive scan (e.g. parsing a CSV tree) feeds several branches of a plan:
without it every branch would re-read and re-parse the source. The written table also cuts
the lineage, so a lost executor does not send the job back to the raw files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampfold.session import scratch_path

#: A file's path as the scans of all formats have it; a condition on it prunes files before they are opened.
FILE_PATH = "_metadata.file_path"
#: Batches into which a tree is dealt whose scan has failed.
BATCHES = 32
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    out = path or scratch_path(spark, f"stage-{name}")
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def file_hash(path: str | Column = FILE_PATH) -> Column:
    """The number by which files are dealt into batches and left out (a long for each, not a path)."""
    return F.xxhash64(path)


def all_but(left_out: Collection[int], path: str | Column = FILE_PATH) -> Column:
    """Whether a file is none of those ``left_out``."""
    return ~file_hash(path).isin(*left_out) if left_out else F.lit(True)


# How Spark tells that a file could not be read, after the retries of its task.
_FAILED_READ = re.compile(r"\[FAILED_READ_FILE\.(?!FILE_NOT_EXIST)")


def stage_readable(
    scan: Callable[[Column], DataFrame], listing: DataFrame, name: str, path: str | None = None, left_out: Collection[int] = ()
) -> tuple[DataFrame, list[int]]:
    """:func:`stage` of a scan whose read errors fail the task, so that Spark retries it and no file is taken in part;
    and the hashes of the files that cannot be read to their end, which are left out whole.

    ``scan`` reads the files that meet a condition on ``FILE_PATH``; ``listing`` lists them all (any format: only
    ``FILE_PATH`` is asked for); ``left_out`` are not opened. One job reads the whole tree. If a file stops it, the
    tree is dealt into batches by the paths' hash, each staged on its own, several at a time; a batch that fails is
    halved until the file is alone. So an unreadable file costs its batch again, and no other;
    errors of any other kind are raised. Nothing but a number for each file left out is held by the driver.
    """
    spark = listing.sparkSession
    out = path or scratch_path(spark, f"stage-{name}")
    bad: list[int] = []

    def within(low: int, high: int, of: str | Column = FILE_PATH) -> Column:
        return file_hash(of).between(low, high) & all_but(left_out, of)

    def staged(low: int, high: int, rows: Column) -> bool:
        try:
            scan(rows).write.mode("overwrite").parquet(f"{out}/{low & (1 << 64) - 1:016x}-{high & (1 << 64) - 1:016x}")
        except Exception as e:  # noqa: BLE001 - errors of other kinds are raised again
            if not _FAILED_READ.search(str(e)):
                raise
            return False
        return True

    def isolate(bounds: tuple[int, int]) -> None:
        low, high = bounds
        if staged(low, high, within(low, high)):
            return
        files = listing.where(within(low, high)).select(file_hash().alias("h"))
        ends = files.agg(F.min("h").alias("low"), F.max("h").alias("high")).first()
        if ends["low"] == ends["high"]:
            bad.append(ends["low"])
            return
        middle = (ends["low"] + ends["high"]) // 2  # hashes are spread evenly, and either half has a file
        isolate((ends["low"], middle))
        isolate((middle + 1, ends["high"]))

    if not staged(_LOWEST, _HIGHEST, all_but(left_out)):
        edges = [_LOWEST + i * ((1 << 64) // BATCHES) for i in range(BATCHES)]
        batches = list(zip(edges, [*(e - 1 for e in edges[1:]), _HIGHEST], strict=True))
        with ThreadPoolExecutor(max_workers=max(1, min(BATCHES, spark.sparkContext.defaultParallelism // 2))) as pool:
            list(pool.map(inheritable_thread_target(spark)(isolate), batches))
        if bad:  # so that there is a table if no file can be read
            scan(F.lit(False)).write.mode("overwrite").parquet(f"{out}/none")
    return spark.read.option("recursiveFileLookup", True).parquet(out), bad
