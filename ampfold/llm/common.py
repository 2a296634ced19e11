"""Column builders and small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partial results that one task merges into one.
FAN_IN = 64
#: One seed for every hash that orders or samples rows.
SEED = 42


_HELD: dict = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task (vocabularies, caches). Workers are reused by one operator
    after another, so only the state asked for last is held, and the memory of the one before goes back."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


#: Whole texts in one Arrow batch, and bytes after which a batch ends: Spark's 10,000 rows of long texts may not fit
#: beside what an executor holds, nor may 1,000 of a hundred kilobytes each.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by TEXT_ROWS and TEXT_BYTES (a lower bound that is set already stays)."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, read in (("maxRecordsPerBatch", TEXT_ROWS, int), ("maxBytesPerBatch", TEXT_BYTES, as_bytes)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < read(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table (other columns, whatever their names, are not read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def whole_text(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def packed(rows: DataFrame, **columns: Column) -> DataFrame:
    """All columns of the rows in one, ``_doc``, beside new ones, so that no name of theirs can clash."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_doc"), *[c.alias(name) for name, c in columns.items()])


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text: str | Column) -> DataFrame:
    """The rows of ``docs`` whose (id, SHA-256 of the text) is in ``kept(_id, _sha)``, one row for each, with all columns.

    One shuffle of the texts by (id, digest); the join's partitioning and sort order also serve the
    removal of rows repeated with the same id and text.
    """
    rows = packed(docs, _id=F.col(id_col), _sha=sha256_hex(whole_text(text)))
    kept = kept.select(F.col("_id").alias("_kept_id"), F.col("_sha").alias("_kept_sha"))
    cond = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    return rows.join(kept, cond, "left_semi").dropDuplicates(["_id", "_sha"]).select("_doc.*")


def merge_in_tree(partials: DataFrame, parts: int, merge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """One row from a row for each of ``parts`` partitions (column ``part``, their numbers).

    ``merge`` makes one row of up to ``FAN_IN`` of them, of the same size as each; so no task ever holds more
    than that, however many partitions there are. ``merge`` keeps the number of its first row.
    """
    schema = partials.schema
    while True:
        parts = -(-parts // FAN_IN)
        dealt = partials.withColumn("part", F.pmod("part", F.lit(max(1, parts))).cast(schema["part"].dataType))
        partials = dealt.groupBy("part").applyInArrow(merge, schema)
        if parts <= 1:
            return partials
