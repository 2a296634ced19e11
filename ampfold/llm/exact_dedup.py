"""Exact duplicates: group by a 128-bit content hash, then compare the bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import ascii_lower, keep_rows, sha256_hex, whole_text
from ampfold.session import checkpoint_dir

#: Bits of the filter of shared hashes: 2^27 bits are 4096 bitmaps of 4 KB, 16 MB however large the data.
FILTER_BITS = 1 << 27


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def normalised(text: str | Column, fold_case: bool) -> Column:
    return ascii_lower(whole_text(text)) if fold_case else whole_text(text)


def _slot(h: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(h), F.lit(FILTER_BITS)) + 1, F.lit(1).cast("long"))  # never null


def _in_filter(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows whose hash has its bit set: all rows of shared hashes, and few others."""
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("_slot", _slot("_h"))
        .withColumn("_bucket", F.coalesce(F.bitmap_bucket_number("_slot"), F.lit(0)))  # so no null filter hashes the texts again
        .join(F.broadcast(bitmaps), "_bucket")
        .where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
    )


def collided_hashes(docs: DataFrame, text: Column, digest: Column, shared: DataFrame) -> DataFrame:
    """Hashes under which two different texts lie: ``_h``.

    The texts of shared hashes are grouped by (hash, whole text), so equal bytes fold together in each
    map task before the shuffle, and a hash with two groups is a collision. Texts of hashes that occur
    once stay out by a bitmap filter of fixed size; a false positive only compares one text more.
    """
    bitmaps = (
        shared.select(_slot("_h").alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    )
    rows = docs.select(digest.alias("_h"), text.alias("_text"))
    variants = _in_filter(rows, bitmaps).groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_n"))
    return variants.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    fold_case: bool = False,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Documents are equal when their (optionally A-Z lower-cased) texts have the same bytes. ``keep``:
    the ``min`` or ``max`` id of a group stays. Only ids and digests are shuffled by hash; texts move
    only where a hash is shared, folded per map task.

    Defined cases: a null text is empty; a null id is kept only if its group has no other id; of rows
    repeated with the same id one is kept (any, as they are alike); an empty table gives no rows; other
    columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    checkpoint_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), normalised(text_col, fold_case).alias("_text"))
    digest = hash_of(F.col("_text"))

    def keys(rows: DataFrame, variant: Column) -> DataFrame:
        return rows.select(
            "_id", "_h", variant.alias("_v"), F.unhex(sha256_hex(F.col("_text"))).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
        ).checkpoint()

    hashed = docs.withColumn("_h", digest)
    rows = keys(hashed, F.lit(None).cast("string"))
    shared = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    collided = collided_hashes(docs, F.col("_text"), digest, shared).checkpoint()
    if not collided.isEmpty():  # then the bytes themselves part the groups of those hashes
        flags = collided.select(F.col("_h").alias("_ch"), F.lit(True).alias("_c"))
        rows = keys(hashed.join(flags, F.col("_h") == F.col("_ch"), "left"), F.when(F.col("_c"), F.col("_text")))

    best = F.max if keep == "max" else F.min
    first = F.struct(F.col("_id").isNull() if keep == "min" else F.col("_id").isNotNull(), F.col("_id"), F.col("_row"))
    groups = rows.groupBy("_h", "_v").agg(F.count(F.lit(1)).alias("group_size"), best(first).alias("_best"))
    groups = groups.select(F.col("_h").alias("_gh"), F.col("_v").alias("_gv"), "group_size", "_best")
    same = (F.col("_h") == F.col("_gh")) & F.col("_v").eqNullSafe(F.col("_gv"))
    return rows.join(groups, same).select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = False
) -> DataFrame:
    """The documents that :func:`exact_duplicates` keeps, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col, keep, fold_case).where("kept")
    kept = found.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    return keep_rows(docs, kept, id_col, normalised(text_col, fold_case))
