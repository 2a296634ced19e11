"""Compressed files that end too soon or do not match their checksum, found before a scan runs into them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.plans.staging import FILE_PATH, file_hash
from ampfold.session import load_files
from ampfold.sources.listing import contents

#: Larger archives are not taken into one row; the scan itself finds out.
MOST_BYTES = 1 << 28
#: Bytes inflated at once.
PIECE = 1 << 20


def is_damaged(data: bytes | memoryview) -> bool:
    """Whether a member of a gzip file ends too soon or fails its checksum (what follows the members is not judged)."""
    rest = memoryview(data)
    first = True
    while len(rest):
        if bytes(rest[:2]) != b"\x1f\x8b":
            return first
        inflate, at = zlib.decompressobj(31), 0
        try:
            while not inflate.eof:
                if at >= len(rest) and not inflate.unconsumed_tail:
                    return True
                piece = inflate.unconsumed_tail or rest[at : at + PIECE]
                at += 0 if inflate.unconsumed_tail else len(piece)
                inflate.decompress(piece, PIECE)
        except zlib.error:
            return True
        rest, first = rest[at - len(inflate.unused_data) :] if inflate.unused_data else rest[at:], False
    return False


def damaged_archives(spark: SparkSession, root: str | Sequence[str], glob: str = "*", recursive: bool = True,
                     listing: DataFrame | None = None) -> list[int]:
    """The path hashes of gzip files (``.gz``) that cannot be read to their end; ``listing``: the same files as Spark's
    binary source has them, where they have been listed.

    One pass over the compressed bytes, a few files a task at a time; nothing fails, so a thousand damaged files cost no
    more than one. Trees without such files are not read at all.
    """
    if listing is None:
        listing = load_files(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob), spark, root)
    files = listing.where(F.lower(FILE_PATH).endswith(".gz"))
    if files.select("length").isEmpty():
        return []

    @F.arrow_udf("boolean")
    def damaged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            yield pa.array([is_damaged(memoryview(c.as_buffer())) for c in contents], type=pa.bool_())

    whole = contents(files, F.col("length") <= MOST_BYTES)
    return [r["h"] for r in whole.select(file_hash("file").alias("h"), damaged(F.col("content")).alias("_found")).where("_found").select("h").collect()]
