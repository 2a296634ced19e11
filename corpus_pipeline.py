"""The training-corpus pipeline: from raw documents to packed sequences in five stages.

Each stage takes all that the one before kept and its decisions take effect; all but the last return the
columns of ``documents``. :func:`run` writes every stage's result to the shared folder and goes on from there, so
a lost executor costs the stage at hand alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.llm import exact_dedup, packing, quality, queries, secrets, simhash
from ampfold.llm.common import table
from ampfold.plans.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the one of the largest id."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max", fold_case=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: 3-word shingles, links of at most 3 bits."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=3)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced and their lengths counted anew."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens with the sources in the corpus's proportions."""
    return queries.packed_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: A trained network and forest, XXH64 and a tokenizer library have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
