"""The registered queries: one per operator, over its whole table, with SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.llm import bpe, exact_dedup, manifest, manifest_sql, merkle, merkle_sql, packing, quality, runs, secrets, sharding, simhash
from ampfold.llm import token_counts, toxicity, warc, warc_sql
from ampfold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(warc_sql.DERIVATIVES)
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of the responses of all pages."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    made = warc.derivatives(warc.page_responses(pages, date="2024-01-01T00:00:00Z"), keep=["page_id"])
    return made.withColumn("source_headers", F.array_join("source_headers", "|"))


@query()
def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 8 shards by the bounded-load ring; the row counts differ by one at most."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), shards=8)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the byte-level ranks, and the bytes that its ids give back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they are more than 512."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all texts with the forest's score; the values as digests."""
    model, found = secrets.fit(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return model.score(found).select(
        "doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score",
        (F.col("score") >= model.threshold).alias("is_secret"),
    )


@query("""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies after lower-casing A-Z; the largest id of a group stays."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep="max", fold_case=True)


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts; rows of remainder 0 are held out of the learning."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles; fingerprints of at most 3 differing bits are linked."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.simhash_groups(docs, shingle=3, radius=3)


@query(merkle_sql.DIGEST)
def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots of every text and of its half-edited version, and their likeness."""
    return merkle.fingerprint_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


@query()
def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, each with the sources in the corpus's proportions."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)
    return packed_digest(pieces)


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all texts; rows of remainder 1 are held out of the learning."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), threshold=0.7)


@query()
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every text, planted ones among them, and the text without the repetitions."""
    return runs.run_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(manifest_sql.DIGEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents by source, and what verifying every document's proof gives."""
    return manifest.verify_digest(table(spark, sf_dir, "documents", *manifest.DOCUMENT))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue"
    )
