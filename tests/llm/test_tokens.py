"""Byte-level BPE and token counts against the tokenizer libraries themselves."""

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampfold.llm import bpe, token_counts
from ampfold.llm.pretokens import JsonTokenizer, WorkerCache, patterns, read_spec, splitter, tiktoken_class
from ampfold.llm.queries import QUERIES
from tests.conftest import SF_SMALL

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "   ", "\n\n  x", "don't  stop 123 ½²", "日本語のテキスト mixed", "a" * 3000, " " * 5000, "é" * 700 + "!" * 900,
       "x՘yᲉ \U00011de0", "J̌ İstanbul ΣΑΣ ﬁ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "\x1c\x1f\x85\xa0t", "😀👍🏽 ok",
       "ab" * 4000, "é 각", "<|startoftext|> hi"]


def fuzz(n=300):
    rng = random.Random(5)
    alphabet = list("abcde ABC  \n\t'.!?,123") + ["é", "ß", "日", "́", "՘", " ", "\xa0", "😀", "'s", "'ll", "<|endoftext|>"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(merger, pieces):
    return np.frombuffer(b"".join(merger.encode([p.encode() for p in pieces])), dtype=np.int32).tolist()


def test_segment_tree_equals_library(library):
    merger = bpe.Merger(bpe.read_ranks(open(RANKS, "rb").read()))
    split = splitter(patterns(P.PATTERN, tiktoken_class))
    texts = ODD + fuzz()
    for t in texts:
        ids = ids_of(merger, split(t))
        assert ids == library.encode_ordinary(t), t[:50]
    for t in texts[:60]:
        data = t.encode()[:60]
        if data and data not in merger.ranks:
            together = np.frombuffer(merger.encode_together([data], 64)[0], dtype=np.int32).tolist()
            assert together == merger.encode_alone(data)


def test_every_character_is_split_as_the_library_does(library):
    split = splitter(patterns(P.PATTERN, tiktoken_class))
    text = "".join(chr(c) + ("x" if c % 3 else " 7") for c in range(0x20, 0x3100) if c % 5 == 0 or 0x500 < c < 0x600)
    assert "".join(split(text)) == text
    merger = bpe.Merger(library._mergeable_ranks)
    assert ids_of(merger, split(text)) == library.encode_ordinary(text)


def test_encode_and_decode_on_spark(spark, library):
    texts = [*ODD, *fuzz(100), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("mine"))
    for out in (bpe.decode(bpe.encode(df.repartition(3), RANKS, P.PATTERN), RANKS), bpe.round_trip(df.repartition(3), RANKS, P.PATTERN)):
        got = {r["doc_id"]: r for r in out.collect()}
        for i, t in enumerate(texts):
            assert got[i]["ids"] == library.encode_ordinary(t or "")
            assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query_over_the_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op3_byte_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_pieces_equal_the_library(name):
    spec, lib = read_spec(P.path(name)), Tokenizer.from_file(P.path(name))
    assert spec.patterns
    own, counts = JsonTokenizer(spec, "<u4"), JsonTokenizer(spec)
    texts = ODD + fuzz()
    for t, values, n in zip(texts, own.values(texts), counts.values(texts), strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(values), dtype="<u4").tolist() == ids, t[:50]
        assert sum(n) == len(ids)


def test_worker_cache_is_bounded_and_right():
    cache = WorkerCache(lambda words: [len(w) for w in words], pinned={"pin": 99}, limit=5)
    for part in (["a", "bb", "pin"], ["ccc"] * 4, list("defghi"), ["a", "pin"]):
        assert list(cache.values([part, []])) == [[99 if w == "pin" else len(w) for w in part], []]
        assert len(cache.known) <= 5 + 6 and len(cache.last) <= 5 + 6


def test_token_counts_on_spark(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *fuzz(100), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    for frequent in (5, 1000):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df.repartition(4), path, frequent=frequent).collect()}
        assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_summaries_keep_heavy_hitters(spark):
    source = read_spec(P.path("byte_bpe_50k.json"))
    df = spark.range(600).select(F.concat(F.lit("heavy heavy w"), F.col("id").cast("string")).alias("text")).repartition(7)
    assert " heavy" in token_counts.frequent_pretokens(df, source, most=8)


def test_count_query(spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_token_counts"](spark, SF_SMALL).collect():
        n = len(lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len(docs[r["doc_id"]].encode()))


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    """A thousand texts of 100 KB do not come in one batch, and a lower bound that is set already stays."""
    from ampfold.llm import common

    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    @F.arrow_udf("long")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), pa.int64())

    try:
        spark.conf.set(name, "64m")
        common.text_batches(spark)
        rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        assert rows.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 2 * common.TEXT_BYTES
        spark.conf.set(name, "1m")
        common.text_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
