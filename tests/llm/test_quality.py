"""Quality scores: vectors against brute force, held-out accuracy, calibration and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ampfold.llm import quality
from ampfold.llm.queries import QUERIES


def test_corpus_vectors_equal_brute_force(spark):
    texts = ["One two, three two!", None, "", "two", "three one one one " * 30, "É é x"]
    places, signs = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.WIDTH), dtype=np.int64)
    for t in texts:
        words = [zlib.crc32(w.encode()) % quality.WORDS for w in quality._words((t or "").lower())]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.SPAN), min(len(words), i + quality.SPAN + 1)):
                if i != j:
                    want[w, places[words[j]]] += signs[words[j]].astype(int)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert (quality.corpus_vectors(df) == want).all()


def test_pooling_has_every_text(spark):
    table = quality.vector_table(np.arange(quality.WORDS * quality.WIDTH).reshape(quality.WORDS, -1))
    texts = ["a b a b", "", "a a a", "  ", "z"]
    both = quality.pooled(texts, table)
    assert both.shape[0] == 5
    for i, t in enumerate(texts):
        assert np.allclose(both[i], quality.pooled([t], table)[0])
    assert both[2, -2] == 2 / 3 and not both[1].any() and both.shape[1] == quality.FEATURES


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_quality"](spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [h for h in held if h[2] == 1], [h for h in held if h[2] == 0]
    assert np.mean([h[1] == h[2] for h in held]) > 0.97
    assert np.mean([h[1] for h in good]) > 0.985 and np.mean([h[1] for h in bad]) < 0.2
    auc = np.mean([(g[0] > b[0]) + 0.5 * (g[0] == b[0]) for g in good for b in bad])
    assert auc > 0.99
    assert abs(np.mean([h[0] for h in held]) - np.mean([h[2] for h in held])) < 0.03


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "words here"), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "_id": F.lit(0)})
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(df, one).collect()} == {1.0}
    assert quality.score_documents(df.limit(0), one).count() == 0
    kept = quality.keep_good(df.withColumn("_score", F.lit("mine")), one)
    assert kept.columns == [*df.columns, "_score"] and kept.count() == 5
    assert {(r["score"], r["_id"], r["_score"]) for r in kept.collect()} == {("s", 0, "mine")}
