"""Toxicity: the network's pooling and slopes against plain loops, held-out accuracy, thresholds and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ampfold.llm import toxicity
from ampfold.llm.queries import QUERIES


def a_network():
    rng = np.random.default_rng(0)
    shape = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    filters = [shape(s, toxicity.WIDTH, toxicity.FILTERS) for s in toxicity.SPANS]
    n = toxicity.FILTERS * len(filters)
    return toxicity.Network(shape(toxicity.ROWS, toxicity.WIDTH), filters, shape(n), shape(n) / 50, 0.3)


def brute_logit(net, text):
    words = [net.embeddings[toxicity.parts(w)].sum(axis=0) for w in toxicity._words(text.lower())]
    at, values = range(max(1, len(words))), []
    words += [np.zeros(toxicity.WIDTH)] * toxicity.PAD
    for w in net.filters:
        values.append(np.max([sum(words[i + j] @ w[j] for j in range(len(w))) for i in at], axis=0))
    return float(np.maximum(np.concatenate(values) + net.bias, 0) @ net.out + net.out_bias)


def test_scores_equal_plain_loops_whatever_the_blocks(monkeypatch):
    net, texts = a_network(), ["One two three", "", "x", "a b c d e f g h i j k " * 20, "...", "Übel übel", "end of it " * 7]
    want = [1 / (1 + np.exp(-brute_logit(net, t))) for t in texts]
    assert max(want) - min(want) > 0.2
    for block in (3, 64, 1 << 15):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        words, vectors = toxicity.Words(), toxicity.Vectors()
        assert np.allclose(net.score(words, texts, vectors), want, atol=1e-4)
        assert np.allclose(net.score(words, texts[::-1], vectors), want[::-1], atol=1e-4)


def test_forgetful_workers_score_alike(monkeypatch):
    net, rng = a_network(), np.random.default_rng(1)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 4000, 40)) for _ in range(200)]
    want = net.score(toxicity.Words(), texts, toxicity.Vectors())
    monkeypatch.setattr(toxicity, "MOST_CACHED", 100)
    words, vectors = toxicity.Words(), toxicity.Vectors()
    got = np.concatenate([net.score(words, texts[i : i + 7], vectors) for i in range(0, 200, 7)])
    assert np.allclose(got, want, atol=1e-5) and words.generation > 10


def test_learning_finds_words_and_pairs():
    """Label 1: 'bad' directly before 'egg', which no single word tells."""
    rng, words = np.random.default_rng(2), toxicity.Words()
    texts, y = [], []
    for i in range(600):
        filler = [f"w{n}" for n in rng.integers(0, 300, 30)]
        at = int(rng.integers(0, 28))
        filler[at : at + 2] = ["bad", "egg"] if i % 3 == 0 else ["egg", "bad"]
        texts.append(" ".join(filler))
        y.append(int(i % 3 == 0))
    numbers, sizes = words.numbers(texts)
    docs, y = np.split(numbers, np.cumsum(sizes)[:-1]), np.array(y)
    table = words.rows[: len(words.number)]
    held = np.arange(600) >= 400
    net = toxicity.learn(docs[:400], table, y[:400], np.arange(400) % 4 == 0)
    scores = net.probability(toxicity.learned_logits(net, docs[400:], table))
    assert np.mean((scores >= 0.5) == y[held]) > 0.95


def test_thresholds_by_language():
    scores, y = np.array([0.1, 0.2, 0.3, 0.8, 0.9] * 20), np.array([0, 0, 1, 1, 1] * 20)
    assert toxicity.best_threshold(scores, y) == 0.25
    langs = ["en"] * 80 + [None] * 10 + ["de"] * 10
    found = toxicity.language_thresholds(scores, y, langs, 0.7)
    assert set(found) == {None, "en"} and found["en"] == 0.25  # de has too few rows
    assert toxicity.language_thresholds(scores[:2], y[:2], langs[:2], 0.7) == {None: 0.7}
    ties = toxicity.best_threshold(np.array([0.5, 0.5, 0.5, 0.1]), np.array([1, 0, 1, 0]))
    assert 0.1 < ties <= 0.5


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op11_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["score"], r["predicted"], r["flagged"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [h for h in held if h[3] == 1], [h for h in held if h[3] == 0]
    assert np.mean([h[1] for h in toxic]) > 0.8 and np.mean([h[1] for h in clean]) < 0.015
    assert np.mean([h[2] for h in toxic]) > 0.8 and np.mean([h[2] for h in clean]) < 0.03
    assert np.mean([(t[0] > c[0]) + 0.5 * (t[0] == c[0]) for t in toxic for c in clean]) > 0.96


def test_a_toxic_end_of_a_very_long_text_counts(spark):
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    rows = [(i, filler(40) + (" vile scoundrel" if i % 2 else " kind person"), "en") for i in range(400)]
    rows += [(1001, filler(50_000) + " vile scoundrel", "en"), (1002, filler(50_000) + " kind person", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_documents(df, labels).collect()}
    assert found[1001]["predicted"] == 1 and found[1002]["predicted"] == 0
    assert found[1001]["flagged"] and not found[1002]["flagged"]


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None, "en"), (2, "", None), (2, "", None), (None, "words here", "xx"), (3, "x" * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"_score": F.lit("s"), "_id": F.lit(0), "_label": F.lit(3)})
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (3, None), (None, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(df, one).collect()} == {1.0}
    assert toxicity.score_documents(df.limit(0), one).count() == 0
    kept = toxicity.fit(df, one).transform(df, to="new")
    assert kept.columns == [*df.columns, "new"] and {r["_score"] for r in kept.collect()} == {"s"}


def test_the_bounds_of_the_sample(spark):
    """Only so many documents, of so many words, are learned from; the order is that of a hash of the id."""
    df = spark.createDataFrame([(i, f"good w{i} " * 20 if i % 2 else f"bad w{i} " * 20) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    seen = []
    keep = toxicity.learn
    try:
        toxicity.learn = lambda docs, words, y, cal: seen.append((len(docs), sum(map(len, docs)))) or keep(docs, words, y, cal)
        toxicity.fit(df, labels, most=60)
        toxicity.fit(df, labels, most_words=1000)
    finally:
        toxicity.learn = keep
    assert seen[0][0] == 60 and seen[1][1] <= 1000 and seen[1][0] >= 20


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """More documents than the draw of old took, in several parts, whose network tells the words of both labels."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{n}" for n in rng.integers(0, 300, 12)) + (" vile" if i % 3 == 0 else " kind"), "en" if i % 2 else None) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    taught = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in taught if zlib.crc32(str(i).encode()) // 3 % 8 == 0]
    monkeypatch.setattr(toxicity, "PART_CHARS", 150_000)
    seen, whole, calibrate = [], toxicity.learn_in_parts, toxicity.calibrate
    monkeypatch.setattr(toxicity, "learn_in_parts", lambda r, parts: seen.append((r.count(), r.select("_part").distinct().count())) or whole(r, parts))
    monkeypatch.setattr(toxicity, "calibrate", lambda net, r, default: seen.append(r.count()) or calibrate(net, r, default))
    model = toxicity.fit(df, labels, lang_col="lang")
    assert len(taught) > 6_000 and seen[0][0] == len(taught) - len(held) and seen[0][1] >= 2 and seen[1] == len(held)
    scores = {r["doc_id"]: r["score"] for r in model.transform(df).select("doc_id", "score").collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 3 == 0) for i, *_ in rows if i not in taught]) > 0.99
    s, y = np.array([scores[i] for i in held]), np.array([int(i % 3 == 0) for i in held])
    want = toxicity.language_thresholds(s, y, [rows[i][2] for i in held], 0.7)
    assert model.thresholds.keys() == want.keys() and all(abs(model.thresholds[k] - want[k]) < 1e-4 for k in want)
