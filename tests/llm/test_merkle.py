"""Merkle fingerprints against a plain Python tree."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ampfold.llm import merkle

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
python = lambda pattern: pattern.replace(r"\z", r"\Z")


def tree(text):
    sections = re.findall(python(merkle.SECTION), text)
    assert "".join(sections) == text
    out, leaves = [], {}
    for s in sections:
        nodes = []
        paragraphs = re.findall(merkle.PARAGRAPH, s)
        assert "".join(paragraphs) == s
        for p in paragraphs:
            parts = re.findall(merkle.LEAF, p)
            assert "".join(parts) == p
            labels = [f"{sha('0' + q)}:{len(q)}" for q in parts]
            leaves |= dict(zip(labels, map(len, parts), strict=True))
            nodes.append(sha("1" + "".join(labels)))
        out.append(sha("1" + "".join(nodes)))
    return sha("1" + "".join(out)), leaves


def like(a, b):
    (ra, la), (rb, lb) = tree(a), tree(b)
    shared = sum(n for k, n in la.items() if k in lb)
    return 1.0 if ra == rb else 2.0 * shared / max(1, sum(la.values()) + sum(lb.values()))


def brute(rows):
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    last = "" if any(isinstance(r[0], str) for r in rows) else merkle.LOWEST
    key = lambda r: (r[0] is not None, last if r[0] is None else r[0])
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: (key(r), signed(r[1] or "")), reverse=True)
    for i, (d, t) in enumerate(order):
        t, x = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + x[:half]
        yield (d, len(t), sha(e), tree(t)[0], tree(e)[0], like(t, e), like(t, x))


TEXTS = ["", None, "\n", "\n\n\n", "One. Two! Three?\nNext line", "a\n\n\nb\n", "é" * 500 + ".", "😀 x\n" * 40, "long " * 30_000, "x.\n" * 5_000, "no end",
         "One. Two! Three?\nNext line"]


@pytest.mark.parametrize("chunk_rows", [1, 3, 512])
def test_digest_equals_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(merkle, "CHUNK_ROWS", chunk_rows)
    rows = [(i * i * 7 - 50, t) for i, t in enumerate(TEXTS)] + [(1000 + i, f"text {i}.\nand {i % 5} more. Same end.") for i in range(150)]
    rows += [(None, "no id"), (1003, "again"), (1003, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"_at": F.lit(1), "own_root": F.lit("x")})
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
           for r in merkle.fingerprint_digest(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("of", [lambda i: None, lambda i: 7 if i % 3 else i, lambda i: f"id {i % 40:03d}" if i % 5 else None])
def test_hot_and_text_ids_are_cut_into_chunks(spark, monkeypatch, of):
    monkeypatch.setattr(merkle, "CHUNK_ROWS", 8)
    rows = [(of(i), f"Text number {i}.\nSecond line of {i}.") for i in range(300)]
    kind = "string" if any(isinstance(r[0], str) for r in rows) else "long"
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
           for r in merkle.fingerprint_digest(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    window = []
    real = merkle.Window.partitionBy
    monkeypatch.setattr(merkle.Window, "partitionBy", staticmethod(lambda *c: window.append(c) or real(*c)))
    rows_of = merkle.with_successor(df.withColumnRenamed("doc_id", "_id"), "_id", "text", "next")
    assert rows_of.count() == 300 and window == [("_at.chunk",)]


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "abcd. efgh.")], "doc_id long, text string")
    r = merkle.fingerprint_digest(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == sha("abcd. " + "abcd.")
    assert merkle.fingerprint_digest(one.limit(0)).count() == 0


def test_edits_are_located(spark):
    lines = [f"Paragraph number {i} of the text." for i in range(60)]
    changed = [*lines]
    changed[37] = "This one is new."
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(changed)), (2, "same", "same")], "id long, old string, new string")
    trees = merkle.with_tree(merkle.with_tree(df, "old", "a"), "new", "b")
    assert [tuple(r) for r in merkle.locate_edits(trees, "id", "a", "b").collect()] == [(1, 2, 5)]
    assert trees.where("id = 2").select(merkle.likeness("a", "b")).first()[0] == 1.0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = merkle.fingerprint_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
