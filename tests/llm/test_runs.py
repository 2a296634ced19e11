"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampfold.llm import runs

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(w):
    """Start, length and smallest period of every run: each period's stretches, least periods first."""
    n, out = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                out.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.randrange(220), rng.choice([1, 2, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        a, p = rng.randrange(n), rng.randrange(1, 20)
        for i in range(a, min(n, a + rng.randrange(20, 150))):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_brute_force():
    rng, found = random.Random(11), 0
    for _ in range(1500):
        words = random_words(rng)
        want = brute_runs(words)
        found += len(want)
        assert runs.word_runs(np.array(words, dtype=np.int64)) == want
    assert found > 500


def test_quick_test_of_texts_misses_none():
    rng = random.Random(12)
    texts = [random_words(rng) for _ in range(300)]
    flat, sizes = np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts])
    flags = runs.may_have_runs(flat, sizes)
    assert all(f for f, t in zip(flags, texts, strict=True) if brute_runs(t)) and not flags.all()
    assert not runs.may_have_runs(np.zeros(0, np.int64), np.zeros(3, np.int64)).any()


@pytest.mark.parametrize("name", ["one word", "Fibonacci", "two halves", "run of runs", "two letters"])
def test_long_and_hostile_texts(name):
    n = 4000
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    inner = ([0] * 30 + [1]) * 10
    words = {
        "one word": [0] * n, "Fibonacci": [ord(c) for c in b[:n]], "two halves": list(range(n // 4)) * 4,
        "run of runs": inner + [2] + inner, "two letters": np.random.default_rng(0).integers(0, 2, n).tolist(),
    }[name]
    assert runs.word_runs(np.array(words, dtype=np.int64)) == brute_runs(words)


def test_positions_stay_sorted(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 4)
    rng = random.Random(5)
    order = rng.sample(range(500), 300)
    held, known = runs.Positions(order[0]), [order[0]]
    for one in order[1:]:
        before, after = held.around(one)
        assert before == max((k for k in known if k < one), default=None) and after == min((k for k in known if k > one), default=None)
        held.add(one)
        known.append(one)
    assert list(held) == sorted(known) and held.size == 300


def digest(doc_id, text):
    words = re.findall(runs.WORD, text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_digest_equals_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{w}" for w in random_words(rng))) for i in range(200)]
    rows += [(i, "\n\t".join(f"v{rng.randrange(9999)}" for _ in range(rng.randrange(1, 300)))) for i in range(200, 400)]
    rows += [(900, None), (901, ""), (902, " \n "), (None, "a b " * 40), (903, "é ü\x0b" * 30), (903, "é ü\x0b" * 30), (904, " x " * 25), (905, "😀 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    df = df.withColumns({"runs": F.lit(1), "_found": F.lit(2), "_words": F.lit("x"), "_n": F.lit(0), "start": F.lit("s")})
    got = sorted(map(tuple, runs.run_digest(df).collect()), key=repr)
    assert got == sorted((digest(*r) for r in rows), key=repr)
    planted = [r for r in got if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0]
    assert sum(r[1] > 0 for r in planted) > 10


def test_general_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x y z " * 10 + "end", 5), (2, None, 6)], "id long, body string, _found long")
    first, second = runs.with_runs(df, "body").orderBy("id").collect()
    assert [tuple(r) for r in first["runs"]] == [(0, 30, 3)] and first["collapsed"] == "x y z end"
    assert (second["runs"], second["collapsed"], second["_found"], second["body"]) == ([], "", 6, None)
    assert runs.with_runs(df.limit(0), "body").count() == 0
