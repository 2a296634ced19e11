"""SimHash fingerprints and components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ampfold.llm import simhash
from ampfold.llm.queries import QUERIES
from tests.conftest import SF_MID


def brute_print(text, size=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, radius=3):
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    arr = np.array(prints, dtype=np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius):
            root[find(prints[i + 1 + j])] = find(p)
    low = {}
    for d, p in rows:
        r = find(p)
        low[r] = d if r not in low or (d is not None and (low[r] is None or d < low[r])) else low[r]
    return {p: low[find(p)] for p in prints}


TEXTS = ["", None, " \t\n", "One", "one two", "ONE  TWO\vthree", "a b c d", "É é x y", "  a b c d e f", "w " * 20_000]


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("ab CD é 日 x, y. \x1c".split(" "), k=rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] for r in df.select("doc_id", simhash.fingerprint_column(F.col("text"), 3).alias("fp")).collect()}
    for i, t in enumerate(texts):
        assert got[i] % (1 << 64) == brute_print(t), t


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("block", [7, 1024])
def test_links_span_all_pairs_within_the_radius(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 1, 3, 7, (1 << 64) - 1}
    for p in list(prints)[:40]:  # chains and dense groups
        for _ in range(25):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
            prints.add(p)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    want = brute_components(rows)
    df = spark.createDataFrame([(signed(p),) for _, p in rows], "fp long").repartition(5)
    edges = simhash.links(df, 3).checkpoint()
    assert all(bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") for r in edges.collect())
    roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    groups = {}
    for i, p in rows:
        groups.setdefault(roots.get(signed(p), signed(p)), []).append(i)
    assert {p: min(groups[roots.get(signed(p), signed(p))]) for _, p in rows} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    out = simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in out} == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 300)}


def test_groups_with_nulls_repeats_and_clashes(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(5, base), (3, base.upper()), (3, base), (9, None), (8, ""), (None, " "), (None, "alone words here now"), (1, "other text entirely, nothing alike")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit("x")})
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (-1, 8), (-1, None), (1, 1)], key=str)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 3, 8]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_every_component_keeps_a_document(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    apart = ["alone words here now", "nothing like the others at all", "a third text, of its own kind"]
    one_id = ["first text of the id seven", "quite another story under one number"]
    rows = [(None, t) for t in apart] + [(7, t) for t in one_id] + [(None, base), (None, base.upper()), (4, "linked Text, twice"), (None, "linked text, twice")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in apart] + [(7, t) for t in one_id] + [(4, "linked Text, twice")]
    got = [(r["doc_id"], r["text"]) for r in got]
    assert len(got) == len(want) + 1 and set(want) < set(got)
    assert sum(t.lower() == base for _, t in got) == 1


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], brute_print(r["text"])) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    want = brute_components(docs)
    got = QUERIES["op8_simhash"](spark, SF_MID).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted((d, p, want[p]) for d, p in docs)
    assert len({r["component_id"] for r in got}) < len(got)
