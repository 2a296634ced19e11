"""Ring sharding and exact duplicates against per-row simulations."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ampfold.llm import exact_dedup, sharding


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_ring(keys, shards, vnodes):
    """Every key alone walks clockwise, round by round, in ring order."""
    points, owners = sharding.ring(shards, vnodes)
    room = sharding.capacities(len(keys), shards, 0.0)
    at = {}
    for i, k in enumerate(keys):
        p = sharding.ring_point("" if k is None else str(k))
        arc = next((j for j, q in enumerate(points) if q >= p), 0)
        at[i] = (arc, p <= points[0], p)
    out, waiting = {}, sorted(at, key=lambda i: (*at[i], -1 if keys[i] is None else keys[i]))
    hops = 0
    while waiting:
        rest = []
        for i in waiting:
            s = owners[(at[i][0] + hops) % len(owners)]
            if room[s]:
                room[s] -= 1
                out[i] = s
            else:
                rest.append(i)
        waiting, hops = rest, hops + 1
    return out


def test_ring_equals_row_by_row_walk(spark):
    keys = list(range(1003))
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string").repartition(5)
    got = rows_of(sharding.shard_documents(df, shards=8, virtual_nodes=16))
    want = brute_ring(keys, 8, 16)
    assert {r["doc_id"]: r["shard"] for r in got} == want
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for r in got:
        t = f"t{r['doc_id']}".encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        assert (r["hops"] == 0) <= (r["shard"] == r["home_shard"])


def test_ring_moves_little_when_a_shard_is_added(spark):
    keys = list(range(4000))
    a, b = brute_ring(keys, 8, 128), brute_ring(keys, 9, 128)
    moved = sum(a[k] != b[k] for k in keys) / len(keys)
    assert moved < 0.45  # a modulo would move 8/9; 1/9 must move at least


def test_ring_with_hot_key_nulls_and_clashing_columns(spark):
    rows = [(7, None)] * 300 + [(None, "x")] * 5 + [(i, "é" * i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine"))
    got = rows_of(sharding.shard_documents(df))
    assert len(got) == 405
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert {r["size"] for r in got if r["doc_id"] == 7} >= {1}
    assert sharding.shard_documents(df.limit(0)).count() == 0
    kept = sharding.shard_rows(df.select("doc_id", "shard"))
    assert sorted(kept.columns) == ["doc_id", "home_shard", "hops", "shard", "slot"]


def brute_dedup(rows, keep):
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(i)
    out = []
    for norm, members in groups.items():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        keep_id = (max if keep == "max" else min)(ids) if ids else None
        out += [(rows[i][0], keep_id, len(members), hashlib.sha256(norm.encode()).hexdigest()) for i in members]
    return out


CASES = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "Élan"), (7, "élan"), (None, "same text"),
         (None, "only null id"), (9, "a" * 200_000), (10, "A" * 200_000), (11, "x\n"), (12, "x")]


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("bits", [None, 1])
def test_exact_duplicates_equal_brute_force(spark, keep, bits):
    rows = CASES + [(100 + i, f"copy {i % 3}") for i in range(400)] + [(7, "élan")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    weak = {} if bits is None else {"hash_of": lambda t: F.substring(exact_dedup.content_hash(t), 1, bits)}
    df = df.withColumns({"keep_id": F.lit("mine"), "_n": F.lit(0)})
    got = rows_of(exact_dedup.exact_duplicates(df, keep=keep, fold_case=True, **weak))
    want = brute_dedup(rows, keep)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_collision_filter_sees_every_shared_hash(spark):
    df = spark.range(3000).select(F.concat(F.lit("t"), F.col("id") % 1500).alias("_text"))
    h = F.unhex(F.substring(F.md5(F.col("_text")), 1, 4))  # 16 bits: collisions are certain
    shared = df.select(h.alias("_h")).groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1")
    got = {bytes(r[0]) for r in exact_dedup.collided_hashes(df, F.col("_text"), h, shared).collect()}
    seen = {}
    for i in range(1500):
        seen.setdefault(hashlib.md5(f"t{i}".encode()).digest()[:2], set()).add(i)
    assert got == {k for k, v in seen.items() if len(v) > 1}


def test_dropping_keeps_columns_and_one_row_each(spark):
    rows = CASES + [(2, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    out = exact_dedup.drop_exact_duplicates(df, keep="max", fold_case=True)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 5, 6, 7, 10, 11, 12]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_user_columns_of_any_name_keep_their_values(spark):
    from ampfold.llm import simhash

    mine = ["_id", "_sha", "_folded", "_point", "_arc", "_row", "_rank", "_seat", "_doc", "_chunk", "_index", "_of", "Root", "fp", "a.b"]
    rows = [(i, f"Text number {i // 2} of them all", *[f"{c}{i}" for c in mine]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *mine]).repartition(3)
    made = {
        "exact": exact_dedup.drop_exact_duplicates(df, keep="max", fold_case=True), "exact, as they are": exact_dedup.drop_exact_duplicates(df),
        "near": simhash.drop_near_duplicates(df), "shards": sharding.shard_rows(df, "doc_id", 3),
    }
    for name, out in made.items():
        got = out.collect()
        assert len(got) == (12 if name == "shards" else 6 if "exact" in name else len(got)) and got, name
        for r in got:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in mine), name
