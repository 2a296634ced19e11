"""The table manifest against a plain Python tree."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ampfold.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes, width):
    """The root, and for each hash its siblings by level."""
    proofs, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            run = p // width * width
            proofs[i].append((hashes[run:p], hashes[p + 1 : run + width]))
        at = [p // width for p in at]
        hashes = [sha("".join(hashes[i : i + width])) for i in range(0, len(hashes), width)]
    return hashes[0], proofs


def brute(rows, width=16):
    groups = {}
    for r in rows:
        groups.setdefault(b"\0" if r[1] is None else b"\1" + r[1].encode(), []).append(r)
    names = sorted(groups)
    own, subroots = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0], leaf(r)) if r[0] is not None else (False, 0, leaf(r)))
        own[g] = tree([leaf(r) for r in groups[g]], width)
        subroots.append(own[g][0])
    root, tops = tree(subroots, width)
    for g, top in zip(names, tops, strict=True):
        for r, proof in zip(groups[g], own[g][1], strict=True):
            path = proof + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            h = leaf((*r[:4], text))
            for left, right in path:
                h = sha("".join([*left, h, *right]))
            yield (r[0], leaf(r), own[g][0], root, sha("".join(x for a, b in path for x in [*a, *b])), h, h == root)


def digests(df):
    return sorted(map(tuple, manifest.verify_digest(df).collect()), key=repr)


def some_rows(n):
    rng = random.Random(3)
    rows = [(rng.randrange(10 * n), rng.choice(["a", "a", "a", "b", "é", None, "", "Z", "0", "one"]), rng.choice(["en", None]), i, rng.choice(["Ab", "", None, "x y Z", "ÄB"]))
            for i in range(n)]
    return [*rows, (None, "a", None, None, None), (None, "a", "en", 3, "Upper"), (7, "lone", "en", 1, "T"), (5, "twice", "en", 1, "T"), (5, "twice", "en", 1, "T")]


@pytest.mark.parametrize(("children", "levels"), [(2, 2), (3, 1), (2, 3)])
def test_small_blocks_climb_many_tiers(spark, monkeypatch, children, levels):
    monkeypatch.setattr(manifest, "CHILDREN", children)
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", children**levels)
    rows = some_rows(60)
    assert digests(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(brute(rows, children), key=repr)


def test_digest_equals_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"Text {i} " * (1 + i % 4)) for i in range(6500)] + some_rows(100) + [(10_001, None, "en", 1, "Ab" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    df = df.withColumns({"_pos": F.lit(1), "_hash": F.lit("x"), "leaf": F.lit(2), "path": F.lit(0), "_group": F.lit("g")})
    got, want = digests(df), sorted(brute(rows), key=repr)
    assert got == want
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize("rows", [[(1, "a", "en", 2, "Ab")], [(None, None, None, None, None)], []])
def test_one_row_and_none(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(df) == sorted(brute(rows) if rows else [], key=repr)


def test_general_operator_keeps_the_group_and_the_path(spark):
    df = spark.createDataFrame([(i, f"k{i % 2}", float(i)) for i in range(40)], "at int, part string, value double")
    rows = manifest.manifest(df, "part", "at", ["at", "value"], {"twice": F.col("value") * 2}).collect()
    assert len(rows) == 40 and {r["part"] for r in rows} == {"k0", "k1"}
    for r in rows:
        assert r["twice"] == 2 * r["at"] and r["leaf"] == sha(f"{len(str(r['at']))}:{r['at']}{len(str(float(r['at'])))}:{float(r['at'])}")
        h = r["leaf"]
        for step in r["path"]:
            h = sha(step["left"] + h + step["right"])
        assert h == r["root"] and len(r["path"]) == 3  # 20 leaves: two levels, and one over the groups


def test_texts_are_not_shuffled_nor_ordered_in_one_task(spark):
    df = spark.createDataFrame(some_rows(50), SCHEMA)
    plan = manifest.verify_digest(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Python|Arrow|Cartesian", plan) and "text#" not in plan
    assert "windowspecdefinition(_group" in plan and "_block" in plan
