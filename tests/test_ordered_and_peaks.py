"""Skew-safe ordered helpers vs brute force; peak detection vs a sequential reference (G9)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ampfold.operators import signals as ops
from ampfold.plans import ordered


def make_series(n_groups=6, hot=600, small=40, seed=7, levels=6):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        n = hot if g == 0 else small  # group 0 holds most of the rows
        for t in range(n):
            v = None if rnd.random() < 0.05 else float(rnd.randint(0, levels))
            rows.append((g, t, rnd.random(), v))
    return rows


def brute_jumps(rows, thr=0.1):
    out = {}
    by = {}
    for g, t, _, v in rows:
        by.setdefault(g, []).append((t, v))
    for g, seq in by.items():
        seq.sort()
        c = 0
        for (_, a), (_, b) in zip(seq, seq[1:]):
            if a is not None and b is not None and abs(b - a) > thr:
                c += 1
        out[g] = c
    return out


def brute_area(rows):
    out = {}
    by = {}
    for g, t, x, v in rows:
        if v is not None:
            by.setdefault(g, []).append((x, t, v))
    for g, pts in by.items():
        pts.sort()
        out[g] = sum((b[0] - a[0]) * (b[2] + a[2]) / 2 for a, b in zip(pts, pts[1:]))
    return out


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_adjacent_sums_match_brute_force_with_hot_group(spark, chunks):
    rows = make_series()
    df = spark.createDataFrame(rows, "g int, t int, x double, v double")
    got = {r["g"]: r["jumps"] for r in ops.jump_counts(df, "g", "t", {"jumps": "v"}).collect()}
    assert got == brute_jumps(rows)
    got2 = {r["g"]: r["s"] for r in ordered.adjacent_sums(
        df.where(F.col("v").isNotNull()), "g", ["x", "t"], ["x", "v"],
        {"s": ops.trapezoid_term("x", "v")}, num_chunks=chunks).collect()}
    exp = brute_area(rows)
    for g in exp:
        assert got2[g] == pytest.approx(exp[g], rel=1e-9, abs=1e-9)


def test_hot_group_is_split_over_chunks(spark):
    rows = make_series(hot=3000)
    df = spark.createDataFrame(rows, "g int, t int, x double, v double")
    chunks = ordered.range_chunks(df, ["g"], ["t"], num_chunks=8)
    n_chunks_hot = chunks.where("g = 0").select(ordered.CHUNK).distinct().count()
    assert n_chunks_hot >= 4  # the hot group is spread, never one task


def test_dense_positions_and_neighbors(spark):
    rows = make_series(hot=500)
    df = spark.createDataFrame(rows, "g int, t int, x double, v double")
    pos = {(r["g"], r["t"]): r["pos"] for r in ordered.dense_positions(df, "g", "t", num_chunks=7).collect()}
    assert all(pos[(g, t)] == t for g, t, _, _ in rows)
    nb = ordered.neighbors(df, "g", "t", ["v"], num_chunks=7).collect()
    vals = {(g, t): v for g, t, _, v in rows}
    for r in nb:
        assert r["pos"] == r["t"]
        assert r["prev_v"] == vals.get((r["g"], r["t"] - 1))
        assert r["next_v"] == vals.get((r["g"], r["t"] + 1))


def sequential_peaks(ys, rel=0.1, distance=5):
    """Plain-Python statement of the peak rules (ends excluded, plateau middle, height, distance)."""
    n = len(ys)
    cands = []
    i = 1
    while i < n - 1:
        if ys[i - 1] is not None and ys[i] is not None and ys[i - 1] < ys[i]:
            j = i
            while j + 1 < n and ys[j + 1] == ys[i]:
                j += 1
            if j + 1 < n and ys[j + 1] is not None and ys[j + 1] < ys[i]:
                cands.append(((i + j) // 2, ys[i]))
            i = j + 1
        else:
            i += 1
    mx = max(v for v in ys if v is not None)
    cands = [c for c in cands if c[1] >= rel * mx]
    keep = []
    for p, h in sorted(cands, key=lambda c: (c[1], c[0]), reverse=True):
        if all(abs(p - q) >= distance for q, _ in keep):
            keep.append((p, h))
    return sorted(keep)


def test_g9_golden(spark):
    ys = [0, 5, 0, 0, 9, 9, 0, 0, 3, 0, 0, 0, 0, 4, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(ys)], "g int, t int, y double")
    cands = [(r["position"], r["height"]) for r in ops.peak_candidates(df, "g", "t", "y").orderBy("position").collect()]
    assert cands == [(1, 5.0), (4, 9.0), (8, 3.0), (13, 4.0)]
    got = [(r["position"], r["height"]) for r in ops.peak_detection(df, "g", "t", "y").orderBy("position").collect()]
    assert got == [(4, 9.0), (13, 4.0)]


def test_monotone_and_constant_have_no_peaks(spark):
    rows = [(1, i, float(i)) for i in range(10)] + [(2, i, float(-i)) for i in range(10)] + [(3, i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, t int, y double")
    assert ops.peak_detection(df, "g", "t", "y").count() == 0


def test_peaks_match_sequential_reference_on_random_series(spark):
    rnd = random.Random(3)
    series = {}
    rows = []
    for g in range(30):
        ys = [float(rnd.randint(0, 5)) for _ in range(60)]
        series[g] = ys
        rows += [(g, t, y) for t, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "g int, t int, y double")
    got = {}
    for r in ops.peak_detection(df, "g", "t", "y").collect():
        got.setdefault(r["g"], []).append((r["position"], r["height"]))
    for g, ys in series.items():
        assert sorted(got.get(g, [])) == sequential_peaks(ys), g


def test_value_at_first_max_keeps_missing_x(spark):
    from ampfold.functions import signals as S

    df = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, None, 9.0), (1, 2, 3.0, 9.0), (1, 3, 4.0, 2.0),
                                (2, 0, 5.0, 1.0), (2, 1, 6.0, 3.0), (2, 2, 7.0, 3.0)],
                               "g int, t int, x double, y double")
    got = {r["g"]: r["xm"] for r in df.groupBy("g").agg(S.value_at_first_max("x", "y", ["t"]).alias("xm")).collect()}
    assert got == {1: None, 2: 6.0}


def test_value_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 2.0), (1, 1.0), (1, None), (2, None)], "g int, v double")
    got = {r["g"]: r["mode"] for r in ops.value_mode(df, "g", "v").collect()}
    assert got == {1: 1.0, 2: None}
    u = {r["g"]: r["n_unique"] for r in ops.unique_values(df, "g", "v").collect()}
    assert u == {1: 3, 2: 1}


@pytest.mark.parametrize("distance", [1, 3, 4.5, 5, 40])
def test_distance_rule_over_many_blocks(spark, monkeypatch, distance):
    monkeypatch.setattr(ops, "BLOCK_SAMPLES", 64)
    rnd = random.Random(int(distance * 10))
    rows = [(g, p, float(rnd.randint(0, 9))) for g in range(4) for p in sorted(rnd.sample(range(600), 200))]
    rows += [(9, 2 * p, float(p)) for p in range(300)]  # one rising run through all blocks
    df = spark.createDataFrame(rows, "g int, position long, height double")
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for p, h in sorted(((p, h) for k, p, h in rows if k == g), key=lambda c: (c[1], c[0]), reverse=True):
            if all(abs(p - q) >= distance for q, _ in kept):
                kept.append((p, h))
        want |= {(g, p, h) for p, h in kept}
    got = {tuple(r) for r in ops.select_by_distance(df, "g", distance).collect()}
    assert got == want


def test_long_rising_run_takes_few_rounds(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), (F.col("id") * 2).alias("position"), F.col("id").cast("double").alias("height"))
    got = sorted(r["position"] for r in ops.select_by_distance(df, "g", 5).collect())
    assert got == sorted(range(199_998, -1, -6))





@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("chunks", [None, 16])
def test_ordered_helpers_keep_every_wide_row(spark, aqe, chunks):
    """400,000 wide rows, 50 groups, one with a third of them: every row once, with its exact position."""
    n = 400_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 49 + 1).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("t"), F.col("id"), F.col("id").cast("double").alias("v"),
        *[(F.col("id") * i).cast("double").alias(f"x{i}") for i in range(15)],
    )
    w = Window.partitionBy("g").orderBy("t", "id")
    want = df.select("id", (F.row_number().over(w) - 1).cast("long").alias("want"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        got = ordered.dense_positions(df, "g", ["t", "id"], num_chunks=chunks)
        assert set(got.columns) == {*df.columns, "pos"}
        check = got.join(want, "id").agg(F.count("*"), F.count_if(F.col("pos") != F.col("want"))).first()
        assert tuple(check) == (n, 0)
        nb = ordered.neighbors(df, "g", ["t", "id"], ["v"], num_chunks=chunks)
        wrong = (F.col("pos") != F.col("want")) | ~F.col("prev_v").eqNullSafe(F.col("before")) | ~F.col("next_v").eqNullSafe(F.col("after"))
        assert tuple(nb.join(want, "id").agg(F.count("*"), F.count_if(wrong)).first()) == (n, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_leave_one_out_folds_are_all_there(spark):
    from ampfold.operators import modeling

    df = spark.range(200_000).select((F.col("id") * 7).alias("battery_id"), *[F.col("id").alias(f"f{i}") for i in range(15)])
    folds = modeling.with_folds(df, "battery_id", "loo")
    assert tuple(folds.agg(F.count("*"), F.countDistinct("fold"), F.count_if(F.col("fold") * 7 != F.col("battery_id"))).first()) == (200_000, 200_000, 0)


def test_global_positions_and_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (1, 1), (None, 2), (1, 0), (None, 2)], "g int, t int")
    pos = ordered.global_positions(df, [F.col("t").desc(), F.col("g").asc_nulls_first()], num_chunks=3)
    assert sorted((r["pos"], r["t"]) for r in pos.collect()) == [(0, 3), (1, 2), (2, 2), (3, 1), (4, 0)]
    own = ordered.dense_positions(df, "g", "t", num_chunks=4).collect()
    assert sorted(((r["g"] or 0), r["pos"]) for r in own) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_hot_groups_are_cut_without_a_range_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", limit)
    rows = [(g if g else None, t // 2, t, v) for g, t, _, v in make_series(hot=3000)]  # order with ties and a null group
    df = spark.createDataFrame(rows, "g int, t int, u int, v double").repartition(6)
    want = {}
    for g in {r[0] for r in rows}:
        vs = [r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        want[g] = sum(abs(b - a) > 1 for a, b in zip(vs, vs[1:]) if a is not None and b is not None)
    out = ordered.adjacent_sums(df, "g", ["t", "u"], ["v"], {"j": ops.jump_term("v", 1.0)})
    assert {r["g"]: r["j"] for r in out.collect()} == want
    plan = df.sparkSession.sql("select 1") and out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    cut = ordered.split_hot_groups(df, ["g"], "t").groupBy("g", "_chunk").count().collect()
    if limit == 100:
        assert len(cut) > 20 and max(r["count"] for r in cut) <= 4 * limit
