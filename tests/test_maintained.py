"""States that are stored and merged: scalers, designs, custom features; folders that change as a whole."""

import random
from pathlib import Path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ampfold.catalog.sessions_q import longest_steady_current
from ampfold.operators import mergeable, scaling
from ampfold.operators import sessions as ses
from ampfold.operators.cycles import early_cycle_stats
from ampfold.plans import life
from ampfold.plans.maintained import MaintainedDesign
from ampfold.sinks import versions
from ampfold.sources import session_csv
from tests.conftest import write_csv


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), i, 1e6 + rng.random(), rng.choice([None, float("nan"), 2.0, 5.0]), None, 7.0)
            for i in range(3000)] + [("alone", 3000, 4.0, None, None, 7.0)]
    return spark.createDataFrame(rows, "g string, t int, x double, y double, z double, c double").persist()


def state_of(state, *keys):
    return {tuple(r[k] for k in (*keys, "column")): [r[s] for s in scaling.STATE] for r in state.collect()}


@pytest.mark.parametrize("group", [None, "g"])
def test_merged_states_are_those_of_all_rows(values, group):
    cols, keys = ["x", "y", "z", "c"], [group] if group else []
    whole = state_of(scaling.scaler_state(values, cols, group), *keys)
    parts = [scaling.scaler_state(values.where(F.pmod("t", F.lit(7)) == i), cols, group) for i in range(7)]
    parts.append(scaling.scaler_state(values.limit(0), cols, group))
    merged = state_of(scaling.merge_scaler_states(parts, group), *keys)
    twice = state_of(scaling.merge_scaler_states([scaling.merge_scaler_states(parts[:3], group), *parts[3:]], group), *keys)
    assert set(merged) == set(whole) == set(twice) and len(whole) == (4 if group is None else 20)
    for k, want in whole.items():
        for got in (merged[k], twice[k]):
            assert got[0] == want[0] and got[1:] == [None if w is None else pytest.approx(w, rel=1e-9, abs=1e-9) for w in want[1:]], k


def test_scaling_by_a_stored_state(spark, values, tmp_root):
    scaling.scaler_state(values, ["x", "c"], "g").write.parquet(f"{tmp_root}/state")
    state = spark.read.parquet(f"{tmp_root}/state")
    got = scaling.scale_by_state(values, state, ["x", "c"], "g", suffix="_s")
    want = scaling.normalize_columns(values.where("g IS NOT NULL"), ["x", "c"], "g", suffix="_w")
    both = got.join(want.select("t", "x_w", "c_w"), "t")
    assert both.count() == values.where("g IS NOT NULL").count() and got.count() == values.count()
    assert both.where("abs(x_s - x_w) > 1e-9 OR abs(c_s - c_w) > 1e-9 OR x_s IS NULL").count() == 0
    all_rows = scaling.scaler_state(values, ["x", "c"])
    row = scaling.scale_by_state(values, all_rows, ["x", "c"], kind="standard").agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert row[0] == pytest.approx(0, abs=1e-5) and row[1] == pytest.approx(1, rel=1e-6) and row[2] == 0.0
    design = VectorAssembler(inputCols=["x", "c"], outputCol="features").transform(values)
    fitted = scaling.ZeroSafeMinMaxScaler().fit(design)
    stored = scaling.minmax_model_of(all_rows, ["x", "c"])
    assert stored.getOrDefault(stored.originalMin) == fitted.getOrDefault(fitted.originalMin)
    labels = values.select(F.col("t").alias("label"))
    fit = scaling.LogStandardTarget().fit(labels)
    made = scaling.target_model_of(scaling.scaler_state(labels.select(F.log1p("label").alias("y")), ["y"]), "y")
    assert made.getOrDefault(made.mean) == pytest.approx(fit.getOrDefault(fit.mean)) and made.getOrDefault(made.std) == pytest.approx(fit.getOrDefault(fit.std))
    with pytest.raises(ValueError, match="no row has a label"):
        scaling.LogStandardTarget().fit(labels.limit(0))


def test_design_of_batches_in_any_order(spark, values, tmp_root, monkeypatch):
    whole = {r["g"]: r.asDict() for r in early_cycle_stats(values.where("g IS NOT NULL"), "g", "t", ["x", "y"], n=40).collect()}
    for order in ((0, 1, 2), (2, 1, 0)):
        kept = MaintainedDesign(spark, f"{tmp_root}/d{order[0]}", "g", "t", ["x", "y"], n=40)
        with pytest.raises(ValueError, match="no batch"):
            kept.design()
        for i in order:
            assert kept.append(values.where((F.pmod("t", F.lit(3)) == i) | (F.lit(i == 1) & F.col("t").isNull())), f"b{i}")
            assert not kept.append(values, f"b{i}")  # a batch that comes again adds nothing
        assert kept.append(values.limit(0), "empty") and kept.batches() == ["b0", "b1", "b2", "empty"]
        got = {r["g"]: r.asDict() for r in kept.design().collect()}
        assert set(got) == {*whole, None}
        for g, want in whole.items():
            assert got[g]["final_cycles"] == want["final_cycles"]
            assert all(got[g][k] == pytest.approx(v, rel=1e-9) for k, v in want.items() if k != "g"), g

    def breaks(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr("ampfold.plans.maintained.merged_totals", breaks)  # between the tables of a version
    with pytest.raises(RuntimeError, match="broken"):
        kept.append(values, "late")
    assert kept.batches() == ["b0", "b1", "b2", "empty"]
    assert {r["g"]: r["final_cycles"] for r in kept.design().collect()} == {g: r["final_cycles"] for g, r in got.items()}


def test_versions(spark, tmp_root):
    out = f"{tmp_root}/v/"
    assert versions.current_version(spark, out) is None
    for i in range(4):
        at = versions.publish(spark, out, lambda path, i=i: spark.range(i + 1).write.parquet(f"{path}/t"), keep=2)
        assert versions.current_version(spark, out) == at and spark.read.parquet(f"{at}/t").count() == i + 1
    assert len(list(Path(out).glob("version-*"))) == 2 and len([p for p in (Path(out) / versions.MARKERS).iterdir() if p.name[0] != "."]) == 2


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_root, monkeypatch):
    rng = random.Random(1)
    rows = [(f"b{i}", 50 + i, float(i), rng.random()) for i in range(12)]
    design = VectorAssembler(inputCols=["f", "n"], outputCol="features").transform(spark.createDataFrame(rows, "battery_id string, final_cycles long, f double, n double"))
    first = life.run_variant_a(design, preset=dict(numTrees=3, maxDepth=2, seed=1), folds=2)
    out = f"{tmp_root}/report"
    with pytest.raises(FileNotFoundError):
        life.read_report(spark, out)
    life.publish_report(first, out)
    kept = life.read_report(spark, out)
    rmse = kept.metrics.first()["rmse"]
    assert kept.predictions.count() == 12 and kept.ranking is None and kept.model is not None

    def breaks(*_):
        raise RuntimeError("broken")

    second = life.LifeResult(first.predictions.limit(5), first.metrics.withColumn("rmse", F.lit(-1.0)), first.importances, first.model)
    monkeypatch.setattr(life.modeling, "save_model", breaks)  # all tables stand by then
    with pytest.raises(RuntimeError, match="broken"):
        life.publish_report(second, out)
    now = life.read_report(spark, out)
    assert now.metrics.first()["rmse"] == rmse and now.predictions.count() == 12
    monkeypatch.undo()
    life.publish_report(second, out)
    assert life.read_report(spark, out).metrics.first()["rmse"] == -1.0 and life.read_report(spark, out).predictions.count() == 5


def test_mergeable_extractors(spark, tmp_root, monkeypatch):
    rng, root = random.Random(4), Path(tmp_root)
    runs = [(rng.randrange(3), rng.randrange(1, 90)) for _ in range(400)]
    current = [v for v, n in runs for _ in range(n)]
    write_csv(root / "v" / "hot_20230101_000001.csv", "charge_current,note\n" + "".join(f"{c},x\n" for c in current))
    for i in range(5):
        write_csv(root / "v" / f"small{i}_20230101_000001.csv", f"charge_current\n{i}\n{i}\n{i + (i > 2)}\n")
    write_csv(root / "v" / "none_20230101_000001.csv", "charge_current\n")
    folded = "charge_current,note\n" + "".join(f'{c},"x\ny"\n' for c in current[:3000])
    write_csv(root / "v" / "folded_20230101_000001.csv", folded)

    def longest(pdf):
        v = pdf[session_csv.CURRENT]
        return (v != v.shift()).cumsum().value_counts().max()

    def boom(*_):
        raise RuntimeError("fails")

    count = ses.MergeableExtractor("rows", lambda: 0, lambda s, pdf: s + len(pdf), lambda a, b: a + b, lambda s: {"rows": s, "shared": s}, (session_csv.CURRENT,))
    bad = ses.MergeableExtractor("bad", lambda: 0, boom, lambda a, b: a, lambda s: s, (session_csv.CURRENT,))
    late = ses.MergeableExtractor("late", lambda: 0, lambda s, pdf: s, lambda a, b: a, boom, (session_csv.CURRENT,))
    extractors = [longest_steady_current(), ses.PandasExtractor("whole", longest), count, bad, late, ses.ColumnExtractor("shared", lambda: F.lit(-1.0))]
    name = lambda p: p.rsplit("/", 1)[-1].split("_")[0]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        monkeypatch.setattr(mergeable, "MERGE_BYTES", 12_000)
        monkeypatch.setattr(mergeable, "FAN_IN", 2)
        tree = ses.SessionTree(spark, tmp_root)
        found = {name(r["session_file"]): r for r in tree.features(extractors).collect()}
        assert tree.rows.where(F.col("session_file").contains("/hot_")).select("_bs").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert set(found) == {"hot", "folded", "none", *(f"small{i}" for i in range(5))}
    for n, r in found.items():
        if n == "none":
            assert not r["custom"]
            continue
        assert r["custom"]["steady_rows"] == r["custom"]["whole"], n
        assert r["custom"]["rows"] == r["n_rows"] and r["custom"]["shared"] == -1.0 and not {"bad", "late"} & set(r["custom"])
        assert sorted(e.split(":")[0] for e in r["extractor_errors"]) == ["bad", "late"]
    assert found["hot"]["custom"]["rows"] == len(current)


def test_states_are_merged_without_a_call_for_each_session(spark, tmp_root):
    """Sessions cost no group of pandas frames each: states arrive sorted, in batches."""
    write_csv(Path(tmp_root) / "v" / "a_20240101_000000.csv", "charge_current\n1\n1\n2\n")
    rows = session_csv.read_sessions(spark, tmp_root)
    plan = mergeable.merged_features(rows, ses.KEY, session_csv.ORDER, [(0, longest_steady_current())])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
