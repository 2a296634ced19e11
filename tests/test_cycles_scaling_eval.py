"""Early-cycle statistics (G3), target (G4), metrics (G5), scaling (G6), positional reader (G7)."""

import math
from pathlib import Path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ampfold.functions.cleaning import fill_nonfinite
from ampfold.operators import evaluation, scaling
from ampfold.operators.cycles import early_cycle_stats
from ampfold.sources import cycle_csv
from tests.conftest import write_csv


def test_g3_early_stats(spark):
    rows = [(1, i, v) for i, v in enumerate([2.0, 4.0, 9.0, 1.0])] + [(2, 0, 7.0)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    out = {r["g"]: r for r in early_cycle_stats(df, "g", "t", ["v"], n=40).collect()}
    a = out[1]
    assert (a["v_Mean"], a["v_Min"], a["v_Max"], a["v_First"], a["v_Last"]) == (4.0, 1.0, 9.0, 2.0, 1.0)
    assert a["v_Std"] == pytest.approx(3.082207001484488)
    assert a["v_Slope"] == pytest.approx(0.2)
    assert a["final_cycles"] == 4 and a["Cycle_Number_Slope"] == pytest.approx(1.0)
    b = out[2]
    assert [b[f"v_{s}"] for s in ["Mean", "Std", "Min", "Max", "First", "Last", "Slope"]] == [7, 0, 7, 7, 7, 7, 0]
    assert b["final_cycles"] == 1


def test_early_stats_limit_and_label(spark):
    rows = [(1, i, float(i)) for i in range(100)]
    out = early_cycle_stats(spark.createDataFrame(rows, "g int, t int, v double"), "g", "t", ["v"], n=40).first()
    assert out["final_cycles"] == 100 and out["v_Max"] == 39.0 and out["Cycle_Number_Max"] == 40.0


def test_nonfinite_fill(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(fill_nonfinite("v")).collect()] == [0.0, 1.0, -1.0, 2.0, 0.0]


def test_g4_target_roundtrip(spark):
    df = spark.createDataFrame([(100,), (200,), (400,)], "y long")
    m = scaling.LogStandardTarget(inputCol="y", outputCol="z").fit(df)
    assert m.getOrDefault(m.mean) == pytest.approx(5.304128950735635)
    assert m.getOrDefault(m.std) == pytest.approx(0.5629097460978687)
    rows = m.transform(df).withColumn("back", m.inverse(F.col("z"))).orderBy("y").collect()
    assert [r["z"] for r in rows] == pytest.approx([-1.22401227, -0.0014639, 1.22547616], abs=1e-7)
    assert [r["back"] for r in rows] == pytest.approx([100, 200, 400])


def test_g5_metrics_and_errors(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (400.0, 430.0), ], "actual double, predicted double")
    m = evaluation.regression_metrics(df).first()
    assert m["rmse"] == pytest.approx(19.148542155126762)
    assert m["mae"] == pytest.approx(16.666666666666668)
    assert m["r2"] == pytest.approx(0.9764285714285714)
    e = evaluation.prediction_errors(df).orderBy("actual").collect()
    assert [r["error_pct"] for r in e] == pytest.approx([10, 5, 7.5])
    assert [r["residual"] for r in e] == pytest.approx([-10, 10, -30])
    z = evaluation.prediction_errors(spark.createDataFrame([(0.0, 1.0)], "actual double, predicted double")).first()
    assert math.isinf(z["error_pct"])


def test_g6_zero_safe_minmax_and_persistence(spark, tmp_root):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = scaling.ZeroSafeMinMaxScaler(inputCol="features", outputCol="s").fit(v)
    got = [r[0] for r in m.transform(v).select(vector_to_array("s")).collect()]
    assert sorted(got) == [[0.0, 0.0], [1.0, 0.0]]
    path = str(Path(tmp_root) / "mm")
    m.write().overwrite().save(path)
    m2 = scaling.ZeroSafeMinMaxModel.load(path)
    assert [r[0] for r in m2.transform(v).select(vector_to_array("s")).collect()] == got


def test_normalize_columns_scopes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", None)], "g string, v double")
    glob = sorted((r["g"], r["v_n"]) for r in scaling.normalize_columns(df, ["v"], suffix="_n").collect()
                  if r["v_n"] is not None)
    assert glob == [("a", 0.0), ("a", 0.5), ("b", 1.0), ("b", 1.0)]
    per = sorted((r["g"], r["v_n"]) for r in scaling.normalize_columns(df, ["v"], group="g", suffix="_n").collect()
                 if r["v_n"] is not None)
    assert per == [("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_positional_reader_rejections(spark, tmp_root):
    root = Path(tmp_root)
    header15 = ",".join(f"h{i}" for i in range(16))
    ok_rows = "\n".join(",".join(str(i + r) for i in range(16)) for r in range(3))
    write_csv(root / "good.csv", header15 + "\n" + ok_rows + "\n")
    write_csv(root / "narrow.csv", ",".join(f"h{i}" for i in range(14)) + "\n" + ",".join("1" * 14) + "\n")
    write_csv(root / "header_only.csv", header15 + "\n")
    write_csv(root / "text.csv", header15 + "\n" + ",".join(["x"] + ["1"] * 15) + "\n")
    good, rej = cycle_csv.usable_cycles(spark, str(root))
    assert {r["battery_id"] for r in good.collect()} == {"good.csv"}
    assert good.count() == 3
    reasons = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in rej.collect()}
    assert reasons == {"narrow.csv": "too_few_columns", "header_only.csv": "empty", "text.csv": "non_numeric"}
