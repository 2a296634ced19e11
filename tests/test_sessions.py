"""Golden session features (G1), degenerate inputs (G7), readers (G8), path datetime (G2)."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ampfold.functions.paths import path_datetime
from ampfold.operators import sessions as ses
from ampfold.sources import session_csv
from tests.conftest import write_csv

G1 = """available_capacity,max_cell_voltage,charge_current,max_temperature,charging_duration_seconds,interpolated_dqdv
0,3.0,10,25,0,-1
1,3.2,10,25,60,2
2,,10.05,26,120,8
3,3.5,,26,,8
4,3.9,12,26,240,
5,4.0,12,27,330,1
"""

G1_EXPECTED = {
    ses.F_V_SLOPE: 0.2058139534883721, ses.F_V_R2: 0.9740392985947022, ses.F_V_MEAN: 3.52,
    ses.F_C_UNIQUE: 4, ses.F_C_MODE: 10.0, ses.F_C_JUMPS: 0,
    ses.F_T_UNIQUE: 3, ses.F_T_MODE: 26.0, ses.F_T_JUMPS: 2,
    ses.F_D_SLOPE: 64.53488372093022, ses.F_D_MEAN: 150.0,
    ses.F_Q_MAX: 8.0, ses.F_Q_PEAK: 2.0, ses.F_Q_AREA: 22.5, ses.F_Q_POS: 22.0,
}


def reversed_header(text: str) -> str:
    lines = [ln.split(",") for ln in text.strip().splitlines()]
    return "\n".join(",".join(reversed(r)) for r in lines) + "\n"


def features_of(spark, root):
    rows = session_csv.read_sessions(spark, str(root))
    return {r["session_file"].rsplit("/", 1)[-1]: r.asDict() for r in ses.session_features(rows).collect()}


def assert_close(got, exp):
    for k, v in exp.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def test_g1_golden_both_header_orders(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v1" / "a_20230101_010203.csv", G1)
    write_csv(root / "v1" / "deep" / "b_20230102_010203.csv", reversed_header(G1))
    feats = features_of(spark, root)
    assert set(feats) == {"a_20230101_010203.csv", "b_20230102_010203.csv"}
    for f in feats.values():
        assert f["vehicle"] == "v1"
        assert_close(f, G1_EXPECTED)


def test_g1_file_split_over_many_partitions(spark, tmp_root):
    root = Path(tmp_root)
    body = "".join(G1.splitlines(keepends=True)[1:]) * 400
    write_csv(root / "v1" / "s_20230101_010203.csv", G1.splitlines()[0] + "\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        rows = session_csv.read_sessions(spark, str(root))
        assert rows.rdd.getNumPartitions() > 5
        many = ses.session_features(rows).first().asDict()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    one = ses.session_features(session_csv.read_sessions(spark, str(root))).first().asDict()
    for k in ses.FEATURES:
        assert many[k] == pytest.approx(one[k], rel=1e-9), k
    # repeated blocks: jumps across block boundaries (12 -> 10, 27 -> 25) are counted
    assert many[ses.F_C_JUMPS] == 399
    assert many[ses.F_T_JUMPS] == 2 * 400 + 399


def test_g7_degenerate(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v" / "constx_20230101_000001.csv", "available_capacity,max_cell_voltage\n1,2\n1,3\n1,4\n")
    write_csv(root / "v" / "consty_20230101_000002.csv", "available_capacity,max_cell_voltage\n1,2\n2,2\n3,2\n")
    write_csv(root / "v" / "onepair_20230101_000003.csv", "available_capacity,max_cell_voltage\n1,2\n,3\n")
    write_csv(root / "v" / "nocap_20230101_000004.csv", "max_cell_voltage,interpolated_dqdv\n2,1\n3,5\n")
    write_csv(root / "v" / "neg_20230101_000005.csv", "available_capacity,interpolated_dqdv\n1,-1\n2,-2\n3,0\n")
    write_csv(root / "v" / "qempty_20230101_000006.csv", "available_capacity,interpolated_dqdv,charge_current\n1,,1\n2,,1\n")
    write_csv(root / "v" / "text_20230101_000007.csv", "available_capacity,charge_current\n1,abc\n2,1\n")
    f = features_of(spark, root)
    assert f["constx_20230101_000001.csv"][ses.F_V_SLOPE] == 0.0
    assert f["constx_20230101_000001.csv"][ses.F_V_R2] == 0.0
    assert f["consty_20230101_000002.csv"][ses.F_V_SLOPE] == 0.0
    assert f["consty_20230101_000002.csv"][ses.F_V_R2] == 1.0
    assert f["onepair_20230101_000003.csv"][ses.F_V_SLOPE] == 0.0
    assert f["onepair_20230101_000003.csv"][ses.F_V_MEAN] == 2.5
    nocap = f["nocap_20230101_000004.csv"]
    assert nocap[ses.F_V_SLOPE] == 0.0 and nocap[ses.F_V_R2] == 0.0
    assert nocap[ses.F_Q_MAX] == 5.0 and nocap[ses.F_Q_PEAK] is None
    assert nocap[ses.F_Q_AREA] is None and nocap[ses.F_Q_POS] is None
    assert nocap[ses.F_C_UNIQUE] is None and nocap[ses.F_D_SLOPE] is None
    assert f["neg_20230101_000005.csv"][ses.F_Q_POS] == 0.0
    assert f["neg_20230101_000005.csv"][ses.F_Q_AREA] == pytest.approx(-2.5)
    qe = f["qempty_20230101_000006.csv"]
    assert qe["dqdv_all_missing"] and qe[ses.F_Q_MAX] is None and qe[ses.F_Q_AREA] is None
    assert qe[ses.F_C_UNIQUE] == 1
    assert f["text_20230101_000007.csv"]["non_numeric"]
    rej = {r["reason"] for r in ses.rejected_sessions(ses.session_features(
        session_csv.read_sessions(spark, str(root)))).collect()}
    assert rej == {"non_numeric", "dqdv_all_missing"}


def test_g8_tokens_and_by_name(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v" / "t_20230101_000001.csv",
              "max_cell_voltage,x\nNaN,1\nnan,1\nNA,1\ninf,1\n-inf,1\nInfinity,1\n,1\n")
    write_csv(root / "v" / "yx_20230101_000002.csv", "charge_current,max_cell_voltage\n7,8\n")
    write_csv(root / "v" / "y_20230101_000003.csv", "charge_current\n9\n")
    rows = session_csv.read_sessions(spark, str(root))
    t = [r[session_csv.VOLTAGE] for r in rows.where(F.col("session_file").contains("/t_")).orderBy("_bs", "_mid").collect()]
    assert t == [None, None, None, float("inf"), float("-inf"), float("inf"), None]
    yx = rows.where(F.col("session_file").contains("/yx_")).first()
    assert yx[session_csv.VOLTAGE] == 8.0 and yx[session_csv.CURRENT] == 7.0
    y = rows.where(F.col("session_file").contains("/y_")).first()
    assert y[session_csv.VOLTAGE] is None and y[session_csv.CURRENT] == 9.0
    assert not y[f"_has_{session_csv.VOLTAGE}"]


def test_g2_path_datetime(spark):
    paths = ["v1/20230101_010203/a.csv", "v1/b_20230102_030405.csv", "v1/20231399_101010.csv",
             "v1/20230229_101010.csv", "v1/plain.csv", "v1/20230101_010260.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [str(r[0]) for r in df.select(path_datetime("p")).collect()]
    assert got == ["2023-01-01 01:02:03", "2023-01-02 03:04:05", "0001-01-01 00:00:00", "0001-01-01 00:00:00",
                   "0001-01-01 00:00:00", "0001-01-01 00:00:00"]


def test_root_files_ignored_and_profile(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "root_20230101_000000.csv", "charge_current\n1\n")
    write_csv(root / "v" / "a_20230101_000001.csv", "charge_current,max_temperature\n1,2\n3,4\n")
    write_csv(root / "v" / "h_20230101_000002.csv", "charge_current\n")
    rows = session_csv.read_sessions(spark, str(root), path_columns=True)
    assert {r["vehicle"] for r in rows.collect()} == {"v", ""}  # root files have no group ...
    feats = ses.session_features(session_csv.read_sessions(spark, str(root)))
    assert {r["vehicle"] for r in feats.collect()} == {"v"}     # ... and are left out of the features
    prof = {r["file"].rsplit("/", 1)[-1]: r for r in session_csv.file_profile(spark, str(root)).collect()}
    assert prof["a_20230101_000001.csv"]["n_cols"] == 2 and prof["a_20230101_000001.csv"]["n_rows"] == 2
    assert prof["h_20230101_000002.csv"]["n_rows"] == 0
    assert prof["root_20230101_000000.csv"]["vehicle"] == ""


def test_timeline_and_summary(spark, tmp_root):
    root = Path(tmp_root)
    for name in ["b_20230102_000000.csv", "a_20230101_000000.csv", "c_20230101_000000.csv"]:
        write_csv(root / "v" / name, "charge_current\n1\n")
    write_csv(root / "w" / "z.csv", "charge_current\n1\n")
    f = ses.session_features(session_csv.read_sessions(spark, str(root)))
    tl = {r["session_file"].rsplit("/", 1)[-1]: r["position"] for r in ses.session_timeline(f).collect()}
    assert tl["a_20230101_000000.csv"] == 0 and tl["c_20230101_000000.csv"] == 1 and tl["b_20230102_000000.csv"] == 2
    assert tl["z.csv"] == 0
    summ = {r["vehicle"]: r for r in ses.run_summary(f).collect()}
    assert summ["v"]["n_files"] == 3 and summ[None]["n_files"] == 4 and summ[None]["n_groups"] == 2
    assert summ["w"]["first_time"] == "0001-01-01 00:00:00"


def test_custom_extractors(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v" / "s_20230101_000001.csv", G1)

    def boom(pdf):
        raise RuntimeError("fails")

    ex = [ses.ColumnExtractor("v_span", lambda: F.max(session_csv.VOLTAGE) - F.min(session_csv.VOLTAGE)),
          ses.ColumnExtractor("multi", lambda: {"n_cap": F.count(session_csv.CAPACITY),
                                                ses.F_V_MEAN: F.lit(-1.0)}),
          ses.PandasExtractor("q_median", lambda pdf: pdf[session_csv.DQDV].median()),
          ses.PandasExtractor("bad", boom)]
    r = ses.session_features(session_csv.read_sessions(spark, str(root)), ex).first()
    assert r["custom"]["v_span"] == pytest.approx(1.0)
    assert r["custom"]["n_cap"] == 6.0
    assert r["custom"]["q_median"] == 2.0
    assert ses.F_V_MEAN not in r["custom"]  # built-in wins
    assert r[ses.F_V_MEAN] == pytest.approx(3.52)
    assert "bad" not in r["custom"] and any("bad" in e for e in r["extractor_errors"])


def test_charset_profile(spark, tmp_root):
    root = Path(tmp_root)
    (root / "v").mkdir(parents=True)
    (root / "v" / "u.csv").write_bytes(b"a,b\n1,2\n")
    (root / "v" / "l.csv").write_bytes(b"caf\xe9,b\n1,2\n")
    got = {r["file"].rsplit("/", 1)[-1]: r["charset"] for r in session_csv.charset_profile(spark, str(root)).collect()}
    assert got == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1"}


def test_feature_csv_export_sorted_per_vehicle(spark, tmp_root):
    from ampfold.sinks.writers import write_feature_csv

    root = Path(tmp_root)
    for name, value in [("b_20230102_000000.csv", 2), ("a_20230101_000000.csv", 1), ("c_20230103_000000.csv", 3)]:
        write_csv(root / "in" / "v" / name, f"charge_current\n{value}\n")
    f = ses.session_features(session_csv.read_sessions(spark, str(root / "in")))
    write_feature_csv(f, str(root / "out"), ses.FEATURES)
    files = sorted((root / "out" / "vehicle=v").glob("*.csv"))
    lines = [ln for p in files for ln in p.read_text().splitlines()[1:]]
    assert [ln.split(",")[ses.FEATURES.index(ses.F_C_MODE)] for ln in lines] == ["1.0", "2.0", "3.0"]


def test_streaming_matches_batch(spark, tmp_root):
    from ampfold.streaming.sessions import read_features, start_session_features

    root = Path(tmp_root)
    write_csv(root / "in" / "v1" / "a_20230101_010203.csv", G1)
    write_csv(root / "in" / "v2" / "b_20230102_010203.csv", reversed_header(G1))
    q = start_session_features(spark, str(root / "in"), str(root / "out"))
    q.awaitTermination()
    rows = read_features(spark, str(root / "out")).collect()
    assert len(rows) == 2
    for r in rows:
        assert_close(r.asDict(), G1_EXPECTED)


def test_header_only_sessions_are_kept(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v" / "full_20230101_000001.csv", G1)
    write_csv(root / "v" / "hq_20230101_000002.csv", "available_capacity,max_cell_voltage,charge_current,interpolated_dqdv\n")
    write_csv(root / "v" / "h_20230101_000003.csv", "max_temperature\n")
    f = {r["session_file"].rsplit("/", 1)[-1]: r.asDict() for r in ses.SessionTree(spark, str(root)).features().collect()}
    assert set(f) == {"full_20230101_000001.csv", "hq_20230101_000002.csv", "h_20230101_000003.csv"}
    assert_close(f["full_20230101_000001.csv"], G1_EXPECTED)
    hq = f["hq_20230101_000002.csv"]
    assert hq[ses.F_V_SLOPE] == 0.0 and hq[ses.F_V_R2] == 0.0 and hq[ses.F_V_MEAN] is None
    assert hq[ses.F_C_UNIQUE] == 0 and hq[ses.F_C_JUMPS] == 0 and hq[ses.F_C_MODE] is None
    assert hq[ses.F_T_UNIQUE] is None and hq[ses.F_Q_MAX] is None and hq["dqdv_all_missing"]
    h = f["h_20230101_000003.csv"]
    assert h[ses.F_T_UNIQUE] == 0 and h[ses.F_V_SLOPE] is None and not h["dqdv_all_missing"]
    assert str(h["session_ts"]) == "2023-01-01 00:00:03"


def test_input_contract(spark, tmp_root):
    root = Path(tmp_root)
    head = "available_capacity,max_cell_voltage,charge_current,max_temperature,charging_duration_seconds,interpolated_dqdv"
    write_csv(root / "v" / "ok_20230101_000001.csv", G1)
    write_csv(root / "v" / "wide_20230101_000002.csv", head + "," + "x" * 90_000 + "\n")
    write_csv(root / "v" / "lines_20230101_000003.csv", head + ',note\n1,10,5,20,7,1,"a\nb"\n2,30,5,21,7,3,"c"\n')
    write_csv(root / "v" / "ragged_20230101_000004.csv", head + "\n1,10,5,20,7,1\n2,30,5,20,7,1,9\n")
    write_csv(root / "v" / "nothing_20230101_000005.csv", "")
    write_csv(root / "v" / "text_20230101_000006.csv", head + "\n1,abc,5,20,7,1\n")
    write_csv(root / "v" / "cap_20230101_000007.csv", "available_capacity,max_cell_voltage\nx,10\n2,20\n3,40\n")
    write_csv(root / "v" / "capq_20230101_000008.csv", "available_capacity,interpolated_dqdv\nx,10\n2,20\n")
    tree = ses.SessionTree(spark, str(root))
    name = lambda p: p.rsplit("/", 1)[-1].split("_")[0]
    f = {name(r["session_file"]): r.asDict() for r in ses.valid_sessions(tree.features()).collect()}
    assert set(f) == {"ok", "wide", "lines", "cap"}
    assert_close(f["ok"], G1_EXPECTED)
    assert f["lines"]["n_rows"] == 2 and f["lines"][ses.F_V_SLOPE] == 20.0
    assert f["cap"][ses.F_V_SLOPE] == 0.0 and f["cap"][ses.F_V_R2] == 0.0 and round(f["cap"][ses.F_V_MEAN], 6) == round(70 / 3, 6)
    rejected = {(name(r["path"]), r["reason"]) for r in tree.rejected().collect()}
    assert rejected == {("wide", "dqdv_all_missing"), ("ragged", "ragged"), ("text", "non_numeric"), ("capq", "non_numeric")}
    assert tree.sessions().count() == 7  # Spark does not list the empty file
    tree.release()
    assert not any(Path(p).exists() for p in tree.paths)
    with pytest.raises(ValueError):
        ses.SessionTree(spark, str(write_csv(root / "none" / "x.txt", "a").parent))


def test_extractors_with_one_name_last_wins(spark, tmp_root):
    root = Path(tmp_root)
    write_csv(root / "v" / "s_20230101_000001.csv", G1)
    tree = ses.SessionTree(spark, str(root))
    a = ses.ColumnExtractor("a", lambda: F.lit(1.0))
    b = ses.ColumnExtractor("b", lambda: {"a": F.lit(2.0), "b": F.lit(3.0)})
    p = ses.PandasExtractor("p", lambda pdf: {"a": 5.0, "c": None})
    custom = lambda *ex: tree.features(ex).first()["custom"]
    assert custom(a, b) == {"a": 2.0, "b": 3.0} and custom(b, a)["a"] == 1.0
    assert custom(a, p) == {"a": 5.0, "c": None} and custom(p, a)["a"] == 1.0


def test_charsets(spark, tmp_root):
    for name, data in (("u", "a,\u5907\n1,2\n".encode()), ("g", "a,\u5907\u6ce8\n1,2\n".encode("gbk")), ("l", "a,caf\xe9 x\n1,2\n".encode("latin-1"))):
        path = Path(tmp_root) / "v" / f"{name}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = {r["file"][-5]: r["charset"] for r in session_csv.charset_profile(spark, tmp_root).collect()}
    assert got == {"u": "UTF-8", "g": "GBK", "l": "ISO-8859-1"}


def test_a_file_cut_off_in_the_middle_is_left_out(spark, tmp_root):
    from ampfold.sources import cycle_csv
    from ampfold.streaming.sessions import read_features, read_rejected, start_session_features

    rng, root = random.Random(5), Path(tmp_root)
    lines = "".join(f"{i},{rng.random()},{rng.random()}\n" for i in range(40_000))
    whole = gzip.compress(("available_capacity,max_cell_voltage,charge_current\n" + lines).encode())
    for folder in ("v/car", "w"):
        write_csv(root / folder / "ok_20230101_000001.csv", G1)
        (root / folder / "zipped_20230101_000002.csv.gz").write_bytes(whole)
        for i in (3, 4):
            (root / folder / f"cut{i}_ 20230101_00000{i}.csv.gz").write_bytes(whole[: len(whole) // 2])
    name = lambda p: p.rsplit("/", 1)[-1].split("_")[0]
    tree = ses.SessionTree(spark, str(root / "v"), glob="*.csv*")
    assert {name(r["session_file"]): r["n_rows"] for r in tree.features().collect()} == {"ok": 6, "zipped": 40_000}
    assert {(name(r["path"]), r["reason"]) for r in tree.rejected().collect()} == {("cut3", "unreadable"), ("cut4", "unreadable")}
    good, rej = cycle_csv.usable_cycles(spark, str(root / "w"), n_features=3, glob="z*_20*.csv*")
    assert good.count() == 40_000 and rej.count() == 0
    good, rej = cycle_csv.usable_cycles(spark, str(root / "w"), n_features=3, glob="[zc]*.csv*")
    assert good.count() == 40_000
    assert {(name(r["path"]), r["reason"]) for r in rej.collect()} == {("cut3", "unreadable"), ("cut4", "unreadable")}
    (root / "s").mkdir()
    write_csv(root / "s" / "v" / "ok_20230101_000001.csv", G1)
    (root / "s" / "v" / "cut_20230101_000002.csv").write_text("max_cell_voltage\n1,2\n")
    start_session_features(spark, str(root / "s"), str(root / "out")).awaitTermination()
    assert [name(r["session_file"]) for r in read_features(spark, str(root / "out")).collect()] == ["ok"]
    assert [(name(r["path"]), r["reason"]) for r in read_rejected(spark, str(root / "out")).collect()] == [("cut", "ragged")]
