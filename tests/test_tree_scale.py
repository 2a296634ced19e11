"""Trees of many small files: written without a process for each file, listed in few tasks."""

from __future__ import annotations

from pathlib import Path

from conftest import write_csv

from ampfold.catalog import QUERIES
from ampfold.operators.sessions import SessionTree
from ampfold.session import few_listing_tasks
from ampfold.sinks.writers import write_feature_csv, write_partitioned, write_session_tree
from ampfold.sources import cycle_csv, listing, session_csv

ROWS = [
    ("a", "s1", 2, 1.5, 'say "x", y'), ("a", "s1", 1, None, "two\nlines"), ("a", "s 2:%", 1, -0.0, " pad "), (None, "s1", 1, 1e20, ""),
    ("", None, 1, float("nan"), None), ("b=c", "sé", 1, 3.0, "\\"),
]


def _files(root: Path) -> dict[str, bytes]:
    return {str(p.parent.relative_to(root)): p.read_bytes() for p in root.rglob("*.csv")}


def test_session_tree_has_the_bytes_of_sparks_writer(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "g string, s string, i int, x double, t string")
    write_session_tree(df, str(tmp_path / "own"), "g", "s", ["i"], ["x", "t"])
    (df.repartition(3, "g", "s").sortWithinPartitions("g", "s", "i").drop("i").write.option("header", True)
     .partitionBy("g", "s").csv(str(tmp_path / "spark")))
    own = _files(tmp_path / "own")
    assert own == _files(tmp_path / "spark") and len(own) == 5
    # Hadoop's local file system, which starts a process for each file, leaves checksum files
    assert not [p for p in (tmp_path / "own").rglob(".*") if p.is_file()]


def test_session_tree_is_added_to(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", 1, 2)], "g string, s string, i int, x int")
    write_session_tree(df, str(tmp_path), "g", "s", ["i"], ["x", "i"])
    write_session_tree(df, str(tmp_path), "g", "s", ["i"], ["i", "x"])
    assert sorted(p.read_text() for p in tmp_path.rglob("*.csv")) == ["i,x\n1,2\n", "x,i\n2,1\n"]


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    sc = spark.sparkContext
    many = 8 * sc.defaultParallelism
    for i in range(many):
        (tmp_path / f"v={i}").mkdir()
        (tmp_path / f"v={i}" / "a.csv").write_text("x\n1\n")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    with few_listing_tasks(spark):
        assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) < many
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    seen = set(sc.statusTracker().getJobIdsForGroup(None))
    assert session_csv.file_tree(spark, str(tmp_path)).count() == many
    stages = [s for j in set(sc.statusTracker().getJobIdsForGroup(None)) - seen for s in sc.statusTracker().getJobInfo(j).stageIds]
    tasks = [sc.statusTracker().getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism


def test_feature_tree_has_the_bytes_of_sparks_writer(spark, tmp_path):
    rows = [(g, t, f"f{t}", x, n) for g, t, x, n in (("v=1", 2, 1.5, None), ("v=1", 1, None, 3), (None, 1, -0.0, 2), ("w", 3, None, None), ("w", 1, 1e-7, 1))]
    df = spark.createDataFrame(rows, "vehicle string, session_ts int, session_file string, x double, n long")
    write_feature_csv(df, str(tmp_path / "own"), ["x", "n"])
    write_feature_csv(df, str(tmp_path / "own"), ["x", "n"])  # a second write takes the place of the first
    write_partitioned(df, str(tmp_path / "spark"), "vehicle", "csv", ["session_ts", "session_file"], drop=["session_ts", "session_file"])
    parts = lambda root: {str(p.parent.relative_to(root)): [] for p in root.rglob("*.csv")}
    own, want = (parts(tmp_path / n) for n in ("own", "spark"))
    for root, found in ((tmp_path / "own", own), (tmp_path / "spark", want)):
        for p in sorted(root.rglob("*.csv")):
            found[str(p.parent.relative_to(root))] += p.read_bytes().splitlines()[1:]
            assert p.read_bytes().splitlines()[0] == b"x,n"
    assert own == want and len(own) == 3 and own["vehicle=v%3D1"] == [b",3", b"1.5,"]
    # Hadoop's local file system, which starts a process for each file, leaves checksum files
    assert not [p for p in (tmp_path / "own").rglob(".*") if p.is_file()]


def test_a_tree_reads_its_small_files_once_and_only_when_asked(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "v" / "a_20240101_000000.csv", "available_capacity,max_cell_voltage\n1,2\n2,4\n")
    write_csv(tmp_path / "v" / "b_20240101_000001.csv", 'available_capacity,note\n1,"two\nlines"\n')
    read = []
    monkeypatch.setattr(session_csv, "small_files", lambda *a, own=session_csv.small_files: read.append(a) or own(*a))
    tree = SessionTree(spark, str(tmp_path), lazy=True)
    assert tree.sessions().count() == 2 and not read
    assert tree.rows.count() == 3 and tree.features().count() == 2 and len(read) == 1


def test_session_timeline_opens_no_file(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts, id % 2 AS user_id, 'view' AS event_type,
        1.0D * id AS value, '{"k": 1}' AS props FROM range(6)""").write.parquet(str(tmp_path / "events.parquet"))

    def fails(*_, **__):
        raise AssertionError("a file is read")

    monkeypatch.setattr(session_csv, "file_profile", fails)
    found = QUERIES["session_timeline"](spark, str(tmp_path)).collect()
    assert sorted((r["vehicle"], r["position"]) for r in found) == [("vehicle=0", 0), ("vehicle=0", 1), ("vehicle=1", 0), ("vehicle=1", 1)]


def _cycle_files(root: Path) -> str:
    for name, text in {"good": "a,b,note\n1,2,x\n3,4,y\n", "text": "a,b\n1,z\n", "lines": 'a,b,note\n1,2,"two\nlines"\n', "nan": "a,b\nnan,-inf\n 5 ,\n"}.items():
        write_csv(root / f"{name}.csv", text)
    return str(root)


def test_small_cycle_files_are_taken_whole(spark, tmp_path, monkeypatch):
    sources = []
    monkeypatch.setattr(cycle_csv, "text_lines", lambda *a: sources.append(a[5]) or session_csv.text_lines(*a))
    good, rejected = cycle_csv.usable_cycles(spark, _cycle_files(tmp_path), n_features=2)
    assert len(sources) == 2 and None not in sources  # of all files, and of those with cells over line ends
    found = sorted((r["battery_id"], r["c0"], r["c1"]) for r in good.fillna(-1.0).collect())
    assert found == [("good.csv", 1.0, 2.0), ("good.csv", 3.0, 4.0), ("lines.csv", 1.0, 2.0), ("nan.csv", -1.0, float("-inf")), ("nan.csv", 5.0, -1.0)]
    assert [(r["path"].rsplit("/", 1)[-1], r["reason"]) for r in rejected.collect()] == [("text.csv", "non_numeric")]


def test_checks_of_cycle_files_read_no_cell_and_are_made_once(spark, tmp_path):
    root = _cycle_files(tmp_path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "c0" not in plan(cycle_csv.file_checks(cycle_csv.scan_cycles(spark, root, 2), 2))
    _, checks, rejected = cycle_csv.usable_design_rows(spark, root, n_features=2)
    assert "Aggregate" not in plan(checks) and "Aggregate" not in plan(rejected)
    assert {r["_file"].rsplit("/", 1)[-1]: (r["n_cols"], r["final_cycles"], r["reason"]) for r in checks.collect()} == {
        "good.csv": (3, 2, None), "text.csv": (2, 1, "non_numeric"), "lines.csv": (3, 1, None), "nan.csv": (2, 2, None)}


def test_feature_tree_is_read_back_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(g, t, f"f{t}", x, n) for g, t, x, n in (("v=1+%", 2, 1.5, None), ("v=1+%", 1, None, 3), (None, 1, -0.5, 2), ("w é", 3, None, None), ("w é", 1, 1e-7, 1))]
    df = spark.createDataFrame(rows, "vehicle string, session_ts int, session_file string, x double, n long")
    write_feature_csv(df, str(tmp_path), ["x", "n"])
    want = sorted(map(str, ([g, None if x is None else str(x).replace("1e-07", "1.0E-7"), None if n is None else str(n)] for g, _, _, x, n in rows)))
    for most in (10_000, 1):
        monkeypatch.setattr(listing, "MOST_INDEXED", most)
        back = session_csv.read_feature_csv(spark, str(tmp_path), ["x", "n"]).orderBy("vehicle", "_f", "_bs", "_mid").collect()
        assert sorted(str([r["vehicle"], r["x"], r["n"]]) for r in back) == want
        assert [r["n"] for r in back if r["vehicle"] == "v=1+%"] == ["3", None]
