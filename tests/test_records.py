"""Records over line ends and text in other charsets, read split by split, against a character-by-character reader."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ampfold.operators import sessions as ses
from ampfold.sources import cycle_csv, records, session_csv
from tests.conftest import write_csv

HEAD = "available_capacity,max_cell_voltage,charge_current,max_temperature,charging_duration_seconds,interpolated_dqdv"


def plain_records(text):
    """The records of a text, each a list of cells; None if a quoted cell is never closed."""
    out, row, cell, state = [], [], "", "start"
    for ch in text:
        if state == "quoted":
            state, cell = ("closing", cell) if ch == '"' else (state, cell + ch)
        elif ch == '"' and state == "start":
            state = "quoted"
        elif ch == '"' and state == "closing":
            state, cell = "quoted", cell + ch
        elif ch in ",\n":
            row, cell, state = [*row, cell], "", "start"
            if ch == "\n":
                out, row = [*out, row], []
        else:
            state, cell = "plain", cell + ch
    if state == "quoted":
        return None
    return [r for r in (out if text.endswith("\n") else [*out, [*row, cell]]) if r != [""]]


@pytest.fixture(params=[64])
def tiny_splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_records_of_random_files(spark, tmp_root, tiny_splits):
    rng, texts = random.Random(7), {}
    for i in range(60):
        text = "".join(rng.choices(['"', ",", "a", "\n", "b c"], weights=(3, 3, 4, 2, 1), k=rng.randrange(5, 700)))
        text = '"' + text if i % 3 == 0 else text
        texts[f"{i}.csv"] = text if plain_records(text) is not None or i % 4 else text.rstrip('"') + '"'
        write_csv(Path(tmp_root) / f"{i}.csv", texts[f"{i}.csv"])
    lines = session_csv.text_lines(spark, tmp_root).checkpoint()
    assert lines.select("file", "_bs").distinct().count() > 150  # files are split, also inside cells
    got = {}
    for r in records.joined_records(lines).withColumn("cells", records.cells(F.col("value"))).orderBy("_bs", "_mid").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["cells"])
    never = {r["file"].rsplit("/", 1)[-1] for r in records.unclosed(lines).collect()}
    assert never == {n for n, t in texts.items() if plain_records(t) is None} and 0 < len(never) < 60
    for name, text in texts.items():
        wanted = [] if name in never else [r for r in plain_records(text) if not (len(r) == 1 and not r[0].strip())]
        assert [r for r in got.get(name, []) if not (len(r) == 1 and not r[0].strip())] == wanted, (name, text)


def test_a_file_that_is_one_cell_and_no_files(spark, tmp_root, tiny_splits):
    write_csv(Path(tmp_root) / "long.csv", 'h\n"' + "x,y\n" * 5000 + '"\n1\n')
    lines = session_csv.text_lines(spark, tmp_root).checkpoint()
    rows = records.joined_records(lines).select("file", "_bs", records.cells(F.col("value")).alias("c")).orderBy("_bs").collect()
    assert [r["c"] for r in rows] == [["h"], ["x,y\n" * 5000], ["1"]]
    assert lines.select("_bs").distinct().count() > 100
    assert records.joined_records(lines.limit(0)).count() == 0 and records.unclosed(lines.limit(0)).count() == 0


def names(rows, col):
    return {r[col].rsplit("/", 1)[-1].split("_")[0]: r.asDict() for r in rows}


@pytest.mark.parametrize("tiny_splits", [700], indirect=True)
def test_sessions_over_lines(spark, tmp_root, tiny_splits):
    root = Path(tmp_root) / "v"
    body = "".join(f'{i},{10 * i},5,20,7,{i % 3},"note {i}\nof, ""two"" lines"\n' for i in range(200))
    flat = "".join(f"{i},{10 * i},5,20,7,{i % 3},note\n" for i in range(200))
    write_csv(root / "lines_20230101_000001.csv", f'{HEAD},"no\nte"\n' + body)
    write_csv(root / "flat_20230101_000002.csv", f"{HEAD},note\n" + flat)
    write_csv(root / "inch_20230101_000003.csv", f'{HEAD},note\n1,10,5,20,7,1,5" pipe\n2,30,5,21,7,3,b\n')
    write_csv(root / "ragged_20230101_000004.csv", f'{HEAD},note\n1,10,5,20,7,1,"a\nb"\n2,30,5,21,7,3,c,more\n')
    write_csv(root / "never_20230101_000005.csv", f'{HEAD},note\n1,10,5,20,7,1,"a\nb\n2,30,5,21,7,3,c\n')
    write_csv(root / "text_20230101_000006.csv", f'{HEAD},note\n1,"te\nxt",5,20,7,1,a\n')
    write_csv(root / "header_20230101_000007.csv", f'{HEAD},"no\nte"\n')
    tree = ses.SessionTree(spark, tmp_root)
    f = names(ses.valid_sessions(tree.features()).collect(), "session_file")
    assert set(f) == {"lines", "flat", "inch", "header"} and f["header"]["n_rows"] == 0 and f["inch"]["n_rows"] == 2
    for c in ["n_rows", *ses.FEATURES]:
        assert f["lines"][c] == pytest.approx(f["flat"][c], rel=1e-12), c
    assert f["lines"]["n_rows"] == 200 and f["inch"][ses.F_V_SLOPE] == 20.0
    rejected = {k: v["reason"] for k, v in names(tree.rejected().collect(), "path").items()}
    assert rejected == {"ragged": "ragged", "never": "unclosed", "text": "non_numeric", "header": "dqdv_all_missing"}
    splits = tree.rows.where(F.col("session_file").contains("/lines_")).select("_bs").distinct().count()
    assert splits > 8  # one file, many tasks
    tree.release()
    assert not any(Path(p).exists() for p in tree.paths)


def test_sessions_in_their_own_charsets(spark, tmp_root):
    text = "电压,available_capacity,max_cell_voltage,备注\n3,1,10,café\n5,2,30,b\n"
    latin = text.replace("电压", "tensión").replace("备注", "été")
    many = text.replace("café", '"电\n压"')
    for name, data in (("u", text.replace("é", "e").encode()), ("g", text.replace("é", "备").encode("gbk")),
                       ("l", latin.encode("latin-1")), ("m", many.encode("gbk"))):
        path = Path(tmp_root) / "v" / f"{name}_20230101_000001.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    tree = ses.SessionTree(spark, tmp_root)
    f = names(tree.features().collect(), "session_file")
    assert set(f) == {"u", "g", "l", "m"}
    for name in f:
        assert [f[name][c] for c in ses.FEATURES] == [f["u"][c] for c in ses.FEATURES] and f[name][ses.F_V_SLOPE] == 20.0
    p = names(tree.profile.collect(), "file")
    assert {n: r["charset"] for n, r in p.items()} == {"u": "UTF-8", "g": "GBK", "l": "ISO-8859-1", "m": "GBK"}
    for n in "ugm":
        assert p[n]["columns"] == ["电压", "available_capacity", "max_cell_voltage", "备注"]
    assert p["l"]["columns"][0] == "tensión" and p["l"]["columns"][3] == "été"
    odd = tree.profile.where("charset <> 'UTF-8'").select("file", "multiline", "charset")
    made = session_csv.odd_records(session_csv.text_lines(spark, tmp_root).checkpoint(), odd)
    notes = names(made.where("NOT header").groupBy("file").agg(F.min_by(F.get("cells", F.lit(3)), "_mid").alias("note")).collect(), "file")
    assert {n: r["note"] for n, r in notes.items()} == {"g": "caf备", "l": "café", "m": "电\n压"}
    volts = session_csv.odd_rows(made, session_csv.odd_profile(made), tmp_root, ["电压"]).groupBy("session_file").agg(F.sum("电压").alias("v"))
    assert {n: r["v"] for n, r in names(volts.collect(), "session_file").items()} == {"g": 8.0, "l": None, "m": 8.0}
    fixed = ses.SessionTree(spark, tmp_root, encoding="ISO-8859-1")
    assert names(fixed.features().collect(), "session_file")["m"]["n_rows"] == 2


@pytest.mark.parametrize("tiny_splits", [700], indirect=True)
def test_cycle_files_over_lines(spark, tmp_root, tiny_splits):
    root = Path(tmp_root)
    write_csv(root / "lines.csv", 'a,b,c,note\n' + "".join(f'{i},{i * i},1,"{i}\n,""{i}"""\n' for i in range(60)))
    write_csv(root / "flat.csv", 'a,b,c,note\n' + "".join(f"{i},{i * i},1,x\n" for i in range(60)))
    write_csv(root / "ragged.csv", 'a,b,c,note\n1,2,3,"x\ny"\n1,2,3,4,5\n')
    write_csv(root / "never.csv", 'a,b,c,note\n1,2,3,"x\n1,2,3,4\n')
    write_csv(root / "text.csv", 'a,b,c,note\n1,"x\ny",3,4\n')
    good, rejected = cycle_csv.usable_cycles(spark, tmp_root, n_features=3)
    got = {r["battery_id"]: r.asDict() for r in good.groupBy("battery_id").agg(F.count("*").alias("n"), F.sum("c0").alias("s"), F.sum("c1").alias("q")).collect()}
    assert set(got) == {"lines.csv", "flat.csv"}
    assert all((r["n"], r["s"], r["q"]) == (60, 1770.0, 70210.0) for r in got.values())
    assert {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in rejected.collect()} == {"ragged.csv": "ragged", "never.csv": "unclosed", "text.csv": "non_numeric"}
    early, checks, _ = cycle_csv.usable_design_rows(spark, tmp_root, n_features=3, n_early=40)
    first = {n: sorted((r["_cycle"], r["c0"]) for r in early.where(F.col("_file").endswith(n)).collect()) for n in got}
    assert first["lines.csv"] == first["flat.csv"] == [(i + 1, float(i)) for i in range(40)]
    assert {r["battery_id"]: r["final_cycles"] for r in checks.where("reason IS NULL").collect()} == {"lines.csv": 60, "flat.csv": 60}
