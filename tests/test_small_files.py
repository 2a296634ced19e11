"""Small files are read whole, larger ones split; both give the same."""
from pathlib import Path

import pytest
from conftest import write_csv

from ampfold.operators import sessions as ses
from ampfold.sources import cycle_csv, session_csv

HEADER = "available_capacity,max_cell_voltage,charge_current,interpolated_dqdv"
FILES = {
    "plain": f"{HEADER}\n1,10,5,0.5\n2,-0,,nan\n\n3,1e5, 7,inf\n",
    "no_end": f"{HEADER}\r\n1,10,5,0.5\r\n2,30,5,0.25",
    "returns": f"{HEADER}\r1,10,5,0.5\r \r2,30,5,0.25\r",
    "short": f"{HEADER}\n1,10\n2,30,5,0.5\n",
    "ragged": f"{HEADER}\n1,10,5,0.5,9\n",
    "text": f"{HEADER}\n1,abc,5,0.5\n",
    "truth": f"{HEADER}\n1,true,5,0.5\n",
    "time": f"{HEADER}\n1,12:30:00,5,0.5\n",
    "quoted": f'{HEADER},note\n"1",10,5,0.5,"a,b"\n',
    "lines": f'{HEADER},note\n1,10,5,0.5,"two\nlines"\n2,11,5,0.5,x\n',
    "open": f'{HEADER},note\n1,10,5,0.5,"never\n',
    "names": "charge_current,charge_current,CHARGE_CURRENT\n1,2,3\n",
    "blank": f"\n{HEADER}\n1,10,5,0.5\n",
    "marked": f"﻿{HEADER}\n1,10,5,0.5\n",
    "header": f"{HEADER}\n",
}


@pytest.fixture()
def tree(tmp_root):
    for i, (name, text) in enumerate(FILES.items()):
        path = write_csv(Path(tmp_root) / f"v{i % 3}" / f"20240101_0000{i:02d}_{name}.csv", "")
        path.write_bytes(text.encode())
    (Path(tmp_root) / "v0" / "20240102_000000_latin.csv").write_bytes(f"{HEADER},note\n1,10,5,0.5,café\n".encode("latin-1"))
    return tmp_root


def _all(spark, root):
    own = ses.SessionTree(spark, root)
    cells, _ = cycle_csv.usable_cycles(spark, root, n_features=2, id_from="dir", recursive=True)
    tables = {
        "profile": own.profile, "rows": own.rows.drop("_bs", "_mid"), "features": own.features(), "rejected": own.rejected(),
        "charset": session_csv.charset_profile(spark, root), "cycles": cells.drop("_bs", "_mid"),
    }
    return {name: sorted(map(str, (r.asDict() for r in t.collect()))) for name, t in tables.items()}


def test_small_and_split_files_give_the_same(spark, tree, monkeypatch):
    whole = _all(spark, tree)
    monkeypatch.setattr(session_csv, "SMALL_BYTES", 80)  # more than half are split
    assert whole == _all(spark, tree)


def test_small_files_are_opened_by_the_binary_source_alone(spark, tree):
    listing = session_csv.file_tree(spark, tree)
    for made in (session_csv.file_profile(spark, tree, listing=listing), session_csv.text_lines(spark, tree, listing=listing),
                 session_csv.plain_rows(listing, tree), session_csv.charset_profile(spark, tree)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" in plan and "FileScan text" not in plan and "FileScan csv" not in plan
    plain = {r["session_file"].rsplit("_", 1)[-1] for r in session_csv.plain_rows(listing, tree).collect()}
    assert plain == {f"{n}.csv" for n in ("plain", "end", "returns", "short", "ragged", "text", "marked")}
