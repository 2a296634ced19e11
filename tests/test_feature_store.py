"""The feature store against features of the whole tree, and what each of its runs reads."""

import os
from pathlib import Path

import pytest

from ampfold.operators import sessions as ses
from ampfold.plans import feature_store
from tests.conftest import write_csv

HEAD = "available_capacity,max_cell_voltage,charge_current\n"


def body(n, k=1):
    return HEAD + "".join(f"{i},{k * i},{i // 4}\n" for i in range(n))


def state(features, rejected):
    rows = {r["session_file"]: [r[c] for c in ("n_rows", *ses.FEATURES)] for r in features.collect()}
    return rows, sorted((r["path"], r["reason"]) for r in rejected.collect())


def test_runs_parse_what_has_changed(spark, tmp_root, monkeypatch):
    root, read = Path(tmp_root) / "in", []

    class Watched(ses.SessionTree):
        def __init__(self, spark, root, glob="*.csv", encoding=None, files=None):
            read.append(None if files is None else sorted(f.rsplit("/", 1)[-1][0] for f in files))
            super().__init__(spark, root, glob, encoding, files)

    monkeypatch.setattr(feature_store, "SessionTree", Watched)
    monkeypatch.setattr(feature_store, "BATCH", 2)
    for i, name in enumerate("abc"):
        write_csv(root / "v" / f"{name}_20230101_00000{i}.csv", body(5 + i))
    write_csv(root / "v" / "r_20230101_000009.csv", HEAD + "1,2,3,4\n")
    store = feature_store.FeatureStore(spark, str(root), f"{tmp_root}/store")
    with pytest.raises(ValueError, match="never"):
        store.features()

    def same():
        tree = ses.SessionTree(spark, str(root))
        return state(store.features(), store.rejected()) == state(tree.features(), tree.rejected())

    assert store.refresh() == feature_store.Refresh(4, 0) and same() and read == [None]
    assert store.refresh() == feature_store.Refresh(0, 0) and read == [None]  # unchanged: no content is read
    (root / "v" / "a_20230101_000000.csv").unlink()
    write_csv(root / "v" / "b_20230101_000001.csv", body(9, k=3))
    write_csv(root / "w" / "d_20230101_000003.csv", body(3))
    write_csv(root / "v" / "r_20230101_000009.csv", HEAD + "1,2,3\n2,3,3\n")  # repaired
    write_csv(root / "v" / "c_20230101_000002.csv", HEAD + 'x,"y\nz",1\n')  # broken
    at = (root / "v" / "c_20230101_000002.csv")
    os.utime(at, (1_700_000_000, 1_700_000_000))
    assert store.refresh() == feature_store.Refresh(4, 1)
    assert sorted(sum(read[1:], [])) == ["b", "c", "d", "r"] and len(read) == 3 and same()
    write_csv(root / "v" / "e_20230101_000004.csv", body(4))

    def breaks(*_):
        raise RuntimeError("broken")

    before = state(store.features(), store.rejected())
    with monkeypatch.context() as m:
        m.setattr(Watched, "rejected", breaks)
        with pytest.raises(RuntimeError, match="broken"):
            store.refresh()
    assert state(store.features(), store.rejected()) == before and store.manifest().count() == 4
    assert store.refresh() == feature_store.Refresh(1, 0) and same()


def test_tens_of_thousands_of_changed_files_are_one_batch(spark, tmp_root, monkeypatch):
    read = []
    monkeypatch.setattr(feature_store, "SessionTree", lambda spark, root, glob, files: read.append(len(files)))
    store = feature_store.FeatureStore(spark, tmp_root, f"{tmp_root}/store")
    list(store._trees(spark.range(40_500).selectExpr("concat('f', id) AS file"), False))
    assert read == [40_500]
