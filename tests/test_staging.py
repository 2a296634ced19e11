"""Scans over trees with unreadable files: what is left out, what is read, and how often."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ampfold.operators.sessions import SessionTree
from ampfold.plans import staging
from ampfold.sources import archives, session_csv


def zipped(n, seed=0):
    rng = random.Random(seed)
    return gzip.compress(("available_capacity,max_cell_voltage\n" + "".join(f"{i},{rng.random()}\n" for i in range(n))).encode())


def write_tree(root, good, cut, rows=3000):
    """Session files of ``rows`` rows, of which ``cut`` end in the middle; names with characters that paths encode."""
    data, names = zipped(rows), []
    for i in range(good + cut):
        name = f"a {i % 5}%[é]_20230101_{i:06d}.csv.gz"
        names.append(name)
        path = Path(root) / f"v{i % 3}" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if i >= cut else data[: len(data) * 2 // 3])
    return names[:cut], names[cut:]


def test_damage_is_told_from_oddities():
    data = zipped(200_000, 1)
    assert not archives.is_damaged(data) and not archives.is_damaged(data + zipped(10)) and not archives.is_damaged(gzip.compress(b""))
    for cut in (1, 5, 9, 20, len(data) // 3, len(data) - 8, len(data) - 1):
        assert archives.is_damaged(data[:cut]), cut
        assert archives.is_damaged(zipped(10) + data[:cut]) == (cut >= 2), cut
    flipped = bytearray(data)
    flipped[-6] ^= 1
    assert archives.is_damaged(bytes(flipped)) and archives.is_damaged(b"no archive at all")
    assert not archives.is_damaged(data + b"\0\0\0 rest") and not archives.is_damaged(b"")


def counted(monkeypatch):
    """The conditions of all scans that are staged from now on."""
    scans, real = [], session_csv.only_files
    monkeypatch.setattr(session_csv, "only_files", lambda raw, only: scans.append(only) or real(raw, only))
    return scans


def names_of(paths):
    from urllib.parse import unquote

    return sorted(unquote(p).rsplit("/", 1)[-1] for p in paths)


def test_damaged_archives_cost_no_scan(spark, tmp_root, monkeypatch):
    cut, good = write_tree(tmp_root, 30, 25)
    scans = counted(monkeypatch)
    tree = SessionTree(spark, tmp_root, glob="*.csv*")
    assert len(scans) == 2  # the profile and the rows, once each
    assert names_of(r["session_file"] for r in tree.features().collect()) == sorted(good)
    rejected = tree.rejected().collect()
    assert names_of(r["path"] for r in rejected) == sorted(cut) and {r["reason"] for r in rejected} == {"unreadable"}
    assert tree.rows.count() == 30 * 3000


def test_unforeseen_errors_cost_their_batch(spark, tmp_root, monkeypatch):
    """Files that fail in the scan itself (as those too large to be tested before)."""
    cut, good = write_tree(tmp_root, 40, 3)
    monkeypatch.setattr(archives, "MOST_BYTES", 0)
    monkeypatch.setattr(staging, "BATCHES", 8)
    scans = counted(monkeypatch)
    tree = SessionTree(spark, tmp_root, glob="*.csv*")
    assert names_of(r["session_file"] for r in tree.features().collect()) == sorted(good)
    assert names_of(r["path"] for r in tree.rejected().collect()) == sorted(cut)
    assert {r["n"] for r in tree.rows.groupBy("session_file").agg(F.count("*").alias("n")).collect()} == {3000}
    assert len(scans) <= 2 + 8 + 3 * 2 * 6 + 1  # whole trees, batches, and halves of at most 3 of them


def test_a_tree_without_a_readable_file(spark, tmp_root, monkeypatch):
    write_tree(tmp_root, 0, 4)
    monkeypatch.setattr(archives, "MOST_BYTES", 0)
    monkeypatch.setattr(staging, "BATCHES", 2)
    with pytest.raises(ValueError, match="no readable session file"):
        SessionTree(spark, tmp_root, glob="*.csv*")


def test_other_errors_are_raised(spark, tmp_root):
    write_tree(tmp_root, 3, 0)
    listing = session_csv.file_tree(spark, tmp_root, "*.csv*")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|divide by zero|Division by zero"):
        staging.stage_readable(lambda only: listing.where(only).select(F.expr("length DIV (length - length)").alias("x")), listing, "broken")


def test_files_that_are_not_asked_for_are_not_opened(spark, tmp_root):
    cut, good = write_tree(tmp_root, 6, 6)
    listing = session_csv.file_tree(spark, tmp_root, "*.csv*")
    hashes = {names_of([r["p"]])[0]: r["h"] for r in listing.select(F.col(staging.FILE_PATH).alias("p"), staging.file_hash().alias("h")).collect()}
    only = staging.all_but([hashes[n] for n in cut])
    assert session_csv.read_sessions(spark, tmp_root, glob="*.csv*", only=only).count() == 6 * 3000
