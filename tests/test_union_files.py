"""The union of files with different columns, against a union of data frames."""

import random
from pathlib import Path

import pandas as pd
import pytest

from ampfold.plans.union_files import union_of_files
from tests.conftest import write_csv


def test_union_is_that_of_data_frames(spark, tmp_root):
    rng, frames = random.Random(8), []
    kinds = [lambda: rng.randrange(99), lambda: rng.choice(["", "NA", rng.randrange(9)]), lambda: round(rng.random(), 3),
             lambda: rng.choice(["x", "007", '"a, ""b"""', '"two\nlines"'])]
    for i in range(500):
        cols = rng.sample(range(40), 3) + [100]
        rows = [[kinds[c % 4]() for c in cols] for _ in range(rng.randrange(4))]
        text = "\n".join([",".join(f"col{c}" for c in cols), *(",".join(map(str, r)) for r in rows)]) + "\n"
        frames.append(pd.read_csv(write_csv(Path(tmp_root) / f"{i:03d}.csv", text), dtype=str, keep_default_na=True))
    write_csv(Path(tmp_root) / "zz_ragged.csv", "col100,other\n1,2,3\n")
    assert len({tuple(f.columns) for f in frames}) > 450
    want = pd.concat(frames, ignore_index=True)
    got = union_of_files(spark, tmp_root).orderBy("file", "_bs", "_mid").drop("file", "_bs", "_mid")
    assert got.columns == list(want.columns)
    types = dict(got.dtypes)
    assert types["col100"] == "bigint" and all(types[c] == "string" for c in types if int(c[3:]) % 4 == 3)
    assert all(types[c] == "double" for c in types if int(c[3:]) % 4 < 3 and c != "col100")
    found = [list(r) for r in got.collect()]
    assert len(found) == len(want)
    for r, (_, w) in zip(found, want.iterrows(), strict=True):
        for c, a, b in zip(got.columns, r, w, strict=True):
            assert a is None if pd.isna(b) else (a == b if types[c] == "string" else a == float(b)), (c, a, b)


def test_union_of_headers_and_of_nothing(spark, tmp_root):
    write_csv(Path(tmp_root) / "h" / "a.csv", "b,a,b,\n")
    out = union_of_files(spark, f"{tmp_root}/h")
    assert out.columns == ["file", "_bs", "_mid", "b", "a"] and out.count() == 0 and dict(out.dtypes)["a"] == "double"
    write_csv(Path(tmp_root) / "e" / "a.txt", "x")
    with pytest.raises(ValueError):
        union_of_files(spark, f"{tmp_root}/e")
