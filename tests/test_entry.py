"""Driver contract: entry() on sf0.001, catalogue keys, oracle keys are a subset of the queries."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "final_cycles" in df.columns


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_fast_queries_run_on_smallest_scale(spark):
    q = E.queries()
    for name in ["linear_fit", "value_jumps", "curve_areas", "early_cycle_stats_short", "loo_split", "path_datetime"]:
        assert q[name](spark, SF_SMALL).count() > 0, name


def test_all_other_queries_without_the_training_data_operators(tmp_path):
    """A copy without the optional folders and the pipeline still lists its queries and SQL."""
    root = Path(E.__file__).resolve().parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root / "ampfold", tmp_path / "ampfold", ignore=skip)
    names = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), any(q.startswith('op') for q in E.queries()))"
    for also in ([], ["corpus_pipeline.py"]):
        for name in ["__spark_entry__.py", *also]:
            shutil.copy(root / name, tmp_path)
        out = subprocess.run([sys.executable, "-c", names], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        queries, sql, ops = out.stdout.split()
        assert int(queries) >= 47 and int(sql) >= 40 and ops == "False"
