"""A design matrix that is kept up to date batch by batch instead of from all cycles anew.

The state of a battery is what the statistics need and no more: its first ``n`` cycles in ``order`` and the number of
all its cycles. States merge in any order (the first of two firsts are the first of both), so batches of cycles may come
in any order and a battery's cycles may lie in several of them. The state is a versioned folder
(:mod:`ampfold.sinks.versions`): an append that fails leaves the former state, and one that is repeated adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.functions.common import as_list
from ampfold.functions.naming import EARLY_CYCLES
from ampfold.operators.cycles import CYCLE, first_rows, stats_of_early_rows
from ampfold.sinks.versions import current_version, publish

TOTAL = "_total"


def merged_early(parts: Sequence[DataFrame], group, order, n: int = EARLY_CYCLES) -> DataFrame:
    """The first ``n`` rows of each group over several tables that hold at least their own first ``n``."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return first_rows(rows, group, order, n).drop(CYCLE)


def merged_totals(parts: Sequence[DataFrame], group) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*as_list(group)).agg(F.sum(TOTAL).alias(TOTAL))


class MaintainedDesign:
    """The early-cycle statistics of all batches appended to the state in ``path``.

    ``order`` should be without ties within a group. Rows whose group is null are one group, as in
    :func:`ampfold.operators.cycles.first_rows`; an empty batch changes nothing but the list of batches.
    """

    def __init__(self, spark: SparkSession, path: str, group, order, cols: Sequence[str], n: int = EARLY_CYCLES):
        self.spark, self.path, self.n = spark, path, n
        self.group, self.order, self.cols = as_list(group), as_list(order), list(cols)

    def _state(self, name: str) -> DataFrame | None:
        at = current_version(self.spark, self.path)
        return None if at is None else self.spark.read.parquet(f"{at}/{name}")

    def batches(self) -> list[str]:
        """The names of the batches that the state has."""
        known = self._state("batches")
        return [] if known is None else sorted(r["batch"] for r in known.collect())

    def append(self, cycles: DataFrame, batch: str) -> bool:
        """Adds a batch of cycles; False if one of that name has been added before."""
        known = self.batches()
        if batch in known:
            return False
        base = cycles.select(*self.group, *self.order, *self.cols)
        early, totals = [base], [base.groupBy(*self.group).agg(F.count(F.lit(1)).alias(TOTAL))]
        if known:
            early, totals = [self._state("early"), *early], [self._state("totals"), *totals]
        names = self.spark.createDataFrame([(b,) for b in [*known, batch]], "batch string")

        def write(path: str) -> None:
            merged_early(early, self.group, self.order, self.n).write.parquet(f"{path}/early")
            merged_totals(totals, self.group).write.parquet(f"{path}/totals")
            names.coalesce(1).write.parquet(f"{path}/batches")

        publish(self.spark, self.path, write)
        return True

    def design(self, series_names: Sequence[str] | None = None, label: str = "final_cycles", with_cycle: bool = True) -> DataFrame:
        """What :func:`ampfold.operators.cycles.early_cycle_stats` gives for all rows of all batches."""
        if self._state("early") is None:
            raise ValueError(f"no batch has been added to {self.path}")
        names = list(series_names) if series_names is not None else self.cols
        numbered = first_rows(self._state("early"), self.group, self.order, self.n)
        stats = stats_of_early_rows(numbered, self.group, CYCLE, self.cols, names, with_cycle)
        found = [c for c in stats.columns if c not in self.group]
        totals = self._state("totals")
        same = F.lit(True)
        for g in self.group:
            same = same & totals[g].eqNullSafe(stats[g])
        out = totals.join(stats, same)
        return out.select(*[totals[g] for g in self.group], totals[TOTAL].cast("long").alias(label), *[stats[c] for c in found])
