"""Session features that are kept up to date: a run parses only the files that are new or have changed.

The store has the features, the rejected files and a manifest (path, length, modification time) of the files they were
made of, as one versioned folder (:mod:`ampfold.sinks.versions`): a run that fails leaves all three as they were. What
has changed is told from the file listing alone; over an unchanged tree no content is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.operators.sessions import KEY, SessionTree
from ampfold.plans.staging import stage
from ampfold.session import remove_scratch, scratch_path
from ampfold.sinks.versions import current_version, publish
from ampfold.sources import session_csv

#: Changed files that are parsed at once: as many paths the driver holds.
BATCH = 100_000


@dataclass(frozen=True)
class Refresh:
    parsed: int    # files that were new or changed
    retired: int   # files that are gone; changed ones are not counted


class FeatureStore:
    """The features of the session files below ``root``, kept in ``path``. The first run parses the whole tree at once,
    later ones the changed files in batches of ``BATCH``. A tree from which all files are gone is an empty store."""

    def __init__(self, spark: SparkSession, root: str, path: str, glob: str = "*.csv", extractors: Sequence = ()):
        self.spark, self.root, self.path, self.glob, self.extractors = spark, root, path, glob, extractors

    def _table(self, name: str) -> DataFrame:
        at = current_version(self.spark, self.path)
        if at is None:
            raise ValueError(f"{self.path} has never been refreshed")
        return self.spark.read.parquet(f"{at}/{name}")

    def features(self) -> DataFrame:
        return self._table("features")

    def rejected(self) -> DataFrame:
        return self._table("rejected")

    def manifest(self) -> DataFrame:
        """``file, length, modified`` of every file that the features and the rejected files were made of."""
        return self._table("manifest")

    def _trees(self, changed: DataFrame, whole: bool) -> Iterator[SessionTree]:
        if whole:
            yield SessionTree(self.spark, self.root, self.glob)
            return
        files: list[str] = []
        for row in changed.select("file").toLocalIterator():
            files.append(row["file"])
            if len(files) == BATCH:
                yield SessionTree(self.spark, self.root, self.glob, files=files)
                files = []
        if files:
            yield SessionTree(self.spark, self.root, self.glob, files=files)

    def refresh(self) -> Refresh:
        """Brings the store up to the state of the tree; what it did. Nothing is written if nothing has changed."""
        first = current_version(self.spark, self.path) is None
        made = [scratch_path(self.spark, f"refresh-{n}") for n in ("listing", "changed")]
        listed = stage(session_csv.file_listing(self.spark, self.root, self.glob), "listing", made[0])  # one state of the tree
        known = listed.limit(0) if first else self.manifest()
        changed = stage(listed.join(known, ["file", "length", "modified"], "left_anti"), "changed", made[1])
        gone = known.join(listed, "file", "left_anti")
        done = Refresh(changed.count(), gone.count())
        if first or done.parsed or done.retired:
            publish(self.spark, self.path, lambda out: self._write(out, listed, changed, gone, first))
        remove_scratch(self.spark, made)
        return done

    def _write(self, out: str, listed: DataFrame, changed: DataFrame, gone: DataFrame, first: bool) -> None:
        stale = changed.select("file").unionByName(gone.select("file"))
        if not first:  # at most a row a session: small next to the sessions
            self.features().join(stale.select(F.col("file").alias(KEY)), KEY, "left_anti").write.parquet(f"{out}/features")
            self.rejected().join(stale.select(F.col("file").alias("path")), "path", "left_anti").write.parquet(f"{out}/rejected")
        for tree in self._trees(changed, first):
            fresh = stage(tree.features(self.extractors), "fresh")
            fresh.write.mode("append").parquet(f"{out}/features")
            tree.rejected(fresh).write.mode("append").parquet(f"{out}/rejected")
            tree.release()
        listed.write.parquet(f"{out}/manifest")
