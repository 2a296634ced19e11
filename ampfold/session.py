"""Spark session helpers: local builder for tests/bench, and the shared scratch folder.

Scratch data (temporary CSV trees, lineage cuts) lives under the folder the cluster
names in ``spark.checkpoint.dir``. Only when that is unset (local tests) do we create
one of our own.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


#: Scratch folders by application, until they are removed.
_SCRATCH: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ampfold") -> SparkSession:
    """A local session with the settings used by tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.openCostInBytes", os.environ.get("AMPFOLD_OPEN_COST_BYTES", "262144"))
        .config("spark.cleaner.periodicGC.interval", "1min")
        .config("spark.driver.memory", os.environ.get("AMPFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; set a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - conf key absent
            conf_dir = None
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder (a machine-local one does not "
                             "survive a lost executor)")
        conf_dir = tempfile.mkdtemp(prefix="ampfold-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark)}/ampfold-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING = threading.RLock()


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Lists the files of folders in a few tasks a core. Spark's 10,000 tasks are one for nearly every folder, and each
    takes far longer to start than to list a folder of one file."""
    with _LISTING:
        before = spark.conf.get(_LISTING_TASKS)
        spark.conf.set(_LISTING_TASKS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
        try:
            yield
        finally:
            spark.conf.set(_LISTING_TASKS, before)


def load_files(reader: DataFrameReader, spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """The files of a reader (below a folder, or listed)."""
    with few_listing_tasks(spark):
        return reader.load(source if isinstance(source, str) else list(source))


def load_listed(reader: DataFrameReader, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files of a list of paths, none of which is taken as a pattern."""
    return load_files(reader.option("__globPaths__", False), spark, paths)


def remove_scratch(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Remove scratch folders that this application made: the given ones, or all. Results that still read them
    are lost, so call it when they have been written or collected."""
    own = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(own) if paths is None else list(paths):
        if path in own:
            own.remove(path)
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), for functions that run in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="ampfold-package-")  # the driver serves it from there
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
