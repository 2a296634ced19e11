"""Writers: partitioned feature tables, per-session CSV trees, report tables."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.functions.common import as_list


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] | str = ("vehicle",), fmt: str = "parquet",
                      order: Sequence[str] | str = (), mode: str = "overwrite", drop: Sequence[str] = ()) -> None:
    """Partitioned write; with ``order``, rows are range-partitioned and sorted on ``(by, order)``.

    Range partitioning keeps each output file sorted and splits a large group over several
    files (part files sort in row order), so no single task writes a whole group. ``drop``
    removes sort keys from the written content (the sort survives the projection: the
    writer's required ordering is the ``by`` prefix, already satisfied).
    """
    by, order = as_list(by), as_list(order)
    out = df
    if order:
        keys = [*by, *order]
        out = out.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    if drop:
        out = out.drop(*drop)
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if by:
        w = w.partitionBy(*by)
    w.save(path)


def write_feature_csv(features: DataFrame, path: str, feature_cols: Sequence[str], group: str = "vehicle",
                      order: Sequence[str] = ("session_ts", "session_file")) -> None:
    """One CSV tree per group with the feature columns only, rows in session time order."""
    cols = [group, *order, *feature_cols]
    local = local_folder(features.sparkSession, path)
    if local is not None and len(feature_cols) > 1:  # a row of a single null has no line in to_csv
        remove_folder(features.sparkSession, path)
        line = F.to_csv(F.struct(*feature_cols)).cast("binary").alias("_line")
        rows = features.select(group, *order, line).repartitionByRange(*[F.col(c) for c in (group, *order)]).sortWithinPartitions(group, *order)
        _write_files(rows.select(F.col(group).cast("string"), "_line"), local, [group], ",".join(map(_header_cell, feature_cols)))
        return
    write_partitioned(features.select(*cols), path, by=group, fmt="csv", order=order, drop=list(order))


def write_session_tree(df: DataFrame, root: str, group: str, session: str, order: Sequence[str],
                       columns: Sequence[str], mode: str = "append") -> None:
    """``<root>/<group>=<g>/<session>=<s>/part-*.csv``: one CSV file per session, rows in ``order``.

    One file per session is the contract of a session tree, so each session is written by one
    task; use it for bounded sessions (the fixture trees built from the driver tables).
    """
    local = local_folder(df.sparkSession, root)
    if local is not None and mode == "append" and len(columns) > 1:  # a row of a single null has no line in to_csv
        line = F.to_csv(F.struct(*columns)).cast("binary").alias("_line")
        write_lines(df.select(group, session, *order, line), local, group, session, order, ",".join(map(_header_cell, columns)))
        return
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    out = (df.select(group, session, *order, *columns)
           .repartition(int(n), group, session)
           .sortWithinPartitions(group, session, *order)
           .drop(*order))
    out.write.mode(mode).option("header", True).partitionBy(group, session).csv(root)


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The path of a folder in the file system of the machines (``file:``), or None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return folder.toUri().getPath() if files.getUri().getScheme() == "file" else None


def _header_cell(name: str) -> str:
    return '"' + name.replace('"', '\\"') + '"' if re.search('[,"\r\n]', name) else name


def _folder(key: str, value: str | None) -> str:
    """The folder of a value as Spark's writers name it."""
    safe = re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", value or "")
    return f"{key}={safe or '__HIVE_DEFAULT_PARTITION__'}"


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_lines(lines: DataFrame, root: str, group: str, session: str, order: Sequence[str], header: str | None = None) -> None:
    """The ``_line`` (bytes) of each session in ``order`` as ``<root>/<group>=<g>/<session>=<s>/part-*.csv``, after the ``header``.

    ``root`` is a folder that all machines share. Spark's own writers start a process for each file and folder that they
    make on such file systems (to set its permissions), which takes longer than all else in a tree of small files. A
    file appears under its name when it is whole, and a task that is run again writes the same name.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(n, group, session).sortWithinPartitions(group, session, *order)
    _write_files(rows.select(F.col(group).cast("string"), F.col(session).cast("string"), "_line"), root, [group, session], header)


def _write_files(rows: DataFrame, root: str, keys: Sequence[str], header: str | None) -> None:
    """A file for each run of rows with equal ``keys`` (the first columns, text) in a partition, of their ``_line`` (bytes)."""
    write = uuid.uuid4()
    first = b"" if header is None else header.encode() + b"\n"
    os.makedirs(root, exist_ok=True)
    n_keys = len(keys)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, at, file, made = f"part-{part:05d}-{write}.c000.csv", None, None, 0

        def close() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, f"{os.path.dirname(file.name)}/{name}")

        for batch in batches:
            if not batch.num_rows:
                continue
            of_rows = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
            own = batch.column(n_keys).to_pylist()
            begin = 0
            for key, run in groupby(of_rows):
                n = sum(1 for _ in run)
                if key != at:
                    close()
                    folder = "/".join([root, *map(_folder, keys, key)])
                    os.makedirs(folder, exist_ok=True)
                    file, at, made = open(f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}", "wb"), key, made + 1  # noqa: SIM115
                    file.write(first)
                file.write(b"\n".join(own[begin : begin + n]) + b"\n")
                begin += n
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    rows.mapInArrow(save, "files long").agg(F.sum("files")).collect()
