"""Skew-safe computations over consecutive rows of ordered groups.

A plain ``Window.partitionBy(group).orderBy(order)`` puts every row of a group into one
task. If one group holds a third of the data that task holds a third of the data. The
helpers here never do that:

1. Rows are cut into *chunks* that are contiguous in ``(group, order)``. By default the
   chunk is the partition of a ``repartitionByRange`` on ``(group, order)`` -- Spark samples
   the keys and splits a hot group over many partitions. Where the chunk is read by more than
   one branch of a plan (``neighbors``, ``dense_positions``) the ranged rows are checkpointed
   with their chunk number and their index in the chunk, so every branch sees the same values:
   two plans of the same range exchange may sample, and be coalesced, differently. A caller
   that already knows a contiguous chunk (e.g. the file split of a CSV scan) passes it and
   saves the range shuffle.
2. Inside each ``(group, chunk)`` a window computes the pair terms with ``lag`` and an
   aggregate reduces them to one row per chunk, with the chunk's first and last row.
3. A window over the small per-chunk table (at most one row per partition per group)
   adds the terms of the pairs that straddle two chunks; a final aggregate sums per group.

Steps 1 and 2 each move the raw rows once (range, then hash on ``(group, chunk)``); step 3
works on at most one row per partition per group. ``adjacent_sums`` over a numeric or time order
saves step 1: it measures the groups and cuts only the hot ones, by quantile bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.functions.common import as_list
from ampfold.session import checkpoint_dir

CHUNK = "_chunk"
INDEX = "_index"

Measure = Callable[[Mapping[str, Column], Mapping[str, Column]], Column]


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], num_chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: the range partition of the row under ``(keys, order)``."""
    sort_cols = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    if num_chunks:
        ranged = df.repartitionByRange(int(num_chunks), *sort_cols)
    else:
        ranged = df.repartitionByRange(*sort_cols)
    return ranged.withColumn(CHUNK, F.spark_partition_id())


#: Rows of a group that one task takes in order; larger groups are cut. No more than MOST_HOT groups are cut:
#: over so many times the rows, a chunk is larger.
ROWS_PER_CHUNK, MOST_HOT, MOST_CHUNKS = 2_000_000, 10_000, 256


def split_hot_groups(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``_chunk``, without moving a row: 0, but in a group of over ROWS_PER_CHUNK rows the number of that
    group's quantile bounds below the first order column (so chunks ascend, and equal values share one).

    Two reads of the keys, and of the hot groups' order column, give the bounds, a table of at most MOST_HOT rows
    of MOST_CHUNKS numbers, which is broadcast.
    """
    checkpoint_dir(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    limit = max(ROWS_PER_CHUNK, total // MOST_HOT)
    if total <= limit:
        return df.withColumn(CHUNK, F.lit(0))
    hot = sizes.where(F.col("_n") > limit).checkpoint()
    most = hot.agg(F.max("_n").alias("n")).first()["n"]
    if most is None:
        return df.withColumn(CHUNK, F.lit(0))
    names = {k: f"_of_{k}" for k in keys}
    same = F.lit(True)
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    own = hot.drop("_n").withColumnsRenamed(names)
    parts = min(MOST_CHUNKS, -(-most // limit))
    cuts = F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.array()
    bounds = df.select(*keys, order).join(F.broadcast(own), same).groupBy(*names.values()).agg(cuts.alias("_bounds")).checkpoint()
    rows = df.join(F.broadcast(bounds), same, "left")
    below = F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    return rows.withColumn(CHUNK, F.coalesce(F.when(F.col("_bounds").isNotNull(), below), F.lit(0))).drop("_bounds", *names.values())


def adjacent_sums(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    values: Sequence[str] | str,
    measures: Mapping[str, Measure],
    chunk: Column | None = None,
    num_chunks: int | None = None,
) -> DataFrame:
    """Per group of ``keys``: sum of ``measure(cur, prev)`` over consecutive rows in ``order``.

    ``order`` must be a total order inside a group (add a tie-breaker column). ``cur`` and
    ``prev`` map each name in ``values`` to the current and previous row's value; ``prev`` is
    null for the first row of a group. A group without any pair sums to 0.
    """
    keys, order, values = as_list(keys), as_list(order), as_list(values)
    cols = list(dict.fromkeys([*keys, *order, *values]))
    base = df.select(*cols)
    if chunk is not None:
        base = base.withColumn(CHUNK, chunk)
    elif num_chunks is None and isinstance(base.schema[order[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        base = split_hot_groups(base, keys, order[0])  # then the rows move once, by (group, chunk)
    else:
        base = range_chunks(base, keys, order, num_chunks)

    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    cur = {v: F.col(v) for v in values}
    prev = {v: F.lag(v).over(w) for v in values}
    local = base.select(*keys, CHUNK, *order, *values, *[m(cur, prev).alias(n) for n, m in measures.items()])

    row = F.struct(*[F.col(v) for v in values])
    pos = F.struct(*[F.col(o) for o in order])
    per_chunk = local.groupBy(*keys, CHUNK).agg(
        *[F.sum(n).alias(n) for n in measures],
        F.min_by(row, pos).alias("_first"),
        F.max_by(row, pos).alias("_last"),
    )

    wc = Window.partitionBy(*keys).orderBy(CHUNK)
    first = {v: F.col("_first")[v] for v in values}
    prev_last = {v: F.lag("_last").over(wc)[v] for v in values}
    stitched = per_chunk.select(
        *keys,
        *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(m(first, prev_last), F.lit(0))).alias(n) for n, m in measures.items()],
    )
    return stitched.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])


def stored_chunks(df: DataFrame, sort_cols: Sequence[Column], num_chunks: int | None = None) -> DataFrame:
    """The rows sorted by range, checkpointed with ``_chunk`` (range partition) and ``_index``
    (0-based index of the row inside its chunk); chunks ascend with the order."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(int(num_chunks), *sort_cols) if num_chunks else df.repartitionByRange(*sort_cols)
    uid = F.monotonically_increasing_id()
    return (
        ranged.sortWithinPartitions(*sort_cols)
        .withColumn(INDEX, uid)
        .withColumn(CHUNK, F.shiftright(INDEX, 33).cast("int"))
        .withColumn(INDEX, F.col(INDEX).bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their (keys, chunk); null keys match."""
    names = {k: f"_of_{k}" for k in [*keys, CHUNK]}
    chunks = chunks.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, other in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(other))
    return rows.join(chunks, cond, "inner").drop(*names.values())


def neighbors(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    values: Sequence[str] | str,
    pos: str = "pos",
    num_chunks: int | None = None,
) -> DataFrame:
    """Add the 0-based position ``pos`` in the group and, per value ``v``, ``prev_v`` / ``next_v``
    (the neighbours in ``order``, null at the group's ends), skew-safe.

    Inside a chunk ``lag``/``lead`` give the neighbours; the first / last row of a chunk takes
    them from the per-chunk edge rows of the adjacent chunks (a window over the small chunk
    table, joined back on ``(keys, chunk)``). A null key is a group of its own.
    """
    keys, order, values = as_list(keys), as_list(order), as_list(values)
    base = stored_chunks(df, _ascending([*keys, *order]), num_chunks)
    w = Window.partitionBy(*keys, CHUNK).orderBy(INDEX)
    local = base
    for v in values:
        local = local.withColumn(f"_lag_{v}", F.lag(v).over(w)).withColumn(f"_lead_{v}", F.lead(v).over(w))
    row = F.struct(*[F.col(v) for v in values])
    per_chunk = base.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(INDEX).alias("_from"),
        F.min_by(row, F.col(INDEX)).alias("_first"),
        F.max_by(row, F.col(INDEX)).alias("_last"),
    )
    wc = Window.partitionBy(*keys).orderBy(CHUNK)
    edges = per_chunk.select(
        *keys, CHUNK, "_n", "_from",
        F.coalesce(F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.lag("_last").over(wc).alias("_prev_last"),
        F.lead("_first").over(wc).alias("_next_first"),
    )
    out = _join_chunks(local, edges, keys)
    at = F.col(INDEX) - F.col("_from")
    cols = [F.col(c) for c in df.columns]
    for v in values:
        cols.append(F.when(at == 0, F.col("_prev_last")[v]).otherwise(F.col(f"_lag_{v}")).alias(f"prev_{v}"))
        cols.append(F.when(at == F.col("_n") - 1, F.col("_next_first")[v]).otherwise(F.col(f"_lead_{v}")).alias(f"next_{v}"))
    cols.append((F.col("_offset") + at).cast("long").alias(pos))
    return out.select(*cols)


def dense_positions(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[str] | str,
    name: str = "pos",
    start: int = 0,
    num_chunks: int | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) position of each row inside its group, skew-safe.

    The stored index of the row in its chunk, less that of the group's first row there, plus the
    number of rows of the group in earlier chunks (a running sum over the small per-chunk table,
    joined back by key). A null key is a group of its own.
    """
    keys, order = as_list(keys), as_list(order)
    base = stored_chunks(df, _ascending([*keys, *order]), num_chunks)
    counts = base.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min(INDEX).alias("_from"))
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, CHUNK, "_from", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_offset"))
    out = _join_chunks(base, offsets, keys)
    at = F.col("_offset") + F.col(INDEX) - F.col("_from") + F.lit(start)
    return out.select(*df.columns, at.cast("long").alias(name))


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "pos", num_chunks: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order ``order`` (sort columns).

    One range exchange, then the offsets of the chunks: one number per chunk, so the table that
    is broadcast has as many rows as the exchange has partitions, whatever the data.
    """
    base = stored_chunks(df, list(order), num_chunks)
    counts = base.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(CHUNK).alias("_of"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    out = base.join(F.broadcast(offsets), F.col(CHUNK) == F.col("_of"), "inner")
    return out.select(*df.columns, (F.col("_offset") + F.col(INDEX)).cast("long").alias(name))
