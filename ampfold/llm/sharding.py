"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import packed, whole_text
from ampfold.plans.ordered import global_positions

#: Hex digits of MD5 that give a point on the ring (60 bits, a positive long).
POINT_DIGITS = 15


def ring_point(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:POINT_DIGITS], 16)


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Points of all virtual nodes in clockwise order, and the shard that owns each."""
    nodes = sorted((ring_point(f"shard-{s}-node-{v}"), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard takes at most. Without slack they add up to all rows: counts differ by one at most."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(arc_rows: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(arc, first rank, rows, shard, hops)``: where the rows of each arc end up.

    Every arc's rows ask for the shard of the next virtual node clockwise; the rows that find it full
    go on to the following node in the next round. The work depends on the ring's size alone.
    """
    free, runs = list(room), []
    waiting = [(arc, 0, n) for arc, n in enumerate(arc_rows) if n]
    for hops in range(len(owners)):
        rest = []
        for arc, first, n in waiting:
            shard = owners[(arc + hops) % len(owners)]
            taken = min(n, free[shard])
            if taken:
                free[shard] -= taken
                runs.append((arc, first, taken, shard, hops))
            if n > taken:
                rest.append((arc, first + taken, n - taken))
        waiting = rest
        if not waiting:
            break
    if waiting:
        raise ValueError("the shards' room is smaller than the number of rows")
    return sorted(runs)


def shard_rows(
    rows: DataFrame,
    key: str = "doc_id",
    shards: int = 8,
    virtual_nodes: int = 128,
    slack: float = 0.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows with ``home_shard`` (of the first virtual node clockwise of the key's point), ``shard`` (where
    the bounded loads put the row), ``hops`` (virtual nodes passed) and ``slot`` (gapless from 0 in a shard).

    Rows are ranked along the ring by one range exchange; per arc only a count goes to the driver (shards x
    virtual nodes numbers, whatever the data), and the runs of :func:`place` turn a rank into shard and slot.
    ``tie`` orders rows of one key, so the result does not depend on the layout unless rows are alike.

    Defined cases: a null key is a key of its own (that of the empty string); rows of a repeated key share a
    point, and may overflow one after another, a hot key over several shards; an empty table gives no rows.
    """
    points, owners = ring(shards, virtual_nodes)
    edges = np.array(points, dtype=np.int64)

    @F.pandas_udf("int")
    def arc_of(point: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, point.to_numpy(), side="left")
        return pd.Series((at % len(edges)).astype("int32"))

    user = lambda c: F.col("_doc")[c]
    point = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, POINT_DIGITS), 16, 10)
    placed = packed(rows, _point=point.cast("long")).withColumn("_arc", arc_of("_point"))
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    # arc 0 also holds the points after the last node: the order is by arc, then clockwise inside it
    order = [F.col("_arc"), (F.col("_point") <= int(edges[0])).asc(), F.col("_point"), user(key), *map(user, tie), F.col("_row")]
    ranked = global_positions(placed, order, "_rank")

    counts = dict(ranked.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect())
    arc_rows = [counts.get(a, 0) for a in range(len(owners))]
    starts = [0, *accumulate(arc_rows)]
    runs = place(arc_rows, owners, capacities(starts[-1], shards, slack))
    first = np.array([starts[a] + f for a, f, *_ in runs] or [0], dtype=np.int64)
    shard = np.array([s for *_, s, _ in runs] or [0], dtype=np.int32)
    hops = np.array([h for *_, h in runs] or [0], dtype=np.int32)
    size = np.array([n for _, _, n, _, _ in runs] or [0], dtype=np.int64)
    base = np.zeros_like(first)  # rows of the shard before the run
    for s in range(shards):
        own = shard == s
        base[own] = np.cumsum(size[own]) - size[own]
    owner_of = np.array(owners, dtype=np.int32)

    @F.pandas_udf("home_shard int, shard int, hops int, slot long")
    def seat(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(first, rank.to_numpy(), side="right") - 1
        return pd.DataFrame({
            "home_shard": owner_of[arc.to_numpy()], "shard": shard[at], "hops": hops[at],
            "slot": base[at] + rank.to_numpy() - first[at],
        })

    names = ["home_shard", "shard", "hops", "slot"]
    out = ranked.withColumn("_seat", seat("_arc", "_rank"))
    return out.select(*[user(c).alias(c) for c in rows.columns if c not in names], *[F.col(f"_seat.{c}").alias(c) for c in names])


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **ring_args) -> DataFrame:
    """Documents over shards with row counts at most one apart: id, ``size`` (UTF-8 bytes + 1) and ``text_crc32``
    of the text (null: empty), and the columns of :func:`shard_rows`."""
    data = whole_text(text_col).cast("binary")
    keys = docs.select(F.col(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return shard_rows(keys, id_col, shards, tie=["text_crc32", "size"], **ring_args)
