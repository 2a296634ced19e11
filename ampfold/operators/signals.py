"""Per-group signal features as DataFrame operators.

Every function takes the DataFrame and the column names (``group``, ``order``, ``x``, ``y``),
so the same code runs on charging sessions and on any other grouped, ordered table.
Order-free features are one ``groupBy().agg()`` (partial aggregation, skew-safe);
order-dependent ones go through :mod:`ampfold.plans.ordered` (range chunks, never one
task per group).
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.functions import signals as S
from ampfold.functions.cleaning import nan_to_null
from ampfold.functions.common import as_list
from ampfold.plans import ordered
from ampfold.session import checkpoint_dir

# ---------------------------------------------------------------------------------------
# Pair terms used by the order-dependent features
# ---------------------------------------------------------------------------------------


def jump_term(col: str, threshold: float = 0.1):
    """1 when |v - previous v| > threshold (strict), null when either side is missing."""

    def term(cur, prev) -> Column:
        d = F.abs(cur[col] - prev[col])
        return F.when(d.isNull(), F.lit(None).cast("long")).otherwise((d > F.lit(threshold)).cast("long"))

    return term


def trapezoid_term(x: str, y: str):
    """Area of one trapezoid between the previous point and the current one."""

    def term(cur, prev) -> Column:
        return (cur[x] - prev[x]) * (cur[y] + prev[y]) / F.lit(2.0)

    return term


# ---------------------------------------------------------------------------------------
# Order-free features
# ---------------------------------------------------------------------------------------


def linear_fit(df: DataFrame, group, x: str, y: str, prefix: str = "") -> DataFrame:
    """slope and r2 of y on x (pairwise-complete rows), and the mean of y over all its rows."""
    group = as_list(group)
    xs, ys = nan_to_null(x), nan_to_null(y)
    clean = df.select(*group, xs.alias("_x"), ys.alias("_y"))
    return clean.groupBy(*group).agg(
        S.fit_slope("_y", "_x").alias(f"{prefix}slope"),
        S.fit_r2("_y", "_x").alias(f"{prefix}r2"),
        F.avg("_y").alias(f"{prefix}y_mean"),
    )


def unique_values(df: DataFrame, group, col: str, name: str = "n_unique", approximate: bool = False,
                  rsd: float = 0.01) -> DataFrame:
    """Distinct values per group, "missing" counted as one value.

    Exact by default (partial aggregation on ``(group, value)``); ``approximate=True`` uses a
    HyperLogLog++ sketch (``approx_count_distinct``, relative error ``rsd``) for very long groups.
    """
    group = as_list(group)
    v = F.col("_v")
    expr = S.n_unique("_v") if not approximate else (
        F.approx_count_distinct(v, rsd) + F.coalesce(F.max(v.isNull().cast("int")), F.lit(0))).cast("long")
    return df.select(*group, nan_to_null(col).alias("_v")).groupBy(*group).agg(expr.alias(name))


def value_mode(df: DataFrame, group, col: str, name: str = "mode") -> DataFrame:
    """Most frequent non-missing value per group, the smallest on ties; null when all are missing.

    Two-level aggregate: counts per ``(group, value)`` (partial aggregation, spill-safe), then the
    best ``(count desc, value asc)`` per group with ``min_by`` - no per-group value map.
    """
    group = as_list(group)
    counts = (df.select(*group, nan_to_null(col).alias("_v")).groupBy(*group, "_v")
              .agg(F.count(F.lit(1)).alias("_n")))
    key = F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("nn"), F.col("_v").alias("v")))
    return counts.groupBy(*group).agg(F.min_by(F.col("_v"), key).alias(name))


def peak_location(df: DataFrame, group, order, x: str, y: str) -> DataFrame:
    """Maximum of y and the x of its first occurrence in ``order``."""
    group, order = as_list(group), as_list(order)
    clean = df.select(*group, *order, nan_to_null(x).alias("_x"), nan_to_null(y).alias("_y"))
    return clean.groupBy(*group).agg(
        F.max("_y").alias("y_max"),
        S.value_at_first_max("_x", "_y", order).alias("x_at_max"),
    )


# ---------------------------------------------------------------------------------------
# Order-dependent features
# ---------------------------------------------------------------------------------------


def jump_counts(df: DataFrame, group, order, cols: dict[str, str], threshold: float = 0.1,
                chunk: Column | None = None) -> DataFrame:
    """For each ``name -> column``: number of consecutive rows (in ``order``) whose values differ
    by more than ``threshold``. All columns share one ordered pass.

    A missing value breaks the pair on both sides (it is not skipped over).
    """
    group, order = as_list(group), as_list(order)
    srcs = list(dict.fromkeys(cols.values()))
    base = df.select(*group, *order, *[nan_to_null(c).alias(f"_v{i}") for i, c in enumerate(srcs)])
    alias = {c: f"_v{i}" for i, c in enumerate(srcs)}
    measures = {name: jump_term(alias[c], threshold) for name, c in cols.items()}
    out = ordered.adjacent_sums(base, group, order, list(alias.values()), measures, chunk=chunk)
    return out.select(*group, *[F.col(n).cast("long").alias(n) for n in cols])


def value_jumps(df: DataFrame, group, order, col: str, threshold: float = 0.1, name: str = "jumps",
                chunk: Column | None = None) -> DataFrame:
    """Number of consecutive rows (in ``order``) whose values differ by more than ``threshold``."""
    return jump_counts(df, group, order, {name: col}, threshold=threshold, chunk=chunk)


def curve_area(df: DataFrame, group, x: str, y: str, tie: Sequence[str] | str | None = None,
               name: str = "area", positive_only: bool = False) -> DataFrame:
    """Trapezoid area under y(x) over the rows where both are present, points sorted by (x, tie).

    ``positive_only`` keeps only points with y > 0 (gaps left by removed points are bridged).
    0 and 1 point give 0.
    """
    group, tie = as_list(group), as_list(tie)
    pts = df.select(*group, *tie, nan_to_null(x).alias("_x"), nan_to_null(y).alias("_y"))
    pts = pts.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if positive_only:
        pts = pts.where(F.col("_y") > 0)
    out = ordered.adjacent_sums(pts, group, ["_x", *tie], ["_x", "_y"], {name: trapezoid_term("_x", "_y")})
    return out.select(*group, F.col(name).cast("double").alias(name))


def positive_area(df: DataFrame, group, x: str, y: str, tie=None, name: str = "positive_area") -> DataFrame:
    return curve_area(df, group, x, y, tie=tie, name=name, positive_only=True)


def curve_areas(df: DataFrame, group, x: str, y: str, tie=None, area: str = "area",
                positive: str = "positive_area") -> DataFrame:
    """Both areas from ONE range shuffle: each positive point is emitted twice (curve 0 and 1)."""
    group, tie = as_list(group), as_list(tie)
    pts = df.select(*group, *tie, nan_to_null(x).alias("_x"), nan_to_null(y).alias("_y"))
    pts = pts.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    curves = F.when(F.col("_y") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pts = pts.withColumn("_curve", F.explode(curves))
    sums = ordered.adjacent_sums(pts, [*group, "_curve"], ["_x", *tie], ["_x", "_y"], {"_a": trapezoid_term("_x", "_y")})
    out = sums.groupBy(*group).agg(
        F.sum(F.when(F.col("_curve") == 0, F.col("_a"))).alias(area),
        F.sum(F.when(F.col("_curve") == 1, F.col("_a"))).alias(positive),
    )
    return out.select(*group, F.coalesce(F.col(area), F.lit(0.0)).alias(area),
                      F.coalesce(F.col(positive), F.lit(0.0)).alias(positive))


# ---------------------------------------------------------------------------------------
# Peak detection: strict local maxima with plateaus, height threshold, minimum distance
# ---------------------------------------------------------------------------------------


def peak_candidates(df: DataFrame, group, order, y: str, rel_height: float = 0.1) -> DataFrame:
    """Local maxima of y along ``order``: ``group..., position, height`` (0-based sample positions).

    A maximum is a run of equal values with a strictly lower neighbour on both sides; a plateau
    reports its middle sample (lower middle for an even length). The ends of a series are never
    peaks. Kept when height >= ``rel_height`` * max(y) of the group (inclusive).

    Plan: one skew-safe neighbour pass gives position, previous and next value; the run edges
    (every run start, and every end with a lower next value) are checkpointed with the group's
    maximum beside them, and paired by a second neighbour pass over that much smaller set. No
    window ever spans a whole group.
    """
    group, order = as_list(group), as_list(order)
    base = df.select(*group, *order, nan_to_null(y).alias("_y"))
    nb = ordered.neighbors(base, group, order, ["_y"], pos="_pos")
    y_, prev_, next_ = F.col("_y"), F.col("prev__y"), F.col("next__y")
    is_start = ~prev_.eqNullSafe(y_) | prev_.isNull()
    is_end = ~next_.eqNullSafe(y_) | next_.isNull()
    rising = is_start & prev_.isNotNull() & (prev_ < y_)
    falling = is_end & next_.isNotNull() & (next_ < y_)
    edges = nb.where(y_.isNotNull() & (is_start | falling)).select(
        *group, "_pos", "_y", rising.alias("_rising"), is_start.alias("_start"), falling.alias("_falling")).checkpoint()
    paired = ordered.neighbors(edges.withColumn("_rise_i", F.col("_rising").cast("int"))
                               .withColumn("_pos_d", F.col("_pos").cast("double")),
                               group, ["_pos"], ["_rise_i", "_pos_d"], pos="_edge_pos")
    # an end that is not itself a start: its run start is the previous edge row
    start_pos = F.when(F.col("_start"), F.col("_pos")).otherwise(F.col("prev__pos_d").cast("long"))
    start_rising = F.when(F.col("_start"), F.col("_rising")).otherwise(F.col("prev__rise_i") == 1)
    peaks = paired.where(F.col("_falling") & start_rising).select(
        *group, F.floor((start_pos + F.col("_pos")) / F.lit(2)).cast("long").alias("position"),
        F.col("_y").alias("height"))
    ymax = edges.groupBy(*group).agg(F.max("_y").alias("_ymax"))  # every run of equal values has its start there
    return peaks.join(ymax, on=group).where(F.col("height") >= F.col("_ymax") * F.lit(rel_height)).drop("_ymax")


#: Samples in a block of the distance rule (a block has at most half as many peaks).
BLOCK_SAMPLES = 1 << 18
#: Peaks that one call decides, about: small blocks, of short series, go together.
PEAKS_PER_TASK = 50_000
_UNDECIDED, _KEPT, _DROPPED = 0, 1, 2


def decide_in_order(position: list, height: list, status: list, own: list, distance: int) -> list:
    """Statuses after one pass over a block's peaks from the highest down (ties: the later position first).

    A peak with a kept one closer than ``distance`` is dropped, one with neither a kept nor an open one there is
    kept. ``own`` flags the peaks that may be decided; the others, of the neighbouring blocks, are as they were.
    """
    kept, open_ = [], []

    def near(places, p):
        i = bisect_left(places, p - distance + 1)
        return i < len(places) and places[i] < p + distance

    for i in sorted(range(len(position)), key=lambda i: (height[i], position[i]), reverse=True):
        if status[i] == _UNDECIDED and own[i]:
            if near(kept, position[i]):
                status[i] = _DROPPED
            elif not near(open_, position[i]):
                status[i] = _KEPT
        if status[i] != _DROPPED:
            insort(kept if status[i] == _KEPT else open_, position[i])
    return status


def select_by_distance(peaks: DataFrame, group, distance: float = 5) -> DataFrame:
    """Keep the highest peaks first and drop every peak closer than ``distance`` samples to a kept one.

    Priority: height, then the later position on equal heights. A group's positions are cut into blocks of
    fixed length (also a hot group is many blocks); each block decides, from the highest peak down, all that do
    not hang on an open peak of a neighbouring block, of which it sees those within the distance. The rounds go
    on until nothing is open, so they are as many as the blocks that a chain of rising peaks runs through, not as
    many as its peaks. Each round's table is checkpointed, so a lost executor costs one round.
    """
    group = as_list(group)
    d = math.ceil(distance)
    p = peaks.select(*group, "position", "height")
    if d <= 1:
        return p
    checkpoint_dir(peaks.sparkSession)
    size = max(BLOCK_SAMPLES, 4 * d)
    block = F.floor(F.col("position") / F.lit(size)).cast("long")
    state = p.select("*", F.lit(_UNDECIDED).alias("status")).checkpoint()
    schema = T.StructType([f for f in state.schema.fields])

    def decide(pdf):  # the blocks of one bucket, each by itself
        codes = pdf.groupby([*group, "_block"], dropna=False, sort=False).ngroup().to_numpy()
        order = codes.argsort(kind="stable")
        pdf = pdf.iloc[order]
        ends = [*(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(pdf)]
        columns = [pdf[c].tolist() for c in ("position", "height", "status", "_own")]
        status, start = [], 0
        for end in ends:
            status += decide_in_order(*(c[start:end] for c in columns), d)
            start = end
        return pdf.assign(status=status).loc[pdf["_own"], schema.names]

    buckets = -(-state.count() // PEAKS_PER_TASK) or 1
    while not state.where(F.col("status") == _UNDECIDED).isEmpty():
        at = F.pmod(F.col("position"), F.lit(size))
        copies = F.filter(F.array(
            F.struct(block.alias("b"), F.lit(True).alias("own")),
            F.when(at < d, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))),
            F.when(at >= size - d, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))),
        ), lambda c: c.isNotNull())
        rows = state.withColumn("_c", F.explode(copies)).select("*", F.col("_c.b").alias("_block"), F.col("_c.own").alias("_own")).drop("_c")
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*group, "_block"), F.lit(buckets)))
        state = rows.groupBy("_bucket").applyInPandas(decide, schema).checkpoint()
    return state.where(F.col("status") == _KEPT).select(*group, "position", "height")


def peak_detection(df: DataFrame, group, order, y: str, rel_height: float = 0.1, distance: float = 5) -> DataFrame:
    """``group..., position, height`` of the peaks kept by the height and distance rules."""
    cands = peak_candidates(df, group, order, y, rel_height)
    return select_by_distance(cands, group, distance)
