"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed length."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampfold.llm.common import SEED, text_batches, whole_text, worker_state
from ampfold.llm.pretokens import JsonSpec, JsonTokenizer, read_spec, slices
from ampfold.session import checkpoint_dir, scratch_path

#: Proportions are whole parts of this.
PARTS = 1 << 16
#: Queues at most but for those named in the targets; sources with a smaller share of the text than one part in so
#: many share the last queue, by a schedule of their own (:func:`_tail_in_turn`).
MOST_QUEUES = 256
#: A source of the shared queue is served in turns of one part in so many of a sequence.
TAIL_TURNS = 64
#: Rows of the table of queue offsets up to which it is broadcast (24 bytes a row); beyond it is shuffled.
BROADCAST_ROWS = 1_000_000


@dataclass
class Segment:
    """Windows ``first`` to ``first + windows - 1``, in which the same queues take turns.

    ``upto[q]``: parts of all queues up to and with q (regular segment), or tokens of those queues in the
    one window of a segment that ends a queue (``exact``). ``served[q]``: the queue's tokens before it.
    """

    first: int
    windows: int
    upto: list[int]
    served: list[int]
    exact: bool = False

    def credit(self, q: int, window: int, length: int) -> int:
        """Tokens that the queues up to q have together in the segment's first ``window`` windows.

        The whole part of the credit they have earned: what a queue is owed or has had beyond its share,
        its deficit, is under one token and goes on into the next window.
        """
        if q < 0:
            return 0
        return self.upto[q] * window if self.exact else self.upto[q] * window * length // PARTS

    def had(self, q: int, window: int, length: int) -> int:
        return self.credit(q, window, length) - self.credit(q - 1, window, length)


def parts_of(weights: Sequence[float], active: Sequence[int], least: int) -> list[int]:
    """Whole parts of PARTS in proportion to the weights of the active queues, ``least`` parts each at least."""
    weights = [w if n else 0.0 for w, n in zip(weights, active, strict=True)]
    total = sum(weights) or 1.0
    parts = [max(least, int(PARTS * w / total)) if n else 0 for w, n in zip(weights, active, strict=True)]
    largest = max(range(len(parts)), key=parts.__getitem__)
    parts[largest] += PARTS - sum(parts)
    if parts[largest] < least:
        raise ValueError("more queues than the window has room for")
    return parts


def schedule(tokens: Sequence[int], targets: Sequence[float], length: int) -> list[Segment]:
    """The windows of all tokens: regular segments, each followed by the one window that ends a queue.

    Deficit round-robin in closed form: in a regular segment a queue's tokens of any window follow from its
    number, so every task works out its own windows. When a queue cannot fill its turn, the others fill the
    window and go on with their proportions among themselves. At most two segments a queue.
    """
    left, served, out, window = list(tokens), [0] * len(tokens), [], 0
    least = max(1, 2 * PARTS // length)  # two tokens a window: a turn is never negative
    while any(left):
        parts = parts_of(targets, left, least)
        upto = np.cumsum(parts).tolist()
        segment = Segment(window, 0, upto, list(served))
        turn = lambda q, w, s=segment: s.had(q, w, length)
        low, high = 0, sum(left) // length
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if all(turn(q, mid) <= n for q, n in enumerate(left)) else (low, mid - 1)
        had = [turn(q, low) for q in range(len(left))]
        if low:
            segment.windows = low
            out.append(segment)
        left = [n - h for n, h in zip(left, had, strict=True)]
        served = [s + h for s, h in zip(served, had, strict=True)]
        window += low
        if not any(left):
            break
        take = [min(n, turn(q, low + 1) - had[q]) for q, n in enumerate(left)]
        room = length - sum(take)
        for q in sorted(range(len(left)), key=lambda q: (-parts[q], q)):
            more = min(room, left[q] - take[q])
            take[q] += more
            room -= more
        out.append(Segment(window, 1, np.cumsum(take).tolist(), list(served), exact=True))
        left = [n - t for n, t in zip(left, take, strict=True)]
        served = [s + t for s, t in zip(served, take, strict=True)]
        window += 1
    return out


def cut(segments: Sequence[Segment], starts: Sequence[int], q: int, at: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces ``(start, length, sequence, offset)`` of ``n`` tokens that begin at ``at`` in queue q.

    ``starts``: the queue's tokens before each segment.
    """
    start, k = 0, bisect_right(starts, at) - 1
    while start < n:
        s, y = segments[k], at + start - starts[k]
        total, below = s.upto[q], s.upto[q - 1] if q else 0
        scale, parts = (1, 1) if s.exact else (length, PARTS)
        w = 0
        if not s.exact and total > below:  # the share gives the window but for the deficit of under a token
            w = min(s.windows - 1, y * PARTS // ((total - below) * length))
            while s.had(q, w, length) > y:
                w -= 1
            while w < s.windows and s.had(q, w + 1, length) <= y:
                w += 1
        before = below * w * scale // parts
        had = total * w * scale // parts - before
        while start < n and w < s.windows:  # window by window; the credits of one's end are the next one's start
            next_before = below * (w + 1) * scale // parts
            next_had = total * (w + 1) * scale // parts - next_before
            take = min(n - start, next_had - y)
            if take > 0:
                yield start, take, s.first + w, next_before - before + y - had
                start += take
                y += take
            before, had, w = next_before, next_had, w + 1
        k += 1


def _tokenizer(spec: JsonSpec, dtype: str) -> JsonTokenizer:
    return worker_state(("packing", spec, dtype), lambda: JsonTokenizer(spec, dtype))


def _queues(docs: DataFrame, most: int, named: Sequence = ()) -> tuple[DataFrame, list]:
    """Documents with their queue number, and the sources that have a queue of their own: at most ``most``, and
    those ``named`` that the corpus has, of any size."""
    checkpoint_dir(docs.sparkSession)
    sizes = docs.groupBy("_source").agg(F.sum(F.octet_length("_text") + 1).alias("size")).checkpoint()
    total = sizes.agg(F.sum("size").alias("size")).first()["size"] or 0
    own = F.col("size") * most >= F.lit(total)
    for name in named:
        own = own | F.col("_source").eqNullSafe(F.lit(name))
    large = sizes.where(own).orderBy("_source").collect()
    sources = [r["_source"] for r in large]
    if not sources:
        return docs.withColumn("_queue", F.lit(0)), sources
    # Literals, since rows of Python objects start a second daemon of Python workers on every executor.
    kind = docs.schema["_source"].dataType
    names = [F.struct(F.lit(s).cast(kind).alias("_name"), F.lit(i).alias("_queue")) for i, s in enumerate(sources)]
    of = docs.sparkSession.range(1).select(F.inline(F.array(*names)))
    joined = docs.join(F.broadcast(of), F.col("_source").eqNullSafe(F.col("_name")), "left")
    return joined.withColumn("_queue", F.coalesce("_queue", F.lit(len(sources)))).drop("_name"), sources


def _tail_in_turn(tail: DataFrame, length: int) -> DataFrame:
    """The shared queue's documents in turns, with ``_at``, their place in that queue, and ``_start`` in the document.

    A weighted fair queue in closed form: a document is cut into turns, and the turns of all sources are put in the
    order of the share of its tokens that the source has had at a point within each (by the source's hash, so that
    sources of a single turn lie apart). At any place of the queue, and so over
    all windows, every source has had its share of the tail's tokens to within a turn before or after.
    A sort by ranges; the places are sums over the ranges before, of which only a number each goes to one task.
    """
    turn = max(2, length // TAIL_TURNS)
    sums = tail.groupBy("_source", "_part").agg(F.sum("_n").alias("_sum"))
    by = Window.partitionBy("_source")
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
                       F.sum("_sum").over(by).alias("_total"))
    width = F.col("_width")
    rows = tail.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(turn).cast("long"))))
    rows = rows.withColumn("_size", F.least(F.lit(turn).cast("long"), F.col("_n") - F.col("_start")))
    phase = F.pmod(F.xxhash64(F.lit(SEED), "_source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    had = F.col("_base") + F.col("_first") + F.col("_start")
    rows = rows.select(
        "_id", "_queue", "_n", "_width", "_start", "_size", "_source",
        F.substring("_ids", F.col("_start").cast("int") * width + 1, F.col("_size").cast("int") * width).alias("_ids"),
        ((had + phase * F.col("_size")) / F.col("_total")).alias("_share"), had.alias("_had"),
    )
    order = ["_share", "_source", "_had"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id()}).checkpoint()
    places = ranged.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_below") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    placed = ranged.join(F.broadcast(places), F.col("_range") == F.col("_r")).withColumn("_at", at)
    return placed.select("_id", "_queue", "_at", "_n", "_ids", "_width", "_start", "_size")


def tokenised_queues(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The queues as a table in the shared folder: ``_id, _queue, _ids, _n``, the partition ``_part`` and the
    queue's tokens before the document in that partition (``_first``). A queue runs through the partitions. Rows of
    the shared queue have their ``_source``, and ``_first`` counts that source's tokens; others have none."""
    spark, spec = docs.sparkSession, read_spec(path)
    text_batches(spark)
    dtype = "<u2" if max(JsonTokenizer(spec, "<u4").whole.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shared, end, width = spark.sparkContext.broadcast(spec), np.array([end_id], dtype=dtype).tobytes(), int(dtype[2:])
    schema = docs.select("_id", "_queue", "_source").schema.add("_part", "integer").add("_first", "long").add("_n", "long").add("_ids", "binary")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part, served = _tokenizer(shared.value, dtype), TaskContext.get().partitionId(), {}
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2)):
                ids = [b"".join([*v, end]) for v in tokenizer.values(texts)]
                rows = batch.slice(at, len(ids))
                at += len(ids)
                counts, firsts = [len(i) // width for i in ids], []
                for q, s, n in zip(rows.column(1).to_pylist(), rows.column(3).to_pylist(), counts, strict=True):
                    firsts.append(served.get((q, s), 0))
                    served[q, s] = firsts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(3), pa.array([part] * len(ids), pa.int32()), pa.array(firsts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["_id", "_queue", "_source", "_part", "_first", "_n", "_ids"],
                )

    out = scratch_path(spark, "packing")
    docs.select("_id", "_queue", "_text", "_source").mapInArrow(tokenise, schema).write.option("compression", "zstd").parquet(out)
    return spark.read.schema(schema).parquet(out).withColumn("_width", F.lit(width))


def pack(
    docs: DataFrame,
    path: str,
    length: int = 4096,
    end_id: int = 2,
    targets: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: id, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` and ``queue``.

    A document is its tokens by the file's library and ``end_id``. Each source is a queue; every sequence has
    the queues' tokens in the proportions of ``targets`` (source to weight; by default the tokens of each
    source in the corpus), to under a token of deficit that the next one carries. When a queue ends, the others
    go on in proportion. All sequences are full but the last.

    The texts are read for the sizes of the sources and to be tokenised; the ids lie once in the shared folder.
    Rows are not shuffled: a queue's order is that of the stored partitions, and only a number per partition
    and queue is summed up. To the driver go the totals of the queues, ``MOST_QUEUES`` + 1 and one for each
    source named in ``targets`` at most: rarer sources share the last queue, in which each keeps its proportion
    among them (their ids alone are shuffled, by ranges).

    Defined cases: a null or empty text is ``end_id`` alone; a null source is a source; repeated rows are
    documents each; a very long text is cut into as many pieces as it needs; an empty table gives no rows;
    a target of 0, or a source that ``targets`` lacks, has the smallest turn (two tokens) until others end.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), whole_text(text_col).alias("_text"))
    docs, sources = _queues(docs, max(1, min(MOST_QUEUES, length // 4)), list(targets or ()))
    shared = F.col("_queue") == len(sources)
    docs = docs.withColumn("_source", F.when(shared, F.col("_source")))
    queues = tokenised_queues(docs, path, end_id)

    sums = queues.groupBy("_queue", "_part").agg(F.sum("_n").alias("n"))
    running = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_queue", "_part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("_base"), "n").checkpoint()
    tokens = [0] * (len(sources) + 1)
    for r in bases.groupBy("_queue").agg(F.sum("n").alias("n")).collect():
        tokens[r["_queue"]] = r["n"]
    weights = [float(t) for t in tokens]
    segments: list[Segment] = []
    if targets is not None:
        weights = [float(targets.get(s, 0)) for s in sources] + [0.0]
    if any(tokens):
        segments = schedule(tokens, weights, length)
    starts = [[s.served[q] for s in segments] for q in range(len(tokens))]

    fields = queues.select(F.col("_id").alias(id_col)).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"),
                       ("sequence_id", "long"), ("offset", "long"), ("queue", "integer")):
        fields = fields.add(name, kind)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("cut",), dict)  # the tokenizers are not needed any more
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for whole in batches:
            for at_row in range(0, whole.num_rows, 512):
                batch = whole.slice(at_row, 512)
                rows, pieces = [], []
                for i, (q, at, n, data, width, begin, whole_n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 8)), strict=True)):
                    ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4").tobytes()
                    for start, size, sequence, offset in cut(segments, starts[q], q, at, n, length):
                        rows.append(i)
                        pieces.append((begin + start, size, ids[4 * start : 4 * (start + size)], whole_n, sequence, offset, q))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
                arrays += [pa.array(values, kind) for values, kind in zip(zip(*pieces, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=fields.names)

    base = bases.select(F.col("_queue").alias("_q"), F.col("_part").alias("_p"), "_base")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = queues.where(~shared).join(base, (F.col("_queue") == F.col("_q")) & (F.col("_part") == F.col("_p")))
    placed = placed.select("_id", "_queue", (F.col("_base") + F.col("_first")).alias("_at"), "_n", "_ids", "_width",
                           F.lit(0).cast("long").alias("_start"), F.col("_n").alias("_doc_n"))
    if tokens[-1]:
        tail = _tail_in_turn(queues.where(shared), length)
        placed = placed.unionByName(tail.select("_id", "_queue", "_at", F.col("_size").alias("_n"), "_ids", "_width", "_start", F.col("_n").alias("_doc_n")))
    return placed.mapInArrow(cut_all, fields)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens`` and ``ids`` in order. A group is one window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
