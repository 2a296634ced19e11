"""Token counts of whole texts by a two-tier lookup, without moving any pre-token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import merge_in_tree, text_batches, whole_text, worker_state
from ampfold.llm.pretokens import JsonSpec, JsonTokenizer, read_spec, slices

#: Entries of the broadcast table of frequent pre-tokens, and of every summary on the way to it.
FREQUENT = 16_384


def _tokenizer(spec: JsonSpec, packed: tuple[bytes, bytes, bytes] | None = None) -> JsonTokenizer:
    return worker_state(("counts", spec, packed), lambda: JsonTokenizer(spec, pinned=_unpacked(*packed) if packed else None))


def prune(counts: Counter, most: int) -> Counter:
    """The ``most`` heaviest entries, less the count of the first that goes: a mergeable summary of heavy hitters.

    A pre-token with more than 1/most of all occurrences is never lost, however the summaries are merged.
    """
    if len(counts) <= most:
        return counts
    ranked = counts.most_common(most + 1)
    least = ranked[-1][1]
    return Counter({w: n - least for w, n in ranked[:-1] if n > least})


def frequent_pretokens(docs: DataFrame, spec: JsonSpec, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all texts, by one bounded summary per partition, merged in a tree.

    What moves are the summaries, of at most ``most`` entries each, one for each partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def summary(counts: Counter, part: int) -> pa.RecordBatch:
        counts = prune(counts, most)
        return pa.RecordBatch.from_pydict(
            {"part": [part], "words": [list(counts)], "counts": [list(counts.values())]},
            pa.schema([("part", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]),
        )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, counts = _tokenizer(shared.value).pieces, Counter()
        for batch in batches:
            for part in slices(batch.column(0)):
                for text in part:
                    counts.update(pieces(text))
                if len(counts) > 16 * most:
                    counts = prune(counts, 4 * most)
        yield summary(counts, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        counts, part = Counter(), table.column("part")[0].as_py()
        for words, n in zip(table.column("words"), table.column("counts"), strict=True):
            counts.update(dict(zip(words.as_py(), n.as_py(), strict=True)))
            counts = prune(counts, most)
        return pa.Table.from_batches([summary(counts, part)])

    if not spec.patterns:
        return []
    schema = "part long, words array<string>, counts array<long>"
    texts = docs.select(whole_text(text_col))
    found = merge_in_tree(texts.mapInArrow(summarise, schema), texts.rdd.getNumPartitions(), merge)
    row = found.first()
    return row["words"] if row else []


def pack_lengths(words: list[str], lengths: list[int]) -> tuple[bytes, bytes, bytes]:
    """The table as three byte strings: the words, where each ends, and the token counts."""
    data = [w.encode() for w in words]
    return b"".join(data), np.cumsum([len(d) for d in data], dtype=np.uint32).tobytes(), np.array(lengths, dtype=np.uint16).tobytes()


def _unpacked(words: bytes, ends: bytes, lengths: bytes) -> dict[str, int]:
    stops = np.frombuffer(ends, dtype=np.uint32).tolist()
    return {
        words[a:b].decode(): n
        for a, b, n in zip([0, *stops], stops, np.frombuffer(lengths, dtype=np.uint16).tolist(), strict=False)
    }


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", to: str = "n_tokens", frequent: int = FREQUENT) -> DataFrame:
    """Documents with the number of tokens of their whole texts, as the file's library counts them.

    Tier one: the token counts of the ``frequent`` most frequent pre-tokens of the corpus, one compact
    table that is broadcast (its size is bounded by the parameter). Tier two: all others are encoded by the
    library once per worker and kept in a bounded cache. The texts are read twice and never shuffled.

    Special strings inside a text count as the library's default has them, as one token each.

    Defined cases: a null or empty text has 0 tokens; a text of any length is taken whole; a pre-token of
    more than 65,535 tokens is left to tier two; a column called as the new one is replaced.
    """
    text_batches(docs.sparkSession)
    spec = read_spec(path)
    words = frequent_pretokens(docs, spec, text_col, frequent)
    special = {w for w, _ in spec.special}
    words = [w for w in words if w not in special]
    lengths = [v[0] for v in JsonTokenizer(spec).cache.values([[w] for w in words])] if words else []
    table = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 1 << 16]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((spec, pack_lengths([w for w, _ in table], [n for _, n in table])))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(*shared.value)
        for batch in batches:
            for texts in slices(batch):
                yield pa.array([sum(v) for v in tokenizer.values(texts)], type=pa.int64())

    return docs.withColumn(to, count(whole_text(text_col)))
