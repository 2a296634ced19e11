"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampfold.llm.common import text_batches, whole_text, worker_state
from ampfold.llm.pretokens import Patterns, WorkerCache, patterns, slices, splitter, tiktoken_class

NONE = np.iinfo(np.int64).max
#: Pre-tokens up to this many bytes are merged many at once; longer ones each alone.
TOGETHER = 64


def read_ranks(source: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source.splitlines()) if token}


class Merger:
    """Merges of byte strings by rank: always the lowest rank, the leftmost of equal ones.

    A segment tree over the byte positions holds ``rank * width + position`` of the pair that starts at a
    live position, so its root is the leftmost minimum. A merge sets three leaves: the merged pair's, that
    of the position which dies, and that of the live neighbour on the left, each in logarithmic time.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, merged = [NONE], [0]
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys)[order], np.array(merged)[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and whether it has one (ids below 0 are no tokens)."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return self.merged[at], (self.keys[at] == key) & (left >= 0) & (right >= 0)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each byte string, as the bytes of 32-bit integers."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > TOGETHER:
                out[i] = np.array(self.encode_alone(piece), dtype=np.int32).tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                for i, ids in zip(part, self.encode_together([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Byte strings of at most ``width`` bytes (a power of two): a tree each, merged in step."""
        n, positions = len(pieces), np.arange(width)
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        live = positions < lengths[:, None]
        ids = np.where(live, self.single[data], -1)
        # one column more: the neighbour of the last and of the first position, never a token
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        after = np.tile(np.append(positions + 1, width), (n, 1))
        before = np.tile(np.append(positions - 1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NONE)
        rank, has = self.pair_rank(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(has, rank * width + positions, NONE)
        node = width
        while node > 1:
            half = node // 2
            tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node = half

        def set_leaf(rows, position, value):
            node = position + width
            tree[rows, node] = value
            node = node >> 1
            while node[0]:  # all leaves are equally deep
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            root = tree[rows, 1]
            at, token = root % width, root // width
            dead = after[rows, at]
            following, left = after[rows, dead], before[rows, at]
            ids[rows, at], ids[rows, dead] = token, -1
            after[rows, at] = following
            before[rows, following] = at  # the spare column takes what has no neighbour
            set_leaf(rows, dead, NONE)
            rank, has = self.pair_rank(token, ids[rows, following])
            set_leaf(rows, at, np.where(has, rank * width + at, NONE))
            rank, has = self.pair_rank(ids[rows, left], token)
            inside = left < width
            if inside.any():
                set_leaf(rows[inside], left[inside], np.where(has, rank * width + left, NONE)[inside])
            rows = rows[tree[rows, 1] != NONE]
        ids = ids[:, :-1].astype(np.int32)
        live = ids >= 0
        flat, ends = ids[live].tobytes(), (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_alone(self, piece: bytes) -> list[int]:
        """One byte string of any length, in n log n."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(a):  # of the pair that starts at a: its bytes end where the live position after next begins
            rank = self.ranks.get(piece[a : after[after[a]]]) if after[a] < n else None
            return NONE if rank is None else rank * width + a

        tree = [NONE] * (2 * width)
        tree[width : width + n] = [key(i) for i in range(n)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def set_leaf(position, value):
            node = position + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != NONE:
            at = tree[1] % width
            dead = after[at]
            after[at] = after[dead]
            if after[at] < n:
                before[after[at]] = at
            set_leaf(dead, NONE)
            set_leaf(at, key(at))
            if before[at] >= 0:
                set_leaf(before[at], key(before[at]))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return out


@dataclass
class _Coder:
    split: Callable[[str], list[str]]
    cache: WorkerCache
    tokens: dict[int, bytes]


def _coder(source: bytes, given: Patterns | None = None) -> _Coder:
    """A worker's encoder and decoder."""

    def make() -> _Coder:
        ranks = read_ranks(source)
        merger = Merger(ranks)
        return _Coder(
            splitter(given) if given else list, WorkerCache(lambda pieces: merger.encode([p.encode() for p in pieces])),
            {rank: token for token, rank in ranks.items()},
        )

    return worker_state(("bpe", source, given), make)


def _shared(spark: SparkSession, path: str):
    """The vocabulary file (of a fixed size) for all workers, who need not have it."""
    text_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode_texts(coder: _Coder, texts: list[str]) -> pa.ListArray:
    ids = [b"".join(values) for values in coder.cache.values([coder.split(t) for t in texts])]
    offsets = np.cumsum([0, *map(len, ids)]) // 4
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _decode_ids(coder: _Coder, ids: pa.ListArray) -> pa.Array:
    tokens, flat, offsets = coder.tokens, ids.values.to_numpy(), ids.offsets.to_numpy()
    rows = (b"".join([tokens[t] for t in flat[a:b].tolist()]) for a, b in zip(offsets, offsets[1:], strict=False))
    return pa.array(rows, type=pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Documents with the token ids (array of int) of their whole texts.

    Every match of the pattern is merged alone by the ranks of the file, as the rank library does. Rows stay
    where they are: no shuffle, and each worker merges a pre-token once while it stays in its bounded cache.

    Defined cases: a null or empty text has no ids; a text of any length is taken whole; a column that is
    already called as the new one is replaced.
    """
    source, given = _shared(docs.sparkSession, path), patterns(pattern, tiktoken_class)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(source.value, given)
        for batch in batches:
            for texts in slices(batch):
                yield _encode_texts(coder, texts)

    return docs.withColumn(to, ids_of(whole_text(text_col)))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Rows with the bytes of their token ids (binary; null: no bytes). An id that the file lacks fails the
    job with a KeyError."""
    source = _shared(tokens.sparkSession, path)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(source.value)
        for batch in batches:
            yield _decode_ids(coder, batch)

    return tokens.withColumn(to, bytes_of(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_to: str = "ids", to: str = "decoded") -> DataFrame:
    """Documents with the ids of :func:`encode` and the bytes that :func:`decode` makes of those, in one pass of
    one worker. Defined cases as there."""
    source, given = _shared(docs.sparkSession, path), patterns(pattern, tiktoken_class)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(source.value, given)
        for batch in batches:
            for texts in slices(batch):
                ids = _encode_texts(coder, texts)
                yield pa.StructArray.from_arrays([ids, _decode_ids(coder, ids)], names=["ids", "decoded"])

    out = docs.withColumn("_both", both(whole_text(text_col)))
    return out.withColumns({ids_to: F.col("_both.ids"), to: F.col("_both.decoded")}).drop("_both")
