"""Near-duplicates by SimHash: tiled exact comparison of fingerprints, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import SEED, keep_rows, sha256_hex, text_batches, whole_text, worker_state
from ampfold.session import checkpoint_dir

BITS = 64
#: A tile is keyed by the bit counts of this many equal parts of the fingerprint.
PARTS = 4
#: Fingerprints in one block of a tile; a pair of blocks is one comparison matrix.
BLOCK = 1024


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included (fewer words: of the whole sequence)."""
    words = text.encode().lower().split()  # on bytes both touch ASCII alone: A-Z, and space or 09-0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str, size: int) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; without words all bits are 0."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The fingerprint of each whole text as a long."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_state(("simhash",), dict)
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), shingle) for t in batch], type=pa.int64())

    return prints(whole_text(text))


def part_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the equal parts of each fingerprint, a row each."""
    width = BITS // PARTS
    parts = [(prints >> np.uint64(i * width)) & np.uint64((1 << width) - 1) for i in range(PARTS)]
    return np.stack([np.bitwise_count(p) for p in parts], axis=1).astype(np.int64)


def tile_key(counts: np.ndarray) -> np.ndarray:
    base = BITS // PARTS + 1
    return counts @ (base ** np.arange(PARTS))


def offsets_within(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that two fingerprints within the radius can have, one of each opposite two.

    A differing bit changes the count of one part by one, so the differences add up to the radius at most;
    tiles that lie further apart are skipped.
    """
    near = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * PARTS]


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a pair of blocks, thinned to a forest: every node with links, and a node of its component."""
    distance = np.bitwise_count(left[:, None] ^ right[None, :])
    a, b = np.nonzero(distance <= radius)
    if same:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return left[:0], left[:0]
    nodes = left if same else np.concatenate([left, right])
    root = components_of(len(nodes), a, b if same else b + len(left))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints (column ``fp``, distinct) that span the same components
    as all pairs within ``radius`` bits.

    Fingerprints are dealt into tiles by the bit counts of their parts and cut into blocks. Every block meets
    the blocks of the tiles that the radius can reach, each two once; a pair of blocks is compared exactly by
    exclusive-or and bit counts, and gives at most one link per fingerprint.
    """
    offsets = offsets_within(radius)
    steps = np.array(offsets, dtype=np.int64)

    @F.arrow_udf("int")
    def tile(fp: pa.Array) -> pa.Array:
        return pa.array(tile_key(part_counts(fp.to_numpy(zero_copy_only=False).view(np.uint64))).astype(np.int32))

    # blocks: the fingerprints of a tile dealt by hash, so that a tile of any size has blocks of about BLOCK
    tiled = prints.select("fp", tile("fp").alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")  # at most 17^4 tiles, whatever the data
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks").cast("long")).cast("int"))
        .groupBy("tile", "block", "n_blocks")
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    ).checkpoint()

    @F.arrow_udf("array<int>")
    def reachable(tiles: pa.Array) -> pa.Array:
        base, top = BITS // PARTS + 1, BITS // PARTS
        keys = tiles.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = (keys[:, None] // base ** np.arange(PARTS)) % base
        out = []
        for row in counts:
            to = row + steps
            out.append(tile_key(to[((to >= 0) & (to <= top)).all(axis=1)]))
        return pa.array(out, type=pa.list_(pa.int32()))

    asks = blocks.select("tile", "block", F.col("fps").alias("left"), F.explode(reachable("tile")).alias("other"))
    others = blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("fps").alias("right"))
    once = (F.col("tile") != F.col("other")) | (F.col("block") <= F.col("other_block"))
    pairs = asks.join(others, "other").where(once).select(
        "left", "right", ((F.col("tile") == F.col("other")) & (F.col("block") == F.col("other_block"))).alias("same")
    )

    def compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sides = [(batch.column(i).values.to_numpy().view(np.uint64), batch.column(i).offsets.to_numpy()) for i in (0, 1)]
            for i, same in enumerate(batch.column(2).to_pylist()):
                left, right = (values[at[i] : at[i + 1]] for values, at in sides)
                found.append(compare(left, right, radius, same))
            a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.mapInArrow(compare_pairs, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``: two nodes have the same root if links join them.

    Large-star and small-star steps in turn: each points a node's neighbours to the smallest of them. They are
    joins and minima by node (no neighbour list is ever gathered), with a reliable checkpoint a round, until
    nothing changes; the rounds grow with the logarithm of the longest chain.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        # a star forest: every node points to one root, which points nowhere
        more = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        inner = small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        edges = small
        if more.unionByName(inner).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """One row per document: ``_id``, ``fp``, ``_sha``, ``component_id``, and ``root``, a fingerprint that is the
    component's own (a ``component_id`` may be of several: null, or an id that several texts carry)."""
    checkpoint_dir(docs.sparkSession)
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"),
        F.unhex(sha256_hex(whole_text(text_col))).alias("_sha"),
    ).checkpoint()
    prints = rows.groupBy("fp").agg(F.min("_id").alias("low")).checkpoint()
    roots = connected_components(links(prints.select("fp"), radius))
    of = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return rows.join(of, F.col("fp") == F.col("_fp")).select("_id", "fp", "_sha", "component_id", "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id that
    links of at most ``radius`` differing bits reach, its own included) and ``text_sha256``.

    Only distinct fingerprints are compared, so a group of copies of any size is one of them.

    Defined cases: a null text is empty; texts without words have the fingerprint zero and link like others;
    a null id is the component's only if all its ids are null; repeated rows stay; an empty table gives no
    rows; other columns are ignored.
    """
    return _rooted(docs, id_col, text_col, shingle, radius).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component of :func:`simhash_groups`, that of the smallest id (nulls last) and then of
    the smallest SHA-256, with all its columns. Components are told apart by their roots, whatever their ids."""
    found = _rooted(docs, id_col, text_col, shingle, radius).where(F.col("_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct(F.lower(F.hex("_sha")).alias("sha"), F.col("_id").alias("id"))).alias("first"))
    return keep_rows(docs, kept.select(F.col("first.id").alias("_id"), F.col("first.sha").alias("_sha")), id_col, text_col)
