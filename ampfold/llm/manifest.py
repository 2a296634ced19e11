"""Merkle manifest of a table: rows are leaves, 16 nodes of a level make one of the next, by lag and lead windows.

The rows of a group (a source) are numbered in order, and blocks of 4,096 consecutive nodes go to one task each. Inside a
block one window, ordered by position, climbs three levels: at distance 1, 16 and 256 the lag and lead columns of fixed
offsets, masked by the node's slot and the run's length, are its siblings, and the first child's row hashes the parent.
The blocks' nodes, one row each, are the next table to climb, so a hot group costs more blocks, never a larger task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampfold.llm.common import ascii_lower
from ampfold.plans.ordered import CHUNK, INDEX, stored_chunks
from ampfold.session import checkpoint_dir

#: Children of a node, levels that one window climbs, and the nodes of a block that it takes.
CHILDREN, LEVELS = 16, 3
BLOCK = CHILDREN**LEVELS

#: The siblings of one level, left and right of the node.
STEP = "array<struct<left: string, right: string>>"
_GROUP, _POS, _SIZE, _HASH, _PATH, _BLOCK = "_group", "_pos", "_size", "_hash", "_path", "_block"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The digest of all values in turn: ``-`` for null, else the UTF-8 bytes' number, a colon and the value."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[told(c) for c in columns]))


def climb_block(nodes: DataFrame) -> DataFrame:
    """Nodes (group, position from 0, size of the group, hash) with their block, its hash on the first row, and the
    ``_path`` of siblings over the levels that the block spans (none where the group has one node left)."""
    rows = nodes.withColumn(_BLOCK, F.expr(f"{_POS} div {BLOCK}"))
    order = Window.partitionBy(_GROUP, _BLOCK).orderBy(_POS)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = []
    for level in range(LEVELS):
        far = CHILDREN**level
        slot = F.expr(f"{_POS} div {far} % {CHILDREN}")
        active = F.col(_SIZE) > far  # more than one node of this level
        hash_ = f"_hash_{level}" if level else _HASH
        # Lag and lead of a row that is no first child are null, as is what lies outside the block.
        left = [F.when(slot >= k, F.lag(hash_, k * far).over(order)) for k in range(CHILDREN - 1, 0, -1)]
        right = [F.when(slot + k < CHILDREN, F.lead(hash_, k * far).over(order)) for k in range(1, CHILDREN)]
        own = active & F.col(hash_).isNotNull()
        rows = rows.withColumns({
            f"_left_{level}": F.when(own, F.concat_ws("", *left)), f"_right_{level}": F.when(own, F.concat_ws("", *right)),
        })
        first = F.expr(f"{_POS} % {far * CHILDREN} = 0")
        parent = F.when(active, digest(F.concat(F.col(hash_), F.col(f"_right_{level}")))).otherwise(F.col(hash_))
        rows = rows.withColumn(f"_hash_{level + 1}", F.when(first, parent))
        # The other rows below a node have the siblings of its first row.
        step = F.struct(*[F.last(f"_{side}_{level}", ignorenulls=True).over(so_far).alias(side) for side in ("left", "right")])
        steps.append(F.when(active, F.array(step)).otherwise(F.array().cast(STEP)))
    return rows.select(*nodes.columns, _BLOCK, F.concat(*steps).alias(_PATH), F.col(f"_hash_{LEVELS}").alias("_above"))


def paths(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The nodes with their whole ``_path`` (left and right siblings, level by level), ``_subroot`` and ``_root``.

    ``most`` is the size of the largest group. ``crown`` takes the last node of every group (group, hash) and gives what
    is above it: group, ``_more`` (path), ``_subroot`` and ``_root``. It joins the topmost blocks alone, and each table of
    blocks the one below it by group and block, as the windows left them; so no join is by a hot group's name.
    """
    tiers = []
    while True:
        tiers.append(climb_block(nodes))
        nodes = tiers[-1].where(F.col(_POS) % BLOCK == 0).select(
            _GROUP, F.col(_BLOCK).alias(_POS), F.expr(f"({_SIZE} + {BLOCK - 1}) div {BLOCK}").alias(_SIZE), F.col("_above").alias(_HASH)
        ).checkpoint()  # one row a block
        most = -(-most // BLOCK)
        if most <= 1:
            break
    above = crown(nodes.select(_GROUP, _HASH)).withColumn(_POS, F.lit(0).cast("long"))
    for tier in reversed(tiers):
        above = above.select(F.col(_GROUP).alias("_of"), F.col(_POS).alias("_of_block"), "_more", "_subroot", "_root")
        rows = tier.join(above, (F.col(_GROUP) == F.col("_of")) & (F.col(_BLOCK) == F.col("_of_block")))
        above = rows.withColumn("_more", F.concat(_PATH, "_more")).drop("_of", "_of_block", _BLOCK, _PATH, "_above")
    return above.withColumnRenamed("_more", _PATH)


def numbered(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with their position in their ``_group``, ordered by ``order`` (nulls first), and the group's size; and the
    size of the largest. One range exchange; a hot group lies in many partitions."""
    base = stored_chunks(rows, [F.col(c).asc_nulls_first() for c in (_GROUP, *order)])
    counts = base.groupBy(_GROUP, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min(INDEX).alias("_from"))
    all_ = Window.partitionBy(_GROUP)
    before = all_.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(_GROUP).alias("_of"), F.col(CHUNK).alias("_of_chunk"), F.sum("_n").over(all_).alias(_SIZE),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_offset"),
    ).checkpoint()
    most = offsets.agg(F.max(_SIZE)).first()[0] or 0
    found = base.join(offsets, (F.col(_GROUP) == F.col("_of")) & (F.col(CHUNK) == F.col("_of_chunk")))
    return found.select(*rows.columns, (F.col("_offset") + F.col(INDEX)).alias(_POS), _SIZE), most


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def siblings_hash(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(rows: DataFrame, group_col: str, order_col: str, columns: Sequence[str], also: dict[str, Column] | None = None) -> DataFrame:
    """For each row its ``leaf``, the ``subroot`` of its group, the ``root`` of the table and its ``path``: per level the
    siblings to the left and to the right, from the leaf up to the subroot and on to the root.

    Only the order column, the group and hashes are shuffled, never the values. ``also`` names further columns of the
    rows to carry (keep them narrow).

    Defined cases: null values are leaves of their own kind; rows without a group form one, the first; null order values
    come first in their group, and equal ones ascend by leaf, so that equal rows may change places but nothing else
    depends on chance; a table of one row has its leaf as root and an empty path; an empty table gives no rows; columns
    that are not named are not read, whatever their names.
    """
    checkpoint_dir(rows.sparkSession)
    group = F.col(group_col).cast("string")
    key = F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))  # null before all others, the rest by bytes
    extra = {f"_also_{name}": column for name, column in (also or {}).items()}
    leaves = rows.select(
        key.alias(_GROUP), F.col(order_col).alias("_order"), leaf_hash([F.col(c) for c in columns]).alias(_HASH),
        *[c.alias(name) for name, c in extra.items()],
    )
    placed, most = numbered(leaves, ["_order", _HASH])

    def up_to_root(subroots: DataFrame) -> DataFrame:
        tops, groups = numbered(subroots.select(F.lit("").alias(_GROUP), F.col(_GROUP).alias("_name"), _HASH), ["_name"])
        last = lambda top: top.select(_GROUP, F.array().cast(STEP).alias("_more"), F.col(_HASH).alias("_subroot"), F.col(_HASH).alias("_root"))
        found = paths(tops, groups, last)
        return found.select(F.col("_name").alias(_GROUP), F.col(_PATH).alias("_more"), F.col(_HASH).alias("_subroot"), "_root")

    return paths(placed, most, up_to_root).select(
        F.col("_order").alias(order_col), F.when(F.col(_GROUP) != "0", F.expr(f"substring({_GROUP}, 2)")).alias(group_col),
        F.col(_HASH).alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col(_PATH).alias("path"),
        *[F.col(f"_also_{name}").alias(name) for name in also or {}],
    )


#: What a document's leaf holds, in this order.
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def verify_digest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, with the root that every path gives back when the texts of every fifth id
    (by CRC-32) have lost their upper case."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = leaf_hash([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in DOCUMENT])
    found = manifest(docs, "source", "doc_id", DOCUMENT, {"tampered": F.when(crc % 5 == 0, tampered)})
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
