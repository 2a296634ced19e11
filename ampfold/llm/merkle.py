"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.llm.common import SEED, sha256_hex, whole_text

#: Sections: up to 16 paragraphs, or fewer that end in blank lines. Paragraphs: a line and the line ends after
#: it. Leaves: a sentence, or 128 characters of a longer one. Each level's pieces together are the whole text.
SECTION = r"(?:[^\n]+(?:\n|\z)){1,16}\n*|\n+"
PARAGRAPH = r"[^\n]+\n*|\n+"
LEAF = r"[^.!?\n]{1,128}[.!?\n]*|[.!?\n]+"

#: Rows of a chunk in which a document meets its successor, on average, and chunks at most.
CHUNK_ROWS = 512
MOST_CHUNKS = 1 << 16
LOWEST = -(1 << 63)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("1"), F.array_join(children, "")), 256)


def _leaf(text: Column) -> Column:
    """A leaf's hash and its characters, which are its weight."""
    return F.concat_ws(":", F.sha2(F.concat(F.lit("0"), text), 256), F.char_length(text))


def leaves_of(text: Column) -> Column:
    """The leaves by section and paragraph (array of arrays of arrays of string)."""
    return F.transform(
        _pieces(text, SECTION),
        lambda s: F.transform(_pieces(s, PARAGRAPH), lambda p: F.transform(_pieces(p, LEAF), _leaf)),
    )


def with_tree(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Documents with the tree of a whole text in three columns: ``<prefix>_leaves`` (distinct leaf labels),
    ``<prefix>_sections`` (per section its node and those of its paragraphs) and ``<prefix>_root``.

    Defined cases: a null or empty text has no leaves and the root of no sections; equal texts, and no others,
    have equal roots (but for collisions of SHA-256); a text of any length is taken whole.
    """
    tree = docs.withColumn("_tree", leaves_of(whole_text(text_col)))
    tree = tree.withColumn("_paragraphs", F.transform("_tree", lambda s: F.transform(s, _node)))
    tree = tree.withColumn(f"{prefix}_leaves", F.array_distinct(F.flatten(F.flatten("_tree"))))
    sections = F.transform("_paragraphs", lambda ps: F.struct(_node(ps).alias("node"), ps.alias("paragraphs")))
    tree = tree.withColumn(f"{prefix}_sections", sections).drop("_tree", "_paragraphs")
    return tree.withColumn(f"{prefix}_root", _node(F.col(f"{prefix}_sections.node")))


def weight(leaves: Column) -> Column:
    """Characters of the leaves."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, leaf: n + F.substring_index(leaf, ":", -1).cast("long"))


def likeness(a: str, b: str) -> Column:
    """Characters in the leaves that two trees share, against the mean of both, 0 to 1 (distinct leaves; equal
    roots: 1)."""
    left, right = F.col(f"{a}_leaves"), F.col(f"{b}_leaves")
    both = weight(left) + weight(right)
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).otherwise(
        F.lit(2.0) * weight(F.array_intersect(left, right)) / F.greatest(both, F.lit(1))
    )


def locate_edits(pairs: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """The paragraphs of the ``new`` tree that the ``old`` one lacks: id, ``section`` and ``paragraph`` (from 0).

    The walk goes down only where nodes differ: texts of equal roots stop at once, sections whose node the old
    tree has are left out, and so are the paragraphs of the rest. ``id_col`` names a pair; nodes of repeated ids
    count together.
    """
    changed = pairs.where(F.col(f"{old}_root") != F.col(f"{new}_root"))
    had = changed.select(F.col(id_col).alias("_pair"), F.explode(f"{old}_sections").alias("_section"))
    now = changed.select(F.col(id_col).alias("_pair"), F.posexplode(f"{new}_sections").alias("section", "_section"))
    same = F.col("a._pair").eqNullSafe(F.col("b._pair"))
    nodes = had.select("_pair", F.col("_section.node").alias("_node"))
    now = now.alias("a").join(nodes.alias("b"), same & (F.col("a._section.node") == F.col("b._node")), "left_anti")
    now = now.select("_pair", "section", F.posexplode("_section.paragraphs").alias("paragraph", "_node"))
    nodes = had.select("_pair", F.explode("_section.paragraphs").alias("_node"))
    now = now.alias("a").join(nodes.alias("b"), same & (F.col("a._node") == F.col("b._node")), "left_anti")
    return now.select(F.col("_pair").alias(id_col), "section", "paragraph")


def with_successor(docs: DataFrame, id_col: str, text_col: str, to: str) -> DataFrame:
    """Documents with the text that follows in descending order of the ids (after the last: the first).

    No task orders all rows: (id, text hash) pairs drawn by hash, one in ``CHUNK_ROWS``, part the order into chunks (so
    a chunk's size depends neither on how the ids are spread nor on how often one of them stands there), each first
    document is also a guest at the end of the chunk before, and a window in each chunk looks one row ahead. The texts
    are shuffled once. To the driver go the drawn pairs, about ``MOST_CHUNKS`` at most.

    Defined cases: a null text is empty; ids of any type that has an order; a null id comes after all others; rows of one
    id stand in the order of their texts' hash, and of their texts; a single row follows itself. Rows that are alike in id
    and text share a chunk.
    """
    number = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind = "bigint" if number else "string"
    if number:
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    else:  # hex digits have no comma, and ascend as the bytes of the text do
        key = F.coalesce(F.concat(F.lit("x"), F.hex(F.col(id_col).cast("string").cast("binary"))), F.lit(""))
    hash_ = F.xxhash64(whole_text(text_col))
    ids = docs.select(F.struct(key.alias("k"), hash_.alias("h")).alias("_key"))
    sizes = ids.agg(F.count(F.lit(1)).alias("n"), F.max("_key").alias("top")).first()
    one_in = max(CHUNK_ROWS, -(-sizes["n"] // MOST_CHUNKS))
    drawn = ids.where(F.pmod(F.xxhash64(F.lit(SEED), "_key.k", "_key.h"), F.lit(one_in)) == 0).distinct().collect()
    lowest = (LOWEST if number else "", LOWEST)
    tops = sorted({tuple(r["_key"]) for r in drawn} | {lowest if sizes["top"] is None else tuple(sizes["top"])}, reverse=True)
    # folded into one literal each
    keys, hashes = (F.split(F.lit(",".join(str(t[i]) for t in tops)), ",").cast(f"array<{k}>") for i, k in enumerate((kind, "bigint")))

    def at_least(found: Column, step: Column) -> Column:  # the number of bounds that are not below the row
        more = found + step
        bound = F.get(keys, more - 1)
        above = (bound > F.col("_key")) | ((bound == F.col("_key")) & (F.get(hashes, more - 1) >= F.col("_hash")))
        return F.when((more <= len(tops)) & above, more).otherwise(found)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(tops).bit_length()))])
    rows = docs.withColumns({"_key": key, "_hash": hash_, text_col: whole_text(text_col)})
    rows = rows.withColumn("_chunk", F.aggregate(steps, F.lit(0), at_least) - 1)
    before = F.pmod(F.col("_chunk") - 1, F.lit(len(tops)))
    own, guest = (F.struct(c.alias("chunk"), F.lit(g).alias("guest")) for c, g in ((F.col("_chunk"), 0), (before, 1)))
    first = (F.get(keys, F.col("_chunk")) == F.col("_key")) & (F.get(hashes, F.col("_chunk")) == F.col("_hash"))
    rows = rows.withColumn("_at", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    ahead = Window.partitionBy("_at.chunk").orderBy("_at.guest", F.col("_key").desc(), F.col("_hash").desc(), text_col)
    return rows.withColumn(to, F.lead(text_col).over(ahead)).where("_at.guest = 0").drop("_key", "_hash", "_chunk", "_at")


def half_edited(docs: DataFrame, text_col: str, next_col: str, to: str) -> DataFrame:
    """Documents with a text whose last half is replaced by the first characters of another."""
    n = F.char_length(text_col)
    half = F.floor(n / 2).cast("int")
    return docs.withColumn(to, F.concat(F.substring(text_col, F.lit(1), n - half), F.substring(next_col, F.lit(1), half)))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its tree (``own_*``), that of its half-edited text (``edited_*``, with ``edited_text``) and
    that of the next document (``next_*``), whole trees for :func:`likeness` and :func:`locate_edits`.

    Defined cases as in :func:`with_successor` and :func:`with_tree`; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_own_text"))
    rows = half_edited(with_successor(rows, "_id", "_own_text", "_next_text"), "_own_text", "_next_text", "edited_text")
    for text, prefix in (("_own_text", "own"), ("edited_text", "edited"), ("_next_text", "next")):
        rows = with_tree(rows, text, prefix)
    return rows.withColumnsRenamed({"_id": id_col, "_own_text": text_col, "_next_text": "next_text"})


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The study of ``doc_id, text`` as digests: roots, likenesses and the paragraphs that the edit touched."""
    nodes = lambda p: F.flatten(F.col(f"{p}_sections.paragraphs"))
    return edit_study(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        sha256_hex(F.col("edited_text")).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        F.size(F.array_except(nodes("edited"), nodes("own"))).cast("long").alias("edited_paragraphs"),
    )
