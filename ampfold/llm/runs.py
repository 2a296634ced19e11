"""Periodic runs of words: maximal pairs out of a bottom-up tree of LCP intervals with left-word classes.

A run of smallest period q begins where a stretch of words and the same stretch q words later form a maximal pair: the
words to their left differ, and so do those to their right. The pairs of one LCP interval are those between its
children whose left words are of different classes; an interval of l words gives runs of at most l / 2 words' period
that are l plus the period long, so nothing has to be extended.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import sha256_hex, text_batches, whole_text
from ampfold.llm.pretokens import slices

#: What parts words, and words themselves.
WORD = r"[^\x20\x09-\x0D]+"
#: A run's fewest words, and fewest periods.
FEWEST_WORDS, FEWEST_PERIODS = 24, 3
#: Positions in one piece of a sorted list.
PIECE = 512

_words = re.compile(WORD).findall
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RESULT = f"struct<runs: array<{_RUN}>, collapsed: string>"
_TYPE = pa.struct([
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])


class Positions:
    """Word positions in order, in pieces, so that one more costs little however many there are."""

    __slots__ = ("pieces", "tops", "size")

    def __init__(self, position: int) -> None:
        self.pieces, self.tops, self.size = [[position]], [position], 1

    def add(self, position: int) -> None:
        at = min(bisect_left(self.tops, position), len(self.tops) - 1)
        piece = self.pieces[at]
        insort(piece, position)
        self.size += 1
        if len(piece) > 2 * PIECE:
            self.pieces[at : at + 1] = [piece[:PIECE], piece[PIECE:]]
            self.tops[at : at + 1] = [piece[PIECE - 1], piece[-1]]
        else:
            self.tops[at] = piece[-1]

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The neighbours before and after a position that is not among them."""
        at = bisect_left(self.tops, position)
        if at == len(self.tops):
            return self.tops[-1], None
        piece = self.pieces[at]
        i = bisect_left(piece, position)
        return (piece[i - 1] if i else self.tops[at - 1] if at else None), piece[i]

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece


def merge_children(a: Positions, b: Positions, common: int, left: list[int], found: dict[tuple[int, int], int]) -> Positions:
    """One list of the positions of two children of an interval of ``common`` words; their maximal pairs go to ``found``.

    Each position of the smaller list meets its neighbours in the larger one, and counts if their left words are of
    different classes. No pair of a run's smallest period is missed: the occurrences of the interval's words within half
    their length of each other are steps of that period, and only the first of them has a left word of another class.
    """
    if a.size < b.size:
        a, b = b, a
    far = common // (FEWEST_PERIODS - 1)
    for position in b:
        before, after = a.around(position)
        for one, other in ((before, position), (position, after)):
            if one is None or other is None or other - one > far or left[one] == left[other]:
                continue
            period = other - one
            key = (one, common + period)
            if common + period >= FEWEST_WORDS and period < found.get(key, period + 1):
                found[key] = period  # a stretch that is found by a multiple of its period is found by that too
    for position in b:
        a.add(position)
    return a


def fewest_common() -> int:
    """The fewest common words of a run's pair, whatever its period."""
    return min(max(FEWEST_WORDS - p, (FEWEST_PERIODS - 1) * p) for p in range(1, FEWEST_WORDS + 1))


def maximal_pairs(order: list[int], lcp: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """The smallest period of every run by its start and length: from the sorted suffixes ``order``, the words ``lcp``
    that each has in common with the one before, and the class of every position's left word.

    Intervals of too few common words cannot hold a run's pair, so what is below them is taken as separate trees.
    """
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, Positions]] = []  # common words with the one before, and positions, of unfinished children
    fewest = fewest_common()
    for position, common in zip(order, lcp, strict=True):
        while len(open_) > 1 and open_[-1][0] > common:
            deepest, last = open_.pop()
            above, first = open_.pop()
            open_.append((above, merge_children(first, last, deepest, left, found)))
        if common < fewest:
            open_.clear()
        open_.append((common, Positions(position)))
    while len(open_) > 1:
        deepest, last = open_.pop()
        above, first = open_.pop()
        open_.append((above, merge_children(first, last, deepest, left, found)))
    return found


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions in the order of the word sequences that begin there, and the rank of every position."""
    n, width = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order, rank


def common_words(words: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each sorted suffix has in common with the one before it."""
    n, same, lcp = len(words), 0, [0] * len(words)
    for i in range(n):
        if rank[i] == 0:
            same = 0
            continue
        j = order[rank[i] - 1]
        most = n - max(i, j)
        while same < most and words[i + same] == words[j + same]:
            same += 1
        lcp[rank[i]] = same
        same = max(0, same - 1)
    return lcp


def word_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run of one text's words, by start and period."""
    if len(words) < FEWEST_WORDS:
        return []
    order, rank = sorted_suffixes(words)
    each, order = words.tolist(), order.tolist()
    found = maximal_pairs(order, common_words(each, order, rank.tolist()), [-1, *each])
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def may_have_runs(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text whether some stretch of about as many words as a run's pair needs stands in it twice.

    Stretches of 1, 2, 4, ... words are numbered for all texts at once; only those that stand twice go on.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, width = np.arange(len(flat)), 1
    key = text * (int(flat.max(initial=0)) + 1) + flat
    while True:
        number, times = np.unique(key, return_inverse=True, return_counts=True)[1:]
        twice = times[number] > 1
        at, number = at[twice], number[twice]
        if 2 * width > fewest_common() or not len(at):
            return np.bincount(text[at], minlength=len(sizes)) > 0
        follows = np.searchsorted(at, at + width)
        follows[follows == len(at)] = 0
        pairs = (at[follows] == at + width) & (at + 2 * width <= ends[at])
        key = number[pairs] * (len(flat) + 1) + number[follows[pairs]]
        at, width = at[pairs], 2 * width


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run contains after its first period."""
    if not runs:
        return " ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return " ".join([w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if d == 0])


def text_runs(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """The runs and the collapsed text of every text."""
    numbers: dict[str, int] = {}
    split = [_words(t) for t in texts]
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    flat = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], dtype=np.int64)
    flags, ends = may_have_runs(flat, sizes), np.cumsum(sizes)
    for words, flag, end in zip(split, flags.tolist(), ends.tolist(), strict=True):
        runs = word_runs(flat[end - len(words) : end]) if flag else []
        yield runs, collapse(words, runs)


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """Documents with the runs of each whole text (array of start, length and period in words, by start and period)
    and the text without the repetitions, as two more columns.

    A map over the rows, without a shuffle; a task holds the words of about a megabyte of texts, or of one longer text.

    Defined cases: a null or empty text, and one of fewer than 24 words, has no runs, and its words are all kept; equal
    rows have equal results; columns of the two names given are replaced, all others stay; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)

    @F.arrow_udf(_RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [row for texts in slices(batch) for row in text_runs(texts)]
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found, _ in rows]
            yield pa.array([{"runs": r, "collapsed": t} for r, (_, t) in zip(runs, rows, strict=True)], type=_TYPE)

    fresh = "_found"
    while fresh in docs.columns:
        fresh += "_"
    out = docs.withColumn(fresh, find(whole_text(text_col)))
    kept = [F.col(c) for c in docs.columns if c not in (runs_col, collapsed_col)]
    return out.select(*kept, F.col(fresh)["runs"].alias(runs_col), F.col(fresh)["collapsed"].alias(collapsed_col))


def strongest(runs: Column) -> Column:
    """Of an array of runs, that of the greatest exact length / period (ties: smallest start, then period); null: none."""

    def better(best: Column, run: Column) -> Column:
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        tie = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (a > b) | ((a == b) & tie), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(_RUN), better)


def planted(docs: DataFrame, id_col: str, text_col: str, to: str) -> DataFrame:
    """Documents with a text in which every tenth id's words become periodic from some place on: of h, the CRC-32 of the
    id, g = h div 10 and n words, those from a = g mod n repeat with period 1 + (n - a) div (3 + g mod 8).

    Where nothing is planted the text stays as it is; a null id plants nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.withColumn("_h", h)
    words = F.regexp_extract_all(whole_text(text_col), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("_words", F.when(F.expr("_h % 10 = 0"), words))
    rows = rows.withColumn("_n", F.size("_words")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    made = F.expr("array_join(transform(sequence(0, _n - 1), i -> get(_words, cast(if(i >= _a, _a + (i - _a) % _p, i) as int))), ' ')")
    rows = rows.withColumn(to, F.when(F.col("_n") > 0, made).otherwise(F.col(text_col)))
    return rows.drop("_h", "_words", "_n", "_g", "_a", "_p")


def run_digest(docs: DataFrame) -> DataFrame:
    """The runs of ``doc_id, text`` with the planted ones, as counts, the strongest run and digests."""
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    found = with_runs(planted(rows, "doc_id", "_text", "_planted"), "_planted", "_runs", "_collapsed")
    found = found.select("doc_id", "_runs", "_collapsed", strongest(F.col("_runs")).alias("_best"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("_best")
    return found.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        sha256_hex(F.array_join(F.transform("_runs", line), "")).alias("runs_sha256"), sha256_hex(F.col("_collapsed")).alias("collapsed_sha256"),
    )
