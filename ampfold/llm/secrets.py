"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import SEED, merge_in_tree, text_batches, whole_text, worker_state
from ampfold.llm.pretokens import slices
from ampfold.llm.token_counts import prune
from ampfold.session import checkpoint_dir

#: Words in the dictionary, from the corpus: a bounded summary of its frequent words.
DICTIONARY = 16_384
#: Labelled findings that the forest learns from, at most (drawn by hash).
MOST_LABELLED = 20_000
TREES, DEPTH, LEAF, CUTS = 40, 8, 4, 16
REDACTED = "[SECRET]"

# Candidates: a value assigned to something, or a long run of key characters.
_assigned = re.compile(r"[:=][ \t]*[\"']?([^\s\"',;:=]{6,})").finditer
_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}").finditer
_letters = re.compile(r"[^\W\d_]{3,}").findall
_word = re.compile(r"\w+")

# Public key formats, and words that stand beside secrets, hashes and placeholders.
_issued = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}")
NAMES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "auth", "credential", "bearer")
DIGESTS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "etag", "rev", "hash")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "test", "redacted", "foobar")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "doc")

FEATURES = (
    "length", "digits", "upper", "lower", "other", "class_changes", "distinct", "transitions", "dictionary", "path_test", "path_depth",
    "path_length", "name_before", "digest_before", "placeholder_near", "placeholder_inside", "assigned", "quoted", "known_before", "known_after",
)


@dataclass
class CorpusStatistics:
    """Byte pairs of all texts as log-probabilities of the second byte, and the dictionary."""

    transitions: np.ndarray
    words: frozenset[str]


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> CorpusStatistics:
    """Counted over all documents: each partition one table of byte pairs and one bounded summary of frequent
    words, merged in a tree."""
    text_batches(docs.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("pairs", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def one(part: int, pairs: np.ndarray, words: Counter) -> dict:
        words = prune(words, DICTIONARY)
        return {"part": [part], "pairs": [pairs.tobytes()], "words": [list(words)], "counts": [list(words.values())]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_state(("secrets",), dict)
        pairs, words = np.zeros(1 << 16, dtype=np.int64), Counter()
        for batch in batches:
            for texts in slices(batch.column(0)):
                data = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8).astype(np.int64)
                pairs += np.bincount(data[:-1] << 8 | data[1:], minlength=1 << 16)
                for t in texts:
                    words.update(_letters(t.lower()))
                if len(words) > 8 * DICTIONARY:
                    words = prune(words, 4 * DICTIONARY)
        yield pa.RecordBatch.from_pydict(one(TaskContext.get().partitionId(), pairs, words), schema)

    def merge(table: pa.Table) -> pa.Table:
        pairs, words = np.zeros(1 << 16, dtype=np.int64), Counter()
        for data, names, n in zip(*(table.column(c) for c in ("pairs", "words", "counts")), strict=True):
            pairs += np.frombuffer(data.as_buffer(), dtype=np.int64)
            words.update(dict(zip(names.as_py(), n.as_py(), strict=True)))
            words = prune(words, DICTIONARY)
        return pa.Table.from_pydict(one(table.column("part")[0].as_py(), pairs, words), schema)

    texts = docs.select(whole_text(text_col))
    counted = texts.mapInArrow(count, "part int, pairs binary, words array<string>, counts array<long>")
    row = merge_in_tree(counted, texts.rdd.getNumPartitions(), merge).first()
    pairs = (np.frombuffer(row["pairs"], dtype=np.int64) if row else np.zeros(1 << 16)).reshape(256, 256) + 1.0
    return CorpusStatistics(np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32), frozenset(row["words"] if row else ()))


def covered(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, the longest first from the left."""
    value, at, inside = value.lower(), 0, 0
    while at < len(value):
        size = next((n for n in range(min(14, len(value) - at), 2, -1) if value[at : at + n] in words), 0)
        inside += size
        at += size or 1
    return inside / max(1, len(value))


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is assigned, of every candidate; none overlaps another."""
    # Both lists are in order and neither overlaps itself, so one pass over each merges them.
    assigned = [m.span(1) for m in _assigned(text)]
    out, at = [], 0
    for m in _run(text):
        start, end = m.span()
        while at < len(assigned) and assigned[at][1] <= start:
            out.append((*assigned[at], True))
            at += 1
        if at == len(assigned) or assigned[at][0] >= end:
            out.append((start, end, False))
    return out + [(a, b, True) for a, b in assigned[at:]]


def describe(text: str, path: str, start: int, end: int, assigned: bool, known: CorpusStatistics) -> list[float]:
    """The features of one candidate, as FEATURES lists them."""
    value, n = text[start:end], end - start
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in value)
    data = np.frombuffer(value.encode(), dtype=np.uint8)
    before, after = text[max(0, start - 48) : start].lower(), text[end : end + 48].lower()
    left, right = _word.findall(before)[-3:], _word.findall(after)[:3]
    path = path.lower()
    share = lambda words: sum(w in known.words for w in words) / max(1, len(words))
    return [
        np.log1p(n), *(kinds.count(k) / n for k in "dulo"), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        len(set(value)) / n, float(known.transitions[data[:-1], data[1:]].mean()) if len(data) > 1 else 0.0, covered(value, known.words),
        float(any(p in path for p in TEST_PATHS)), float(path.count("/")), np.log1p(len(path)),
        float(any(w.endswith(NAMES) for w in left)), float(any(w in DIGESTS for w in left)),
        float(any(w in PLACEHOLDERS for w in left + right)), float(any(p in value.lower() for p in PLACEHOLDERS)),
        float(assigned), float(before.endswith(('"', "'")) and after.startswith(('"', "'"))), share(left), share(right),
    ]


def weak_label(value: str, features: list[float]) -> int | None:
    """1, 0 or not known, by rules that are sure of themselves; for corpora without labelled findings.

    Issued key formats, whatever words stand beside them, and values with letters and digits assigned to a name of
    secrets are secrets. Values that are placeholders, named digests, and runs of letters or digits alone that no
    such name has are none. Not known are other values beside a placeholder's word, and passwords of letters alone.
    """
    f = dict(zip(FEATURES, features, strict=True))
    if f["placeholder_inside"]:
        return 0
    if _issued.fullmatch(value):
        return 1
    if f["digest_before"]:
        return 0
    if f["placeholder_near"]:
        return None
    mixed = f["digits"] > 0 and f["digits"] + f["other"] < 1
    if f["assigned"] and f["name_before"]:
        return 1 if mixed and len(value) >= 8 else None
    return 0 if not mixed or not f["digits"] else None


@dataclass
class Forest:
    """Trees as arrays: feature (below 0: a leaf), threshold, the left child (the right one follows it), share of
    label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += share[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """A random forest: bootstrap rows, the square root of the features at each split, Gini impurity."""
    rng, forest = np.random.default_rng(SEED), Forest()
    tried = max(1, int(np.sqrt(x.shape[1])) + 1)
    for _ in range(TREES):
        feature, threshold, child, share = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.integers(0, len(x), len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            label = y[rows]
            share[node] = float(label.mean())
            if depth == DEPTH or share[node] in (0.0, 1.0) or len(rows) < 2 * LEAF:
                continue
            best = (share[node] * (1 - share[node]) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tried, replace=False):
                column = x[rows, f]
                for cut in np.unique(np.quantile(column, np.linspace(0.02, 0.98, CUTS))):
                    right = column > cut
                    n = right.sum()
                    if LEAF <= n <= len(rows) - LEAF:
                        p, q = label[right].mean(), label[~right].mean()
                        impurity = (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                        best = min(best, (impurity, int(f), float(cut)))
            if best[1] >= 0:
                feature[node], threshold[node], child[node] = best[1], best[2], len(feature)
                right = x[rows, best[1]] > best[2]
                for part in (rows[~right], rows[right]):
                    todo.append((len(feature), part, depth + 1))
                    feature.append(-1), threshold.append(0.0), child.append(0), share.append(0.0)
        forest.trees.append((np.array(feature), np.array(threshold), np.array(child), np.array(share)))
    return forest


_FINDING = "array<struct<start: int, length: int, value: string, label: int, features: array<double>>>"


def findings(docs: DataFrame, known: CorpusStatistics, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All candidates of all texts: id, ``start`` and ``length`` (characters), ``value``, the rule's ``label`` and
    the ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of a bounded size
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")

    @F.arrow_udf(_FINDING)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, paths in batches:
            at = 0
            for part in slices(texts):
                out = []
                for text, where in zip(part, paths.slice(at, len(part)).to_pylist(), strict=True):
                    rows = []
                    for a, b, assigned in candidates(text):
                        features = [float(f) for f in describe(text, where, a, b, assigned, shared.value)]
                        rows.append({"start": a, "length": b - a, "value": text[a:b], "label": weak_label(text[a:b], features), "features": features})
                    out.append(rows)
                at += len(part)
                yield pa.array(out, pa.list_(pa.struct([
                    ("start", pa.int32()), ("length", pa.int32()), ("value", pa.string()), ("label", pa.int32()),
                    ("features", pa.list_(pa.float64()))])))

    found = docs.select(F.col(id_col).alias("_id"), find(whole_text(text_col), path).alias("_found"))
    # Of a plain explode Spark infers a filter on the array's size, for which every text would be searched a second time,
    # by a second Python worker beside the first.
    found = found.select("_id", F.explode_outer("_found").alias("_f")).where(F.col("_f").isNotNull())
    return found.select(F.col("_id").alias(id_col), "_f.*")


@dataclass
class SecretModel:
    known: CorpusStatistics
    forest: Forest
    threshold: float = 0.5

    def score(self, found: DataFrame, to: str = "score") -> DataFrame:
        """Findings with the forest's probability that each is a secret."""
        shared = found.sparkSession.sparkContext.broadcast(self.forest)

        @F.arrow_udf("double")
        def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for features in batches:
                x = np.array(features.to_pylist(), dtype=float).reshape(len(features), len(FEATURES))
                yield pa.array(shared.value.score(x), type=pa.float64())

        return found.withColumn(to, vote("features"))

    def redact(self, docs: DataFrame, text_col: str = "text", path_col: str | None = "source", by: str = REDACTED) -> DataFrame:
        """Documents with the secrets of each text replaced; one pass over the texts, no shuffle. Null stays null."""
        text_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast(self)
        path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")

        @F.arrow_udf("string")
        def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = shared.value
            for texts, paths in batches:
                at = 0
                for part in slices(texts):
                    where = paths.slice(at, len(part)).to_pylist()
                    at += len(part)
                    yield pa.array([model._redacted(t, p, by) for t, p in zip(part, where, strict=True)], type=pa.string())

        new = clean(whole_text(text_col), path)
        return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), new))

    def _redacted(self, text: str, path: str, by: str) -> str:
        spans = candidates(text)
        if not spans:
            return text
        scores = self.forest.score(np.array([describe(text, path, *s, self.known) for s in spans], dtype=float))
        parts, end = [], 0
        for (a, b, _), score in zip(spans, scores.tolist(), strict=True):
            if score >= self.threshold:
                parts += [text[end:a], by]
                end = b
        return "".join([*parts, text[end:]])


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
    labelled: DataFrame | None = None, most: int = MOST_LABELLED,
) -> tuple[SecretModel, DataFrame]:
    """The model, and the findings of all documents (checkpointed).

    ``labelled``: findings with a ``label`` (id, ``start``, 1 or 0); without it those that :func:`weak_label` is
    sure of. At most ``most`` of them, drawn by hash, go to the driver for the forest; half of them at most are
    of one label where the other has as many.

    Defined cases: a null or empty text has no candidates; a null path is empty; repeated rows give repeated
    findings; an empty table, or labels of one kind alone, give a forest without trees, which scores 0.
    """
    checkpoint_dir(docs.sparkSession)
    known = corpus_statistics(docs, text_col)
    found = findings(docs, known, id_col, text_col, path_col).checkpoint()
    rows = found
    if labelled is not None:
        names = labelled.select(F.col(id_col).alias("_id"), F.col("start").alias("_start"), F.col("label").alias("_label"))
        rows = found.drop("label").join(names.dropDuplicates(["_id", "_start"]), (F.col(id_col) == F.col("_id")) & (F.col("start") == F.col("_start")))
        rows = rows.withColumnRenamed("_label", "label")
    order = [F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), "start", "value"), F.col(id_col), F.col("start")]
    drawn = []
    for label in (0, 1):
        drawn += rows.where(F.col("label") == label).orderBy(*order).limit(most // 2).select("features", "label").collect()
    x = np.array([r["features"] for r in drawn], dtype=float).reshape(len(drawn), len(FEATURES))
    y = np.array([r["label"] for r in drawn], dtype=int)
    return SecretModel(known, grow(x, y) if len(set(y.tolist())) == 2 else Forest()), found


def redact_secrets(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", id_col: str = "doc_id") -> DataFrame:
    """All documents, with the secrets that the forest confirms replaced in their texts."""
    model, _ = fit(docs, id_col, text_col, path_col)
    return model.redact(docs, text_col, path_col)
