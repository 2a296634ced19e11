"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampfold.llm.common import SEED, merge_in_tree, packed, text_batches, whole_text, worker_state
from ampfold.llm.pretokens import slices

#: Words are dealt by hash into this many rows of the vector table, so every word has a vector.
WORDS = 1 << 14
#: Components of a vector, and those of an index vector that are not 0.
WIDTH, ENTRIES = 32, 4
#: Inputs of the network, as :func:`pooled` lists them.
FEATURES = 2 * WIDTH + 4
#: Neighbours on each side whose index vectors a word's vector gathers.
SPAN = 2
#: Labelled documents that the network learns from, at most (drawn by hash of the id).
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Of the five remainders of the ids' hash, that of the rows held out and that of the rows for calibration.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4

_words = re.compile(r"\w+|[^\w\s]+").findall


class _Rows(dict):
    """Table row of each word, bounded by :func:`word_rows`."""

    def __missing__(self, word: str) -> int:
        row = self[word] = zlib.crc32(word.encode()) % WORDS
        return row


def word_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words of all texts, one text after another, and where each text ends."""
    _rows = worker_state(("quality",), _Rows)
    if len(_rows) > 250_000:
        _rows.clear()
    words = [_words(t.lower()) for t in texts]
    flat = np.fromiter(map(_rows.__getitem__, chain.from_iterable(words)), dtype=np.int64)
    return flat, np.cumsum([len(w) for w in words], dtype=np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The components that are not 0 of every row's index vector, and their signs; the same everywhere."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((WORDS, WIDTH)), axis=1)[:, :ENTRIES]
    return places, rng.choice([-1.0, 1.0], (WORDS, ENTRIES))


def corpus_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sums of the index vectors of every word's neighbours over all documents (``WORDS`` x ``WIDTH``).

    Each partition adds up its own table, and the tables are added in a tree; their size is fixed.
    """
    text_batches(docs.sparkSession)
    schema = "part int, sums binary"
    names = pa.schema([("part", pa.int32()), ("sums", pa.binary())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors()
        sums = np.zeros(WORDS * WIDTH)
        for batch in batches:
            for texts in slices(batch.column(0)):
                flat, ends = word_rows(texts)
                text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                for step in range(1, SPAN + 1):
                    same = text[:-step] == text[step:]
                    left, right = flat[:-step][same], flat[step:][same]
                    for word, other in ((left, right), (right, left)):
                        for k in range(ENTRIES):
                            sums += np.bincount(word * WIDTH + places[other, k], signs[other, k], len(sums))
        data = zlib.compress(sums.astype(np.int64).tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [data]}, names)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(WORDS * WIDTH, dtype=np.int64)
        for one in table.column("sums"):
            total += np.frombuffer(zlib.decompress(one.as_buffer()), dtype=np.int64)
        return pa.Table.from_pydict({"part": [table.column("part")[0].as_py()], "sums": [zlib.compress(total.tobytes(), 1)]}, names)

    texts = docs.select(whole_text(text_col))
    row = merge_in_tree(texts.mapInArrow(add_up, schema), texts.rdd.getNumPartitions(), merge).first()
    sums = np.frombuffer(zlib.decompress(row["sums"]), dtype=np.int64) if row else np.zeros(WORDS * WIDTH, dtype=np.int64)
    return sums.reshape(WORDS, WIDTH)


def vector_table(sums: np.ndarray) -> np.ndarray:
    """Per row the word's vector, of length 1, beside its index vector."""
    places, signs = index_vectors()
    index = np.zeros((WORDS, WIDTH))
    np.put_along_axis(index, places, signs, axis=1)
    return np.hstack([sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), index]).astype(np.float32)


def pooled(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Per text the mean of its words' vectors, the lengths of both halves of it (long where the words agree),
    the share of words that repeat the one before, and the logarithm of their number; zeros without words."""
    flat, ends = word_rows(texts)
    out, start = np.zeros((len(texts), FEATURES)), 0
    for i, end in enumerate(ends.tolist()):
        if end > start:
            words = flat[start:end]
            rows, counts = np.unique(words, return_counts=True)  # a text of any length has so many rows at most
            mean = counts @ table[rows].astype(np.float64) / len(words)
            lengths = [np.linalg.norm(half) for half in np.split(mean, 2)]
            out[i] = [*mean, *lengths, np.count_nonzero(words[1:] == words[:-1]) / len(words), np.log1p(len(words))]
        start = end
    return out


@dataclass
class Network:
    """Scaling, two layers and a temperature. Without both labels to learn from, a constant."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0
    constant: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def learn(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """The network of the rows that are not for calibration, and the temperature that fits the others best."""
    fit = ~calibration if len(set(y[~calibration])) == 2 else np.ones(len(y), dtype=bool)
    if len(set(y[fit])) < 2:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-6, [
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ])
    z, target = np.clip((x[fit] - net.mean) / net.scale, -8, 8), y[fit].astype(float)
    first, second, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            w1, b1, w2, b2 = net.layers
            hidden = np.tanh(z[rows] @ w1 + b1)
            error = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - target[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - hidden**2)
            slopes = [z[rows].T @ back + DECAY * w1, back.sum(0), hidden.T @ error + DECAY * w2, error.sum(keepdims=True)]
            step += 1
            for p, m, v, g in zip(net.layers, first, second, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if calibration.any():
        logits, label = net.logits(x[calibration]), y[calibration]
        loss = lambda t: np.logaddexp(0, np.where(label == 1, -logits, logits) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return net


def remainder(id_col: str) -> Column:
    """CRC-32 of the id as text, modulo the folds (null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network

    def transform(self, docs: DataFrame, text_col: str = "text", to: str = "score") -> DataFrame:
        """Documents with the calibrated probability of label 1 of each whole text (null: empty)."""
        text_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.table, self.network))  # of a fixed size

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table, network = shared.value
            for batch in batches:
                for texts in slices(batch):
                    yield pa.array(network.score(pooled(texts, table)), type=pa.float64())

        return docs.withColumn(to, score(whole_text(text_col)))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = MOST_LABELLED,
) -> QualityModel:
    """Word vectors of all documents, and the network of at most ``most`` labelled ones that are not held out.

    The only rows that go to the driver are the pooled vectors of the drawn labelled documents (68 numbers each).
    The inputs are the words alone: no id, label, language or source.

    Defined cases: labels of a document that differ count by their majority (a tie is 1); labels without a
    document, null labels and null ids teach nothing; without both labels the score is the share of label 1, or
    0.5 without any.
    """
    table = vector_table(corpus_vectors(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield pa.array(list(pooled(texts, shared.value)), type=pa.list_(pa.float64()))

    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).alias("_label")).dropna()
    known = known.where(remainder("_label_id") != HELD_OUT).groupBy("_label_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    drawn = known.orderBy(F.xxhash64(F.lit(SEED), "_label_id"), "_label_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = texts.join(F.broadcast(drawn), F.col("_id") == F.col("_label_id")).limit(most)
    rows = rows.select("_id", "_label", remainder("_id").alias("_fold"), vectors("_text").alias("_vector")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_vector"]))
    x = np.array([r["_vector"] for r in rows], dtype=float).reshape(len(rows), FEATURES)
    y, folds = (np.array([r[c] for r in rows], dtype=int) for c in ("_label", "_fold"))
    return QualityModel(table, learn(x, y, folds == CALIBRATION))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on)."""
    scored = fit(docs, labels, id_col, text_col).transform(docs.select(id_col, text_col), text_col, "_score")
    return scored.select(
        id_col, (remainder(id_col) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns, whatever their names; repeated rows, null
    and empty texts are scored as any other, and an empty table gives no rows."""
    rows = packed(docs, _text=F.col(text_col))
    scored = fit(docs, labels, id_col, text_col).transform(rows, "_text", "_score")
    return scored.where(F.col("_score") >= threshold).select("_doc.*")
