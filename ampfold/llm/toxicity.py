"""Toxicity scores: a convolutional network over hashed word embeddings, with thresholds for each language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampfold.llm.common import SEED, text_batches, whole_text, worker_state
from ampfold.llm.pretokens import slices
from ampfold.plans.staging import stage
from ampfold.session import scratch_path

#: Rows of the embedding table, and components of a row. A word's embedding is the sum of the rows of its PARTS: the
#: word, its first three to seven characters (so forms of one stem share rows) and its last four.
ROWS, WIDTH = 1 << 15, 16
STEMS = (3, 4, 5, 6, 7)
PARTS = 2 + len(STEMS)
#: Words that a filter sees, and filters of each width.
SPANS, FILTERS = (1, 2, 3, 5), 16
PAD = max(SPANS)  # so no filter that begins in a text, or in an empty one, sees the next
EPOCHS, BATCH, RATE, DECAY, DROPPED = 12, 32, 3e-3, 1e-4, 0.1
#: Characters of the labelled documents of one part (some two million words), and passes over several parts at least.
PART_CHARS, PASSES = 12_000_000, 2
#: Ranges of a network's numbers that are averaged each on its own, and labels up to which a join broadcasts them.
SLICES, MOST_BROADCAST = 32, 8_000_000
#: Of the three remainders of the ids' hash, that of the rows held out; of the others, one in five calibrates.
FOLDS, HELD_OUT, CALIBRATION = 3, 1, 8
#: Toxic calibration rows that a language needs for a threshold of its own.
FEWEST = 10
#: Words that a worker remembers, and words whose filters are computed at once.
MOST_CACHED, BLOCK = 200_000, 1 << 15

_words = re.compile(r"\w+").findall


def parts(word: str) -> list[int]:
    """Rows of the embedding table that make up a word."""
    named = [f"<{word}>", *(f"{n}<{word[:n]}" for n in STEMS), f"{word[-4:]}>"]
    return [zlib.crc32(p.encode()) % ROWS for p in named]


class Words:
    """Numbers of words by first appearance, with their parts; forgotten when they are too many."""

    def __init__(self) -> None:
        self.generation = 0
        self.forget()

    def forget(self) -> None:
        self.generation += 1
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, PARTS), dtype=np.uint16)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of all texts, one text after another, and the words of each text."""
        if len(self.number) > MOST_CACHED:
            self.forget()
        known, flat, sizes = self.number, [], []
        for text in texts:
            words = _words(text.lower())
            sizes.append(len(words))
            try:
                flat += [known[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in known:
                        self._add(w)
                flat += [known[w] for w in words]
        return np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def _add(self, word: str) -> None:
        n = self.number[word] = len(self.number)
        if n == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = parts(word)


class Vectors:
    """The embeddings of the words that a worker remembers, made as they appear."""

    def __init__(self) -> None:
        self.generation, self.known, self.rows = -1, 0, np.zeros((0, WIDTH), np.float32)

    def of(self, words: Words, embeddings: np.ndarray) -> np.ndarray:
        if self.generation != words.generation:
            self.generation, self.known = words.generation, 0
        n = len(words.number)
        if len(self.rows) < n or len(self.rows) > 2 * len(words.rows):
            grown = np.zeros((len(words.rows), WIDTH), np.float32)
            grown[: self.known] = self.rows[: self.known]
            self.rows = grown
        self.rows[self.known : n] = embeddings[words.rows[self.known : n]].sum(axis=1)
        self.known = n
        return self.rows


def _padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts when ``PAD`` empty words follow it, and the places of all words."""
    starts = np.cumsum(sizes + PAD) - sizes - PAD
    return starts, np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) * PAD, sizes)


def _activations(x: np.ndarray, filters: list[np.ndarray], n: int) -> np.ndarray:
    """The filters at the first ``n`` words of ``x``, before their bias (n x all filters)."""
    out = []
    for w in filters:  # span x width x filters
        out.append(sum(x[j : j + n] @ w[j] for j in range(len(w))))
    return np.hstack(out)


@dataclass
class Network:
    """Embeddings, filters of each span, and the output layer. Without both labels to learn from, a constant."""

    embeddings: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    temperature: float = 1.0
    shift: float = 0.0
    constant: float = 0.5

    def pooled(self, numbers: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Per text each filter's highest value, at least 0. Texts of any length are taken in blocks of words."""
        starts, places = _padded(sizes)
        begins = np.zeros(int((sizes + PAD).sum()), dtype=bool)  # where a filter may begin: at words, or in an empty text
        begins[places] = begins[starts] = True
        top = np.zeros((len(sizes), len(self.bias)), dtype=np.float32)
        total, text = int((sizes + PAD).sum()), np.repeat(np.arange(len(sizes)), sizes + PAD)
        for at in range(0, total, BLOCK):
            n = min(BLOCK, total - at)
            x = np.zeros((n + PAD, WIDTH), dtype=np.float32)
            a, b = np.searchsorted(places, (at, at + n + PAD))
            x[places[a:b] - at] = vectors[numbers[a:b]]
            here = text[at : at + n]
            first = np.flatnonzero(np.diff(here, prepend=-1))
            values = _activations(x, self.filters, n)
            values[~begins[at : at + n]] = -np.inf
            best = np.maximum.reduceat(values, first, axis=0) + self.bias
            np.maximum.at(top, here[first], best)
        return top

    def logits(self, numbers: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return (self.pooled(numbers, sizes, vectors) @ self.out + self.out_bias).astype(float)

    def score(self, words: Words, texts: list[str], vectors: Vectors) -> np.ndarray:
        """Probabilities of label 1; ``vectors`` keeps the embeddings of the words known so far."""
        if self.embeddings is None:
            return np.full(len(texts), self.constant)
        numbers, sizes = words.numbers(texts)
        return self.probability(self.logits(numbers, sizes, vectors.of(words, self.embeddings)))

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((logits + self.shift) / self.temperature, -60, 60)))


class _Adam:
    def __init__(self, shape: tuple) -> None:
        self.first, self.second, self.step = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def change(self, slope: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first += 0.1 * (slope - self.first)
        self.second += 0.001 * (slope * slope - self.second)
        return RATE * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)


def begin(rng: np.random.Generator) -> Network:
    """The network before it has learned anything."""
    normal = lambda size, *shape: rng.normal(0, size, shape).astype(np.float32)
    return Network(
        embeddings=normal(0.1, ROWS, WIDTH), filters=[normal((WIDTH * s) ** -0.5, s, WIDTH, FILTERS) for s in SPANS],
        bias=np.zeros(len(SPANS) * FILTERS, np.float32), out=normal(0.1, len(SPANS) * FILTERS), out_bias=0.0,
    )


def _tops(net: Network, vectors: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the padded texts each filter is highest, and how high (texts x filters), in blocks of words."""
    starts, places = _padded(sizes)
    ends, total = starts + np.maximum(sizes, 1), int((sizes + PAD).sum())
    top = np.zeros((len(sizes), len(net.bias)), dtype=np.int64)
    value = np.full(top.shape, -np.inf, dtype=np.float32)
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        x = np.zeros((n + PAD, WIDTH), dtype=np.float32)
        a, b = np.searchsorted(places, (at, at + n + PAD))
        x[places[a:b] - at] = vectors[word[a:b]]
        acts = _activations(x, net.filters, n)
        for i in np.flatnonzero((starts < at + n) & (ends > at)):
            low = max(starts[i] - at, 0)
            own = acts[low : ends[i] - at]
            best = own.argmax(axis=0)
            found = np.take_along_axis(own, best[None], axis=0)[0]
            higher = found > value[i]
            top[i, higher], value[i, higher] = best[higher] + low + at, found[higher]
    return top, value


def train(net: Network, docs: list[np.ndarray], words: np.ndarray, y: np.ndarray, fit: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Teach the network the documents numbered in ``fit``, each once an epoch."""
    tables, layers = _Adam(net.embeddings.shape), [_Adam(w.shape) for w in net.filters]
    bias, out, last = _Adam(net.bias.shape), _Adam(net.out.shape), _Adam((1,))
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            sizes = np.array([len(docs[i]) for i in picked])
            known, word = np.unique(np.concatenate([docs[i] for i in picked]), return_inverse=True)
            kept = (rng.random((len(known), PARTS)) >= DROPPED).astype(np.float32)
            vectors, row = np.einsum("npw,np->nw", net.embeddings[words[known]], kept), words[known]
            top, value = _tops(net, vectors, word, sizes)
            value += net.bias
            pooled = np.maximum(value, 0)
            error = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -60, 60))) - y[picked]
            error = (error / len(picked)).astype(np.float32)
            back = np.outer(error, net.out) * (value > 0)
            # Only the words that some filter was highest at have slopes; the empty ones between texts are zeros.
            seen = [top[:, k * FILTERS : (k + 1) * FILTERS, None] + np.arange(len(w)) for k, w in enumerate(net.filters)]
            spots, inverse = np.unique(np.concatenate([one.ravel() for one in seen]), return_inverse=True)
            places = _padded(sizes)[1]
            number = np.searchsorted(places, spots)
            real = number < len(places)
            real[real] = places[number[real]] == spots[real]
            x, slope_x = np.zeros((len(spots), WIDTH), dtype=np.float32), np.zeros((len(spots), WIDTH), dtype=np.float32)
            x[real] = vectors[word[number[real]]]
            slopes, done = [], 0
            for k, w in enumerate(net.filters):
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                own = inverse[done : done + seen[k].size].reshape(seen[k].shape)  # texts x filters x span
                done += seen[k].size
                slopes.append(np.einsum("tfsw,tf->swf", x[own], back[:, mine]) + DECAY * w)
                np.add.at(slope_x, own, np.einsum("tf,swf->tfsw", back[:, mine], w))
            slope, moved, touched = np.zeros_like(net.embeddings), slope_x[real], word[number[real]]
            for p in range(PARTS):
                np.add.at(slope, row[touched, p], moved * kept[touched, p, None])
            net.embeddings -= tables.change(slope)
            for w, s, adam in zip(net.filters, slopes, layers, strict=True):
                w -= adam.change(s)
            net.out_bias -= float(last.change(np.array([error.sum()]))[0])
            net.out = net.out - out.change(pooled.T @ error + DECAY * net.out)
            net.bias = net.bias - bias.change(back.sum(axis=0))


#: Temperatures and shifts that calibration tries.
_PAIRS = [(t, s) for t in np.geomspace(0.25, 8, 41) for s in np.linspace(-4, 4, 33)]


def _losses(logits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The summed loss of the rows with each pair of ``_PAIRS``."""
    sign = np.where(label == 1, -1, 1)
    return np.array([np.logaddexp(0, sign * (logits + s) / t).sum() for t, s in _PAIRS])


def learn(docs: list[np.ndarray], words: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """The network of the documents (their words' numbers in ``words``, which lists parts) that are not for
    calibration, and the temperature and shift that fit the others best."""
    fit = np.flatnonzero(~calibration if len(set(y[~calibration])) == 2 else np.ones(len(y), dtype=bool))
    if len(set(y[fit])) < 2:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    net = begin(rng)
    train(net, docs, words, y, fit, EPOCHS, rng)
    held = np.flatnonzero(calibration)
    if len(set(y[held])) == 2:
        losses = _losses(learned_logits(net, [docs[i] for i in held], words), y[held])
        net.temperature, net.shift = map(float, _PAIRS[int(np.argmin(losses))])
    return net


def learned_logits(net: Network, docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Logits of documents given as the numbers of their words."""
    vectors = net.embeddings[words].sum(axis=1)
    return np.array([net.logits(one, np.array([len(one)]), vectors)[0] for one in docs])


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Where flagging from this score on has the highest F1: half way between that score and the next below."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # equal scores are flagged together
    f1 = 2 * hits[ends] / (ends + 1 + y.sum())
    at = ends[int(np.argmax(f1))]
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list, default: float) -> dict:
    """A threshold for each language with FEWEST toxic and other rows, and that of all rows under None."""
    out = {None: best_threshold(scores, y) if len(set(y)) == 2 else default}
    for lang in sorted({one for one in langs if one is not None}):
        own = np.array([one == lang for one in langs])
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= FEWEST:
            out[lang] = best_threshold(scores[own], y[own])
    return out


def remainder(id_col: str | Column, of: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo the folds (null id: as the empty text)."""
    one = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(one.cast("string"), F.lit("")).cast("binary")), F.lit(of)).cast("int")


@dataclass
class ToxicityModel:
    """The network, and the threshold of each language (None: of the others) on the calibration rows."""

    network: Network
    thresholds: dict

    def transform(self, docs: DataFrame, text_col: str = "text", to: str = "score") -> DataFrame:
        """Documents with the calibrated probability of label 1 of each whole text (null: empty) in the column ``to``."""
        text_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast(self.network)  # of a fixed size

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words, vectors = worker_state(("toxicity",), Words), Vectors()
            for batch in batches:
                for texts in slices(batch):
                    yield pa.array(shared.value.score(words, texts, vectors), type=pa.float64())

        return docs.withColumn(to, score(whole_text(text_col)))

    def threshold(self, lang: Column) -> Column:
        """The threshold of a language: its own, or that of all rows."""
        known = F.create_map(*[F.lit(v) for k, t in self.thresholds.items() if k is not None for v in (k, t)])
        other = F.lit(self.thresholds[None])
        return F.coalesce(F.try_element_at(known, lang), other) if len(self.thresholds) > 1 else other


def numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of texts as the parts of their words: the numbers of their words, and the parts of each number."""
    rows = [np.frombuffer(t, dtype=np.uint16).reshape(-1, PARTS) for t in texts]
    flat = np.concatenate([*rows, np.zeros((0, PARTS), np.uint16)])
    wide = np.zeros((len(flat), 8), np.uint16)
    wide[:, :PARTS] = flat
    halves = wide.view(np.uint64)
    # Words are told apart by both halves; numbers follow the order of the bytes, whatever the texts' order.
    one, two = (np.unique(halves[:, i].byteswap(), return_inverse=True)[1].astype(np.int64) for i in (0, 1))
    _, first, numbers = np.unique(one * (len(flat) + 1) + two, return_index=True, return_inverse=True)
    return np.split(numbers, np.cumsum([len(r) for r in rows])[:-1]) if rows else [], flat[first]


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([a.ravel() for a in (net.embeddings, *net.filters, net.bias, net.out, np.array([net.out_bias]))]).astype(np.float32)


def _shaped(values: np.ndarray) -> Network:
    shapes = [(ROWS, WIDTH), *((s, WIDTH, FILTERS) for s in SPANS), (len(SPANS) * FILTERS,), (len(SPANS) * FILTERS,), (1,)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    e, *filters, bias, out, last = (v.reshape(s).copy() for v, s in zip(np.split(values, ends[:-1]), shapes, strict=True))
    return Network(e, filters, bias, out, float(last[0]))


def learn_in_parts(rows: DataFrame, parts: int) -> Network:
    """The network of all ``rows`` (``_part, _key, _label, _lang, _words``), not calibrated.

    In each round every part goes on from the same network with its own documents, in tasks; then the networks are averaged
    by their documents, each range of their numbers in a group of its own. One part alone learns for all epochs at once.
    No more than one network goes to the driver.
    """
    rounds, epochs = (1, EPOCHS) if parts == 1 else (max(PASSES, -(-EPOCHS // parts)), 1)
    sc, names = rows.sparkSession.sparkContext, pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])
    net = None

    def one_round(at: int, net: Network | None) -> Network:
        shared = sc.broadcast(None if net is None else _flat(net))

        def learned(part: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
            docs.sort(key=lambda d: (d[0], d[2], d[3] or ""))
            rng = np.random.default_rng(SEED)
            own = begin(rng)
            if part or at:
                rng = np.random.default_rng([SEED, at, part])
            if shared.value is not None:
                own = _shaped(shared.value)
            texts, words = numbered([d[2] for d in docs])
            train(own, texts, words, np.array([d[1] for d in docs]), np.arange(len(docs)), epochs, rng)
            for i, values in enumerate(np.array_split(_flat(own), SLICES)):
                yield pa.RecordBatch.from_pydict({"slice": [i], "n": [len(docs)], "values": [values.tobytes()]}, names)

        def each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, docs = None, []
            for batch in batches:
                for p, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if p != part and docs:
                        yield from learned(part, docs)
                        docs = []
                    part = p
                    docs.append(tuple(doc))
            if docs:
                yield from learned(part, docs)

        def average(table: pa.Table) -> pa.Table:
            n = table.column("n").to_numpy().astype(float)
            total = sum(np.frombuffer(v.as_buffer(), np.float32) * k for v, k in zip(table.column("values"), n, strict=True))
            mean = (total / n.sum()).astype(np.float32).tobytes()
            return pa.Table.from_pydict({"slice": table.column("slice")[:1], "n": [int(n.sum())], "values": [mean]}, names)

        one = rows.select("_part", "_key", "_label", "_words", "_lang").mapInArrow(each_part, "slice int, n long, values binary")
        got = one.groupBy("slice").applyInArrow(average, "slice int, n long, values binary").collect()
        return _shaped(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(got, key=lambda r: r["slice"])]))

    for at in range(rounds):
        net = one_round(at, net)
    return net


def calibrate(net: Network, rows: DataFrame, default: float) -> dict:
    """Set the temperature and shift that fit all ``rows`` best, and give the thresholds of their languages, as
    :func:`language_thresholds` does of rows at hand. The driver gets sums, and one row for each language."""
    spark, scored = rows.sparkSession, "_lang string, _label int, _logit double"
    shared = spark.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2):
                one, words = numbered([text.as_py()])
                found += learned_logits(shared.value, one, words).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["_lang", "_label", "_logit"])

    held = stage(rows.select("_lang", "_label", "_words").mapInArrow(logits, scored), "toxicity-logits")

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_PAIRS))
        for batch in batches:
            total += _losses(batch.column(1).to_numpy(), batch.column(0).to_numpy())
        yield pa.RecordBatch.from_pydict({"pair": pa.array(range(len(_PAIRS)), pa.int32()), "loss": total})

    labels = {r[0] for r in held.select("_label").distinct().collect()}
    if len(labels) < 2:
        return {None: default}
    sums = held.select("_label", "_logit").mapInArrow(losses, "pair int, loss double").groupBy("pair").agg(F.sum("loss").alias("loss"))
    net.temperature, net.shift = map(float, _PAIRS[sums.orderBy("loss", "pair").first()["pair"]])
    logit = F.least(F.greatest((F.col("_logit") + net.shift) / net.temperature, F.lit(-60.0)), F.lit(60.0))
    own = held.select(F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")),
                                        F.struct(F.lit(False).alias("all"), F.col("_lang").alias("lang")))).alias("_of"), "_label", logit.alias("_logit"))
    own = own.where(F.col("_of.all") | F.col("_of.lang").isNotNull())
    own = own.select("_of", "_label", F.floor(F.col("_logit") * 16).alias("_bin"), (1 / (1 + F.exp(-F.col("_logit")))).alias("_score"))
    # Rows of one language are summed by ranges of the logit, and ranked within each: no group holds them all.
    order = Window.partitionBy("_of").orderBy(F.desc("_bin"))
    bins = own.groupBy("_of", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_label").alias("_hits"), F.max("_score").alias("_high"))
    before, of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_of")
    bins = bins.select(
        "_of", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_hits"),
        F.lead("_high").over(order).alias("_below"), F.sum("_n").over(of).alias("_rows"), F.sum("_hits").over(of).alias("_toxic"))
    fewest = F.when(F.col("_of.all"), 1).otherwise(FEWEST)
    bins = bins.where(F.least("_toxic", F.col("_rows") - F.col("_toxic")) >= fewest)
    points = own.groupBy("_of", "_bin", "_score").agg(F.count(F.lit(1)).alias("_m"), F.sum("_label").alias("_t")).join(bins, ["_of", "_bin"])
    down = Window.partitionBy("_of", "_bin").orderBy(F.desc("_score"))
    n, hits = F.col("_n") + F.sum("_m").over(down), F.col("_hits") + F.sum("_t").over(down)
    below = F.coalesce(F.lead("_score").over(down), F.col("_below"), F.col("_score"))
    points = points.select("_of", "_score", (2 * hits / (n + F.col("_toxic"))).alias("_f1"), ((F.col("_score") + below) / 2).alias("_at"))
    best = points.groupBy("_of").agg(F.max_by("_at", F.struct("_f1", "_score")).alias("_at")).collect()
    return {None: default, **{r["_of"]["lang"]: r["_at"] for r in best}}


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    lang_col: str | None = None, most: int | None = None, most_words: int | None = None, default: float = 0.7,
) -> ToxicityModel:
    """A network of all labelled documents that are not held out, and the thresholds of the languages in ``lang_col``.

    The inputs are the words alone: no id, label, language or source. The labelled documents are staged as seven
    numbers of 16 bits for each word, in parts of about ``PART_CHARS`` characters, and learned from in tasks
    (:func:`learn_in_parts`, :func:`calibrate`). Only a caller that names ``most`` documents or ``most_words`` words gets
    a network of a draw by hash of the id, which goes to the driver.

    Defined cases: labels of a document that differ count by their majority (a tie is 1); repeated rows of an id are
    taken each; labels without a document, null labels and null ids teach nothing; without both labels the score is the
    share of label 1, or 0.5 without any, and the threshold ``default``.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).alias("_label")).dropna()
    known = known.where(remainder("_label_id") != HELD_OUT).groupBy("_label_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), lang.alias("_lang"))
    on = F.col("_id") == F.col("_label_id")

    @F.arrow_udf("binary")
    def rows_of_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = worker_state(("toxicity",), Words)
        for batch in batches:
            for texts in slices(batch):
                numbers, sizes = words.numbers(texts)
                ends = np.cumsum(sizes)
                yield pa.array([words.rows[numbers[a:b]].tobytes() for a, b in zip(ends - sizes, ends, strict=True)], type=pa.binary())

    text_batches(spark)
    if most is not None or most_words is not None:
        return _fit_of_draw(texts, known, on, rows_of_words, most, most_words, default)
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    crc = F.crc32(F.col("_id").cast("string").cast("binary"))
    rows = texts.join(known, on).withColumn("_calibrates", F.pmod(F.floor(crc / FOLDS), F.lit(CALIBRATION)) == 0)
    found = rows.groupBy("_calibrates", "_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("_text").cast("long")).alias("chars")).collect()
    count = {(r["_calibrates"], r["_label"]): r["n"] for r in found}
    split = all((False, one) in count for one in (0, 1))  # else the rows for calibration teach as well
    if not split and len({one for _, one in count}) < 2:
        toxic, total = sum(n for (_, one), n in count.items() if one), sum(count.values())
        return ToxicityModel(Network(constant=toxic / total if total else 0.5), {None: default})
    parts = max(1, -(-sum(r["chars"] for r in found) // PART_CHARS))
    part = F.pmod(F.xxhash64(F.lit(SEED), "_label_id", "_text"), F.lit(parts)).cast("int").alias("_part")
    rows = rows.select(part, F.col("_id").cast("string").alias("_key"), "_label", "_lang", "_calibrates", rows_of_words("_text").alias("_words"))
    path = scratch_path(spark, "stage-toxicity")
    rows.repartition(parts, "_part").write.partitionBy("_part").option("compression", "zstd").parquet(path)  # a file for each part
    rows = spark.read.schema(rows.schema).parquet(path)
    network = learn_in_parts(rows.where(~F.col("_calibrates")) if split else rows, parts)
    thresholds = calibrate(network, rows.where("_calibrates"), default)
    return ToxicityModel(network, thresholds)


def _fit_of_draw(
    texts: DataFrame, known: DataFrame, on: Column, rows_of_words: Callable[[str], Column], most: int | None, most_words: int | None, default: float
) -> ToxicityModel:
    """The model of ``most`` labelled documents, of ``most_words`` words altogether (None: no bound)."""
    order = [F.xxhash64(F.lit(SEED), "_label_id"), F.col("_label_id")]
    drawn = known if most is None else known.orderBy(*order).limit(most)
    rows = texts.join(drawn if most is None else F.broadcast(drawn), on)
    rows = rows.withColumn("_n", F.size(F.split("_text", r"\W+")))  # about the words
    if most_words is not None:
        so_far = Window.orderBy(*order, "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Narrow rows are ranked (as many as the drawn labels have documents); their texts are read in the second pass.
        ranked = rows.select("_label_id", "_n", F.xxhash64("_text").alias("_text")).withColumn("_sum", F.sum("_n").over(so_far))
        ids = ranked.groupBy("_label_id").agg(F.max("_sum").alias("_sum")).where(F.col("_sum") <= most_words).select("_label_id")
        rows = rows.join(ids, "_label_id", "left_semi")
    got = rows.select("_id", "_label", "_lang", rows_of_words("_text").alias("_words")).collect()
    got.sort(key=lambda r: (str(r["_id"]), bytes(r["_words"]), r["_lang"] or ""))
    each, words = numbered([bytes(r["_words"]) for r in got])
    y = np.array([r["_label"] for r in got], dtype=int)
    calibration = np.array([zlib.crc32(str(r["_id"]).encode()) // FOLDS % CALIBRATION == 0 for r in got], dtype=bool)
    network = learn(each, words, y, calibration)
    thresholds = {None: default}
    if network.embeddings is not None and calibration.any():
        held = np.flatnonzero(calibration)
        scores = network.probability(learned_logits(network, [each[i] for i in held], words))
        thresholds = language_thresholds(scores, y[held], [got[i]["_lang"] for i in held], default)
    return ToxicityModel(network, thresholds)


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` (1 from the threshold on) and
    ``flagged`` (whether the score reaches the threshold calibrated for the document's language).

    Defined cases: a null or empty text has a score as any other; a language without a threshold of its own, or null,
    has that of all calibration rows; a null id counts as the empty text and is held out if that is; repeated rows have
    equal scores; an empty table gives no rows. Columns but those named are not read.
    """
    model = fit(docs, labels, id_col, text_col, lang_col=lang_col)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"))
    scored = model.transform(rows, "_text", "_score")
    return scored.select(
        F.col("_id").alias(id_col), (remainder("_id") == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"), (F.col("_score") >= model.threshold(F.col("_lang"))).alias("flagged"),
    )
