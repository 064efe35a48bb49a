"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model gives each sentence a probability; the document's is their noisy-or,
1 - prod(1 - p). Only documents have labels: the likelihood of these trains the sentence model, which then also tells
which sentences make a document toxic. Features are words and their prefixes, so that inflected forms share weights.

Every sentence has some probability, so that a plain noisy-or makes any text toxic that is long enough. In a score, only
what a sentence has above FLOOR is added up; of sentences below it the worst one counts, once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WRITING, broadcast_if_small, settings, stored, tidy
from .wordhash import lots

PREFIXES = (4, 5, 6)
#: A feature is learned if it is in so many documents of label 1, that many times and standard deviations above chance.
LEAST_DOCS, LEAST_LIFT, LEAST_SIGMA = 3, 4.0, 2.5
THRESHOLD = 0.3
ROUNDS, RATE, LASSO = 200, 0.15, 0.01
#: Where the likelihood is worked out: of bags of so many bytes at most by the driver, of more by executors. The model is the same.
DRIVER_BYTES = 16 << 20
#: Words and features that a task remembers, and numbers in a block of bags.
HELD, BLOCK = 100_000, 1 << 16
#: Sentences of at most this probability are neutral.
FLOOR = 0.05

_SENTENCE, _WORD, _WORD_OR_END = re.compile(r"[^.!?\n]+"), re.compile(r"\w+"), re.compile(r"[.!?\n]|\w+")


def _features(word: str) -> set[int]:
    """Hashes of a lower-case word and of its prefixes."""
    return {zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:k]}*".encode()) for k in PREFIXES if len(word) >= k)}


class Model(dict):
    """Weight of each feature. Looking up a word gives the sum over its features, which is kept for the next time."""

    def __init__(self, bias: float, weights: dict[int, float]):
        super().__init__()
        self.bias, self.weights = bias, weights

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        if word in ".!?\n":  # the end of a sentence
            self[word] = math.nan
            return math.nan
        get, n = self.weights.get, len(word)
        w = get(zlib.crc32(word.encode()), 0.0)  # as _features has them
        for k in PREFIXES:
            if n >= k:
                w += get(zlib.crc32((word[:k] + "*").encode()), 0.0)
        self[word] = w
        return w

    def probabilities(self, text: str) -> np.ndarray:
        """The probability of each sentence of a whole text, those without a word left out."""
        z = np.array(list(map(self.__getitem__, _WORD_OR_END.findall(text.lower()))), float)
        ends = np.isnan(z)
        of = np.cumsum(ends)
        sums, words = np.bincount(of, np.where(ends, 0.0, z)), np.bincount(of, ~ends)
        return 1 / (1 + np.exp(-np.clip(sums[words > 0] + self.bias, -30, 30)))

    def sentences(self, text: str) -> tuple[np.ndarray, list[re.Match]]:
        """The same, and where these sentences are."""
        return self.probabilities(text), [s for s in _SENTENCE.finditer(text) if _WORD.search(s.group().lower())]


def noisy_or(p: np.ndarray) -> float:
    """The probability that at least one of independent instances is positive; 0 for none."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def document_score(p: np.ndarray, floor: float = FLOOR) -> float:
    """The noisy-or of what sentences have above the floor and of the worst of what they have below it; 0 for none. More
    neutral sentences don't change it."""
    if not len(p):
        return 0.0
    above = np.maximum(p - floor, 0) / (1 - floor)
    return noisy_or(np.append(above[above > 0], min(float(p.max()), floor)))


class _Known(dict):
    """A function of words whose results are kept for the next time."""

    def __init__(self, of: Callable[[str], tuple]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple:
        if len(self) > HELD:
            self.clear()
        self[word] = found = self.of(word)
        return found


def _words(text: str) -> Iterator[list[str]]:
    """The words of each sentence that has some, as scores see them."""
    for s in _SENTENCE.finditer(text.lower()):
        if words := _WORD.findall(s.group()):
            yield words


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, str]]:
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1), strict=True):
            yield label.as_py(), text.as_py()


def _counted(texts: DataFrame) -> DataFrame:
    """(feature, n1, n): how many of the texts (label, text) of label 1, and how many of all, have the feature. Feature -1 stands
    for any word at all."""

    def table(n: Counter, n1: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (n, (n1[f] for f in n), n.values())], names=["feature", "n1", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda word: tuple(_features(word)))
        n, n1 = Counter(), Counter()
        for label, text in _rows(batches):
            words: set[str] = set()
            for some in _words(text):
                words.update(some)
            if words:
                own = {-1}.union(*map(known.__getitem__, words))
                n.update(own)
                if label:
                    n1.update(own)
            if len(n) > HELD:
                yield table(n, n1)
                n, n1 = Counter(), Counter()
        yield table(n, n1)

    return texts.mapInArrow(run, "feature long, n1 long, n long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))


def _bags(texts: DataFrame, values: np.ndarray) -> DataFrame:
    """(label, bag, n) of texts (label, text): a bag says how many sentences have which of the features, by their numbers; n
    texts have that bag. Texts without a word have none.

    A bag is 32-bit numbers: the number of kinds of sentences, how many sentences each kind has, how many features, and which.
    """
    shared = texts.sparkSession.sparkContext.broadcast(values)

    def table(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([label for label, _ in found], pa.bool_()), pa.array([bag for _, bag in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["label", "bag", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value

        def numbers(word: str) -> tuple[int, ...]:
            own = np.array(list(_features(word)), np.int64)
            at = np.searchsorted(values, own)
            return tuple(at[(at < len(values)) & (values[at.clip(max=max(len(values) - 1, 0))] == own)].tolist()) if len(values) else ()

        known = _Known(numbers)
        found, size = Counter(), 0
        for label, text in _rows(batches):
            kinds = Counter(tuple(sorted(set().union(*map(known.__getitem__, words)))) for words in _words(text))
            if kinds:
                every = sorted(kinds)
                bag = np.array([len(every), *(kinds[k] for k in every), *map(len, every), *(i for k in every for i in k)], np.int32).tobytes()
                found[label, bag] += 1
                size += len(bag) if found[label, bag] == 1 else 0
            if size > 4 << 20 or len(found) > HELD:
                yield table(found)
                found, size = Counter(), 0
        yield table(found)

    return texts.mapInArrow(run, "label boolean, bag binary, n long").groupBy("label", "bag").agg(F.sum("n").alias("n"))


def _blocks(bags: DataFrame) -> DataFrame:
    """Rows of many bags each, their numbers one after the other as bytes: labels, texts and kinds of the bags, sentences and
    features of the kinds, and the features."""
    names, types = ["y", "n", "kinds", "times", "lengths", "ids"], [np.bool_, np.int64, np.int32, np.int32, np.int32, np.int32]

    def table(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).astype(t).tobytes()], pa.binary()) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for label, bag, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(bag, np.int32)
                k = a[0]
                held.append(([label], [n], [k], a[1 : k + 1], a[k + 1 : 2 * k + 1], a[2 * k + 1 :]))
                size += len(a) + 4
                if size > BLOCK:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    return bags.select("label", "bag", "n").mapInArrow(run, ", ".join(f"{x} binary" for x in names))


def _slopes(blocks: Iterable[pa.RecordBatch | pa.Table], w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """The slopes of the negative log likelihood by weights and bias, summed over the documents of blocks."""
    grad, grad_b = np.zeros(len(w)), 0.0
    for batch in blocks:
        for row in zip(*batch.columns, strict=True):
            y, n, kinds, times, lengths, ids = (np.frombuffer(x.as_py(), t) for x, t in zip(row, [np.bool_, np.int64, np.int32, np.int32, np.int32, np.int32], strict=True))
            first = np.concatenate([[0], np.cumsum(kinds, dtype=np.int64)])
            _, by_w, by_b = _sums(w, bias, ids, np.repeat(np.arange(len(times)), lengths), first, y, times, n)
            grad += by_w
            grad_b += by_b
    return grad, grad_b


@tidy
def fit(docs: DataFrame, labels: DataFrame, text_col: str, label_col: str, id_col: str) -> Model:
    """Train on all labelled rows, each with its whole text.

    ``labels`` has one row an id. Executors count features and turn texts into bags, of which equal ones are one with a weight.
    The likelihood is maximised by Adam: its slopes are summed by executors, or by the driver if the bags are counted to be
    small; the driver holds the weights. Rows without a label or a text are left out. Without rows of both labels the model
    gives every sentence a probability near 0.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("labelled"), (F.nanvl(F.col(label_col).cast("double"), F.lit(0.0)) > 0).alias("label")).where("labelled is not null and label is not null")
    own = broadcast_if_small(stored(own, "labels"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = stored(rows.join(own, F.col("id") == F.col("labelled")).select("label", "text"), "labelled", "zstd")
    counts = stored(_counted(texts).where((F.col("feature") == -1) | (F.col("n1") >= LEAST_DOCS)), "features")
    total = counts.where("feature = -1").first()
    if total is None or total.n1 in (0, total.n):
        return Model(-6.0, {})
    # the features that speak for label 1, numbered
    chance = (F.col("n") - F.col("n1")) * F.lit(total.n1 / (total.n - total.n1))  # the documents of label 1 to expect if the feature said nothing
    speak = (F.col("n1") >= LEAST_LIFT * chance) & (F.col("n1") - chance >= LEAST_SIGMA * F.sqrt(chance + 1))
    values = np.sort(counts.where("feature >= 0").where(speak).select("feature").toArrow().column(0).to_numpy())
    blocks = stored(_blocks(_bags(texts, values).sortWithinPartitions("label", "bag")), "bags")
    size = blocks.agg(F.sum(sum(F.octet_length(c) for c in blocks.columns))).first()[0]
    if size <= DRIVER_BYTES:
        here = blocks.toArrow()
        return learn(lambda w, bias: _slopes([here], w, bias), values, total.n)

    def there(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, grad_b = _slopes(batches, w, bias)
            yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary()), pa.array([grad_b])], names=["w", "b"])

        got = blocks.mapInArrow(run, "w binary, b double").toArrow()
        return sum(np.frombuffer(x.as_py()) for x in got.column(0)), sum(got.column(1).to_pylist())

    with settings(spark, {**WRITING, "spark.sql.parquet.columnarReaderBatchSize": "16"}):  # few blocks at a time
        return learn(there, values, total.n)


def _sums(w: np.ndarray, bias: float, ids: np.ndarray, sentence: np.ndarray, first: np.ndarray, y: np.ndarray, times: np.ndarray | int = 1, n: np.ndarray | int = 1) -> tuple[float, np.ndarray, float]:
    """The negative log likelihood of documents' labels and its slopes by weights and bias, summed. Sentences count ``times``,
    documents ``n`` times."""
    doc_of = np.repeat(np.arange(len(y)), np.diff(first))
    z = np.bincount(sentence, weights=w[ids], minlength=len(doc_of)) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clear = np.exp(np.add.reduceat(times * np.log1p(-np.minimum(p, 1 - 1e-9)), first[:-1]))
    pull = n * np.where(y, -clear / np.maximum(1 - clear, 1e-9), 1.0)  # d loss / d z is p times this
    g = times * p * pull[doc_of]
    loss = -np.sum(n * np.where(y, np.log(np.maximum(1 - clear, 1e-9)), np.log(np.maximum(clear, 1e-300))))
    return float(loss), np.bincount(ids, weights=g[sentence], minlength=len(w)), float(g.sum())


def likelihood(w: np.ndarray, bias: float, ids: np.ndarray, sentence: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The mean negative log likelihood of documents' labels, and its slopes by weights and bias.

    ``ids`` are features and ``sentence`` the sentences that have them; ``first`` is each document's first sentence and the
    end, and no document is without one. A document is clean if all its sentences are.
    """
    loss, grad, grad_b = _sums(w, bias, ids, sentence, first, y)
    return loss / len(y), grad / len(y), grad_b / len(y)


def learn(slopes: Callable[[np.ndarray, float], tuple[np.ndarray, float]], values: np.ndarray, n: int) -> Model:
    """The model of the features ``values`` that the slopes, sums over n documents at given weights and bias, lead to."""
    width = len(values)
    w, bias = np.zeros(width), -5.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        grad, grad_b = (x / n for x in slopes(w, bias))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        slow, fast = 1 - 0.9**step, 1 - 0.99**step
        w = w - RATE * (m / slow) / (np.sqrt(v / fast) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * LASSO, 0)
        bias -= RATE * (mb / slow) / (np.sqrt(vb / fast) + 1e-6)
    large = np.abs(w) > 1e-2
    return Model(float(bias), dict(zip(values[large].tolist(), w[large].tolist(), strict=True)))


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and ``tox_score``; with ``spans`` also ``tox_spans``, the sentences of at least that probability
    as (start, end, score), in characters of the text.

    Whole texts are scored, one at a time. Null and empty texts, and texts without a word, score 0 and have no spans.
    """
    given = docs.drop("tox_score", "tox_spans")
    out = T.StructType([*given.schema.fields, T.StructField("tox_score", T.DoubleType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    if spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
        out = out.add("tox_spans", T.ArrayType(span))
    at = given.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lot in lots(batch, at):  # smaller batches go back than have come
                scores, found = [], []
                for text in lot.column(at):
                    text = text.as_py() or ""
                    p = model.probabilities(text)
                    scores.append(document_score(p))
                    if spans:
                        where = model.sentences(text)[1] if (p >= least).any() else []
                        found.append([{"start": s.start(), "end": s.end(), "score": float(x)} for s, x in zip(where, p, strict=False) if x >= least])
                more = [pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if spans else [])
                yield pa.RecordBatch.from_arrays([*lot.columns, *more], names=out.names)

    return given.mapInArrow(run, out)


def one_label(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """One label a document: 1 if any of its rows says 1."""
    return labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("tox_label"))


def train(docs: DataFrame, labels: DataFrame, held_out=None) -> Model:
    """The model that ``docs.text`` and ``labels.toxic`` give; rows where ``held_out`` holds are not learned from."""
    rows = docs.select("doc_id", "text").where(~held_out) if held_out is not None else docs.select("doc_id", "text")
    return fit(rows, one_label(labels, "toxic"), "text", "tox_label", "doc_id")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, from a model that has seen no label of a held-out row, and its number of offending sentences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    scored = score(docs, model, spans=True).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("tox_spans").alias("n_offending"))
