"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Two bigram models, matched in all but their texts: one vocabulary (every word of every document), one set of bigrams (all of
them), one smoothing. The target model counts the target documents, the background model all others. A text's events are its
words and its end; the loss of an event under a model is

    log(count(previous) + S) - log(count(previous, event) + S * share(event))

where the start of a text is previous to its first word. A document's score is the mean over its events of the target
model's loss minus the background model's: the lower, the more it is like the target.

No count is left out and none is sent to the driver: there are more distinct bigrams than any machine's memory holds. Texts
lie in blocks of bounded size. Each block asks for its distinct words and bigrams, under 64-bit hashes, once, with its own
counts of them; what is asked is dealt by hash to parts, which add up the counts of all blocks and answer each block in the
order of its questions. The block then scores its texts. A frequent word or bigram is one question a block, so no part is
hot. Questions and answers travel as packed arrays, a row for each block and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, dropped, stored, tidy
from .wordhash import mixed, parts, word_hashes

SMOOTHING, UNIGRAM_ADD = 50.0, 0.5
#: Bytes of texts in a block (a longer text is one alone), and in all blocks for each part.
BLOCK, PART = 4 << 20, 8 << 20
START, END = np.uint64(1), np.uint64(2)
WORDS, BIGRAMS = 0, 1


class Events:
    """The events of some texts, and the distinct words and bigrams among them, ascending."""

    def __init__(self, texts: pa.Array):
        hashes, at = word_hashes(texts)
        self.n_words = np.diff(at)
        some = np.flatnonzero(self.n_words)  # texts without words have no events
        sizes = self.n_words[some] + 1
        last = np.cumsum(sizes) - 1
        event = np.full(int(sizes.sum()), END, np.uint64)
        own = np.ones(len(event), bool)
        own[last] = False
        event[own] = hashes
        self.some, self.sizes, self.first = some, sizes, last - sizes + 1
        previous = np.empty_like(event)
        previous[1:] = event[:-1]
        previous[self.first] = START
        bigram = mixed(previous * np.uint64(0xD1342543DE82EF95) + event)
        del previous, own, hashes
        self.bigrams, self.which_bigram = _numbered(bigram)
        del bigram
        self.words, which = _numbered(np.concatenate([event, np.full(1, START, np.uint64)]))
        self.which_word, self.start = which[:-1], which[-1]

    def counts(self, kind: int, target: np.ndarray) -> np.ndarray:
        """(2, distinct): how often each occurs in texts whose ``target`` is 1, and in those where it is 0."""
        of = np.repeat(target[self.some], self.sizes)
        which, n = (self.which_word, len(self.words)) if kind == WORDS else (self.which_bigram, len(self.bigrams))
        out = np.stack([np.bincount(which[of == m], minlength=n) for m in (1, 0)]).astype(np.uint64)
        if kind == WORDS:
            out[:, self.start] = [(target[self.some] == m).sum() for m in (1, 0)]
        return out

    def losses(self, words: np.ndarray, bigrams: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
        """(2, texts): the mean loss of each text under both models, from the counts of words and bigrams in all texts."""
        out = np.zeros((2, len(self.n_words)))
        previous = np.empty_like(self.which_word)
        previous[1:] = self.which_word[:-1]
        previous[self.first] = self.start
        for m in (0, 1):
            rest = SMOOTHING * (words[m] + UNIGRAM_ADD) / (total[m] + UNIGRAM_ADD * size)
            loss = np.log(words[m] + SMOOTHING)[previous] - np.log(bigrams[m][self.which_bigram] + rest[self.which_word])
            if len(loss):
                out[m, self.some] = np.add.reduceat(loss, self.first) / self.sizes
        return out


def packed(n: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, which the first byte says."""
    width = next(w for w in (1, 2, 4, 8) if not len(n) or int(n.max()) < 1 << 8 * w)
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """One or more ascending 64-bit numbers: the first, and the differences in as few bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the number of each key among them."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    which = np.empty(len(own), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], which


def _bounds(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """Where the keys of each of the parts begin among ascending ones, and the last one's end: parts are equal ranges of hashes."""
    cuts = np.array([(p << 64) // n_parts for p in range(1, n_parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (id, target, text) with a block of about BLOCK bytes of texts, stored."""
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("rid", T.LongType()), *docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rid, held = 0, 0
        for batch in batches:
            _, at = parts(batch.column(2))
            block = first + (held + at[1:]) // BLOCK
            numbers = first + np.arange(rid, rid + batch.num_rows)
            rid, held = rid + batch.num_rows, held + int(at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(numbers), *batch.columns], names=kind.names)

    return stored(docs.mapInArrow(run, kind), "blocks", "zstd")


def _units(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """The rows of each block, as far as they are next to each other; no more of a block than a task reads in a go."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        block = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if held and held[0].column("block")[0].as_py() != block[s]:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(s, e - s))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _flags(target: pa.ChunkedArray) -> np.ndarray:
    """1 for true, 0 for false, 2 for null."""
    return target.cast(pa.int8()).fill_null(2).to_numpy()


_ASKED = "block long, rid long, kind int, part int, keys binary, n1 binary, n0 binary"
_ANSWERED = "block long, rid long, kind int, part int, n1 binary, n0 binary, events long, t1 long, t0 long"


def _asked(blocks: DataFrame, n_parts: int) -> DataFrame:
    """For each block, kind and part the ascending keys, and how often the block's target and other texts have them. ``rid`` is
    the block's first row (of those that are next to each other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, ["block", "rid", "target", "text"]):
            events, target = Events(unit.column("text").chunk(0)), _flags(unit.column("target"))
            for kind, keys in ((WORDS, events.words), (BIGRAMS, events.bigrams)):
                n = events.counts(kind, target)
                at = _bounds(keys, n_parts)
                some = np.flatnonzero(np.diff(at))
                cut = lambda x, pack: [pack(x[at[p] : at[p + 1]]) for p in some]  # noqa: B023, E731
                m = len(some)
                cols = [[unit.column("block")[0].as_py()] * m, [unit.column("rid")[0].as_py()] * m, [kind] * m, some, cut(keys, packed_keys), cut(n[0], packed), cut(n[1], packed)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_names(_ASKED))

    return blocks.mapInArrow(run, _ASKED)


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def _answered(asked: DataFrame, n_parts: int) -> DataFrame:
    """The counts in all blocks, in the order of each block's keys; and of each part once the number of its events, and how
    often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            keys = [unpacked_keys(k) for k in part["keys"]]
            which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            distinct, number = _numbered(np.concatenate(keys))
            n = [np.bincount(number, np.concatenate([unpacked(x) for x in part[c]]), len(distinct)).astype(np.uint64) for c in ("n1", "n0")]
            events = (distinct != START) & (n[0] + n[1] > 0) if part["kind"] == WORDS else np.zeros(len(distinct), bool)
            said = [int(events.sum()), int(n[0][events].sum()), int(n[1][events].sum())]
            ends = np.searchsorted(which, np.arange(len(keys) + 1))
            m = len(keys)
            cut = lambda x: [packed(x[number[s:e]]) for s, e in zip(ends, ends[1:], strict=False)]  # noqa: B023, E731
            cols = [part["block"], part["rid"], [part["kind"]] * m, [part["part"]] * m, cut(n[0]), cut(n[1]), *([v] + [0] * (m - 1) for v in said)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_names(_ANSWERED))

    dealt = asked.repartition(2 * n_parts, "kind", "part").sortWithinPartitions("kind", "part")
    return stored(dealt.mapInArrow(run, _ANSWERED), "answers", "zstd")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of each kind and part, which are next to each other."""
    held: dict = {}
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for block, rid, kind, part, keys, n1, n0 in zip(*cols, strict=True):
            if held and (held["kind"], held["part"]) != (kind, part):
                yield held
                held = {}
            if not held:
                held = {"kind": kind, "part": part, "block": [], "rid": [], "keys": [], "n1": [], "n0": []}
            for name, value in (("block", block), ("rid", rid), ("keys", keys), ("n1", n1), ("n0", n0)):
                held[name].append(value)
    if held:
        yield held


@tidy
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row, the losses as means over the events of the whole text.

    Models learn from rows whose ``target_col`` is true (the target) or false (the background); rows where it is null are
    scored only. Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts, and ones of white space,
    have no words; their losses and score are 0. Repeated rows and null ids keep their rows, and count as often as they
    occur. Without any word to learn from all words are alike. Other columns are not looked at; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(target_col).cast("boolean").alias("target"), F.col(text_col).cast("binary").alias("text"))
    blocks = _blocks(rows)
    n_parts = max(1, -(-(blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    answers = _answered(_asked(blocks, n_parts), n_parts)
    size, *total = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("events", "t1", "t0")]).first()
    # an unknown word is one more
    size, total = size + 1, np.array(total, float)

    def run(texts: pa.Table, said: pa.Table) -> pa.Table:
        texts, said = texts.sort_by("rid"), said.sort_by([("rid", "ascending"), ("kind", "ascending"), ("part", "ascending")])
        rid = texts.column("rid").to_numpy()
        firsts, begins = np.unique(said.column("rid").to_numpy(), return_index=True)
        begins, out = [*begins.tolist(), said.num_rows], []
        for i, s in enumerate(np.searchsorted(rid, firsts).tolist()):
            e = int(np.searchsorted(rid, firsts[i + 1])) if i + 1 < len(firsts) else len(rid)
            own, unit = said.slice(begins[i], begins[i + 1] - begins[i]), texts.slice(s, e - s).combine_chunks()
            events = Events(unit.column("text").chunk(0))
            kind = own.column("kind").to_numpy()
            n = {c: np.array(own.column(c).to_pylist(), object) for c in ("n1", "n0")}
            words, bigrams = (np.stack([np.concatenate([np.zeros(0), *map(unpacked, n[c][kind == k])]) for c in ("n1", "n0")]) for k in (WORDS, BIGRAMS))
            if words.shape[1] != len(events.words) or bigrams.shape[1] != len(events.bigrams):
                raise ValueError("answers don't fit the block")
            target, background = events.losses(words, bigrams, total, size)
            cols = [unit.column("id").chunk(0), pa.array(events.n_words, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)]
            out.append(pa.Table.from_arrays(cols, names=["id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(out)

    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])
    n_tasks = max(1, n_parts // 4)  # in proportion to the texts, whatever the session's number of partitions
    texts = blocks.select("block", "rid", "id", "text").repartition(n_tasks, "block")
    said = answers.select("block", "rid", "kind", "part", "n1", "n0").repartition(n_tasks, "block")
    scored = stored(texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(run, kind), "scores")
    dropped(blocks, answers)
    return scored


def marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, text, target): whether the document's id is among ``targets.doc_id``."""
    names = targets.where("doc_id is not null").select(F.col("doc_id").alias("wanted")).distinct()
    rows = docs.select("doc_id", "text").join(broadcast_if_small(names), F.col("doc_id") == F.col("wanted"), "left")
    return rows.select("doc_id", "text", F.col("wanted").isNotNull().alias("target"))


@tidy
def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents; the target are those labelled as of good quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(marked(docs, labels.where("quality = 1"))).withColumnRenamed("id", "doc_id")
