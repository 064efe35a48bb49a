"""Token ids in a compressed block format.

Format: a Parquet table of blocks and one of the shared frequency table. A block holds whole documents and decodes alone. Its
ids are coded by a static range asymmetric numeral system with 52-bit states and 32-bit words: id i goes to lane i mod
lanes, and all lanes are coded side by side into one stream of words, so coding is array operations on one element a lane.
At every CHECKPOINT steps a block keeps the lanes' states and the place in the stream, from which decoding can start too. CRC-32
checksums of the words and of the ids are checked on reading. Only Spark's readers and writers touch the files, so they
can be in any store.

Columns of a block: part, block (their order is that of the documents), doc_ids, lengths (ids of each, with the end id),
n, lanes, states, words, points (steps), point_states, point_words, words_crc32, ids_crc32.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, scratch_path, stored, tidy, writing

BLOCK, LANES, CHECKPOINT, PRECISION = 1 << 20, 4096, 128, 20
#: States stay between this and 2 ** 52, so that doubles divide them exactly.
LOW = np.uint64(1 << PRECISION)
END = 0
#: Words that are tokenized at a time, and that a worker remembers; bytes of text whose pieces are made distinct, and in a part.
ASKED, REMEMBERED, LOT, PART = 20_000, 250_000, 8 << 20, 32 << 20

#: Signs that are no letters or digits, nor an apostrophe, and a letter or digit before them: there a new token begins too.
_MARKS, _BEFORE_MARKS = ".,;:!?*#%$&+-=_/()[]{}<>|~\"@^", "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """A byte-level tokenizer of the ``tokenizers`` library that tokenizes each distinct word of many texts once, and remembers
    the words it has seen lately.

    Byte-level pre-tokenizing never joins text across a single space between two other characters: the space starts the
    next token. So a text's ids are those of its pieces cut there, each with its space. Other spaces are not cut at. The
    distinct pieces are tokenized as one text, in which a piece begins where a token begins with a space.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.words, self.known = pa.array([], pa.string()), pa.array([], pa.binary())
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(" " in t for t in self.specials):
            raise ValueError("a special token holds a space")
        # a byte-level vocabulary writes the space as U+0120
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One for each worker process and path."""
        if path not in cls._known:
            pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
            cls._known[path] = cls(path)
        return cls._known[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces that neither begin nor end with white space, each as it is after a space."""
        found, sizes = [], []
        for at in range(0, len(pieces), ASKED):
            some = pieces.slice(at, ASKED).to_pylist()
            ids = self._ids([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some) and not starts[0]:
                found.append(ids)
                sizes.append(np.diff(starts, append=len(ids)))
            else:
                each = self._ids([" " + p for p in some])
                found += each
                sizes.append(np.array([len(x) for x in each]))
        return self._listed(found, np.concatenate([*sizes, np.zeros(0, np.int64)]))

    def _remembered(self, words: pa.Array) -> pa.Array:
        """The same for distinct words, from memory where they are there."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        ids = pa.concat_arrays([self.known, self._after_space(new)])
        which = at.to_numpy(zero_copy_only=False).copy()
        which[np.isnan(which)] = np.arange(len(self.words), len(ids))
        found = ids.take(pa.array(which.astype(np.int32)))
        if len(ids) > REMEMBERED:
            self.words, self.known = words, found
        else:
            self.words, self.known = pa.concat_arrays([self.words, new]), ids
        return found

    def _listed(self, ids: list[np.ndarray], sizes: list[int] | np.ndarray) -> pa.Array:
        """Consecutive ids, cut into values of so many ids, as bytes."""
        data = np.concatenate([*ids, np.zeros(0, self.kind)])
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]) * data.itemsize
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each whole text, as bytes of ``kind``. No text is null."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        pieces = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy()
        ends = ends - ends[0]
        which, distinct, first = pieces.indices.to_numpy().astype(np.int32), pieces.dictionary, ends[:-1]
        # a piece that begins or ends with white space, or is empty, can't be cut off
        firm = pc.and_(pc.equal(distinct, pc.utf8_trim_whitespace(distinct)), pc.greater(pc.binary_length(distinct), 0)).to_numpy(zero_copy_only=False)
        # signs at a piece's end are a piece of their own, without a space
        words = pc.utf8_rtrim(distinct, characters=_MARKS)
        marked = pc.and_(pc.and_(pa.array(firm), pc.not_equal(words, distinct)), pc.match_substring_regex(words, _BEFORE_MARKS))
        for special in self.specials:
            marked = pc.and_not(marked, pc.match_substring(distinct, special))
        words = pc.if_else(marked, words, distinct).dictionary_encode()
        ends_in = [p[len(w) :] for p, w in zip(distinct.filter(marked).to_pylist(), words.filter(marked).cast(pa.string()).to_pylist(), strict=True)]
        marks = pa.array(ends_in, pa.string()).dictionary_encode()
        marks_ids = self._ids(marks.dictionary.to_pylist())
        firm_ones = np.unique(words.indices.to_numpy()[firm])
        values = [self._remembered(words.dictionary.take(pa.array(firm_ones))), self._listed([*marks_ids], [*map(len, marks_ids), 0])]
        # each distinct piece as its word, then its signs or else nothing
        nothing = len(firm_ones) + len(marks_ids)
        place = np.full(len(words.dictionary), nothing, np.int32)
        place[firm_ones] = np.arange(len(firm_ones))
        both = np.full((len(distinct), 2), nothing, np.int32)
        both[:, 0] = place[words.indices.to_numpy()]
        both[np.flatnonzero(marked.to_numpy(zero_copy_only=False)), 1] = marks.indices.to_numpy() + len(firm_ones)
        pairs = pa.concat_arrays(values).take(pa.array(both.ravel()))
        # the first piece of each text has no space before it, whatever else it has
        starts = self._ids(distinct.take(pa.array(which[first])).to_pylist())
        _, offsets, data = pairs.buffers()
        at = np.frombuffer(offsets, np.int32)[: 2 * len(distinct) + 1 : 2]
        known = self._listed([np.frombuffer(data, self.kind, int(at[-1]) // self.kind().itemsize), *starts], [*np.diff(at) // self.kind().itemsize, *map(len, starts)])
        loose = ~firm[which]
        loose[first] = False
        odd = np.flatnonzero(np.add.reduceat(loose, first))
        which[first] = np.arange(len(distinct), len(distinct) + len(starts), dtype=np.int32)
        _, offsets, data = known.take(pa.array(which)).buffers()
        at = np.frombuffer(offsets, np.int32)[ends].tolist()
        out = [data[s:e].to_pybytes() for s, e in zip(at, at[1:], strict=False)]
        for i in odd.tolist():
            some = _BETWEEN.split(texts[i].as_py())
            out[i] = b"".join(x.tobytes() for x in self._ids([some[0], *[" " + p for p in some[1:]]]))
        return out


def lots(texts: pa.Array, size: int = LOT) -> Iterator[tuple[int, int]]:
    """(start, rows) of consecutive parts of about so many bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(total):
        before = int(total[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(total, before + size, "right")) - at)
        yield at, n
        at += n


class Frequencies:
    """The shared table: how many of 2 ** PRECISION slots each id has; every id that occurs has one at least."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        total, slots = max(1, int(counts.sum())), 1 << PRECISION
        if np.count_nonzero(counts) > slots:
            raise ValueError("more ids than slots")
        own = np.where(counts > 0, np.maximum(1, counts * (slots / total)).astype(np.int64), 0)
        if own.any():  # what rounding left over or took too much is the most frequent ids'
            order = np.argsort(-own, kind="stable")
            off = slots - int(own.sum())
            if off > 0:
                own[order[0]] += off
            for i in order:
                if off >= 0:
                    break
                less = min(int(own[i]) - 1, -off)
                own[i] -= less
                off += less
        self.slots = own

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots and first slot of each id, and the id of each slot."""
        f = self.slots.astype(np.uint64)
        kind = np.uint16 if len(f) <= 1 << 16 else np.uint32
        return f, (np.cumsum(self.slots) - self.slots).astype(np.uint64), np.repeat(np.arange(len(f)).astype(kind), self.slots)


def encode_block(ids: np.ndarray, f: np.ndarray, first: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> dict:
    """The coded columns of a block. Lanes code from the last step to the first, so that they decode forwards."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    n_words = 0
    points, states, places = [], [], []
    most, exact, rest = f << np.uint64(32), f.astype(float), np.uint64(1 << PRECISION) - f
    for s in range(steps - 1, -1, -1):
        own = ids[s * lanes : (s + 1) * lanes]
        live = x[: len(own)]
        full = live >= most[own]
        words = live[full].astype(np.uint32)
        live = np.where(full, live >> np.uint64(32), live)
        # under f * 2 ** 32 and so 2 ** 52, where the floor of the quotient of doubles is exact
        times = (live.astype(float) / exact[own]).astype(np.uint64)
        x[: len(own)] = live + times * rest[own] + first[own]
        out.append(words)
        n_words += len(words)
        if s and s % every == 0:
            points.append(s)
            states.append(x.copy())
            places.append(n_words)
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    data = stream.tobytes()
    return {
        "n": n, "lanes": lanes, "states": x.tobytes(), "words": data, "points": points[::-1], "point_states": b"".join(s.tobytes() for s in states[::-1]),
        "point_words": [len(stream) - w for w in places[::-1]], "words_crc32": zlib.crc32(data), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def decode_block(b: dict, f: np.ndarray, first: np.ndarray, symbol: np.ndarray, start: int | None = None, stop: int | None = None) -> np.ndarray:
    """The ids of a block, or those from checkpoint number ``start`` up to ``stop`` (counted from 0, the block's own start).

    Raises ValueError where a checksum is wrong; that of the ids is for whole blocks.
    """
    if zlib.crc32(b["words"]) != b["words_crc32"]:
        raise ValueError("damaged words")
    words = np.frombuffer(b["words"], np.uint32)
    n, lanes = b["n"], b["lanes"]
    steps = -(-n // lanes)
    begin, at, x = 0, 0, np.frombuffer(b["states"], np.uint64).copy()
    if start:
        begin, at = b["points"][start - 1], b["point_words"][start - 1]
        x = np.frombuffer(b["point_states"], np.uint64).reshape(-1, lanes)[start - 1].copy()
    end = b["points"][stop - 1] if stop is not None and stop <= len(b["points"]) else steps
    out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
    p, mask = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    for s in range(begin, end):
        m = min(lanes, n - s * lanes)
        live = x[:m]
        slot = live & mask
        own = symbol[slot]
        live = f[own] * (live >> p) + slot - first[own]
        low = np.flatnonzero(live < LOW)
        live[low] = live[low] << np.uint64(32) | words[at : at + len(low)]
        at += len(low)
        x[:m] = live
        out[(s - begin) * lanes : (s - begin) * lanes + m] = own
    if not start and end == steps and zlib.crc32(out.astype("<u4").tobytes()) != b["ids_crc32"]:
        raise ValueError("damaged ids")
    return out


def _blocks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """Uncoded blocks (part, block, doc_ids, lengths, ids) in the order of ids, then of texts' hashes; null ids come first. The
    last block of a part has in (seen, times) which ids the part has, and how often."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-total // PART)), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0
        end, seen = np.array([END], encoder.kind).tobytes(), np.zeros(encoder.size, np.int64)
        doc_ids, lengths, held, size = [], [], [], 0

        def out(last: bool) -> pa.RecordBatch:
            nonlocal block, doc_ids, lengths, held, size, seen
            ids = np.frombuffer(b"".join(held), encoder.kind)
            seen += np.bincount(ids, minlength=encoder.size)
            some = np.flatnonzero(seen) if last else []
            cols = [[part], [block], [doc_ids], [lengths], [ids.astype("<u2" if encoder.kind == np.uint16 else "<u4").tobytes()], [some], [seen[some] if last else []]]
            row = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "block", "doc_ids", "lengths", "ids", "seen", "times"])
            block, doc_ids, lengths, held, size = block + 1, [], [], [], 0
            return row

        for batch in batches:
            own = batch.column(0).to_pylist()
            for at, rows in lots(batch.column(1)):
                for doc, ids in zip(own[at : at + rows], encoder.encode(batch.column(1).slice(at, rows)), strict=True):
                    if size >= BLOCK:
                        yield out(False)
                    doc_ids.append(doc)
                    lengths.append(len(ids) // encoder.kind().itemsize + 1)
                    held += [ids, end]
                    size += lengths[-1]
        if doc_ids:
            yield out(True)

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return rows.mapInArrow(run, "part int, block int, doc_ids array<long>, lengths array<long>, ids binary, seen array<int>, times array<long>")


_KIND = "part int, block int, doc_ids array<long>, lengths array<long>, n long, lanes int, states binary, words binary, points array<int>, point_states binary, point_words array<long>, words_crc32 long, ids_crc32 long"
_ARROW = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write ``path``/blocks and ``path``/frequencies, documents in ascending order of their ids.

    An end id follows each document; null and empty texts are just that. Of equal ids the order is that of the texts' hashes,
    null ids come first. An empty table gives no blocks. The frequencies are counted over all ids of all documents.
    """
    spark = docs.sparkSession
    encoder = Encoder(tokenizer)
    size, width = encoder.size, np.dtype(encoder.kind).itemsize
    raw = stored(_blocks(docs, tokenizer, id_col, text_col), "ids")

    counts = np.zeros(size, np.int64)
    times = raw.where(F.size("seen") > 0).select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n"))
    for r in times.collect():  # a row an id of the vocabulary
        counts[r[0]] = r[1]
    table = Frequencies(counts)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(table.slots)], "id long, slots long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(table)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, first, _ = shared.value.tables()
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, doc_ids, lengths, ids = (c[i].as_py() for c in batch.columns)
                b = {"part": part, "block": block, "doc_ids": doc_ids, "lengths": lengths} | encode_block(np.frombuffer(ids, f"<u{width}"), f, first)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(b.values(), _ARROW, strict=True)], names=list(b))

    with writing(spark):
        raw.drop("seen", "times").mapInArrow(code, _KIND).write.parquet(f"{path}/blocks")
    dropped(raw)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids binary) of every document of files that ``write`` made: little-endian unsigned 32-bit ids with the
    end id, and the number of ids of all documents before it."""
    return _read(spark, path, "ids binary", lambda ids: ids, pa.binary())


def _read(spark, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.schema(_KIND).parquet(f"{path}/blocks")
    slots = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()["slots"].to_numpy()  # a row an id of the vocabulary
    table = Frequencies.__new__(Frequencies)
    table.slots = slots
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                ids = decode_block(b, *tables).astype("<u4").tobytes()
                ends = np.cumsum(b["lengths"], dtype=np.int64)
                starts = ends - np.array(b["lengths"], np.int64)
                if len(ids) != 4 * ends[-1]:
                    raise ValueError("lengths and ids don't agree")
                m = len(ends)
                cols = [pa.array([b["part"]] * m, pa.int32()), pa.array([b["block"]] * m, pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts)]
                values = pa.array([value(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*cols, values], names=["part", "block", "doc_id", "inside", "n_tokens", column.split(" ")[0]])

    docs = blocks.mapInArrow(run, f"part int, block int, doc_id long, inside long, n_tokens long, {column}")
    # a row a part reaches the driver: as many as the writer had tasks
    totals = sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets or [(-1, 0)], "part int, offset long")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = blocks.select("part", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")).join(F.broadcast(offset), "part")
    start = start.select("part", "block", (F.col("first") + F.col("offset")).alias("first"))
    return docs.join(broadcast_if_small(start), ["part", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", column.split(" ")[0])


@tidy
def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, written and read back: where they start, how many they are, and their CRC-32."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return _read(spark, path, "ids_crc32 long", zlib.crc32, pa.int64())
