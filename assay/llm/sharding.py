"""Sharding by sampled splitters.

Records are ordered by a hash of their text. A sample in which a record's chance grows with its size gives splitters: the
sample's quantiles cut the order into ranges of about equal bytes. Every record goes to its range; the exact bytes of the
ranges are counted, and overfull ones are subdivided by a second hash. Whole ranges are then dealt to the shards, largest
first, each to the shard with the fewest bytes. There are many more ranges than shards, so the shards come out nearly
equal. Equal texts share their place in the order and so their shard, unless their group alone exceeds a fair shard; such
a group is divided like any overfull range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, stored, tidy, unused

RANGES_A_SHARD, SAMPLES_A_RANGE, ROWS_A_RANGE = 64, 32, 1_000_000
#: A range beyond so many times its fair size is overfull.
OVERFULL = 2.0


def _splitters(records: DataFrame, ranges: int, total: int) -> list[int]:
    """Ascending hashes that cut the records into ranges of about equal bytes.

    The sample has about ``ranges`` * SAMPLES_A_RANGE keys, however many records there are. A record larger than a step of
    the sample counts as often as it has steps.
    """
    step = max(1.0, total / (ranges * SAMPLES_A_RANGE))
    chance = F.pmod(F.xxhash64("key", "row"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = records.select("key", F.floor(F.col("size") / step + chance).alias("times")).where("times >= 1").toArrow()
    keys = np.repeat(sample.column("key").to_numpy(), sample.column("times").to_numpy())
    keys.sort()
    return [] if not len(keys) else sorted({int(keys[len(keys) * i // ranges]) for i in range(1, ranges)})


def _ranged(records: DataFrame, cuts: list[int]) -> DataFrame:
    """With ``range``: the even number 2i for keys between two cuts, 2i + 1 for a key that equals a cut."""
    edges = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            left = np.searchsorted(edges, key, "left")
            same = left < np.searchsorted(edges, key, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(2 * left + same, pa.int64())], names=[*batch.schema.names, "range"])

    first = records.select("key", *[c for c in records.columns if c != "key"])
    return first.mapInArrow(run, T.StructType([*first.schema.fields, T.StructField("range", T.LongType())]))


def plan(units: list[tuple[int, int, int, int]], shards: int, total: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Of ranges (range, bytes, rows, bytes of its largest text group): the parts that overfull ones are cut into, and the shard
    of each part.

    A range whose largest group is no more than a fair shard stays on one shard, though cut; else its parts are dealt singly.
    """
    fair = max(1.0, total / (shards * RANGES_A_SHARD))
    parts = {r: max(1, round(size / fair) if size > OVERFULL * fair else 1, -(-rows // ROWS_A_RANGE)) for r, size, rows, _ in units}
    loads = [(0.0, s) for s in range(shards)]
    deals = []
    for r, size, _, largest in units:
        if largest <= total / shards:
            deals.append((size, r, None))
        else:
            deals += [(size / parts[r], r, p) for p in range(parts[r])]
    homes: dict[int, list[int]] = {r: [0] * n for r, n in parts.items()}
    for size, r, p in sorted(deals, key=lambda d: (-d[0], d[1], d[2] or 0)):
        load, s = heapq.heappop(loads)
        if p is None:
            homes[r] = [s] * parts[r]
        else:
            homes[r][p] = s
        heapq.heappush(loads, (load + size, s))
    return parts, homes


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Numbered rows of the columns that decide where a row goes, stored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    size = (F.octet_length(text) + 1).cast("long")
    return stored(docs.select(F.xxhash64(text).alias("key"), row.alias("row"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "records")


def _assigned(records: DataFrame, shards: int) -> DataFrame:
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = records.sparkSession
    rows, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_A_SHARD, -(-rows // ROWS_A_RANGE))
    placed = stored(_ranged(records, _splitters(records, ranges, total)), "ranged")
    # a heavy key is a cut itself, so it has a range of its own and is that range's largest group
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toArrow().to_pylist()
    parts, homes = plan([(r["range"], r["bytes"], r["rows"], r["bytes"] if r["range"] % 2 else 0) for r in sums], shards, total)
    cut = spark.createDataFrame([(r, n) for r, n in parts.items()] or [(-1, 1)], "range long, parts int")
    placed = placed.join(broadcast_if_small(cut), "range")
    # parts follow the texts' hashes inside a range; rows of one text are dealt by their numbers, which repeated rows don't share
    within = F.when(F.col("range") % 2 == 1, F.xxhash64("row")).otherwise(F.xxhash64("key"))
    placed = placed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(within, F.col("parts").cast("long"))).otherwise(0).cast("int"))
    counts = placed.groupBy("range", "part").agg(F.count(F.lit(1)).alias("rows")).toArrow().to_pylist()
    first: dict[int, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: (r["range"], r["part"])):
        s = homes[r["range"]][r["part"]]
        starts.append((r["range"], r["part"], s, first.get(s, 0)))
        first[s] = first.get(s, 0) + r["rows"]
    start = spark.createDataFrame(starts or [(-1, 0, 0, 0)], "range long, part int, shard int, first long")
    order = Window.partitionBy("range", "part").orderBy("key", "id", "row")
    slotted = placed.withColumn("nth", F.row_number().over(order)).join(broadcast_if_small(start), ["range", "part"])
    return slotted.select("row", "id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))


@tidy
def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    Size is the UTF-8 bytes of the text and 1; a null text counts as empty but is no copy of the empty text's size: both
    are 1. Slots count from 0 in each shard, without gaps, along the parts of ranges and in these along the order of texts'
    hashes, then of ids; rows that agree in both, like repeated rows and null ids, follow each other in any order. Ranges
    are ranges of the texts' hashes, so they have no meaning of their own. No rows give none.
    """
    return _assigned(_records(docs.select(id_col, text_col), id_col, text_col), shards).drop("row")


@tidy
def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of ``docs`` under ``path``, a folder a shard, with their slots. Ids may be null or repeated, and rows too: they
    are numbered first. A column called shard or slot is replaced."""
    row, number = unused(docs, "row", "number")
    numbered = stored(docs.drop("shard", "slot").withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = _assigned(_records(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"), shards)
    placed = placed.select(F.col("row").alias(number), "shard", "slot")
    whole = numbered.join(placed, F.col(row) == F.col(number)).drop(row, number)
    whole.repartition("shard", F.pmod("slot", F.lit(64))).sortWithinPartitions("slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
