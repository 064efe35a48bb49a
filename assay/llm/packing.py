"""Best-fit packing of documents into bins of fixed size, under conflicts.

A bin holds at most one piece of each source and at most one of each cluster of duplicates. Pieces are placed from the
longest. Bins are kept in the order of their residual space; each carries a bitmap of its sources and one of its clusters.
The search starts at the smallest residual that fits and goes on to the successors until a bin has neither of the piece's
bits: that is the tightest compatible bin. If none is left, a bin is opened. So the search has no limit, and a hot source
or a large group of copies only means more bins.

Pieces are dealt evenly to groups of about GROUP and packed there; a group's size doesn't grow with the input.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

CAPACITY = 2_048
GROUP = 2_048


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece and its offset there, in the order given. None as a source or cluster conflicts with nothing."""

    def bits(values) -> list[int]:
        """A bit for each value that occurs more than once; others can't conflict."""
        often = [v for v, n in Counter(v for v in values if v is not None).items() if n > 1]
        at = {v: 1 << i for i, v in enumerate(often)}
        return [at.get(v, 0) for v in values]

    source_bits, cluster_bits = bits(sources), bits(clusters)
    residual: list[int] = []
    held_clusters: list[int] = []
    present = 0  # bit r: some bin has residual r
    level: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> bitmap of sources -> bins
    total: Counter = Counter()
    having: dict[int, Counter] = defaultdict(Counter)  # residual -> source bit -> bins that hold it

    def members(mask: int):
        while mask:
            low = mask & -mask
            yield low
            mask ^= low

    def put(k: int, mask: int, sign: int) -> None:
        nonlocal present
        r = residual[k]
        if sign > 0:
            level[r].setdefault(mask, []).append(k)
        else:
            level[r][mask].remove(k)
            if not level[r][mask]:
                del level[r][mask]
        total[r] += sign
        for b in members(mask):
            having[r][b] += sign
        present = present | 1 << r if total[r] else present & ~(1 << r)

    bins, offsets = [], []
    for n, s, c in zip(lengths, source_bits, cluster_bits, strict=True):
        r, found, mask = n, None, 0
        while found is None and (rest := present >> r):
            r += (rest & -rest).bit_length() - 1
            if total[r] > (having[r][s] if s else 0):
                for mask, some in level[r].items():
                    if not mask & s:
                        found = next((k for k in some if not held_clusters[k] & c), None)
                        if found is not None:
                            break
            r += 1
        if found is None:
            found, mask = len(residual), 0
            residual.append(capacity)
            held_clusters.append(0)
        else:
            put(found, mask, -1)
        bins.append(found)
        offsets.append(capacity - residual[found])
        residual[found] -= n
        held_clusters[found] |= c
        if residual[found]:
            put(found, mask | s, 1)
    return bins, offsets


def word_count(text: Column) -> Column:
    """Words as runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


@tidy
def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces (id, piece, start, n, bin, offset) of items (id, source, cluster, length), ``cluster`` a long.

    An item longer than a bin is cut into full pieces and a rest. An item of length 0 or null has one piece with a null bin.
    A null source or cluster conflicts with nothing; null ids and repeated rows are packed like others (of repeated rows,
    which share source and cluster, each goes to another bin). No items give no pieces; other columns are not looked at.
    """
    if capacity < 1 or group < 1:
        raise ValueError("capacity and group must be positive")
    sized = items.select("id", "source", "cluster", F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"))
    last = F.greatest(F.ceil(F.col("length") / capacity) - 1, F.lit(0)).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("n", F.least(F.col("length") - F.col("start"), F.lit(capacity)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    pieces = stored(pieces.drop("length"), "pieces")  # the row numbers hold from here
    groups = max(1, -(-pieces.where("n > 0").count() // group))
    dealt = pieces.where("n > 0").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).select("row", "n", "source", "cluster", "part")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "row"], ascending=[False, True])
        none = lambda values: [None if pd.isna(v) else v for v in values]
        bins, offsets = best_fit(rows["n"].tolist(), none(rows["source"]), none(rows["cluster"].tolist()), capacity)
        part = np.int64(rows["part"].iloc[0]) << 32
        return pd.DataFrame({"row": rows["row"], "bin": part + np.array(bins, np.int64), "offset": np.array(offsets, np.int32)})

    # as text, clusters keep all 64 bits where some are null
    dealt = dealt.withColumn("cluster", F.col("cluster").cast("string")).withColumn("source", F.col("source").cast("string"))
    packed = dealt.groupBy("part").applyInPandas(run, "row long, bin long, offset int")
    return pieces.join(packed, "row", "left").select("id", "piece", "start", "n", "bin", "offset")


def document_items(docs: DataFrame) -> DataFrame:
    """Documents as items: their words, their source, and equal texts as a cluster."""
    return docs.select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("cluster"), word_count(F.col("text")).alias("length"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words, without two pieces of a source or of equal texts in a bin."""
    packed = pack(document_items(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("bin").alias("bin_id"), F.col("offset").alias("bin_offset"))
