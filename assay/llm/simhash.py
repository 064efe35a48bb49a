"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common point at most ``radius / 2`` bits from either. So every
distinct fingerprint emits all its variants within half the radius, the variants are shuffled, and fingerprints that meet
at one are linked. A variant has at most as many members as the ball has points (65 at radius 2), however large a group
of copies is, because equal fingerprints are one member. Every two members of a variant are within the radius of each
other, so each links to the smallest member of the variant only: the components stay the same, and no group's pairs are
listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stored, tidy

SEED = 42
#: Hashes whose bits are counted at a time.
CHUNK = 255 * 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a whole UTF-8 text; 0 for null and for no words.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by a space and count as often as
    they occur; a text of fewer words is one shingle. A bit is set if it is in over half of the XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(some[k:] for k in range(shingle)), strict=False)) if len(some) >= shingle else [b" ".join(some)]
        bits = np.unpackbits(np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def masks(bits: int) -> list[int]:
    """All 64-bit words with at most so many bits set, as signed numbers."""
    words = [sum(1 << i for i in some) for k in range(bits + 1) for some in combinations(range(64), k)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def linked_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all distinct values of the column ``fp`` within ``radius`` bits of each other.

    The radius is even, from 0 to 4 (2,081 variants of each fingerprint); an odd one would need other verification.
    """
    if radius not in (0, 2, 4):
        raise ValueError(f"radius must be 0, 2 or 4, not {radius}")
    ball = F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)]))
    # each value becomes many rows, so the values are dealt to as many tasks as there are
    values = fps.select("fp").distinct().repartition(fps.sparkSession.sparkContext.defaultParallelism * 4, "fp")
    met = values.select("fp", ball.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    first = met.withColumn("first", F.min("fp").over(Window.partitionBy("variant")))
    pairs = first.where("first <> fp").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fp and component_id, the smallest id of the texts reachable by links.

    Null and empty texts have fingerprint 0, linked like any other. Null ids get a row too and are never a component's
    id unless the component has no other. Repeated rows stay repeated. An empty table gives none; other columns are not
    looked at.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    parts = components(linked_fingerprints(fps, radius))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(parts, least.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = stored(named, "classes")
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(smallest, "part").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


@tidy
def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents: 3-word shingles, links at 2 or fewer differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
