"""URL lists: a blocked Bloom filter passes possible hits, an exact hash join removes those that only look like hits.

A rule is a host and a start of a path. It fits its host and all subdomains, where the path starts with its own. The filter
holds the hosts of rules, and their hosts with paths. A url's domains are tested, as far as some rule's host has as many
labels; under those that pass each length of path that some rule has is tested, and only what passes again is shuffled and
joined with the list. So a long host costs no more than its length for each label of a rule. The filter is made of blocks of 512 bits: a key
sets and tests bits of one block only, so a test touches one cache line. Its size follows the counted rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, stored, tidy

BITS_A_KEY, PROBES, WORDS = 16, 8, 8
#: The largest filter that is made, in blocks of 64 bytes; a list for which it is too small still gives right results, as
#: the join decides, but more keys pass.
MOST_BLOCKS = 1 << 20
#: Characters of keys that are tested at a time.
TESTED = 1 << 22


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the first ``/`` after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bits(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and the 512-bit word with its bits."""
    h = np.array([xxhash.xxh3_128_intdigest(k) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
    g = np.array([xxhash.xxh64_intdigest(k, 7) for k in keys], np.uint64)
    mask = np.zeros((len(keys), WORDS), np.uint64)
    rows = np.arange(len(keys))
    for i in range(PROBES):
        bit = (g >> np.uint64(7 * i)) & np.uint64(0x7F) | (h >> np.uint64(62 - 2 * i) & np.uint64(3)) << np.uint64(7)
        mask[rows, (bit >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit & np.uint64(63))
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mask


class BlockedBloom:
    """The filter; ``blocks`` rows of 512 bits."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, keys: DataFrame) -> BlockedBloom:
        """Built from a DataFrame with a column ``key``: executors set bits, one row a used block reaches the driver."""
        n = keys.count()
        blocks = min(MOST_BLOCKS, max(1, -(-n * BITS_A_KEY // 512)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, mask = _bits([k.encode() for k in batch.column(0).to_pylist()], blocks)
                words = [pa.array(mask[:, i].view(np.int64)) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *words], names=["block", *[f"w{i}" for i in range(WORDS)]])

        kind = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
        set_bits = keys.select("key").mapInArrow(run, kind).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        table = np.zeros((blocks, WORDS), np.uint64)
        found = set_bits.toArrow()  # at most MOST_BLOCKS rows, as columns
        at = found.column("block").to_numpy()
        for i in range(WORDS):
            table[at, i] = found.column(f"w{i}").to_numpy().view(np.uint64)
        return cls(table)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        """True for every key of the list, and for a few others."""
        if not keys:
            return np.zeros(0, bool)
        at, mask = _bits(keys, len(self.table))
        return ((self.table[at] & mask) == mask).all(axis=1)


def domains(host: str, labels: int) -> list[str]:
    """The host and the domains above it, those of at most so many labels, shortest first."""
    parts = host.rsplit(".", labels)
    most = min(labels, len(parts))
    return [".".join(parts[len(parts) - k :]) for k in range(1, most + 1)]


def possible_keys(hosts: list[str], paths: list[str], holds: Callable[[list[bytes]], np.ndarray], lengths: list[int], labels: int) -> Iterator[tuple[int, str]]:
    """(url, key) of the keys, a host and the start of a path, that the filter may hold."""
    asked = [(i, d) for i, host in enumerate(hosts) for d in domains(host, labels) if d]

    def passed(some: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
        return (some[k] for k in np.flatnonzero(holds([key.encode() for _, key in some])))

    held, chars = [], 0
    for i, d in passed(asked):
        for n in lengths:
            if n <= len(paths[i]):
                held.append((i, f"{d} {paths[i][:n]}"))
                chars += len(d) + n
                if chars > TESTED:
                    yield from passed(held)
                    held, chars = [], 0
    yield from passed(held)


@tidy
def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` and ``url_host``, ``url_path``, ``url_rule``, ``url_verdict``, by ``rules`` (host, path, verdict).

    The longest rule that fits wins, of equally long ones the one whose verdict is block. Without one the verdict is
    ``default`` and the rule null. A url that is null or has no ``://`` has an empty host and path, which only a rule with
    an empty host could fit; such rules, and ones with nulls, are left out. Every row of ``pages`` stays, repeated ones too.
    """
    parts = {"url_host": host_of(F.col(url_col)), "url_path": path_of(F.col(url_col))}
    given = pages.drop("url_host", "url_path", "url_rule", "url_verdict").withColumns(parts)
    listed = rules.where("host <> '' and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    # a space can't be in a host's key twice over: it parts the host from the path
    listed = listed.groupBy(F.concat_ws(" ", "host", "path").alias("key"), "host", "path").agg(F.max("verdict").alias("verdict"))
    listed = stored(listed, "rules")
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # one number a length
    labels = listed.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    # a key of a host alone has no space, one with a path has
    bloom = given.sparkSession.sparkContext.broadcast(BlockedBloom.of(listed.select("key").unionByName(listed.select(F.col("host").alias("key")).distinct())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = bloom.value.holds
        for batch in batches:
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = list(possible_keys(hosts, paths, holds, lengths, labels))
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for _, k in found], pa.string())], names=["url_host", "url_path", "key"])

    urls = given.select("url_host", "url_path").where("url_host <> ''").distinct()
    possible = urls.mapInArrow(run, "url_host string, url_path string, key string")
    right = broadcast_if_small(listed)
    fit = possible.join(right, "key").groupBy("url_host", "url_path")
    best = fit.agg(F.max(F.struct((F.length("host") + F.length("path")).alias("n"), (F.col("verdict") == "block").alias("no"), F.concat("host", "path").alias("rule"), "verdict")).alias("best"))
    best = stored(best.select("url_host", "url_path", F.col("best.rule").alias("url_rule"), F.col("best.verdict").alias("url_verdict")), "verdicts")
    return given.join(best, ["url_host", "url_path"], "left").withColumn("url_verdict", F.coalesce("url_verdict", F.lit(default)))


#: The rules of the query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@tidy
def op9_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return got.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP9_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
       (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(verdict, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM u
"""
