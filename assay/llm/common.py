"""What several operators share: scratch tables, word splitting, size-checked broadcasts and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The most that any operator broadcasts, in bytes of rows, and the most rows.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 400_000
#: While an operator writes a table: the files of its shuffles are deleted when it is written, and batches that go to Python
#: are small, as a worker holds several copies of one.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_own_scratch: str | None = None
#: Folders of the tables that are there, for each operator that runs inside another, outermost first.
_tables: list[list[str]] = [[]]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one on a single
    machine, and an error on a cluster, whose machines wouldn't see each other's."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="assay-")
        atexit.register(shutil.rmtree, _own_scratch, ignore_errors=True)
    return "file://" + _own_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name, which is deleted like those of ``stored``."""
    path = f"{scratch_dir(spark)}/assay-{name}-{uuid.uuid4().hex}"
    _tables[-1].append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The values hold inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def writing(spark: SparkSession):
    """WRITING holds inside."""
    return settings(spark, WRITING)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.
    The files of the shuffles that led to it are deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with writing(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    """Names of the folders that a DataFrame reads, without what stands before them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation" and leaves.apply(i).relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaves.apply(i).relation().location().rootPaths()
            for k in range(roots.size()):
                at = roots.apply(k)
                found |= {at.getName(), at.getParent().getName() if at.getParent() else ""}
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        names = _folders(df)
        for made in _tables:
            for folder in [f for f in made if f.rsplit("/", 1)[1] in names]:
                _deleted(df.sparkSession, folder)
                made.remove(folder)


def only(spark: SparkSession, *needed: DataFrame) -> None:
    """Delete all tables of the running operator but those that the DataFrames read."""
    names = set().union(*map(_folders, needed))
    for folder in [f for f in _tables[-1] if f.rsplit("/", 1)[1] not in names]:
        _deleted(spark, folder)
        _tables[-1].remove(folder)


def release(spark: SparkSession) -> None:
    """Delete the tables behind the results of operators that have returned, once these results are written or read."""
    only(spark)


@atexit.register
def _at_exit() -> None:
    """What is left goes with the session, where that is still there."""
    spark = SparkSession._instantiatedSession
    if any(_tables) and spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def tidy(operator: Callable) -> Callable:
    """An operator whose tables are deleted when it returns, but for those that its resulting DataFrames read. These belong
    to the operator that called it, or else stay until ``release``."""

    @wraps(operator)
    def run(*args, **kwargs):
        _tables.append([])
        results = ()
        try:
            out = operator(*args, **kwargs)
            results = [df for df in (out if isinstance(out, tuple) else (out,)) if isinstance(df, DataFrame)]
            return out
        finally:
            if _tables[-1]:
                only(SparkSession.getActiveSession() or SparkSession._instantiatedSession, *results)
            left = _tables.pop()
            _tables[-1].extend(left)

    return run


def _bytes(field: T.StructField) -> Column:
    """About how many bytes a value takes in memory."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint only when the counted rows and their bytes prove the size; otherwise Spark's own shuffle join does the
    work. The DataFrame is computed twice, so it should be a table."""
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge, component being the smallest node reachable.

    ``edges`` has two columns of one orderable type. Alternates large-star and small-star steps, which need a number of
    rounds logarithmic in the nodes; each round is stored. Minima are aggregated before the shuffle and the join back is
    a plain shuffle join, whose hot keys adaptive execution splits, so a node with very many links is no bottleneck.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "edges")
    before = _print_of(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(pairs)
        pairs, now = after, _print_of(after)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _print_of(pairs: DataFrame) -> tuple:
    """A count and two order-free sums of hashes: equal when the rows are equal."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
