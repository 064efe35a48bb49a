"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by fast Hadamard transforms with random signs; a hash is the axis closest to the rotated vector, with
its sign. A table joins several hashes; their number follows the number of vectors. Vectors meet in the bucket of one and
a probe of the other, where the probes change the hash that was decided by the least margin.

So that large groups don't become all their pairs, equal vectors are one weighted vector, and vectors are put into classes:
all members lie within half the linking angle of a centre, hence within the linking angle of each other. Classes that came
about apart are joined where the centres' angle and a radius stay within half the linking angle. Pairs of classes that meet
are decided by their centres and radii, where these prove all or no links, and are then one row with no members; only
the members of other pairs are compared, by blocks, and counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, dropped, stored, tidy
from .wordhash import mixed

SIMILARITY = 0.95
#: Tables, probes, vectors of a class that are compared at a time, and vectors that are put into classes together.
TABLES, PROBES, BLOCK, GROUP = 12, 4, 256, 256
#: Bits of 128 random signs that vectors at the linking angle differ in, and a wide margin over it: no filter of links.
SIGNS_APART = 48


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, by row, and which rows have one: not those that are null, empty or zero, or that hold
    null or non-finite components. All have the length of the longest (shorter ones end in zeros)."""
    rows = []
    for v in vectors:
        ok = v is not None and len(v) > 0 and all(x is not None for x in v)
        rows.append(np.array(v, float) if ok else np.zeros(0))
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    good = np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        top = np.abs(r).max() if len(r) else 0.0
        if np.isfinite(top) and top > 0:
            out[i, : len(r)] = r / top / np.linalg.norm(r / top)
            good[i] = True
    return out, good


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of 2."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = _hadamard(x * s)
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    d = 1 << max(1, ceil(log2(max(2, x.shape[1]))))
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def buckets(x: np.ndarray, table: int, bits: int, probes: int) -> np.ndarray:
    """(rows, 1 + probes): the bucket of each row in a table of 2 ** bits buckets, then the probes from the likeliest."""
    x = _padded(x)
    full = int(log2(x.shape[1])) + 1
    code = np.zeros(len(x), np.int64)
    moves, costs = [], []
    for k in range(ceil(bits / full)):
        b = min(full, bits - k * full)
        y = _rotated(x, 1_000 * table + k)[:, : 1 << (b - 1)]
        both = np.concatenate([y, -y], axis=1)  # the axes, then the axes turned round
        best = np.argsort(-both, axis=1, kind="stable")[:, :3]
        at = np.take_along_axis(both, best, axis=1)
        code = (code << b) + best[:, 0]
        for j in range(1, best.shape[1]):
            moves.append((k, best[:, j] - best[:, 0], b))
            costs.append((at[:, 0] - at[:, j]) ** 2)
    later = {k: sum(min(full, bits - j * full) for j in range(k + 1, ceil(bits / full))) for k in range(ceil(bits / full))}
    steps = np.stack([delta << later[k] for k, delta, _ in moves], axis=1)
    order = np.argsort(np.stack(costs, axis=1), axis=1, kind="stable")[:, :probes]
    return np.concatenate([code[:, None], code[:, None] + np.take_along_axis(steps, order, axis=1)], axis=1)


def _signs(x: np.ndarray) -> np.ndarray:
    """(rows, 2): 128 signs of projections."""
    plane = np.random.default_rng(99).standard_normal((x.shape[1], 128))
    return np.packbits(x @ plane > 0, axis=1).view(np.int64)


def _angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centre, -1.0, 1.0))


def classes_of(x: np.ndarray, half: float, most: int) -> list[np.ndarray]:
    """Rows in classes, each with its centre first: the others' cosine with it is at least ``half``."""
    left, out = np.arange(len(x)), []
    while len(left):
        near = x[left] @ x[left[0]] >= half
        near[0] = True
        own = left[near][:most]
        out.append(own)
        left = np.setdiff1d(left, own, assume_unique=True)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns of rows that agree in the first ``keys`` columns, where such rows are next to each other."""
    held: list[list] = []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if held and tuple(c[0] for c in held[:keys]) != row[:keys]:
                yield held
                held = []
            if not held:
                held = [[] for _ in row]
            for c, v in zip(held, row, strict=True):
                c.append(v)
    if held:
        yield held


def _rows(columns: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch of rows given as tuples."""
    turned = list(zip(*columns, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(turned, kinds.values(), strict=True)], names=list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{n} {names[t]}" for n, t in kinds.items())


def _units(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rid, unit vectors) of the rows that have a direction, by length."""
    given = batch.column(1).to_pylist()
    rid = np.array(batch.column(0).to_pylist(), np.int64)
    lengths = np.array([0 if v is None else len(v) for v in given])
    for size in set(lengths.tolist()) - {0}:
        own = np.flatnonzero(lengths == size)
        x, good = unit([given[i] for i in own])
        if good.any():
            yield size, rid[own[good]], x[good] + 0.0


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows (size, code, ...) next to each other by bucket, crowded buckets dealt to several by the hash of ``key``."""
    crowd = df.groupBy("size", "code").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("salts")).where("salts > 1")
    dealt = df.join(broadcast_if_small(stored(crowd, "crowd")), ["size", "code"], "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(key), "salts"), F.lit(0).cast("long"))).drop("salts")
    return dealt.repartition("size", "code", "salt").sortWithinPartitions("size", "code", "salt", key)


_BLOCK = {"class": pa.int64(), "size": pa.int32(), "code": pa.int64(), "rids": pa.binary(), "weights": pa.binary(), "xs": pa.binary(), "members": pa.int64(), "weight": pa.int64(), "radius": pa.float64(), "centre": pa.binary(), "s0": pa.int64(), "s1": pa.int64()}


def _classes(distinct: DataFrame, angle: float) -> tuple[DataFrame, DataFrame]:
    """Of weighted vectors (rid, size, code, x, weight): blocks (class, size, rids, weights, xs) of members, and classes
    (class, size, members, weight, radius, centre, s0, s1), both stored. A class is called after its centre."""
    half = cos(angle / 2) + 2e-5

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for size, code, _, rids, xs, weights in _groups(batches, 3):
            x, rid, w = np.stack([np.frombuffer(b, float) for b in xs]), np.array(rids, np.int64), np.array(weights, np.int64)
            for own in classes_of(x, half, len(x)):
                name, radius = int(rid[own[0]]), float(_angles(x[own[1:]], x[own[0]]).max(initial=0.0))
                s0, s1 = _signs(x[own[:1]])[0].tolist()
                for at in range(0, len(own), BLOCK):
                    some = own[at : at + BLOCK]
                    told = (len(own), int(w[own].sum()), radius, x[own[0]].tobytes(), s0, s1) if not at else (None,) * 6
                    out.append((name, size[0], code[0], rid[some].tobytes(), w[some].tobytes(), x[some].tobytes(), *told))
            if len(out) >= 1000:
                yield _rows(out, _BLOCK)
                out = []
        yield _rows(out, _BLOCK)

    dealt = _dealt(distinct.select("size", "code", "rid", "x", "weight"), "rid").select("size", "code", "salt", "rid", "x", "weight")
    blocks = stored(dealt.mapInArrow(grouped, _ddl(_BLOCK)), "blocks")
    columns = ["class", "size", "code", "members", "weight", "radius", "centre", "s0", "s1"]
    classes = blocks.where("centre is not null").select(columns)
    kinds = {k: _BLOCK[k] for k in columns} | {"was": pa.int64()}

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of one bucket joined, from the heaviest; a row each, with the class it has joined."""
        for size, code, _, names, members, weights, radii, centres, s0, s1 in _groups(batches, 3):
            x, r, out = np.stack([np.frombuffer(b, float) for b in centres]), np.array(radii), []
            left = np.array(sorted(range(len(names)), key=lambda i: (-weights[i], names[i])))
            while len(left):
                reach = _angles(x[left], x[left[0]]) + r[left]
                reach[0] = r[left[0]]
                near = reach <= angle / 2 - 2e-5
                near[0] = True
                c, own = left[0], left[near]
                told = (sum(members[i] for i in own), sum(weights[i] for i in own), float(reach[near].max()))
                out += [(names[c], size[0], code[0], *told, centres[c], s0[c], s1[c], names[i]) for i in own]
                left = left[~near]
            yield _rows(out, kinds)

    # buckets that were dealt to several groups have classes that could be one
    n, moved = None, None
    while True:
        crowded = stored(classes.groupBy("size", "code").agg(F.sum("members").alias("of"), F.count(F.lit(1)).alias("n")).where(f"of > {GROUP} and n > 1").select("size", "code", "n"), "crowded")
        now = crowded.agg(F.sum("n")).first()[0] or 0
        if not now or n is not None and now > 0.9 * n:
            break
        n = now
        few = broadcast_if_small(crowded.select("size", "code"))
        some = _dealt(classes.join(few, ["size", "code"], "left_semi"), "class").select("size", "code", "salt", *[c for c in columns if c not in ("size", "code")])
        done = stored(some.mapInArrow(merged, _ddl(kinds)), "merged")
        step = done.select("was", F.col("class").alias("into"))
        rest = classes.join(few, ["size", "code"], "left_anti")
        classes = stored(rest.unionByName(done.where("class = was").select(columns)), "classes")
        if moved is None:
            moved = step
        else:
            joined = moved.join(step.toDF("into", "after"), "into", "left").select("was", F.coalesce("after", "into").alias("into"))
            moved = joined
        moved = stored(moved, "moved")
    if moved is not None:
        blocks = blocks.join(moved, F.col("class") == F.col("was"), "left").withColumn("class", F.coalesce("into", "class"))
        blocks = stored(blocks.drop("was", "into"), "blocks")
    return blocks.select("class", "size", "rids", "weights", "xs"), classes.drop("code")


def _met(blocks: DataFrame, bits: int) -> DataFrame:
    """(one, two): classes, one below two, of which a member of one lies in a bucket that a member of the other probes."""
    kinds = {"bucket": pa.int64(), "class": pa.int64(), "home": pa.bool_()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), 512):
                    some = own[at : at + 512]
                    each = [np.frombuffer(xs[int(i)].as_py(), float).reshape(-1, size) for i in some]
                    x, of = np.concatenate(each), np.repeat(names[some], [len(e) for e in each])
                    for t in range(TABLES):
                        code = buckets(x, t, bits, PROBES)
                        k = code.shape[1]
                        bucket = mixed(code.astype(np.uint64) + np.uint64((size * TABLES + t) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64).ravel()
                        home = np.tile(np.arange(k) == 0, len(x))
                        # a class is once in a bucket, as its home if it is any member's
                        order = np.lexsort((~home, np.repeat(of, k), bucket))
                        b, c, h = bucket[order], np.repeat(of, k)[order], home[order]
                        new = np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
                        yield pa.RecordBatch.from_arrays([pa.array(b[new]), pa.array(c[new]), pa.array(h[new])], names=list(kinds))

    put = blocks.select("class", "size", "xs").mapInArrow(hashed, _ddl(kinds))
    put = stored(put.groupBy("bucket", "class").agg(F.bool_or("home").alias("home")), "buckets")
    one, two = put.where("home").select("bucket", F.col("class").alias("a")), put.select("bucket", F.col("class").alias("b"))
    met = one.join(two, "bucket").where("a <> b").select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two")).distinct()
    met = stored(met, "met")
    dropped(put)
    return met


@tidy
def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_links, component_id) of every row: the other rows found with a cosine of at least ``similarity`` in double precision.

    Rows without a direction (null, zero, with null or non-finite components) have no links and are their own component,
    as are vectors of other lengths to each other. Equal vectors link like any other, repeated rows too. The component is
    named by its smallest id that is not null. Other columns are not looked at; an empty table gives none.
    """
    angle = acos(similarity)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("rid", F.monotonically_increasing_id())
    rows = stored(rows, "vectors")  # rid holds from here
    n = rows.count()
    bits = max(2, ceil(log2(max(n, 2))))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rid, x in _units(batch):
                code = buckets(x, 0, bits, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.full(len(rid), size, np.int32)), pa.array(code), pa.array([v.tobytes() for v in x], pa.binary())], names=["rid", "size", "code", "x"])

    coded = rows.select("rid", "v").mapInArrow(coarse, "rid long, size int, code long, x binary")
    coded = stored(coded.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64("x", F.lit(1))}), "units")
    # equal vectors: one of them, with their number
    same = stored(coded.groupBy("size", "k1", "k2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight")), "same")
    distinct = coded.join(same.select(F.col("rep").alias("rid"), "weight"), "rid").select("rid", "size", "code", "x", "weight")
    blocks, classes = _classes(distinct, angle)

    met = _met(blocks, bits)
    # vectors that are their class alone: by their signs first
    signs = classes.select("class", "members", "s0", "s1")
    known = met.join(signs.toDF("one", "m1", "a0", "a1"), "one").join(signs.toDF("two", "m2", "b0", "b1"), "two")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = known.where((F.col("m1") > 1) | (F.col("m2") > 1) | (apart <= SIGNS_APART)).select("one", "two")
    told = classes.select("class", "weight", "radius", "centre")
    both = pairs.join(told.toDF("one", "w1", "r1", "c1"), "one").join(told.toDF("two", "w2", "r2", "c2"), "two").select("one", "two", "w1", "w2", "r1", "r2", "c1", "c2")
    decided_kinds = {"one": pa.int64(), "two": pa.int64(), "w1": pa.int64(), "w2": pa.int64(), "all": pa.bool_()}

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that are linked member by member, and those that may be linked in part; not those that are apart."""
        for batch in batches:
            r = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            a, b = (np.frombuffer(b"".join(c.to_pylist()), float) for c in batch.columns[6:])
            lengths = np.array([len(c) // 8 for c in batch.column(6).to_pylist()], np.int64)
            between = np.arccos(np.clip(np.add.reduceat(a * b, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0), -1.0, 1.0))
            every = between + r < angle - 1e-6
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(every)], names=list(decided_kinds))
            yield out.filter(pa.array(between - r <= angle + 1e-6))

    found = stored(both.mapInArrow(decided, _ddl(decided_kinds)), "decided")
    dropped(met)
    partly = found.where("not all").select("one", "two")
    block = blocks.select("class", "size", "rids", "weights", "xs")
    parts = partly.join(block.toDF("one", "size", "i1", "w1", "x1"), "one").join(block.toDF("two", "size2", "i2", "w2", "x2"), "two").select("one", "two", "size", "i1", "w1", "x1", "i2", "w2", "x2")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By all cosines between two blocks: how many each member is linked with."""
        for batch in batches:
            for one, two, size, i1, w1, x1, i2, w2, x2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = np.frombuffer(x1, float).reshape(-1, size) @ np.frombuffer(x2, float).reshape(-1, size).T >= similarity
                counts = np.concatenate([near @ np.frombuffer(w2, np.int64), np.frombuffer(w1, np.int64) @ near])
                seen = np.flatnonzero(counts)
                rids = np.concatenate([np.frombuffer(i1, np.int64), np.frombuffer(i2, np.int64)])[seen]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), v)) for v in (one, two)] + [pa.array(rids), pa.array(counts[seen])], names=["one", "two", "rid", "n"])

    partial = stored(parts.mapInArrow(compared, "one long, two long, rid long, n long"), "compared")
    edges = found.where("all").select("one", "two").unionByName(partial.select("one", "two").distinct())
    named = components(edges)
    outside = found.where("all").select(F.col("one").alias("class"), F.col("w2").alias("n")).unionByName(found.where("all").select(F.col("two").alias("class"), F.col("w1").alias("n")))
    outside = outside.groupBy("class").agg(F.sum("n").alias("outside"))
    whole = classes.select("class", "weight").join(outside, "class", "left").join(named, F.col("class") == F.col("node"), "left")
    whole = whole.select("class", (F.col("weight") - 1 + F.coalesce("outside", F.lit(0))).alias("n"), F.coalesce("component", "class").alias("part"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()]
            of = np.repeat(batch.column(0).to_numpy(), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.int64)])), pa.array(of)], names=["rep", "class"])

    members = blocks.select("class", "rids").mapInArrow(listed, "rep long, class long").join(whole, "class")
    members = members.join(partial.groupBy(F.col("rid").alias("rep")).agg(F.sum("n").alias("more")), "rep", "left")
    members = members.select("rep", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"), "part")
    placed = coded.select("rid", "size", "k1", "k2").join(same.join(members, "rep").select("size", "k1", "k2", "n_links", "part"), ["size", "k1", "k2"]).select("rid", "n_links", "part")
    every = rows.select("id", "rid").join(placed, "rid", "left")
    every = stored(every.select("id", F.coalesce("part", -1 - F.col("rid")).alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")
    least = every.groupBy("part").agg(F.min("id").alias("component_id"))
    return every.join(least, "part").select("id", "n_links", "component_id")


@tidy
def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    got = links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return got.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
