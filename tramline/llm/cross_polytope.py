"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Equal vectors of a label are one class. A class is hashed in several tables: pseudo-random rotations (three rounds of
random signs and a fast Walsh-Hadamard transform), of which the largest coordinate and its sign are the hash; a table joins
``width`` of them. A class posts to its own bucket and to those with the smallest loss where one hash is replaced by the
runner-up. Two classes meet in a bucket that is one's own. All pairs that meet are verified by their cosine.

A pair that meets more than once counts where it meets first, which both sides' bucket lists tell. Buckets over ``BLOCK``
members are split into blocks, and each pair of blocks is a group of its own, so no task holds more than two blocks. What
leaves a group are sums by class and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, tidy
from .components import connected_components
from .runs import forest, runs, survivors, whole_runs

BLOCK = 1024
PROBES = 3
SMALL = 24  # buckets up to here are paired by shifting the sorted rows
SEED = 20_240_229
COLUMNS = 1024  # vectors that are hashed at a time


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns; their length is a power of two."""
    d, n = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(d // (2 * h), 2, h, n)
        y = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=y[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=y[:, 1])
        x = y.reshape(d, n)
        h *= 2
    return x


class Rotations:
    """``count`` pseudo-random rotations, the same on every worker."""

    def __init__(self, dim: int, count: int, seed: int = SEED):
        self.d = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(count, 3, self.d, 1))

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The rows of ``x`` as columns of the rotations' length."""
        y = np.zeros((self.d, len(x)), dtype=np.float32)
        y[: x.shape[1]] = x.T
        return y

    def __call__(self, y: np.ndarray, i: int) -> np.ndarray:
        for s in self.signs[i]:
            y = hadamard(y * s)
        return y


def _top_two(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column the hash (place and sign of the largest component), the runner-up's, and by how much that is less."""
    at = np.arange(y.shape[1])
    a = np.abs(y)
    one = a.argmax(axis=0)
    most = a[one, at]
    a[one, at] = -1
    two = a.argmax(axis=0)
    return one * 2 + (y[one, at] < 0), two * 2 + (y[two, at] < 0), most - a[two, at]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets(x: np.ndarray, label: np.ndarray, rotations: Rotations, tables: int, width: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys: a row's own bucket first, then probes by loss."""
    n = len(x)
    if n > COLUMNS:
        return np.concatenate([buckets(x[i : i + COLUMNS], label[i : i + COLUMNS], rotations, tables, width, probes) for i in range(0, n, COLUMNS)])
    out = np.empty((n, tables, 1 + probes), dtype=np.uint64)
    columns = rotations.columns(x)
    base = _mix(label.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for t in range(tables):
            first, second, loss = zip(*(_top_two(rotations(columns, t * width + w)) for w in range(width)))
            first, second, loss = np.stack(first, 1), np.stack(second, 1), np.stack(loss, 1)
            # every choice of hashes to replace, by the sum of losses
            choices = [[bool(c >> w & 1) for w in range(width)] for c in range(1, 1 << width)][: 4 * probes + 4]
            costs = np.stack([sum((loss[:, w] for w in range(width) if c[w]), np.zeros(n)) for c in choices], 1)
            order = np.argsort(costs, axis=1, kind="stable")[:, :probes]

            def key(codes: np.ndarray) -> np.ndarray:
                k = _mix(base + np.uint64(t + 1) * np.uint64(0xD1B54A32D192ED03))
                for w in range(width):
                    k = _mix(k ^ (codes[:, w].astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))
                return k

            out[:, t, 0] = key(first)
            masks = np.array(choices)
            for p in range(probes):
                c = masks[order[:, min(p, order.shape[1] - 1)]]
                out[:, t, 1 + p] = key(np.where(c, second, first))
    return out


def _plan(n: int, dim: int) -> tuple[int, int]:
    """(tables, hashes a table): four buckets a class or more, so that those who meet are mostly near; more tables where a
    bucket takes more hashes."""
    d = 1 << max(1, (dim - 1).bit_length())
    width = max(2, math.ceil(math.log(max(2, 4 * n)) / math.log(2 * d)))
    return (4 * width if width < 4 else 1 << width + 1), width


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of a table's (1 + probes) buckets, the key where they meet (0: nowhere): one that is a side's own."""
    at_a, at_b = (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)
    both = np.minimum(a[:, 0], b[:, 0])
    return np.where(at_a & at_b, both, np.where(at_a, a[:, 0], np.where(at_b, b[:, 0], np.uint64(0))))


def meets_first(a: np.ndarray, b: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs of (tables, 1 + probes) bucket lists meet nowhere before this bucket of this table. Most pairs are near and
    meet in the first tables, so the others are looked at for few."""
    left = np.arange(len(a))
    for t in range(int(table.max(initial=0)) + 1):
        later, here = left[table[left] > t], left[table[left] == t]
        later = later[_meeting(a[later, t], b[later, t]) == 0]
        here = here[_meeting(a[here, t], b[here, t]) == key[here]]
        left = np.concatenate([left[table[left] < t], here, later])
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _verify(batches: Iterator[pa.RecordBatch], cut: float, tables: int, probes: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Sorted (group, key, side, pair, cid, label, copies, keys, vec) -> (kind, a, b): 0 links b of class a, 1 an edge."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])

    for t in whole_runs(batches):
        group = t.column(0).to_numpy()
        key = t.column(1).to_numpy().view(np.uint64)
        side, across = t.column(2).to_numpy(), t.column(3).to_numpy(zero_copy_only=False)
        cid, label, copies = (t.column(i).to_numpy() for i in (4, 5, 6))
        lists = np.frombuffer(b"".join(t.column(7).to_pylist()), dtype=np.uint64).reshape(len(group), tables, 1 + probes)
        table = (lists.reshape(len(group), -1) == key[:, None]).argmax(axis=1) // (1 + probes)
        x = np.frombuffer(b"".join(t.column(8).to_pylist()), dtype=dtype).reshape(len(group), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        links = np.zeros(len(group), dtype=np.int64)
        lefts, rights = [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            ok = (label[i] == label[j]) & (key[i] == key[j])
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                ok = meets_first(lists[a], lists[b], table[a], key[a])
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                lefts.append(a)
                rights.append(b)

        starts, sizes = runs(group)
        size_of = np.repeat(sizes, sizes)
        rows = np.nonzero((size_of > 1) & (size_of <= SMALL))[0]
        for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            i, j = rows[:-d], rows[d:]
            same = group[i] == group[j]
            i, j = i[same], j[same]
            ok = ~across[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= cut
            take(i[ok], j[ok])
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own = np.arange(s, s + n)
            for p in range(0, n, BLOCK):
                i = own[p : p + BLOCK]
                for q in range(p, n, BLOCK):
                    j = own[q : q + BLOCK]
                    r, c = np.nonzero(x[i] @ x[j].T >= cut)
                    r, c = i[r], j[c]
                    ok = (r < c) & (~across[r] | (side[r] != side[c]))
                    take(r[ok], c[ok])
        if lefts:
            hit = links > 0
            yield out(0, cid[hit], links[hit])
            left, right = np.concatenate(lefts), np.concatenate(rights)
            root = forest(len(group), left, right)
            apart = root != np.arange(len(group))
            yield out(1, cid[apart], cid[root[apart]])


def _digested(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, label, digest, vec): ``vec`` the components as bytes, null where a vector links with nothing; numpy's type of them."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype) + 0  # no negative zeros
            before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
            bad, some = (before(f)[ends] for f in (~np.isfinite(x) | ~flat.is_valid().to_numpy(zero_copy_only=False), x != 0))
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0) & (np.diff(some) > 0)
            raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)])
            vec = pc.if_else(pa.array(ok), raw, None).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], names=["vec_id", "label", "vec"])

    bound_batches(vectors.sparkSession)
    cast = "array<float>" if dtype == "<f4" else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(cast).alias("embedding"))
    rows = own.mapInArrow(tidy(run), "vec_id long, label long, vec binary")
    vec = F.when(F.col("vec_id").isNotNull(), F.col("vec"))
    return rows.select("vec_id", "label", F.unhex(F.md5(vec)).alias("digest"), vec.alias("vec")), dtype


def near_duplicates(vectors: DataFrame, cut: float = 0.93, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors`` (vec_id, label, embedding).

    Only vectors of equal, non-null labels link. Vectors that are null, empty or zero, hold a null or non-finite component
    or have a null id or another length link with nothing: no links, their own component, kept. Rows with equal vectors
    link with each other. Repeated ids stay rows of their own, and count as links of each other. Other columns aren't read.
    """
    spark = vectors.sparkSession
    all_rows, dtype = _digested(vectors)
    rows = materialize(all_rows, "vectors")
    linkable = rows.where("digest is not null")
    classes = linkable.groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = [r[0] for r in classes.groupBy(F.octet_length("vec").alias("n")).count().orderBy("n").select("n").collect()]  # one row a length
    found = None
    for size in dims:
        own = classes.where(F.octet_length("vec") == size)
        part = _links(own, size // np.dtype(dtype).itemsize, dtype, cut, probes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "kind int, a long, b long")
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("kind = 1").select("a", "b"))
    known = classes.select("cid", "label", "digest", "least", "copies").join(links, "cid", "left").join(roots, F.col("cid") == roots["node"], "left")
    known = known.withColumn("root", F.coalesce("root", "cid"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialize(
        known.join(least, "root").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "by_class"
    )
    joined = rows.where("digest is not null").drop("vec").join(by_class, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, dtype: str, cut: float, probes: int) -> DataFrame:
    """(kind, a, b) of the classes of one length, materialized."""
    spark = classes.sparkSession
    tables, width = _plan(classes.count(), dim)
    rotations = Rotations(dim, tables * width)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=dtype).reshape(b.num_rows, dim).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            keys = buckets(x, b.column(1).to_numpy(), rotations, tables, width, probes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["cid", "label", "copies", "vec", "keys"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int64).reshape(b.num_rows, tables * (1 + probes))
            cid = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            own = np.tile(np.arange(keys.shape[1]) % (1 + probes) == 0, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid), pa.array(own)], names=["key", "cid", "own"])

    bound_batches(spark)
    hashed = classes.select("cid", "label", "copies", "vec").mapInArrow(tidy(hash_rows), "cid long, label long, copies long, vec binary, keys binary")
    hashed = materialize(hashed, "hashed")
    posts = hashed.select("cid", "keys").mapInArrow(tidy(post), "key long, cid long, own boolean")
    met = materialize(posts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(survivors), "key long, cid long, n long"), "met")
    full = met.join(hashed, "cid")  # buckets of one never meet a vector
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = full.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", other)
    low, high = F.least("side", "other"), F.greatest("side", "other")
    grouped = split.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("group"), "key", "side", (low != high).alias("across"), "cid", "label", "copies", "keys", "vec"
    )
    verified = grouped.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(lambda it: _verify(it, cut, tables, probes, dtype)), "kind int, a long, b long")
    return materialize(verified, "links")
