"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions. Two fingerprints at three or fewer differing bits share at least
five positional bytes. The index posts each distinct fingerprint under the 14 position quadruples that are the words of
weight four of the extended Hamming code [8,4,4]: any five positions contain exactly one of them, so a pair with five
shared positional bytes always meets in a posting list. In a list the shared bytes of each pair are tallied, pairs under
the guaranteed minimum are dropped, and the rest is verified by their differing bits.

Bounds: lists over ``LIST_LIMIT`` members are posted again under five positions (each pair that counts shares one of the
four that were left out) and a quarter of the other bits (three differing bits leave at least one quarter equal). So a member
of a long list goes to sixteen shorter ones, of at most 2^18 distinct fingerprints, whose pairs share the guaranteed five bytes
by their key. Those still over ``LIST_LIMIT`` are verified in time linear in their size, by looking up each member's neighbours
at up to three flipped bits. Lists give a spanning forest, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, tidy
from .components import connected_components
from .runs import forest, runs, whole_runs

SEED = 42
LIST_LIMIT = 2048
MATRIX = 64  # lists up to here are paired by shifting the sorted rows
MIN_SHARED = 5
MAX_BITS = 3
QUARTER = 6  # bits of a quarter of the three bytes that five positions leave
CHUNK = 1 << 16


def _quadruples() -> list[int]:
    """Position sets, as 8-bit masks: weight-four words of the extended Hamming code."""
    rows = (0b11110000, 0b11001100, 0b10101010, 0b11111111)
    words = set()
    for n in range(16):
        w = 0
        for i, r in enumerate(rows):
            w ^= r if n >> i & 1 else 0
        words.add(w)
    return sorted(w for w in words if w.bit_count() == 4)


QUADS = _quadruples()


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit SimHash of the lower-cased (A-Z) text's ``n``-word shingles, each weighted by its repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < n:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    total = len(raw) // 8
    bits = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, total, CHUNK):
        bits += np.unpackbits(rows[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's bits as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([_signed(fingerprint(t, n)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _key(mask: int):
    """A long that is unique for the position set and the bytes at its positions (up to five)."""
    at = [i for i in range(8) if mask >> i & 1]
    out = F.lit(mask).cast("long")
    for i in at:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(i))
    return out


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes of each XOR are zero."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    ok = _shared_bytes(np.ascontiguousarray(x)) >= MIN_SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def _link_blocks(fps: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            x = fps[i : i + block, None] ^ fps[None, j : j + block]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.int8)
            r, c = np.nonzero(shared >= MIN_SHARED)
            keep = (r + i < c + j) & (np.bitwise_count(x[r, c]) <= MAX_BITS)
            left.append(r[keep] + i)
            right.append(c[keep] + j)
    return np.concatenate(left), np.concatenate(right)


def _free_bits(key: int) -> list[int]:
    """The bits in which members of the list with this wider key may differ."""
    mask, quarter = key >> 48, key >> 6 & 3
    free = [8 * p + k for p in reversed(range(8)) if not mask >> p & 1 for k in range(8)]
    return [b for j, b in enumerate(free) if j // QUARTER != quarter]


def _link_flips(fps: np.ndarray, free: list[int]) -> np.ndarray:
    """Roots in a list whose members differ in the ``free`` bits only: look up all neighbours of each member."""
    bits = [np.uint64(1 << b) for b in free]
    order = np.sort(fps)
    root = np.arange(len(order))
    held_l, held_r, held = [], [], 0
    masks = [np.bitwise_or.reduce(np.array(m, dtype=np.uint64)) for r in (1, 2, 3) for m in combinations(bits, r)]
    for k, m in enumerate(masks):
        other = order ^ m
        at = np.searchsorted(order, other)
        at[at == len(order)] = 0
        hit = (order[at] == other) & (order < other)
        held_l.append(np.nonzero(hit)[0])
        held_r.append(at[hit])
        held += len(held_l[-1])
        if held > 2_000_000 or k == len(masks) - 1:
            left, right = np.concatenate(held_l), np.concatenate(held_r)
            root = forest(len(order), np.concatenate([np.arange(len(order)), left]), np.concatenate([root, right]))
            held_l, held_r, held = [], [], 0
    return order[root]


def _scan(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> (kind, a, b): kind 0 a link, kind 1 a member a of a long list with position set b.

    ``limit`` None: long lists are linked here (their key has five positions and a quarter).
    """

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"]
        )

    def link(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        size_of = np.repeat(sizes, sizes)
        rows = np.nonzero((size_of > 1) & (size_of <= MATRIX))[0]
        k, f = keys[rows], fps[rows]
        for d in range(1, int(sizes[sizes <= MATRIX].max(initial=1))):
            same = k[d:] == k[:-d]
            if not same.any():
                break
            a, b = f[:-d][same], f[d:][same]
            ok = _close(a, b)
            if ok.any():
                yield out(0, a[ok], b[ok])
        for s, n in zip(starts[sizes > MATRIX], sizes[sizes > MATRIX]):
            run = fps[s : s + n]
            if limit and n > limit:
                yield out(1, run, np.full(n, keys[s], dtype=np.int64))
                continue
            if n <= LIST_LIMIT:
                root = run[forest(n, *_link_blocks(run))]
            else:
                run = np.sort(run)
                root = _link_flips(run, _free_bits(int(keys[s])))
            ok = run != root
            if ok.any():
                yield out(0, run[ok], root[ok])

    key, held, deferred = None, [], False  # the last, unfinished list
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if keys[-1] == key:
            cut = 0
        if cut:
            same = int(np.searchsorted(keys, key, side="right")) if key is not None and keys[0] == key else 0
            if deferred:
                yield out(1, fps[:same], np.full(same, key, dtype=np.int64))
                yield from link(keys[same:cut], fps[same:cut])
            else:
                before = np.concatenate(held) if held else fps[:0]
                head = len(before) + same
                if limit and head > limit:
                    yield out(1, np.concatenate([before, fps[:same]]), np.full(head, key, dtype=np.int64))
                    yield from link(keys[same:cut], fps[same:cut])
                else:
                    yield from link(np.concatenate([np.full(len(before), key if key is not None else 0, dtype=np.int64), keys[:cut]]), np.concatenate([before, fps[:cut]]))
            held, deferred = [], False
        elif key is not None and keys[-1] != key:  # a new list begins with the batch
            if held and not deferred:
                before = np.concatenate(held)
                yield from link(np.full(len(before), key, dtype=np.int64), before)
            held, deferred = [], False
        key = int(keys[-1])
        if deferred:
            yield out(1, fps[cut:], np.full(len(fps) - cut, key, dtype=np.int64))
        else:
            held.append(fps[cut:].copy())
            if limit and sum(map(len, held)) > limit:
                before = np.concatenate(held)
                yield out(1, before, np.full(len(before), key, dtype=np.int64))
                held, deferred = [], True
    if held:
        before = np.concatenate(held)
        yield from link(np.full(len(before), key, dtype=np.int64), before)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Distinct (fp long) -> (a, b) links whose components are those of all pairs at three or fewer differing bits."""
    spark = distinct.sparkSession
    kinds = "kind int, a long, b long"
    posts = distinct.select(F.explode(F.array(*(_key(m) for m in QUADS))).alias("key"), "fp")
    bound_batches(spark)
    first = posts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda it: _scan(it, LIST_LIMIT)), kinds)
    first = materialize(first, "lists")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps = wider_posts(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], names=["key", "fp"])

    again = (
        first.where("kind = 1")
        .select("a", "b")
        .mapInArrow(tidy(widen), "key long, fp long")
        .distinct()
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(tidy(lambda it: _scan(it, None)), kinds)
    )
    return first.where("kind = 0").select("a", "b").unionByName(again.select("a", "b"))


def wider_posts(fps: np.ndarray, quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sixteen wider keys of each member of a long list (its fingerprint, the list's four-position key): the position set
    with one position more, the bytes there, the number of a quarter of the other bits, and that quarter."""
    out, own = [], []
    masks = quads >> 32
    byte = lambda f, i: (f >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)
    for mask in np.unique(masks):
        f = fps[masks == mask]
        for extra in (i for i in range(8) if not mask >> i & 1):
            wide = int(mask) | 1 << extra
            key, free = np.full(len(f), wide, dtype=np.int64), np.zeros(len(f), dtype=np.int64)
            for i in range(8):
                if wide >> i & 1:
                    key = key << 8 | byte(f, i)
                else:
                    free = free << 8 | byte(f, i)
            for q in range(4):
                out.append(key << 8 | q << QUARTER | free >> QUARTER * q & (1 << QUARTER) - 1)
                own.append(f)
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def components(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links at three or fewer differing bits, its own included. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows stay. A null id stays null and never is a
    component's id unless its whole component has none. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, n, id_col, text_col), "fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a class alone in its component needs no second lookup
    ids = materialize(rooted.join(least, "root").select("fp", "component_id"), "ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None, n: int, words: int) -> np.ndarray:
    """``words`` 64-bit SimHashes of the text's distinct ``n``-word shingles under independent mixes of one hash; no words: zeros."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(words, dtype=np.uint64)
    shingles = [b" ".join(tokens)] if len(tokens) < n else map(b" ".join, zip(*(tokens[i:] for i in range(n))))
    h = np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), dtype=">u8").astype(np.uint64))
    out = np.empty(words, dtype=np.uint64)
    for w in range(words):
        bits = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), CHUNK):
            x = h[at : at + CHUNK] * np.uint64(2 * (0x9E3779B97F4A7C15 * (w + 1) >> 1 & (1 << 62) - 1) + 1)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            bits += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


#: Any five of a word's eight bytes hold three of one half: the triples within either half.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _wide_posts(cids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of the fingerprints (rows, words): word, triple and the three bytes there."""
    raw = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), fps.shape[1], 8).astype(np.int64)
    keys = np.stack([raw[:, :, a] | raw[:, :, b] << 8 | raw[:, :, c] << 16 for a, b, c in TRIPLES], axis=2)
    keys |= np.arange(keys.shape[1] * keys.shape[2]).reshape(keys.shape[1:]) << 24
    return keys.reshape(len(fps), -1).ravel(), np.repeat(cids, keys.shape[1] * keys.shape[2])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, cid) -> (key, cid, n, low): members of lists of two or more, with the list's size and its smallest member."""
    for t in whole_runs(batches):
        keys, cids = t.column(0).to_numpy(), t.column(1).to_numpy()
        starts, sizes = runs(keys)
        keep = np.repeat(sizes > 1, sizes)
        n, low = np.repeat(sizes, sizes)[keep], np.repeat(np.minimum.reduceat(cids, starts), sizes)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(cids[keep]), pa.array(n, pa.int64()), pa.array(low)], names=["key", "cid", "n", "low"])


def _blocks(size: str, most: int):
    return F.ceil(F.col(size) / most).cast("long")


def _group_blocks(size: str):
    """A group of lists is dealt in up to ``GROUP_BLOCKS`` small blocks, and in as few as a list where it is large."""
    return F.greatest(_blocks(size, LIST_BLOCK), F.least(F.lit(GROUP_BLOCKS), _blocks(size, GROUP_BLOCK)))


def _merged(met: DataFrame, long: int) -> DataFrame:
    """(key, cid, n, low) -> (key, cid, blocks): lists of near copies of one text become one of their own, under a negative key.

    Near copies meet in up to all of their lists. Lists of ``long`` members that share some form a group; where its members, each
    with every block of the group, are no more rows than those of its lists, and its pairs no more than theirs, the group stands
    for all lists within it, short ones too: it holds all their pairs. Other lists stay as they are.
    """
    met = met.withColumn("blocks", _blocks("n", LIST_BLOCK))
    long_lists = met.where(F.col("n") >= long)
    lows = long_lists.groupBy("cid").agg(F.min("low").alias("b"), F.collect_set("low").alias("lows"))  # no more of them than keys a class
    roots = materialize(connected_components(lows.select(F.explode(F.concat(F.array("cid"), "lows")).alias("a"), "b")), "grouped")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    size = members.groupBy("root").agg(F.count("*").alias("size")).withColumn("own_blocks", _group_blocks("size"))
    lists = long_lists.where("cid = low").groupBy("low").agg(F.sum(F.col("n") * F.col("blocks")).alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs"))
    work = lists.join(members, lists["low"] == members["node"]).groupBy("root").agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs"))
    dense = size.join(work, "root").where("size * own_blocks <= rows and size * size <= pairs").select("root", "own_blocks")
    grouped = materialize(members.join(dense, "root").select("node", "root", "own_blocks"), "dense")
    root = F.coalesce("root", F.lit(-1))
    listed = Window.partitionBy("key")
    rest = met.join(grouped, met["cid"] == grouped["node"], "left").withColumn("lowest", F.min(root).over(listed)).withColumn("highest", F.max(root).over(listed))
    rest = rest.where("lowest < 0 or lowest <> highest").select("key", "cid", "blocks")
    return rest.unionByName(grouped.select((-1 - F.col("root")).alias("key"), F.col("node").alias("cid"), F.col("own_blocks").alias("blocks")))


def _first_list(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of the first list that each pair of fingerprints meets in, or -1."""
    out = np.zeros(len(left), dtype=np.int64)
    raw = x.view(np.uint8).reshape(len(x), x.shape[1], 8)
    for s in range(0, len(left), 20_000):
        same = raw[left[s : s + 20_000]] == raw[right[s : s + 20_000]]
        meets = np.stack([same[:, :, a] & same[:, :, b] & same[:, :, c] for a, b, c in TRIPLES], axis=2).reshape(len(same), -1)
        out[s : s + 20_000] = np.where(meets.any(axis=1), meets.argmax(axis=1), -1)
    return out


def _looked_at(x: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Is a pair looked at under its key: in a list if that is the first it meets in, in a group of lists if it meets in any?"""
    first = _first_list(x, left, right)
    return np.where(key[left] < 0, first >= 0, first == key[left] >> 24)


def _wide_pairs(t: pa.Table, words: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole lists (group, side, across, cid, fp, ...) -> fingerprints, and row numbers and differing bits of pairs up to ``most``."""
    group, side = t.column(0).to_numpy(), t.column(1).to_numpy()
    across = t.column(2).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(t.column(4).to_pylist()), dtype=np.uint64).reshape(len(group), words)
    starts, sizes = runs(group)
    size_of = np.repeat(sizes, sizes)
    lefts, rights, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.nonzero((size_of > 1) & (size_of <= MATRIX))[0]
    for d in range(1, int(sizes[sizes <= MATRIX].max(initial=1))):
        i, j = rows[:-d], rows[d:]
        same = (group[i] == group[j]) & (~across[i] | (side[i] != side[j]))
        i, j = i[same], j[same]
        for s in range(0, len(i), 100_000):
            a, b = i[s : s + 100_000], j[s : s + 100_000]
            far = np.bitwise_count(x[a] ^ x[b]).sum(axis=1)
            ok = far <= most
            lefts.append(a[ok])
            rights.append(b[ok])
            bits.append(far[ok])
    for s, n in zip(starts[sizes > MATRIX], sizes[sizes > MATRIX]):
        own = np.arange(s, s + n)
        for p in range(0, n, 512):
            for q in range(p, n, 512):
                i, j = own[p : p + 512], own[q : q + 512]
                far = np.zeros((len(i), len(j)), dtype=np.int32)
                for w in range(words):
                    far += np.bitwise_count(x[i, w][:, None] ^ x[j, w][None, :])
                r, c = np.nonzero(far <= most)
                bits_here = far[r, c]
                r, c = i[r], j[c]
                ok = (r < c) & (~across[r] | (side[r] != side[c]))
                lefts.append(r[ok])
                rights.append(c[ok])
                bits.append(bits_here[ok])
    return x, np.concatenate(lefts), np.concatenate(rights), np.concatenate(bits).astype(np.int64)


def _clear_links(batches: Iterator[pa.RecordBatch], words: int, sure: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (group, side, across, cid, fp, key) -> (clear, a, b), at most two for each row.

    Clear: a forest of the pairs at ``sure`` or fewer differing bits. Else a class ``a`` with a pair up to ``most`` bits
    between two trees, and the key ``b`` that this pair is looked at under."""
    for t in whole_runs(batches):
        x, left, right, far = _wide_pairs(t, words, most)
        cid, key = t.column(3).to_numpy(), t.column(5).to_numpy()
        near = far <= sure
        own, row = np.unique(cid, return_inverse=True)  # a class has a row in each of its lists
        listed = near & (key[left] >= 0)
        root = forest(len(own), row[left[listed]], row[right[listed]])
        grouped = np.nonzero(near & (key[left] < 0))[0]
        for s in range(0, len(grouped), 20_000):  # in a group of lists a pair may meet in none
            at = grouped[s : s + 20_000]
            at = at[root[row[left[at]]] != root[row[right[at]]]]
            at = at[_first_list(x, left[at], right[at]) >= 0]
            root = _joined(root, row[left[at]], row[right[at]])
        apart = root != np.arange(len(own))
        between = np.nonzero(~near & (root[row[left]] != root[row[right]]))[0]
        left, right = left[between], right[between]
        here = _looked_at(x, key, left, right)
        ends = np.unique(np.concatenate([left[here], right[here]]))
        a, b = np.concatenate([own[apart], cid[ends]]), np.concatenate([own[root[apart]], key[ends]])
        clear = np.arange(len(a)) < int(apart.sum())
        yield pa.RecordBatch.from_arrays([pa.array(clear), pa.array(a), pa.array(b)], names=["clear", "a", "b"])


def _doubtful_links(batches: Iterator[pa.RecordBatch], words: int, most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Sorted (group, side, across, cid, fp, key, comp, s) -> (a, b): links between components ``comp`` of which a pair up to
    ``most`` bits reaches the similarity by its shingles ``s``.

    A pair is looked at once. Those with fewer bits go first, and what they link is not asked again, so that there are fewer
    links than rows, however many pairs."""
    for t in whole_runs(batches):
        x, left, right, far = _wide_pairs(t, words, most)
        key, sets = t.column(5).to_numpy(), t.column(7).chunk(0)
        own, comp = np.unique(t.column(6).to_numpy(), return_inverse=True)
        n = pc.binary_length(sets).to_numpy() // 8
        fit = (comp[left] != comp[right]) & (np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-9)
        left, right, far = left[fit], right[fit], far[fit]
        here = _looked_at(x, key, left, right)
        order = np.nonzero(here)[0][np.argsort(far[here], kind="stable")]
        left, right = left[order], right[order]
        root = np.arange(len(own))
        for s in range(0, len(left), ASKED):
            i, j = left[s : s + ASKED], right[s : s + ASKED]
            asked = root[comp[i]] != root[comp[j]]
            i, j = i[asked], j[asked]
            ok = np.array([_alike(sets[p].as_buffer(), sets[q].as_buffer(), similarity) for p, q in zip(i.tolist(), j.tolist())], dtype=bool)
            root = _joined(root, comp[i[ok]], comp[j[ok]])
        apart = root != np.arange(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(own[apart]), pa.array(own[root[apart]])], names=["a", "b"])


def _joined(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The roots with more pairs linked."""
    return forest(len(root), np.concatenate([np.arange(len(root)), left]), np.concatenate([root, right])) if len(left) else root


def _alike(a: pa.Buffer, b: pa.Buffer, similarity: float) -> bool:
    """Do two sorted sets of hashes reach the similarity?"""
    p, q = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common >= similarity * (len(p) + len(q) - common) - 1e-9


WIDE_WORDS = 20
#: Standard errors below and above the threshold's differing bits within which a pair is checked against the shingles.
DOUBT = (3.5, 3.5)
LIST_BLOCK = 1024
LONG_LIST = 16  # members, and six times as many as chance puts into a list: such lists are merged where they overlap
GROUP_BLOCK, GROUP_BLOCKS = 128, 8
LIST_BYTES = 8 << 20  # of shingle sets in a block of a list
ASKED = 512  # pairs between two looks at what is linked by now


def differing_share(similarity: float) -> float:
    """The share of SimHash bits that differ between texts at this Jaccard similarity of equally many shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_components(docs: DataFrame, n: int = 5, similarity: float = 0.8, words: int = WIDE_WORDS) -> DataFrame:
    """(doc_id, component_id) by estimated similarity of ``n``-word shingles: for thresholds that 64 bits can't tell.

    The fingerprint is ``words`` times 64 bits; the share of differing bits estimates the angle between the shingle sets,
    and so the similarity. A pair is a candidate if it shares three bytes within one half of one of the words: nearly all
    pairs over 0.85, nine in ten at 0.8. All candidates are verified over all bits; those near the threshold, if between
    components of clear pairs, by the similarity of their shingle sets. Nulls, empty texts, repeated rows and null ids are as in ``components``.
    """
    spark = docs.sparkSession

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([wide_fingerprint(t, n, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint64).reshape(b.num_rows, words)
            keys, cids = _wide_posts(b.column(0).to_numpy(), fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cids)], names=["key", "cid"])

    bound_batches(spark)
    rows = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(prints), "doc_id long, fp binary"), "wide")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    bound_batches(spark)
    posts = classes.select("cid", "fp").mapInArrow(tidy(post), "key long, cid long")
    bound_batches(spark)
    met = materialize(posts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_met), "key long, cid long, n long, low long"), "met")
    share = differing_share(similarity)
    error = math.sqrt(share * (1 - share) / (64 * words))
    sure, most = int((share - DOUBT[0] * error) * 64 * words), int((share + DOUBT[1] * error) * 64 * words)

    def lists(posts: DataFrame, *more: str) -> DataFrame:
        """Rows (group, side, across, cid, fp, key, ...) sorted by group: a list of ``blocks``, or two blocks of it."""
        split = posts.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        low, high = F.least("side", "other"), F.greatest("side", "other")
        grouped = split.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)).alias("group"), "side", (low != high).alias("across"), "cid", "fp", "key", *more)
        return grouped.repartition("group").sortWithinPartitions("group")

    long = LONG_LIST + 6 * classes.count() // (1 << 24)
    posted = materialize(_merged(met, long), "posted").join(classes.select("cid", "fp"), "cid")
    found = materialize(lists(posted).mapInArrow(tidy(lambda it: _clear_links(it, words, sure, most)), "clear boolean, a long, b long"), "wide_edges")
    links = found.where("clear").select("a", "b")
    roots = materialize(connected_components(links), "roots")
    left = found.where("not clear").select(F.col("a").alias("cid"), F.col("b").alias("key")).distinct()
    left = materialize(left.join(roots, left["cid"] == roots["node"], "left").select("cid", "key", F.coalesce("root", "cid").alias("comp")), "doubtful")
    if not left.isEmpty():
        # a list within one component is settled; the rest goes with its shingles
        open_lists = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        left = materialize(left.join(open_lists, "key", "left_semi"), "doubtful")
        sets = _shingle_sets(docs, left, classes.select("cid", "least"), n)
        sized = left.join(sets.select("cid", F.length("s").alias("bytes")), "cid")
        sizes = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        by_rows = F.when(F.col("key") < 0, _group_blocks("n")).otherwise(_blocks("n", LIST_BLOCK))
        sizes = sizes.select("key", F.greatest(F.lit(1), by_rows, _blocks("bytes", LIST_BYTES)).alias("blocks"))
        posted = left.join(sizes, "key").join(classes.select("cid", "fp"), "cid").join(sets, "cid")
        more = lists(posted, "comp", "s").mapInArrow(tidy(lambda it: _doubtful_links(it, words, most, similarity)), "a long, b long")
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # what is connected goes on as one link a node
        roots = materialize(connected_components(known.unionByName(more)), "roots")
    rooted = classes.join(roots, classes.cid == roots.node, "left").select("fp", "least", F.coalesce("root", "cid").alias("root"))
    ids = materialize(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "ids")
    return rows.join(ids, "fp").select("doc_id", "component_id")


def _shingle_sets(docs: DataFrame, ends: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, s binary): the sorted shingle hashes of the classes ``cid`` in ``ends``, read from their smallest ids' texts."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                parts = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n))))
                sets.append(np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts)), dtype=">u8").astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["cid", "s"])

    needed = materialize(ends.select("cid").distinct().join(classes, "cid").where("least is not null"), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text")).join(needed, "least").dropDuplicates(["cid"])
    bound_batches(docs.sparkSession)
    return materialize(texts.select("cid", "text").mapInArrow(tidy(shingles), "cid long, s binary"), "sets")


def keep_representatives(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each of the ``groups`` (doc_id, component_id): that with the smallest id; of wholly repeated rows one.

    An id names one document: rows that share it stay or go together unless their texts are equal too. Rows with a null id
    can't be told apart and stay.
    """
    ids = materialize(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    kept = docs.join(ids, docs["doc_id"] == ids["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
