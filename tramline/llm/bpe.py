"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a token. Tier two: misses
are merged by a heap of neighbouring pairs over a linked list of bytes. A worker remembers resolved pre-tokens up to
``MEMO_LIMIT`` of them, then starts afresh.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

MEMO_LIMIT = 300_000
MEMO_BYTES = 64  # longer pre-tokens aren't remembered


class PerfectHash:
    """Minimal perfect hash of byte strings: buckets in order of size are displaced until all their keys fall free.

    ``slot(key)`` is in 0..n-1 and collision-free on the keys; other keys get some slot too, so compare the key there.
    """

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n = n = len(keys)
        self.m = max(1, n // load)
        self.shift = [0] * self.m
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for k in keys:
            h = xxhash.xxh3_128_intdigest(k)
            buckets[(h >> 64) % self.m].append(h & (1 << 64) - 1)
        taken = bytearray(n)
        free = 0
        for g in sorted(range(self.m), key=lambda g: -len(buckets[g])):
            own = buckets[g]
            if len(own) < 2:
                if own:  # straight to the next free slot
                    while taken[free]:
                        free += 1
                    taken[free] = 1
                    self.shift[g] = (free - own[0]) % n
                continue
            parts = [(b % n, (b >> 20 | 1) % n) for b in own]
            for d in range(64 * n):
                # a mix of the displacement and two hashes, so that equal starts part
                far, near = divmod(d, 8)
                at = [(start + near + step * far) % n for start, step in parts]
                if not any(taken[x] for x in at) and len(set(at)) == len(at):
                    break
            else:
                raise ValueError("keys repeat")
            for x in at:
                taken[x] = 1
            self.shift[g] = ~d

    @staticmethod
    def _at(b: int, d: int, n: int) -> int:
        """Shifts at or over zero are of a bucket with one key."""
        if d >= 0:
            return (b + d) % n
        far, near = divmod(~d, 8)
        return (b % n + near + (b >> 20 | 1) % n * far) % n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        return self._at(h & (1 << 64) - 1, self.shift[(h >> 64) % self.m], self.n)


def merge_bytes(piece: bytes, ranks: Callable[[bytes], int | None]) -> list[int]:
    """Lowest-rank merges first, leftmost of equals, by a heap over linked bytes."""
    n = len(piece)
    if n == 1:
        return [ranks(piece)]
    end = list(range(1, n + 1))  # of the part that begins here; 0: merged away
    prev = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or not end[mid] or end[mid] != stop:
            continue  # a part has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (s := ranks(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (s, i, end[stop]))
        if (p := prev[i]) >= 0 and (s := ranks(piece[p:stop])) is not None:
            heapq.heappush(heap, (s, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks(piece[i : end[i]]))
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with a rank file; without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(r): base64.b64decode(t) for t, r in pairs}
        ids = sorted(self.tokens)
        self.hash = PerfectHash([self.tokens[i] for i in ids])
        self.key_at: list[bytes] = [b""] * len(ids)
        self.id_at = [0] * len(ids)
        for i in ids:
            s = self.hash.slot(self.tokens[i])
            self.key_at[s], self.id_at[s] = self.tokens[i], i
        self.longest = max(map(len, self.tokens.values()), default=0)
        self.split = regex.compile(pattern).findall
        self.pair_rank = {t: i for i, t in self.tokens.items()}.get  # the merge table: ranks of parts
        self.memo: dict[str, list[int]] = {}

    def lookup(self, piece: bytes) -> int | None:
        """Tier one."""
        if len(piece) > self.longest:
            return None
        s = self.hash.slot(piece)
        return self.id_at[s] if self.key_at[s] == piece else None

    def piece(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.lookup(raw)
        ids = [whole] if whole is not None else merge_bytes(raw, self.pair_rank)
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, piece, extend = self.memo.get, self.piece, out.extend
        for word in self.split(text or ""):
            extend(get(word) or piece(word))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process: the file is bounded by its vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row for each row. Null texts give an empty array; rows repeat as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes binary). Null arrays give empty bytes; an id that is no token is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), raw], names=["doc_id", "bytes"])

    bound_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's rows: each text is encoded, its ids decoded again; digests of both.

    One row for each row of ``docs``; null and empty texts have no tokens and the digests of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimal = {i: str(i) for i in c.tokens}.__getitem__
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, ids_sha, raw_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
