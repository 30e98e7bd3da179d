"""Benchmark decontamination: shared n-grams join training passages to test items, Smith-Waterman scores the pairs.

Texts are compared as lower-case words without punctuation; a character of a script that isn't spaced is a word. Seeds are
all of an item's word n-grams, common ones too, as an item's rare ones can all be edited away; of a shorter item all its words
are the seed. One pass reads the documents and cuts the passages around seeds: it looks n-grams up in bit tables of fixed size
first, and joins what passes them with the seeds exactly. Items are classed by length, with a table each, so that a passage is
padded for items of about its seeds' items' length. A passage and an item with a common seed are aligned, unless they share
too few words for any alignment to reach the threshold; the score is the local alignment's over that of the item with itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, tidy

SEED_WORDS = 3
#: Score at which a document holds a copy of an item.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a class' table, whatever the number of seeds.
TABLE_BITS = 24
#: A document isn't dropped for items of fewer words: those are in too many texts by chance.
EVIDENCE_WORDS = 3

# ASCII punctuation parts words; apostrophes too.
_PARTS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


# Blocks of Thai, Lao, Burmese, Khmer, kana and ideographs, which put no space between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
# Punctuation of these scripts.
_WIDE_PARTS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u104a\u104b\u17d4-\u17d6]")


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii() and _UNSPACED.search(low):
        low = _UNSPACED.sub(r" \g<0> ", _WIDE_PARTS.sub(" ", low))
    return low.encode("utf-8", "replace").translate(_PARTS).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[bytes], n: int = SEED_WORDS) -> np.ndarray:
    """64-bit hashes of the word n-grams, by place."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i] + np.uint64(1))
    return out


class BitTable:
    """A Bloom filter of fixed size over seed hashes: two places each."""

    MASK = (1 << TABLE_BITS) - 1

    def __init__(self):
        self.bits = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)

    def _has(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) != 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.MASK)
        at = np.nonzero(self._has(hashes & mask))[0]
        return at[self._has((hashes[at] >> np.uint64(TABLE_BITS)) & mask)]


def length_class(words: int) -> int:
    """Items of a class are of lengths within four times of each other; 1 and 2 are the items of so many words."""
    return words if words < SEED_WORDS else SEED_WORDS + (words - 1).bit_length() // 2


def _tables(seeds: DataFrame) -> dict[int, BitTable]:
    """A table for each class of (cls, h). At most 2^18 numbers a class come to the driver, whatever the number of seeds."""
    mask = F.lit(BitTable.MASK).cast("long")
    slots = seeds.select("cls", F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", TABLE_BITS).bitwiseAND(mask))).alias("s"))
    bits = slots.groupBy("cls", F.shiftright("s", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out: dict[int, BitTable] = {}
    cls = bits.column("cls").to_numpy()
    for c in np.unique(cls):
        out[int(c)] = BitTable()
        out[int(c)].bits[bits.column("i").to_numpy()[cls == c]] = bits.column("bits").to_numpy()[cls == c].view(np.uint64)
    return out


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, cls, h): each item's distinct seeds. Items without a word have none and match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, cls, h = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                own = np.unique(gram_hashes(words, min(SEED_WORDS, len(words)))) if words else np.zeros(0, np.uint64)
                item += [k] * len(own)
                cls += [length_class(len(words))] * len(own)
                h.append(own)
            flat = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(cls, pa.int32()), pa.array(flat.view(np.int64))], names=["item", "cls", "h"])

    bound_batches(items.sparkSession)
    return items.select("item", "text").mapInArrow(tidy(run), "item long, cls int, h long")


def passages(docs: DataFrame, seeds: DataFrame, pads: dict[int, int]) -> DataFrame:
    """(doc_id, cls, at, words, hs): stretches of the texts around seeds of a class, with its longest item's length on either
    side (``pads``); ``at`` their first word's place."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(_tables(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                grams: dict[int, np.ndarray] = {}
                for cls, table in tables.value.items():
                    n, pad = min(SEED_WORDS, cls), pads[cls]
                    h = grams[n] if n in grams else grams.setdefault(n, gram_hashes(words, n))
                    at = table.places(h)
                    if not len(at):
                        continue
                    for part in np.split(at, np.nonzero(np.diff(at) > pad)[0] + 1):
                        a, z = max(0, int(part[0]) - pad), min(len(words), int(part[-1]) + n + pad)
                        rows.append((k, cls, a, b" ".join(words[a:z]).decode(), np.unique(h[part]).view(np.int64)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["doc_id", "cls", "at", "words", "hs"])

    bound_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, cls int, at long, words string, hs array<long>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word numbers, with linear gaps: (best score, place after its last word in the passage)."""
    if not len(item) or not len(passage):
        return 0, 0
    steps = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        np.maximum(new, row + GAP, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def score_pair(item: str, passage: str, threshold: float = 0.0) -> tuple[float, int, int]:
    """(score, first word, place after the last word) of the best local alignment; the score is 1 for a whole copy.

    The score is at most the share of the item's words, with their repeats, that the passage has: under ``threshold`` zeros.
    """
    a, b = item.split(), passage.split()
    if (Counter(a) & Counter(b)).total() < threshold * len(a):
        return 0.0, 0, 0
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x = np.array([number[w] for w in a])
    y = np.array([number.get(w, -1) for w in b])
    best, end = align(x, y)
    if not best:
        return 0.0, 0, 0
    back, length = align(x[::-1], y[:end][::-1])
    return best / (MATCH * len(a)), end - (length if back == best else end), end


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = 1) -> DataFrame:
    """(doc_id, item_id, score, word_start, word_end): the documents that hold a copy, and where its best one is.

    One row for each pair of ids; of repeated rows and passages the best score, then the first place. Null texts, items without
    a word and those of fewer than ``least_words`` match nothing, a null document id is reported as null, items with a null id are left out. Items
    with the same id are alternatives. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b" ".join(words_of(t)).decode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string()), pa.array([len(r.split()) for r in rows], pa.int64())], names=["item_id", "text", "n"])

    bound_batches(spark)
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = own.mapInArrow(tidy(normal), "item_id long, text string, n long").where(F.col("n") >= max(1, least_words)).distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    empty = spark.createDataFrame([], "doc_id long, item_id long, score double, word_start long, word_end long")
    seeds = materialize(item_seeds(items), "seeds")
    pads = {r["cls"]: r["n"] for r in seeds.select("item", "cls").distinct().join(items, "item").groupBy("cls").agg(F.max("n").alias("n")).collect()}  # a row a class
    if not pads:
        return empty
    found = materialize(passages(docs, seeds, pads).withColumn("passage", F.monotonically_increasing_id()), "passages")
    pairs = found.select("passage", "cls", F.explode("hs").alias("h")).join(seeds, ["cls", "h"]).select("passage", "item").distinct()
    full = pairs.join(found.select("passage", "doc_id", "at", "words"), "passage").join(items.select("item", "item_id", "text"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, at, words, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                s, a, z = score_pair(text, words, threshold)
                if s >= threshold:
                    rows.append((doc, item, s, at + a, at + z))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "score", "word_start", "word_end"])

    bound_batches(spark)
    scored = full.select("doc_id", "item_id", "at", "words", "text").mapInArrow(tidy(run), empty.schema)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("word_start")).alias("s"), F.col("word_end").alias("e"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("word_start"), F.col("b.e").alias("word_end"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a copy of an item of ``EVIDENCE_WORDS`` or more; columns as they were. Rows with a null
    id stay."""
    bad = materialize(matches(docs, benchmark, threshold, EVIDENCE_WORDS).select(F.col("doc_id").alias("_bad")).where("_bad is not null").distinct(), "bad")
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti").select(*(f"`{c}`" for c in docs.columns))
