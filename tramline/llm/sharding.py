"""Sharding by longest-processing-time scheduling: groups that stay together go, largest first, to the least-loaded shard.

Every group is scheduled through the heap of shard loads. The driver doesn't hold the groups but their classes by size: a class
holds the groups whose sizes agree in their ``DIGITS`` leading bits, so there are few, whatever the table. Within a class all
groups count as its mean size, and are dealt in bulk to where the heap would put them one by one: first every shard is filled
to a common level, then the heap deals the rest, of fewer groups than there are shards. A class of one group is exact. Which of a class'
groups goes where follows from its number in the class, which is counted in chunks, so that no class lands in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Leading bits of a size that its class keeps: sizes of a class are within a 512th of each other.
DIGITS = 10
OVERHEAD = 16
ROWS_PER_CHUNK = 50_000
#: A group of over one in so many of all rows is hot: its home is broadcast, with fewer than so many others.
HOT_SHARE = 65_536


def size_class(size: int) -> int:
    """``size`` with all but its leading bits cleared."""
    low = max(0, size.bit_length() - DIGITS)
    return size >> low << low


def deal(n: int, size: float, loads: list[float]) -> list[int]:
    """How many of ``n`` groups of equal ``size`` the heap gives to each shard; adds them to ``loads``."""
    counts = [0] * len(loads)
    if n > len(loads):  # in bulk up to the highest level that all reach, less what is left to the heap
        order = sorted(loads)
        below, level = 0.0, 0.0
        for k, x in enumerate(order, 1):
            below += x
            level = (n * size + below) / k
            if k == len(order) or level <= order[k]:
                break
        for s, x in enumerate(loads):
            counts[s] = max(0, int((level - x) / size) - 1)
    heap = [(x + c * size, s) for s, (x, c) in enumerate(zip(loads, counts))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        x, s = heap[0]
        heapq.heapreplace(heap, (x + size, s))
        counts[s] += 1
    for s, c in enumerate(counts):
        loads[s] += c * size
    return counts


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """(class, groups, bytes) -> how many of each class' groups go to each shard: classes by size descending."""
    loads = [0.0] * shards
    return {c: deal(n, total / n, loads) for c, n, total in sorted(classes, reverse=True)}


def _class_of(size):
    low = F.greatest(F.lit(0), F.char_length(F.bin(size)) - DIGITS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row for each row of ``docs``; rows with equal texts share a shard.

    A row's size is its UTF-8 bytes plus 16; a null text counts as an empty one, and is grouped with those. ``slot`` numbers
    a shard's rows from 0 without gaps. Null and repeated ids are allowed. An empty table gives no rows. A group over a
    shard's share can't be evened out, as it stays whole; the others then share the remaining shards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.md5("text")).alias("digest")
    )
    rows = materialize(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("copies")).withColumn("class", _class_of(F.col("size")))
    groups = materialize(groups, "groups")
    classes = [tuple(r) for r in groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("size")).collect()]  # at most 2^9 for each bit of a size
    if not classes:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")
    plan = schedule(classes, shards)
    ends = {c: [sum(counts[: s + 1]) for s in range(shards)] for c, counts in plan.items()}
    dealt = spark.createDataFrame(list(ends.items()), "class long, ends array<long>")
    chunks = _chunks(sum(n for _, n, _ in classes), 1, spark)
    numbered = number(groups.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(chunks))), "class", "chunk", ["digest"])
    # one row a class
    homes = materialize(numbered.join(F.broadcast(dealt), "class").select("digest", "copies", F.size(F.filter("ends", lambda e: e <= F.col("slot"))).alias("shard")), "homes")
    hot = F.col("copies") * HOT_SHARE > rows.count()
    known = rows.join(F.broadcast(homes.where(hot).select("digest", "shard")), "digest", "left")
    placed = known.where("shard is not null").unionByName(known.where("shard is null").drop("shard").join(homes.where(~hot).select("digest", "shard"), "digest"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.xxhash64("doc_id", "digest").alias("h"))
    placed = placed.withColumn("chunk", F.pmod(F.col("h"), F.lit(_chunks(sum(n for _, n, _ in classes), shards, spark))))
    return number(placed, "shard", "chunk", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def _chunks(n: int, keys: int, spark) -> int:
    return max(1, n // keys // ROWS_PER_CHUNK * 2, spark.sparkContext.defaultParallelism)


def number(df: DataFrame, key: str, chunk: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: each key's rows from 0 without gaps. A key's rows are spread over chunks, so none lands in one task."""
    df = materialize(df, "placed")
    sizes = df.groupBy(key, chunk).agg(F.count("*").alias("_n"))
    before = sizes.select(key, chunk, (F.sum("_n").over(Window.partitionBy(key).orderBy(chunk)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, chunk).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(before, [key, chunk]).withColumn("slot", (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's rows under the law ``bytes``."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
