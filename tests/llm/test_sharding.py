import random
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tramline.llm import sharding

from .cases import ODD, documents


def check(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, loads = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    home = defaultdict(set)
    for r in got:
        home[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    return loads


def test_odd_rows(spark):
    check(ODD, sharding.by_bytes(documents(spark), 4).collect(), 4)
    assert sharding.by_bytes(documents(spark, []), 4).collect() == []


def plain(sizes, shards):
    """Loads by scheduling one group after the other."""
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        heap[heap.index(min(heap))] += size
    return sorted(heap)


def test_table_is_as_even_as_plain_scheduling(spark):
    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/documents.parquet"
        rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
        loads = check(rows, sharding.by_bytes(spark.read.parquet(path)).collect(), 40)
        sizes = Counter()
        for _, t in rows:
            sizes[t] += len((t or "").encode()) + 16
        want = plain(sizes.values(), 40)
        assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= max(want) - min(want) + 0.0002 * max(want)


def test_dealing_in_bulk_equals_one_by_one():
    rnd = random.Random(1)
    for _ in range(300):
        loads = [float(rnd.randrange(0, 400)) for _ in range(rnd.randrange(1, 9))]
        n, size = rnd.randrange(1, 200), float(rnd.randrange(1, 30))
        want = list(loads)
        for _ in range(n):
            want[want.index(min(want))] += size
        counts = sharding.deal(n, size, loads)
        assert sum(counts) == n and min(counts) >= 0 and sorted(loads) == sorted(want)


def test_classes_are_few_and_of_like_sizes(spark):
    sizes = [*range(1, 3000), *(10**k + 7 for k in range(3, 18)), (1 << 40) - 1]
    got = spark.createDataFrame([(x,) for x in sizes], "size long").select("size", sharding._class_of(F.col("size")).alias("c")).collect()
    assert all(r["c"] == sharding.size_class(r["size"]) and r["c"] <= r["size"] < r["c"] * (1 + 1 / 512) + 1 for r in got)


def test_equals_plain_scheduling(spark):
    rows = [(i, "x" * (3 ** (i % 9)) + str(i % 50)) for i in range(150)]
    loads = check(rows, sharding.by_bytes(documents(spark, rows), 5).collect(), 5)
    sizes = Counter()
    for _, t in rows:
        sizes[t] += len(t) + 16
    want = plain(sizes.values(), 5)
    assert max(loads.values()) - min(loads.values()) <= max(want) - min(want) + 64


def test_homes_of_rare_groups_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_SHARE", 3)
    test_hot_group_stays_whole(spark)


def test_hot_group_stays_whole(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(600)]
    check(rows, sharding.by_bytes(documents(spark, rows), 8).collect(), 8)
