import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from tramline.llm import lexical

from . import cases

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("query", T.StringType())])
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(t):
    return SPLIT.findall((t or "").translate(LOWER))


def plainly(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        ranked = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                ranked.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, k=20, parts=3):
    d = cases.documents(spark, docs).repartition(parts) if docs else cases.documents(spark, docs)
    return sorted(map(tuple, lexical.search(d, spark.createDataFrame([(*x, "r", "q") for x in items], ITEMS), k).collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_scoring_every_document(spark, parts):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(30_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 400])))) for i in range(700)] + [(10_000 + i, "tie breaks w1") for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 12, 60])))) for i in range(60)] + [(99, "Tie-breaks! TIE"), (100, "nothing here"), (101, "w1 w1 w2")]
    assert got(spark, docs, items, 20, parts) == plainly(docs, items, 20)


def test_odd_rows(spark):
    docs = [*cases.ODD, (20, "Ünïcode x x"), (None, "lorem"), (21, "a\x00b_c"), (22, "İ K ǅ")]
    items = [(1, "one two"), (1, "one two"), (1, "a b"), (None, "lorem end"), (3, None), (4, ""), (5, "..."), (6, "X ünïcode"), (7, "日本語"), (8, "B C"), (9, "i k K")]
    assert got(spark, docs, items) == plainly(docs, items, 20)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, None)], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == []


def test_queries_in_several_blocks(spark, monkeypatch):
    docs = [(i, f"common word{i % 7} only{i}") for i in range(200)]
    items = [(i, f"common word{i % 7} only{i * 3}") for i in range(30)]
    monkeypatch.setattr(lexical, "QUERY_BYTES", 100)
    assert got(spark, docs, items, 5) == plainly(docs, items, 5)


def test_blocks_are_left_out(spark, sf_dir, monkeypatch):
    """On the tables most (query, block) pairs are never scored, and the result is whole (see the query's SQL)."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n, total = lexical.corpus_size(docs)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    index = lexical.build_index(docs, n, total).toArrow()
    scored, passed = [], lexical._Best.add
    monkeypatch.setattr(lexical._Best, "add", lambda self, s, i: (scored.append(len(i)), passed(self, s, i))[1])
    seen = {}
    monkeypatch.setattr(lexical, "tidy", lambda run: seen.setdefault("run", run))
    queries = next(lexical._query_blocks(items))
    words = sorted({t for _, q in queries for t in q})
    df = Counter(t for row in index.column("terms").to_pylist() for t in row)
    number = {t: i for i, t in enumerate(words)}
    cells = sorted((number[t], q, c * lexical.weight(n, max(1, df[t]))) for q, (_, found) in enumerate(queries) for t, c in found.items())
    import numpy as np

    cells = np.array(cells, np.int64)

    class Shared:
        value = (words, np.searchsorted(cells[:, 0], np.arange(len(words) + 1)), cells[:, 1], cells[:, 2], np.zeros(len(queries), np.int64))

    class Table:
        def mapInArrow(self, run, schema):
            return list(run(iter(index.to_batches())))

    lexical._scored(Table(), Shared, 5)
    assert 0 < len(scored) < 0.75 * index.num_rows * len(queries)
