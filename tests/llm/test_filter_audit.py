import itertools
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tramline.llm import filter_audit

from . import cases

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
KEYS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plainly(rows, labels):
    """Every order applied to every row, one after the other. rows: (doc_id, text, source)."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    marks = defaultdict(lambda: [False, False])
    for i, q, x, *_ in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        flags = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in low and i > low[t],
        }
        parts[s or ""].append((flags, *(marks[i] if i in marks else (False, False))))
    out, shapley = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in docs if d[0][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[0].values()) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, rows, labels):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n", T.StringType()), T.StructField("digest", T.StringType())])
    docs = spark.createDataFrame([(*r, "p", "n", "d") for r in rows], schema)
    found = filter_audit.report(docs, spark.createDataFrame([(*x, "t") for x in labels], LABELS)).select(KEYS).collect()
    assert len(found) == len(set(map(tuple, found)))
    return set(map(tuple, found))


def test_equals_filtering_in_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "a"), (2, long, "a"), (3, long, "b"), (3, long, "b"), (4, long + " #", "a"), (5, long.upper(), "a"), (6, "the same " * 150, "a"), (7, "Tiny", None), (8, "Tiny", ""),
        (9, None, "a"), (10, "", "b"), (None, "", "b"), (None, long, "c"), (11, "THE & " * 120, "c"), (11, "other text of one id", "c"), (12, " \t\n", "c"),
        (13, "\x1c \x0b \x00 a", "c"), (14, "ÄÖ ünï 日本語 " * 80, "c"), (15, "|" * 5000, "c"), (0, "Tiny", "z"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, None, 1), (4, 1, 0), (4, 0, 1), (5, 0, 0), (11, 1, 1), (None, 1, 1), (99, 1, 1)]
    assert got(spark, rows, labels) == plainly(rows, labels)


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "copy of a page" if i % 3 == 0 else f"page {i} # " * (i % 90), f"s{i % 4 if i % 2 else 0}") for i in range(600)]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 600, 2)]
    assert got(spark, rows, labels) == plainly(rows, labels)


def test_empty_and_odd(spark):
    assert got(spark, [], []) == set()
    assert filter_audit.report(cases.documents(spark), spark.createDataFrame([], LABELS)).count() == 600


@pytest.mark.parametrize("k", [1, 3])
def test_any_number_of_filters(spark, k):
    rows = spark.createDataFrame([(p, *[(i >> b) & 1 for b in range(k)], i + 1) for p in "xy" for i in range(1 << k)], ["part", *"abc"[:k], "n"])
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "part", list("abc"[:k]), "ABC"[:k]).collect()}
    total = sum(range(1, (1 << k) + 1))
    orders = list(itertools.permutations("ABC"[:k]))
    assert len(found) == 2 * len(orders) * k
    for order in orders:
        at = [found["x", "".join(order), s] for s in range(1, k + 1)]
        assert at[-1].kept == 1 and sum(r.removed for r in at) == total - 1
    assert sum({r.filter_order[r.step - 1]: r.shapley for r in found.values() if r.part == "y"}.values()) == len(orders) * (total - 1)
