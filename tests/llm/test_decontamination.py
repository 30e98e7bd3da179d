import random

import duckdb
import numpy as np

from tramline.llm import decontamination as d

from .cases import ODD, documents


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
            best = max(best, h[i][j])
    return best


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, doc_id string, score string")


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 25)), rng.integers(0, 6, rng.integers(0, 40))
        assert d.align(a, b)[0] == slow_align(a, b)


def test_planted_copies(spark):
    rng = random.Random(3)
    words = [f"wort{i}" for i in range(2000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    bench = [(i, text(40)) for i in range(20)] + [(50, text(2)), (51, None), (None, text(30)), (52, []), (3, text(40))]
    rows = [(1000 + i, " ".join(text(300))) for i in range(60)]
    where = {}
    for k in range(20):
        copy = list(bench[k][1])
        if k % 2:  # edited: every sixth word replaced, one dropped, one put in
            copy[::6] = text(len(copy[::6]))
            del copy[20]
            copy.insert(10, "neu")
        before = text(100)
        rows.append((k, " ".join(before).upper() + ". " + ", ".join(copy) + "! " + " ".join(text(80))))
        where[k] = (k, 100)
    for i in range(300):  # one item in very many documents
        rows.append((5000 + i, " ".join(text(20) + bench[0][1] + text(20))))
    docs = documents(spark, [*rows, *((9000 + i, t) for i, (_, t) in enumerate(ODD))])
    got = d.matches(docs, items(spark, [(i, None if t is None else " ".join(t)) for i, t in bench])).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    pair = " ".join(bench[20][1])
    short = {(i, 50) for i, t in rows if f" {pair} " in f" {' '.join(w.decode() for w in d.words_of(t))} "}
    assert set(found) == {(k, k) for k in range(20)} | {(5000 + i, 0) for i in range(300)} | short
    assert all(found[(k, k)]["score"] == 1.0 and found[(k, k)]["word_start"] == 100 for k in range(0, 20, 2))
    assert all(0.5 <= found[(k, k)]["score"] < 1.0 for k in range(1, 20, 2))
    kept = {r["doc_id"] for r in d.drop_contaminated(docs, items(spark, [(i, None if t is None else " ".join(t)) for i, t in bench])).collect()}
    assert kept == {i for i, _ in rows} - set(range(20)) - set(range(5000, 5300)) | set(range(9000, 9000 + len(ODD)))


def test_edited_copies_beside_one_exact_copy(spark):
    rng = random.Random(4)
    text = lambda n: [f"wort{rng.randrange(2000)}" for _ in range(n)]
    item = [f"item{i}" for i in range(20)]
    copy = list(item)
    copy[6], copy[13] = "neu", "anders"
    rows = [(0, " ".join(text(30) + item + text(30)))] + [(1 + i, " ".join(text(30) + copy + text(30))) for i in range(60)]
    rows += [(100 + i, " ".join(text(30) + item[:3] + text(30))) for i in range(60)]  # a seed in common, no copy
    got = {r["doc_id"]: r["score"] for r in d.matches(documents(spark, rows), items(spark, [(1, " ".join(item))])).collect()}
    assert set(got) == set(range(61))
    assert got[0] == 1.0 and all(0.8 <= got[i] < 1.0 for i in range(1, 61))


def test_short_and_unspaced_items(spark):
    chinese = "这是一个很长的中文句子，没有空格，但它仍然是测试集的一部分"
    bench = [(1, "Xylophon!"), (2, "purple zebra"), (3, chinese), (4, "ภาษาไทยไม่มีช่องว่าง"), (5, "..."), (6, "")]
    rows = [(1, "a xylophon here"), (2, "the purple, zebra"), (3, "purple and zebra"), (4, "前文。" + chinese.replace("，", "") + "。后文"), (5, "前文" + chinese.replace("很长", "特别短") + "后文"), (6, "这是别的句子"), (7, "xภาษาไทยไม่มีช่องว่างy"), (8, "nothing")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.matches(documents(spark, rows), items(spark, bench)).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 3), (5, 3), (7, 4)}
    assert got[(4, 3)] == 1.0 and 0.5 <= got[(5, 3)] < 1
    kept = {r["doc_id"] for r in d.drop_contaminated(documents(spark, rows), items(spark, bench)).collect()}
    assert kept == {1, 2, 3, 6, 8}


def test_a_long_item_pads_its_own_passages_only(spark):
    rng = random.Random(9)
    text = lambda n: [f"wort{rng.randrange(10**6)}" for _ in range(n)]
    short, long = text(12), text(3000)
    own = items(spark, [(1, " ".join(short)), (2, " ".join(long))]).selectExpr("item_id as item", "text", "size(split(text, ' ')) as n")
    seeds = d.item_seeds(own)
    rows = [(1, " ".join(text(5000) + short + text(5000))), (2, " ".join(text(100) + long + text(100)))]
    found = {r["doc_id"]: r for r in d.passages(documents(spark, rows), seeds, {d.length_class(12): 12, d.length_class(3000): 3000}).collect()}
    assert len(found[1]["words"].split()) == 36 and len(found[2]["words"].split()) == 3200
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.matches(documents(spark, rows), items(spark, [(1, " ".join(short)), (2, " ".join(long))])).collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0}


def test_too_few_shared_words_never_reach_the_threshold():
    rng = random.Random(8)
    for _ in range(300):
        a, b = (" ".join(str(rng.randrange(30)) for _ in range(n)) for n in (20, 60))
        whole, bounded = d.score_pair(a, b), d.score_pair(a, b, 0.5)
        assert bounded == whole or (whole[0] < 0.5 and bounded == (0.0, 0, 0))


def test_empty_tables(spark):
    assert d.matches(documents(spark, []), items(spark, [(1, "a b c d e")])).collect() == []
    assert d.matches(documents(spark), items(spark, [])).collect() == []
    assert d.drop_contaminated(documents(spark), items(spark, [])).count() == len(ODD)


def test_table_matches_exact_search(spark):
    path = "/root/testdata/sf0.01"
    bench = [(i, b" ".join(d.words_of(t))) for i, t in duckdb.sql(f"select item_id, text from '{path}/benchmark.parquet'").fetchall()]
    want = set()
    for i, t in duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall():
        text = b" " + b" ".join(d.words_of(t)) + b" "
        want |= {(i, k) for k, item in bench if b" " + item + b" " in text}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.matches(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()}
    assert want and {k for k, s in got.items() if s == 1.0} == want
