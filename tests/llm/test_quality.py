import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from tramline.llm import quality

from . import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = W.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    marked = {k + i for v in places.values() if len(v) > 1 for k in v for i in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked)


def test_counts_equal_plain_counting(spark):
    rng = random.Random(3)
    rows = [*cases.ODD, (20, "a b c d e f g h " * 3), (21, "x " * 40), (22, "l one\nl one\n\n \n\nl two\nl one"), (23, "#*$%&|<> ~ a\x1cb \x00")]
    rows += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(cases.documents(spark, rows)).collect()}
    want = {(i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in rows for c in [counts(t)]}
    assert got == want


def test_table_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.kept is not None and not (r.kept and r.base_failed)
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert clean and all(clean)


def vectors(spark, rows):
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(f"x{i}", T.DoubleType()) for i in range(5)]])
    return spark.createDataFrame([(a, b, *map(float, v)) for a, b, v in rows], schema)


def inverse(r):
    m = np.zeros((5, 5))
    for i, j in quality._PAIRS:
        m[i, j] = m[j, i] = r[f"v{i}{j}"]
    return np.array([r[f"c{i}"] for i in range(5)]), np.linalg.inv(m)


def test_finds_the_bulk_under_contamination(spark):
    """A third of a source is far off and tight; centre and scatter are those of the rest, and the planted rows are far."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5)) * 0.3
    cov = a @ a.T + np.eye(5) * 0.2
    good = rng.multivariate_normal([5, 1, 0, 0, 0], cov, 1400)
    bad = rng.multivariate_normal([9, 4, 3, 3, 3], np.eye(5) * 0.01, 700)
    rows = [("en", "s", v) for v in [*good, *bad]]
    got = {(r.level, r.g1, r.g2): r for r in quality.estimates(vectors(spark, rows)).collect()}
    assert set(got) == {(0, "", ""), (1, "en", ""), (2, "en", "s")}
    centre, scatter = inverse(got[2, "en", "s"])
    want = cov + np.diag(np.array(quality.RESOLUTION) ** 2)
    assert np.abs(centre - [5, 1, 0, 0, 0]).max() < 0.15
    wide = np.linalg.eigvals(np.linalg.solve(want, scatter)).real  # half of all rows is three quarters of the good ones: 1.36 in theory
    assert 0.9 < wide.min() and wide.max() < 1.7
    assert math.isclose(got[2, "en", "s"]["logdet"], np.linalg.slogdet(scatter)[1], abs_tol=1e-6)
    far = [(v - centre) @ np.linalg.solve(scatter, v - centre) for v in bad]
    near = [(v - centre) @ np.linalg.solve(scatter, v - centre) for v in good]
    assert min(far) > quality.CUTOFF and max(near) < quality.CUTOFF


def test_determinant_is_near_the_least_of_all_halves(spark, monkeypatch):
    """Against every half of 14 rows, by brute force: no other half is much tighter."""
    monkeypatch.setattr(quality, "PRIOR", 0.0)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(10, 5)), rng.normal(size=(4, 5)) * 0.5 + 6])
    r = next(r for r in quality.estimates(vectors(spark, [("en", "s", v) for v in x])).collect() if r.level == 0)
    floor = np.diag(np.array(quality.RESOLUTION) ** 2)
    least = min(np.linalg.slogdet(quality.CONSISTENCY * np.cov(x[list(h)].T, bias=True) + floor)[1] for h in itertools.combinations(range(14), 10))
    every = np.linalg.slogdet(quality.CONSISTENCY * np.cov(x.T, bias=True) + floor)[1]
    assert least - 1e-9 <= r["logdet"] < least + 0.35 * (every - least)
    assert np.abs(inverse(r)[0]).max() < 1.5


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "w " * 30)]])
def test_small_tables(spark, rows):
    assert quality.judge(cases.documents(spark, rows)).count() == len(rows)


def test_null_languages_and_sources_with_parted_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "SMALL", 0)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(99)) for _ in range(rng.randrange(30, 300)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("x0", T.StringType()), T.StructField("level", T.StringType())])
    rows = [(i, text(), [None, "en", "de"][i % 3], [None, "s"][i % 2], "x", "l") for i in range(90)] + [(500, text().replace(" ", "$$$ &&& "), "en", "s", "x", "l")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 91 and sum(got[i] for i in range(90)) == 90 and not got[500]
