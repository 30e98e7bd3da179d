import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from tramline.llm import simhash
from tramline.llm.components import connected_components

from .cases import ODD, documents


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    out = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << b
    return out


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    distinct = {}
    for i, f in enumerate(fps):
        root[find(i)] = find(distinct.setdefault(f, i))
    keys = np.array(list(distinct), dtype=np.uint64)
    for f, i in distinct.items():
        for g in keys[np.bitwise_count(keys ^ np.uint64(f)) <= 3]:
            root[find(i)] = find(distinct[int(g)])
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return sorted(((k, f"{f:016x}", least.get(find(i))) for i, (k, f) in enumerate(zip((k for k, _ in rows), fps))), key=str)


def same(spark, rows):
    got = [tuple(r) for r in simhash.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_odd_rows(spark):
    same(spark, ODD)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.similar_components(documents(spark, [])).collect() == []


def test_table_matches_brute_force(spark):
    same(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())


def test_quadruples_cover_all_fives():
    from itertools import combinations

    assert len(simhash.QUADS) == 14
    for five in combinations(range(8), 5):
        m = sum(1 << i for i in five)
        assert sum(q & m == q for q in simhash.QUADS) == 1


def planted(n, seed):
    """Fingerprints in a dense ball, a chain and at random."""
    rng = random.Random(seed)
    center = rng.getrandbits(64)
    out = {center}
    while len(out) < n:
        f = center
        for _ in range(rng.randrange(1, 6)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    f = rng.getrandbits(64)
    for _ in range(60):
        out.add(f)
        for _ in range(3):
            f ^= 1 << rng.randrange(64)
    out |= {rng.getrandbits(64) for _ in range(500)}
    return np.array(sorted(out), dtype=np.uint64)


def roots_of(keys):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, f in enumerate(keys):
        for j in np.nonzero(np.bitwise_count(keys ^ f) <= 3)[0]:
            root[find(i)] = find(int(j))
    groups = {}
    for i in range(len(keys)):
        groups.setdefault(find(i), set()).add(int(keys[i]))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_dense_groups_keep_all_links(spark, monkeypatch):
    keys = planted(1500, 7)
    want = roots_of(keys)
    df = spark.createDataFrame([(int(k.view(np.int64)),) for k in keys], "fp long")
    for limit in (simhash.LIST_LIMIT, 80):
        monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
        groups = {}
        for r in connected_components(simhash.fingerprint_links(df)).collect():
            groups.setdefault(r["root"], {r["root"] & (1 << 64) - 1}).add(r["node"] & (1 << 64) - 1)
        assert {frozenset(g) for g in groups.values()} == want


def test_scan_over_batch_borders():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 3000)).astype(np.int64)
    fps = rng.integers(0, 8, 3000).astype(np.uint64) ^ (keys.astype(np.uint64) << np.uint64(20))
    want = None
    for size in (1, 7, 250, 3000):
        for limit in (None, 75):
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(fps[i : i + size].view(np.int64))], names=["key", "fp"]) for i in range(0, 3000, size)]
            rows = [r for b in simhash._scan(iter(batches), limit) for r in zip(*(c.to_pylist() for c in b.columns))]
            if limit:
                long = {k for k, n in zip(*np.unique(keys, return_counts=True)) if n > limit}
                assert sorted(a for k, a, b in rows if k == 1) == sorted(fps[np.isin(keys, list(long))].view(np.int64).tolist())
            else:
                nodes = {x for k, a, b in rows if k == 0 for x in (a, b)}
                want = nodes if want is None else want
                assert nodes == want


def test_flips_equal_blocks():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 24, 4000).astype(np.uint64) | np.uint64(0xABCDE << 40))
    roots = simhash._link_flips(fps, list(range(24)))
    left, right = simhash._link_blocks(fps)
    blocks = fps[simhash.forest(len(fps), left, right)]
    pair = lambda r: {tuple(sorted(np.unique(fps[r == x]).tolist())) for x in np.unique(r)}
    assert pair(roots) == pair(blocks)


def test_wider_keys_split_long_lists_and_keep_pairs():
    """Members of a long list: each pair at three bits meets under a wider key, whose free bits are those that may differ."""
    rng = random.Random(2)
    mask = simhash.QUADS[3]
    base = rng.getrandbits(64)
    free = [8 * p + k for p in range(8) if not mask >> p & 1 for k in range(8)]
    key = mask << 32 | sum(((base >> 8 * p) & 255) << 8 * (3 - i) for i, p in enumerate(p for p in range(8) if mask >> p & 1))
    for _ in range(300):
        f = base ^ sum(1 << b for b in rng.sample(free, 20))
        g = f ^ sum(1 << b for b in rng.sample([b for b in free if b // 8 != free[0] // 8], 3))
        keys, fps = simhash.wider_posts(np.array([f, g], dtype=np.uint64), np.array([key, key]))
        lists = [set(keys[fps == np.uint64(x)].tolist()) for x in (f, g)]
        assert len(lists[0]) == len(lists[1]) == 16 and lists[0] & lists[1]
        for k in lists[0] & lists[1]:
            assert len(simhash._free_bits(k)) == 18 and (f ^ g) & ~sum(1 << b for b in simhash._free_bits(k)) == 0


def test_tally_goes_before_bits():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << rng.integers(0, 64, 350).astype(np.uint64))
    left, right = simhash._link_blocks(fps)
    assert sorted(zip(left.tolist(), right.tolist())) == [(i, i + 1) for i in range(0, 700, 2)]


def test_wide_groups_copies_and_leaves_others(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choice(words) for _ in range(300)]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(60)]
    rows += [(200, rows[50][1]), (201, None), (202, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, rows)).collect()}
    assert {got[i] for i in range(40)} == {0}
    assert all(got[100 + i] == 100 + i for i in range(60)) and got[200] == rows[50][0] and got[202] == 201
    kept = simhash.keep_representatives(documents(spark, rows), simhash.similar_components(documents(spark, rows)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 160), 201]
    assert kept.columns == documents(spark, rows).columns


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {(r["node"], r["root"]) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(2, 61)} | {(x, 100) for x in range(101, 160)}


def test_wide_recall_near_the_threshold(spark):
    rng = random.Random(11)
    rows, pairs = [], 400
    for i in range(pairs):  # k words changed, far apart: similarity (s - 5k) / (s + 5k) of s shingles, 0.80 to 0.82
        k = rng.choice((4, 6, 8))
        s = 45 * k + rng.randrange(5 * k)
        base = [f"w{rng.getrandbits(40)}" for _ in range(s + 4)]
        copy = list(base)
        for j in range(k):
            copy[6 + j * (s // k)] = f"x{rng.getrandbits(40)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, rows)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.92 * pairs


def exact_pairs(rows, similarity=0.8, n=5):
    """All pairs of texts with different shingle sets at this similarity or more, by a prefix filter; and each set's smallest id."""
    first, of = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().lower().split()
        of[i] = frozenset([b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[k:] for k in range(n)))))
        first.setdefault(of[i], i)
    often = Counter(x for s in first for x in s)
    index, pairs = defaultdict(list), []
    for s in sorted(first, key=len):
        near = set()
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(similarity * len(s)) + 1]:
            near.update(o for o in index[x] if len(o) >= similarity * len(s))
            index[x].append(s)
        pairs += [(first[s], first[o]) for o in near if len(s & o) >= similarity * len(s | o)]
    return pairs


def test_wide_recall_on_table(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    pairs = exact_pairs(duckdb.sql(f"select doc_id, text from '{path}'").fetchall())
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.read.parquet(path)).collect()}
    assert len(pairs) > 30 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_wide_group_at_the_threshold(spark):
    """Copies of one text, each with its own edits: most pairs lie about the threshold, so it takes all doubtful ones to tell."""
    rng = random.Random(21)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(260):
        copy = list(base)
        for at in rng.sample(range(0, 400, 6), rng.randrange(3, 12)):
            copy[at] = f"x{rng.getrandbits(30)}"
        rows.append((i, " ".join(copy)))
    fps = np.stack([simhash.wide_fingerprint(t, 5, simhash.WIDE_WORDS) for _, t in rows])
    keys = simhash._wide_posts(np.arange(len(rows)), fps)[0].reshape(len(rows), -1)
    pairs = [(a, b) for a, b in exact_pairs(rows) if (keys[a] == keys[b]).any()]  # those that the index holds
    assert len(pairs) >= 0.9 * len(exact_pairs(rows))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i, _ in rows}
    assert 1 < len(set(want.values())) < 200
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, rows)).collect()}
    assert got == want


def edited(n, seed, length, edits):
    """Copies of one text, each with ``edits`` words of its own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        copy = [f"w{j}" for j in range(length)]
        for at in rng.sample(range(0, length, 6), edits(rng)):
            copy[at] = f"x{rng.getrandbits(30)}"
        rows.append((i, " ".join(copy)))
    return rows


def written(spark, rows, monkeypatch):
    """Rows of every table that the operator writes; and its result."""
    sizes, write = defaultdict(list), simhash.materialize

    def counted(df, tag, **options):
        out = write(df, tag, **options)
        sizes[tag].append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(simhash, "materialize", counted)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, rows)).collect()}
    return sizes, got


def test_wide_group_makes_no_rows_of_pairs(spark, monkeypatch):
    """Nearly all of half a million pairs are doubtful and fail by their shingles: rows stay within those of the index."""
    sizes, got = written(spark, edited(1000, 4, 800, lambda rng: 12), monkeypatch)
    assert len(set(got.values())) > 500
    assert max(n for tag, found in sizes.items() for n in found) <= sizes["met"][0] <= 1000 * 20 * len(simhash.TRIPLES)


def test_wide_group_of_near_copies_is_one_list(spark, monkeypatch):
    """A class of a large group goes with its fingerprint and shingles to the group's blocks, not to each list it is in."""
    sizes, _ = written(spark, edited(1000, 4, 800, lambda rng: 12), monkeypatch)
    assert sizes["met"][0] > 50_000 and sizes["wide_edges"][0] <= 25_000 and max(sizes["doubtful"]) <= 10_000


def test_wide_merged_lists_keep_all_links(spark, monkeypatch):
    """Merged or not, with small blocks or one, beside texts that share lists with a part of the group only."""
    rows = edited(260, 23, 400, lambda rng: rng.randrange(3, 8)) + [(1000 + i, t) for i, t in edited(40, 24, 330, lambda rng: rng.randrange(2, 8))]
    rows += [(2000 + i, t + " tail" * i + f" own{i}") for i, t in edited(20, 23, 400, lambda rng: 25)]
    results = []
    for long, block, most in ((3, 20, 8), (8, 1000, 1), (1 << 40, 128, 8)):
        monkeypatch.setattr(simhash, "LONG_LIST", long)
        monkeypatch.setattr(simhash, "GROUP_BLOCK", block)
        monkeypatch.setattr(simhash, "GROUP_BLOCKS", most)
        sizes, got = written(spark, rows, monkeypatch)
        assert (sizes["dense"][0] > 0) == (long < 1 << 40)
        results.append(got)
    assert all(r == results[-1] for r in results) and 10 < len(set(results[-1].values())) < 100


def test_wide_blocks_keep_all_links(spark, monkeypatch):
    rows = edited(200, 22, 400, lambda rng: rng.randrange(3, 12))
    _, want = written(spark, rows, monkeypatch)
    assert 1 < len(set(want.values())) < 150
    monkeypatch.setattr(simhash, "LIST_BLOCK", 30)
    monkeypatch.setattr(simhash, "LIST_BYTES", 20_000)
    _, got = written(spark, rows, monkeypatch)
    assert got == want


def test_wide_repeats_dont_weigh(spark):
    line = " ".join(f"l{i}" for i in range(10))
    own = lambda x: " ".join(f"{x}{i}" for i in range(104))
    body = " ".join(f"b{i}" for i in range(60))
    rows = [(1, " ".join([line] * 50) + " " + own("x")), (2, " ".join([line] * 50) + " " + own("y")), (3, " ".join([body] * 2)), (4, " ".join([body] * 2 + [body] * 30))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
