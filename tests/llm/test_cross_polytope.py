import numpy as np

from tramline.llm import cross_polytope

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string, digest string"


def brute(rows, cut=0.93):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and label is not None and i is not None for i, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if o else None for (_, v, _), o in zip(rows, ok)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cut:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if ok[i]:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, n[i], least[find(i)] if ok[i] else k, (least[find(i)] == k) if ok[i] else True) for i, (k, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA)
    return sorted((tuple(r) for r in cross_polytope.near_duplicates(df).collect()), key=str)


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 0.0], None),
        (8, [1.0, 0.1], 3), (9, [1.0, 0.1], 3), (9, [2.0, 0.2], 3), (10, [1.0, 0.1], 4), (11, [-1.0, -0.1], 3), (12, [1.0, 0.1, 0.0], 3), (None, [1.0, 0.1], 3), (13, [1e30, 1e29], 3),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_planted_groups(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for g, size in enumerate([2, 3, 5, 60, 150]):
        center = rng.normal(size=64)
        for _ in range(size):
            rows.append((k, (center + rng.normal(size=64) * 0.22).tolist(), g % 2))
            k += 1
    rows += [(k + i, rng.normal(size=64).tolist(), i % 3) for i in range(300)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(40)]
    got, want = run(spark, rows), brute(rows)
    assert got == want


def test_blocks_split_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(200)]
    want = brute(rows)
    monkeypatch.setattr(cross_polytope, "BLOCK", 30)
    assert run(spark, rows) == want


def test_recall_at_the_threshold():
    """Pairs at 0.93 to 0.94, for each number of hashes that tables up to 10^8 rows get."""
    rng = np.random.default_rng(1)
    for dim, count, least in ((64, 1500, 0.99), (128, 1000, 0.98), (768, 300, 0.95)):
        a, b = rng.normal(size=(2, count, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        cos = rng.uniform(0.93, 0.94, size=(count, 1))
        b = cos * a + np.sqrt(1 - cos**2) * b
        label = np.zeros(count, dtype=np.int64)
        for tables, width in sorted({cross_polytope._plan(10**k, dim) for k in range(1, 9)}):
            rotations = cross_polytope.Rotations(dim, tables * width)
            one, two = (cross_polytope.buckets(x, label, rotations, tables, width) for x in (a, b))
            met = np.stack([cross_polytope._meeting(one[:, t], two[:, t]) for t in range(tables)], axis=1)
            assert (met != 0).any(axis=1).mean() >= least, (dim, tables, width)
            # each pair that meets counts in one bucket only
            at, where = np.nonzero(met)
            assert cross_polytope.meets_first(one[at], two[at], where, met[at, where]).sum() == (met != 0).any(axis=1).sum()


def test_planted_groups_at_three_hashes(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "_plan", lambda n, dim: (12, 3))
    test_planted_groups(spark)


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(32, 5))
    y = cross_polytope.hadamard(x)
    assert np.allclose((y * y).sum(0), 32 * (x * x).sum(0)) and np.allclose(cross_polytope.hadamard(y) / 32, x)
