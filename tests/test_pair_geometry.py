import math

from tramline.operators import pair_geometry as pg


def evolution(spark, **pairs):
    rows = [(p, f, d) for p, ds in pairs.items() for f, d in enumerate(ds)]
    return {r.pair: r for r in pg.distance_evolution(spark.createDataFrame(rows, "pair string, frame long, distance double"), ["pair"]).collect()}


def test_distance_evolution(spark):
    down, up = [12.0, 11.0, 10.0, 9.0, 8.0, 7.0, 6.0, 5.0], [6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0]
    got = evolution(spark, both=down + up, near=[3.0, 2.96, 3.0], first=[2.0, *up], last=down, flat=[5.0] * 5 + [4.99] + [5.0] * 5, odd=[None, float("nan"), 3.0, float("inf")], none=[None], long=[9.0] * 30 + down + [5.0])
    assert {k: (r.overall, r.status, r.closest_frame, r.minimum_distance) for k, r in got.items()} == {
        "both": ("approaching_then_separating", "available", 7, 5.0), "near": ("uncertain", "insufficient_data", 1, 2.96), "first": ("separating_only", "available", 0, 2.0), "last": ("approaching_only", "available", 7, 5.0),
        "flat": ("roughly_stable", "available", 5, 4.99), "odd": ("uncertain", "insufficient_data", 2, 3.0), "long": ("approaching_only", "available", 37, 5.0),
    }
    assert tuple(got["both"].before) == ("available", "approaching", 0, 6, -4.0) and tuple(got["both"].after) == ("available", "separating", 8, 14, 4.0)
    assert got["long"].before.start_frame == 27 and got["near"].before.delta is None


def test_heading_relations(spark):
    tau = 2 * math.pi
    cases = {
        "same": [(0.0, 0.05)] * 15, "cross": [(0.0, math.pi / 2)] * 15, "opposing": [(0.0, math.pi), (0.1, math.pi)], "wrapped": [(3.1, -3.1)] * 3, "turns": [(0.1 + tau, 0.1)] * 2, "one": [(0.0, 0.0)],
        "unknown": [(None, 1.0), (float("nan"), 1.0), (0.0, 0.6)], "nothing": [(None, 1.0)] * 3, "tie": [(0.0, 0.0), (0.0, 0.5)],
    }
    rows = [(p, f, a, b) for p, v in cases.items() for f, (a, b) in enumerate(v)]
    got = {r.pair: r for r in pg.heading_relations(spark.createDataFrame(rows, "pair string, frame long, yaw double, other_yaw double"), ["pair"]).collect()}
    assert {k: (r.status, r.dominant, r.share) for k, r in got.items()} == {
        "same": ("available", "aligned", 1.0), "cross": ("available", "cross_direction", 1.0), "opposing": ("available", "opposing", 1.0), "wrapped": ("available", "aligned", 1.0), "turns": ("available", "aligned", 1.0),
        "one": ("insufficient_data", None, None), "unknown": ("available", "roughly_aligned", 1.0), "nothing": ("available", None, None), "tie": ("available", "roughly_aligned", 0.5),
    }
    assert (got["cross"].median, got["one"].least, got["nothing"].median, got["unknown"].frames) == (90.0, 0.0, None, 3)
