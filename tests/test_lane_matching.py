import math
import random

import numpy as np

from tramline.operators import kernels as k
from tramline.operators import tracks

POINTS = "array<struct<x:double,y:double>>"


def matched(spark, rows, lanes, **near):
    df = spark.createDataFrame(rows, "scene long, agent long, frame long, x double, y double, heading double")
    lm = spark.createDataFrame(lanes, f"scene long, lane string, points {POINTS}, next array<string>, beside array<string>")
    return {(r.scene, r.agent, r.frame): r.lane for r in tracks.matched_lanes(df, lm, "scene", "agent", "frame", **near).collect()}


def test_three_lanes(spark):
    """Twelve frames along A and B with a jump toward C at 5, and one frame far away."""
    lanes = [(0, "A", [(0.0, 0.0), (10.0, 0.0)], ["B"], ["C"]), (0, "B", [(10.0, 0.0), (20.0, 0.0)], [], []), (0, "C", [(0.0, 2.0), (20.0, 2.0)], [], [])]
    rows = [(0, 1, f, 100.0 if f == 8 else f + 1.0, 2.0 if f == 5 else 0.0, 0.0) for f in range(12)]
    got = matched(spark, rows, lanes)
    assert [got[0, 1, f] for f in (0, 1, 2, 3, 5)] == ["A"] * 5 and got[0, 1, 8] is None and len(got) == 12


def test_equals_matching_against_the_whole_map(spark):
    """Random bent lanes, long diagonal ones and a single point, in two scenes, against the kernel that looks at every lane; for small cells and large."""
    rng = random.Random(8)
    lanes, shape = [], {}
    for scene in (0, 1):
        for n in range(25):
            a = rng.random() * 2 * math.pi
            points = [(rng.uniform(-40, 40), rng.uniform(-40, 40))]
            for _ in range(rng.choice([1, 3, 8])):
                a += rng.uniform(-0.4, 0.4)
                h = rng.choice([0.0, 2.0, 15.0, 90.0])
                points.append((points[-1][0] + h * math.cos(a), points[-1][1] + h * math.sin(a)))
            if n == 0:
                points = points[:1]
            name = f"L{n:02d}"
            shape[scene, name] = np.array(points)
            lanes.append((scene, name, points, [f"L{rng.randrange(25):02d}"], [f"L{rng.randrange(25):02d}"] if n % 2 else []))
    rows = []
    for scene in (0, 1):
        for agent in range(12):
            x, y, a = rng.uniform(-40, 40), rng.uniform(-40, 40), rng.random() * 6.28
            for f in range(40):
                odd = rng.random()
                rows.append((scene, agent, f, None if odd < 0.02 else x, float("nan") if 0.02 < odd < 0.04 else y, a))
                a += rng.uniform(-0.2, 0.2)
                x, y = x + 1.5 * math.cos(a), y + 1.5 * math.sin(a)
    want = {}
    for scene in (0, 1):
        maps = {n: p for (s, n), p in sorted(shape.items()) if s == scene}
        follows = {(n, t) for s, n, _, nx, _ in lanes if s == scene for t in nx}
        beside = {(n, t) for s, n, _, _, bs in lanes if s == scene for t in bs}
        for agent in range(12):
            part = [r for r in rows if r[:2] == (scene, agent)]
            found = k.match_lanes([r[3] for r in part], [r[4] for r in part], [r[5] for r in part], maps, follows, beside, reach=8.0, turn=1.0)
            want.update({r[:3]: lane for r, lane in zip(part, found)})
    assert sum(v is not None for v in want.values()) > 200
    for cell in (3.0, 50.0):
        assert matched(spark, rows, lanes, reach=8.0, turn=1.0, cell=cell) == want


def test_no_lanes_and_no_rows(spark):
    assert matched(spark, [(0, 1, 0, 1.0, 1.0, 0.0)], []) == {(0, 1, 0): None} and matched(spark, [], []) == {}
