import math

import numpy as np

from tramline.operators import u_turns as ut

SCHEMA = "track long, frame long, valid boolean, x double, y double, yaw double"


def walk(track, turns, step=1.0, valid=None):
    """A path that turns by the given degrees at each frame."""
    a, x, y, rows = 0.0, 0.0, 0.0, []
    for f, d in enumerate([0.0, *turns]):
        a += math.radians(d)
        if f:
            x, y = x + step * math.cos(a), y + step * math.sin(a)
        rows.append((track, f, valid is None or f in valid, x, y, (a + math.pi) % (2 * math.pi) - math.pi))
    return rows


def plainly(rows):
    """Status and numbers of one track, with arrays."""
    ok = [r[0:] for r in rows if r[2]]
    runs, best = [], None
    for r in ok:
        if runs and runs[-1][-1][1] + 1 == r[1]:
            runs[-1].append(r)
        else:
            runs.append([r])
    runs = [r for r in runs if len(r) >= 2]
    if not runs:
        return "insufficient_data",
    best = max(runs, key=lambda r: (len(r), -r[0][1]))
    yaw, xy = np.array([r[5] for r in best], float), np.array([r[3:5] for r in best], float)
    if not (np.isfinite(yaw).all() and np.isfinite(xy).all()):
        return "insufficient_data",
    u, n = np.unwrap(yaw), len(best)
    s = np.degrees([np.median(u[max(0, i - 2) : i + 3]) for i in range(n)])
    inc, net = np.diff(s), math.degrees(u[-1] - u[0])
    sign = np.where(inc >= 1, 1, np.where(inc <= -1, -1, 0))
    left, right = (sign > 0).sum(), (sign < 0).sum()
    way = 0 if left + right == 0 else 1 if left >= right else -1
    share = max(left, right) / (left + right) if way else 0.0
    longest = now = 0
    for v in sign:
        now = now + 1 if v == way and way else 0
        longest = max(longest, now)
    e = min(5, max(1, (n - 1) // 3))
    a, b = xy[e] - xy[0], xy[-1] - xy[-1 - e]
    dot = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if min(np.linalg.norm(a), np.linalg.norm(b)) > 1e-6 else None
    length, away = float(np.linalg.norm(np.diff(xy, axis=0), axis=1).sum()), float(np.linalg.norm(xy[-1] - xy[0]))
    ratio = length / away if away > 1e-6 else None
    boundary = not any(r[2] for r in rows if r[1] > best[-1][1])
    t = max(0, n - 1 - min(12, max(1, n - 1)))
    stable = abs(s[-1] - s[t]) <= 8 and (np.abs(inc[t:]) >= 1).mean() <= 0.35
    steady = lambda k, c: left + right >= k and share >= c and longest >= k and way == (1 if net > 0 else -1)
    whole = abs(net) >= 135 and steady(8, 0.75) and dot is not None and dot <= -0.35 and ratio is not None and ratio >= 1.15
    part = abs(net) >= 90 and steady(8, 0.7) and ((dot is not None and dot <= 0.55) or (ratio is not None and ratio >= 1.05)) and boundary and not stable
    up = lambda v: None if v is None else round(v, 3)
    return "supported" if whole else "partial_supported" if part else "not_supported", best[0][1], best[-1][1], up(net), up(share), longest, up(dot), up(ratio), boundary, stable


def found(spark, tracks):
    df = spark.createDataFrame([r for t in tracks.values() for r in t], SCHEMA)
    return {r.track: r for r in ut.u_turn_evidence(df, ["track"]).collect()}


def test_turns(spark):
    tracks = {
        1: walk(1, [0.0] * 6 + [6.0] * 30 + [0.0] * 6), 2: walk(2, [0.0] * 6 + [-6.0] * 30 + [0.0] * 6), 3: walk(3, [0.0] * 20), 4: walk(4, [0.0] * 6 + [4.0] * 25), 5: walk(5, [0.0] * 6 + [4.0] * 25 + [0.0] * 20),
        6: walk(6, [0.0] * 6 + [4.0] * 25 + [4.0], valid=[*range(28), 31]), 7: walk(7, [0.0] * 6 + [40.0, 0.0, 0.0] * 4), 8: walk(8, [], valid=[]), 9: [(9, 0, True, 0.0, 0.0, 0.0), (9, 1, True, None, 0.0, 0.0)],
    }
    got = found(spark, tracks)
    assert {k: r.status for k, r in got.items()} == {1: "supported", 2: "supported", 3: "not_supported", 4: "partial_supported", 5: "not_supported", 6: "not_supported", 7: "not_supported", 8: "insufficient_data", 9: "insufficient_data"}
    assert (got[1].heading_change, got[1].rotation, got[2].rotation, got[3].rotation) == (180.0, "increasing_ccw", "decreasing_cw", "roughly_stable")
    assert got[1].evidence == ["large_global_heading_reversal", "sustained_same_direction_rotation", "trajectory_entry_exit_direction_reversal", "curved_return_path_shape"]
    assert got[4].at_boundary and not got[4].stable_exit and got[5].stable_exit and not got[6].at_boundary and got[9].heading_change is None


def test_equals_plain_evidence_on_random_tracks(spark):
    rng = np.random.default_rng(3)
    tracks = {}
    for t in range(60):
        n = int(rng.integers(1, 60))
        turns = rng.normal(rng.choice([0, 3, -4, 6]), rng.choice([0.3, 2, 8]), n)
        lost = set(rng.choice(n + 1, int(rng.integers(0, 4))))
        tracks[t] = walk(t, turns.tolist(), float(rng.choice([0.0, 0.5, 2.0])), set(range(n + 1)) - lost)
    got = found(spark, tracks)
    statuses = set()
    for t, rows in tracks.items():
        want, r = plainly(rows), got[t]
        statuses.add(want[0])
        mine = (r.status, r.start_frame, r.end_frame, r.heading_change, r.consistency, r.longest_rotation, r.edge_dot, r.path_ratio, r.at_boundary, r.stable_exit)
        assert r.status == want[0], (t, want, mine)
        for a, b in zip(mine[1:], want[1:]):
            assert a == b or abs(a - b) < 2e-3, (t, want, mine)
    assert statuses == {"supported", "partial_supported", "not_supported", "insufficient_data"}
