import pytest

from tramline.operators import track_quality as tq

SCHEMA = "track long, frame long, valid boolean, time double, x double, y double, vx double, vy double, yaw double"


def even(n=12, track=1):
    """Ten frames a second at 10 m/s along x."""
    return [[track, f, True, f * 0.1, float(f), 0.0, 10.0, 0.0, 0.0] for f in range(n)]


def found(spark, *tracks):
    df = spark.createDataFrame([tuple(r) for t in tracks for r in t], SCHEMA)
    events = {}
    for e in tq.quality_events(df, ["track"]).collect():
        events.setdefault(e.track, []).append((e.frame, e.type, None if e.value is None else round(e.value, 3), e.severity))
    return {r.track: r for r in tq.track_quality(df, ["track"]).collect()}, {k: sorted(v) for k, v in events.items()}


def changed(track, n=12, **fields):
    rows = even(n, track)
    for name, at in fields.items():
        c = {"valid": 2, "time": 3, "x": 4, "y": 5, "vx": 6, "vy": 7, "yaw": 8}[name]
        for f, v in at.items():
            rows[f][c] = v
    return rows


def slow(frames):
    """Speeds whose neighbours differ by 0.9 m/s (9 m/s2) at the given frames only."""
    v, out = 10.0, {}
    for f in range(30):
        v += 0.9 if f in frames else 0.0
        out[f] = v
    return out


def placed(speeds):
    """Positions that fit the speeds."""
    x, out = 0.0, {0: 0.0}
    for f in range(1, len(speeds)):
        x += 0.05 * (speeds[f - 1] + speeds[f])
        out[f] = x
    return out


def jumps(track, frames):
    return changed(track, 30, vx=slow(frames), x=placed(slow(frames)))


def test_each_rule_by_itself(spark):
    tracks = {
        1: even(track=1),
        2: changed(2, yaw={5: float("nan")}),
        3: changed(3, valid=dict.fromkeys(range(3, 9), False)),
        4: changed(4, valid=dict.fromkeys(range(3, 8), False)),
        5: changed(5, yaw=dict.fromkeys(range(6, 12), 0.5236)),
        6: changed(6, x={f: f + 3.0 for f in range(6, 12)}),
        7: changed(7, x={f: 10.0 - f for f in range(6, 12)}),
        8: jumps(8, [5]),
        9: jumps(9, [5, 10]),
        10: jumps(10, [5, 11]),
        11: changed(11, vx=dict.fromkeys(range(6, 12), 13.5), x={f: 5.0 + 1.175 + (f - 6) * 1.35 for f in range(6, 12)}),
        12: changed(12, valid=dict.fromkeys(range(12), False)),
        13: changed(13, time={5: 0.4}),
        14: changed(14, vx={5: None}),
    }
    q, e = found(spark, *tracks.values())
    status = {k: q[k].status for k in tracks}
    assert status == {1: "clean", 2: "suspicious", 3: "suspicious", 4: "clean", 5: "suspicious", 6: "suspicious", 7: "suspicious", 8: "warning", 9: "suspicious", 10: "warning", 11: "suspicious", 12: "clean", 13: "clean", 14: "suspicious"}
    assert e[2] == [(5, "nonfinite_state", None, None)] and e[14] == e[2] and q[2].checked_pairs == 9
    assert e[3] == [(9, "long_validity_gap", 6.0, None)] and 4 not in e
    assert e[5] == [(6, "heading_jump", 30.0, None)]
    assert e[6] == [(6, "position_velocity_mismatch", 3.0, None)]
    assert {x[:2] for x in e[7]} == {(f, "position_velocity_direction_mismatch") for f in range(6, 12)} and q[7].position_velocity_mismatch == 0
    assert e[8] == [(5, "velocity_jump", 9.0, "warning")] and (q[8].warnings, q[9].warnings, q[10].warnings) == (1, 0, 2)
    assert [x[3] for x in e[11]] == ["severe"] and e[11][0][0] == 6
    assert (q[1].valid_frames, q[1].checked_pairs, q[12].valid_frames, q[13].checked_pairs) == (12, 11, 0, 10)


def test_a_jump_beside_another_issue_is_one(spark):
    rows = jumps(1, [5])
    rows[20][8] = float("inf")
    q, _ = found(spark, rows)
    assert q[1].status == "suspicious" and q[1].warnings == 0 and q[1].velocity_jump == 1


@pytest.mark.parametrize("turn, n", [(6.2, 0), (-6.2, 0), (3.0, 1)])
def test_headings_wrap(spark, turn, n):
    q, _ = found(spark, changed(1, yaw=dict.fromkeys(range(6, 12), turn)))
    assert q[1].heading_jump == n
