from tramline.operators import lane_change_events as lce

STATES = "track long, frame long, valid boolean, matched boolean, lane_id string, confidence double, centerline double, offset double"
LANES = "lane_id string, left array<string>, right array<string>, next array<string>, prev array<string>"


def lane(i, left=(), right=(), next=(), prev=()):
    return i, list(left), list(right), list(next), list(prev)


def change(track=1, target="B", n=5, m=5, grow=0.15, shrink=0.2, **other):
    """Away from A's centre for n frames, then toward the target's for m."""
    rows = [[track, f, True, True, "A", 0.9, 0.4 + grow * f, 0.4 + grow * f] for f in range(n)]
    rows += [[track, n + k, True, True, target, 0.9, 1.0 - shrink * k, 1.0 - shrink * k] for k in range(m)]
    for f, (c, v) in other.items():
        rows[int(f[1:])][c] = v
    return [tuple(r) for r in rows]


def found(spark, lanes, *tracks):
    s, lm = spark.createDataFrame([r for t in tracks for r in t], STATES), spark.createDataFrame(lanes, LANES)
    e = lce.lane_change_events(s, lm, ["track"])
    return {r.track: r for r in e.collect()}, {r.track: (r.lane_change_detected, r.events) for r in lce.lane_change_verdict(s, e, ["track"]).collect()}


def test_lane_changes(spark):
    lanes = [lane("A", left=["B"], right=["C"], next=["D"]), lane("B", right=["A"]), lane("C", left=["A"]), lane("D", left=["A"]), lane("E", right=["A"]), lane("F", right=["A"], prev=["A"]), lane("G")]
    tracks = {
        1: change(1), 2: change(2, "C"), 3: change(3, "D"), 4: change(4, "E"), 5: change(5, "F"), 6: change(6, "G"), 7: change(7, grow=0.01), 8: change(8, shrink=0.01), 9: change(9, m=2), 10: change(10, n=3, m=3), 11: change(11, n=2, m=2),
        12: change(12, f4=(5, 0.4)), 13: change(13, f2=(6, None), f3=(6, float("nan"))), 14: change(14, n=8, m=8, **{f"f{i}": (3, False) for i in (0, 1, 2, 3, 4, 10, 11, 12, 13)}), 15: change(15, "X"),
    }
    events, verdict = found(spark, lanes, *tracks.values())
    assert {k: e.direction for k, e in events.items()} == {1: "left", 2: "right", 4: "left", 10: "left", 13: "left"}
    e = events[1]
    assert (e.from_lane, e.to_lane, e.start_frame, e.transition_frame, e.end_frame, e.confidence) == ("A", "B", 1, 5, 8, 0.96)
    assert (events[10].start_frame, events[10].end_frame, events[10].confidence) == (0, 5, 0.88)
    assert verdict == {**{k: (k in events, int(k in events)) for k in tracks}, 11: (None, 0), 14: (None, 0)}


def test_a_jump_of_one_frame_and_empty_tables(spark):
    rows = [(1, f, True, True, "B" if f == 5 else "A", 0.9, 0.5, 0.5) for f in range(11)]
    assert found(spark, [lane("A", left=["B"]), lane("B", right=["A"])], rows)[1] == {1: (False, 0)}
    assert found(spark, [], []) == ({}, {})
