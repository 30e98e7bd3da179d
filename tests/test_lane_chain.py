import math

import pytest
from pyspark.sql import types as T

from tramline.operators import lane_chain as lc

E = ["track"]
MATCHES = "track long, frame long, valid boolean, available boolean, lane_id long, group_id long, confidence double, x double, y double, stable_group long"
SIDE = "array<struct<lane_id:bigint,first:int,last:int>>"
LANES = f"lane_id long, group_id long, points array<struct<x:double,y:double>>, exits array<bigint>, entries array<bigint>, left {SIDE}, right {SIDE}"


def line(y=0.0, x0=0.0, x1=5.0):
    return [(float(x0), float(y)), (float(x1), float(y))]


def lane(i, group=None, points=None, exits=(), entries=(), left=(), right=()):
    return i, i if group is None else group, points or line(), list(exits), list(entries), list(left), list(right)


def track(ids, confidence=None, groups=None, number=1):
    groups = groups or ids
    return [(number, f, True, v is not None, v, g, None if v is None else (confidence[f] if confidence else 1.0), float(f), 0.0, g) for f, (v, g) in enumerate(zip(ids, groups))]


def chain(spark, rows, lanes, lateral=()):
    m, lm = spark.createDataFrame(rows, MATCHES), spark.createDataFrame(lanes, LANES)
    lt = spark.createDataFrame(list(lateral), "track long, start_frame long, end_frame long, direction string")
    s = lc.stabilised(m, E).cache()
    r = lc.reliable_runs(s, E)
    c = lc.transitions(r, lm, lt, E)
    g = lc.unresolved_gaps(s, r, lm, E)
    by = lambda df, *k: sorted(df.collect(), key=lambda x: [x[i] for i in k])
    return by(r, "track", "start_frame"), by(c, "track", "transition_frame"), by(g, "track", "start_frame"), by(lc.lane_behaviour(s, r, c, g, E), "track"), by(lc.route_transitions(s, c, lm, E), "track", "transition_frame")


def test_continuations_are_lane_keep(spark):
    lanes = [lane(490, exits=[637]), lane(637, exits=[812], entries=[490]), lane(812, entries=[637])]
    _, c, g, b, _ = chain(spark, track([490] * 3 + [637] * 3 + [812] * 3), lanes)
    assert [x.relation for x in c] == ["continuation"] * 2 and c[0].evidence == ["source_exit_lane", "target_entry_lane"] and not g
    assert b[0].lane_chain == [490, 637, 812] and b[0].behavior == "lane_keep"


@pytest.mark.parametrize("episode, behaviour", [((2, 4, "left"), "left_lane_change"), ((2, 4, "right"), "unknown"), ((12, 20, "left"), "unknown"), ((11, 20, "left"), "left_lane_change"), (None, "unknown")])
def test_a_lane_change_needs_neighbour_and_motion(spark, episode, behaviour):
    lanes = [lane(490, left=[(701, 0, 1)]), lane(701, points=line(3.0))]
    _, c, _, b, _ = chain(spark, track([490] * 3 + [701] * 3), lanes, [(1, *episode)] if episode else [])
    assert c[0].relation == "left_neighbor" and c[0].side == "left" and c[0].source_s == 2.0
    assert c[0].supported == (behaviour != "unknown") and b[0].behavior == behaviour


def test_neighbours_hold_at_their_place_only(spark):
    """The lane is left at s = 2, past the points 0 to 1 (s 0 to 1) along which 701 is beside it."""
    points = [(0.0, 0.0), (1.0, 0.0), (5.0, 0.0)]
    for place, relation in (((701, 0, 1), "unknown"), ((701, 1, 2), "left_neighbor"), ((701, 2, 0), "left_neighbor"), ((701, None, None), "left_neighbor"), ((701, 0, 99), "left_neighbor")):
        _, c, _, _, _ = chain(spark, track([490] * 3 + [701] * 3), [lane(490, points=points, left=[place]), lane(701)])
        assert c[0].relation == relation, place


def test_sides_in_two_directions_are_mixed(spark):
    lanes = [lane(1, left=[(2, None, None)]), lane(2, right=[(1, None, None)])]
    _, c, _, b, _ = chain(spark, track([1] * 4 + [2] * 14 + [1] * 4), lanes, [(1, 3, 5, "left"), (1, 17, 19, "right")])
    assert [x.episodes for x in c] == [[0], [1]] and b[0].behavior == "mixed_lane_behavior"


def test_groups_and_unknown_lanes(spark):
    _, c, _, b, _ = chain(spark, track([1] * 3 + [2] * 3), [lane(1, group=9), lane(2, group=9)])
    assert c[0].relation == "same_continuous_lane_group" and c[0].evidence == ["continuous_lane_group_audit_only"] and b[0].behavior == "lane_keep"
    _, c, _, b, _ = chain(spark, track([1] * 3 + [2] * 3), [lane(1), lane(2)])
    assert c[0].relation == "unknown" and c[0].source_s == 2.0 and b[0].behavior == "unknown"


def test_short_low_confidence_matches(spark):
    lanes = [lane(490), lane(637), lane(812)]
    r, c, g, b, _ = chain(spark, track([490] * 3 + [637] + [490] * 3, [0.9] * 3 + [0.2] + [0.9] * 3), lanes)
    assert [x.lane_id for x in r] == [490, 490] and not c and not g and b[0].lane_chain == [490] and b[0].behavior == "lane_keep"
    r, _, g, _, _ = chain(spark, track([490] * 3 + [637] + [490] * 3, [0.9] * 3 + [0.35] + [0.9] * 3), lanes)
    assert [x.lane_id for x in r] == [490] and not g  # a flicker
    r, _, _, _, _ = chain(spark, track([490] * 3 + [637] + [812] * 3, [0.9] * 3 + [0.35] + [0.9] * 3), lanes)
    assert [x.lane_id for x in r] == [490, 637, 812]
    _, c, g, b, _ = chain(spark, track([490] * 3 + [637] + [812] * 3, [0.9] * 3 + [0.2] + [0.9] * 3), lanes)
    assert not c and (g[0].after_lane, g[0].gap_types) == (812, ["confidence_rejected"]) and b[0].behavior == "unknown"


def test_unmatched_gap_between_lanes(spark):
    r, c, g, b, _ = chain(spark, track([490] * 3 + [None] * 3 + [701] * 3, [0.9] * 9), [lane(490), lane(701)])
    assert [x.lane_id for x in r] == [490, 701] and not c and b[0].behavior == "unknown"
    assert (g[0].start_frame, g[0].end_frame, g[0].gap_types) == (3, 5, ["match_unavailable"])
    *_, g, b, _ = chain(spark, track([490] * 3 + [None] * 3 + [701] * 3), [lane(490, group=5), lane(701, group=5)])
    assert not g and b[0].behavior == "lane_keep"


def test_a_track_without_a_lane_and_several_tracks(spark):
    rows = track([None] * 4) + track([490] * 3, number=2)
    _, _, _, b, _ = chain(spark, rows, [lane(490)])
    assert [(x.status, x.behavior, x.lane_chain) for x in b] == [("unknown", "unknown", []), ("available", "lane_keep", [490])]
    assert chain(spark, [], [lane(490)]) == ([], [], [], [], [])


def test_primary_route_transition_turns_most(spark):
    up = [(4.0, 0.0), (4.0, 1.0)]
    lanes = [lane(10, 100, line(0, 0, 1), exits=[20]), lane(20, 200, line(0, 2, 3), exits=[30], entries=[10]), lane(30, 300, up, entries=[20])]
    *_, t = chain(spark, track([10, 10, 20, 20, 30, 30], groups=[100, 100, 200, 200, 300, 300]), lanes)
    assert [(x.transition_frame, x.lane_before, x.lane_after, x.change, x.primary) for x in t] == [(2, 100, 200, 0.0, False), (4, 200, 300, 90.0, True)]


def test_route_headings_are_medians_of_a_window(spark):
    """Lane directions of 0 to 40 and 50 to 90 degrees: 20, 70 and a change of 50; the last five frames of a longer run count."""

    def bend(start, x0, n):
        points, x, y = [(float(x0), 0.0)], float(x0), 0.0
        for i in range(n):
            a = math.radians(start + 10 * i)
            x, y = x + math.cos(a), y + math.sin(a)
            points.append((x, y))
        return points

    a, b = bend(0, 0, 5), bend(50, 100, 5)
    rows = [(1, f, True, True, 10, 100, 1.0, *a[0], 100) for f in range(4)]  # more than five frames before
    mid = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    assert mid(a[0], a[1])
    rows += [(1, 4 + i, True, True, 10, 100, 1.0, *a[i], 100) for i in range(5)] + [(1, 9 + i, True, True, 20, 200, 1.0, *b[i], 200) for i in range(5)]
    *_, t = chain(spark, rows, [lane(10, 100, a, exits=[20]), lane(20, 200, b, entries=[10])])
    # a vertex has the direction between its neighbours: 0, 5, 15, 25, 35 and 50, 55, 65, 75, 85
    assert (t[0].incoming, t[0].outgoing, t[0].change) == (15.0, 65.0, 50.0)
    unsure = [(*r[:6], 0.1 if r[1] in (7, 8) else 1.0, *r[7:]) for r in rows]
    *_, t = chain(spark, unsure, [lane(10, 100, a, exits=[20]), lane(20, 200, b, entries=[10])])
    assert t == []  # frames 7 and 8 are a gap: no transition


def test_circular_median_at_zero(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([359.0, 1.0, 3.0],), ([10.0, 350.0],), ([],)], T.StructType([T.StructField("h", T.ArrayType(T.DoubleType()))]))
    assert [r[0] for r in df.select(lc.circular_median(F.col("h"))).collect()] == [1.0, 0.0, None]


def test_all_flickers_of_a_track_go(spark):
    """Six excursions to 637; the count of passes is no bound on them unless it is given."""
    ids = [490] * 3 + ([637] + [490] * 3) * 6
    rows = track(ids, [0.35 if v == 637 else 0.9 for v in ids])
    r, c, g, b, _ = chain(spark, rows, [lane(490), lane(637)])
    assert [(x.lane_id, x.start_frame, x.end_frame) for x in r] == [(490, 0, 26)] and not c and not g and b[0].behavior == "lane_keep"
    four = lc.stabilised(spark.createDataFrame(rows, MATCHES), E, 4)
    assert [x.frame for x in four.where("stable = 637").orderBy("frame").collect()] == [19, 23]
