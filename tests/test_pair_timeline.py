import pytest
from pyspark.sql import functions as F

from tramline.operators import facts as ft
from tramline.operators import pair_timeline as pt

SCHEMA = "pair long, frame long, valid boolean, lane_id string, x double, y double, heading double, speed double"


def scene(pair=1, during=8.0, b_lane="lane_B", a_x=None):
    """A comes from behind in its own lane, enters B's at frame 10 and is ahead from frame 30 on; B slows down at frame 10."""
    a, b = [], []
    for f in range(40):
        x = a_x if a_x is not None else f - 8.0 + (24.0 if f >= 30 else 0.0)
        a.append((pair, f, True, "lane_A" if f < 10 else "lane_B", x, 0.0, 0.0, 10.0))
        b.append((pair, f, True, b_lane, 0.0, 0.0, 0.0, 10.0 if f < 10 else during))
    return a, b


def timeline(spark, *scenes):
    a, b = (spark.createDataFrame([r for s in scenes for r in s[i]], SCHEMA) for i in (0, 1))
    t = pt.pair_timeline(a, b, ["pair"])
    kind, modifiers, status = ft.rule_class(*(F.col(c) for c in ("a_changed_lane", "a_entered_b_lane", "a_behind_to_ahead", "b_speed_reduced")))
    return {r.pair: r for r in t.withColumns({"kind": kind, "modifiers": modifiers, "class_status": status}).collect()}


FACTS = ("a_changed_lane", "b_maintained_lane", "a_entered_b_lane", "a_behind_to_ahead", "b_speed_reduced")


def facts(r):
    return [r[f] for f in FACTS]


@pytest.fixture(scope="module")
def found(spark):
    """Pairs: the whole overtaking; no yielding; B elsewhere; A stays behind; no common frame; a moment of contact only; nulls."""
    apart = ([(5, f, True, "l", 0.0, 0.0, 0.0, 1.0) for f in range(4)], [(5, f + 9, True, "l", 0.0, 0.0, 0.0, 1.0) for f in range(4)])
    still = [(6, f, True, "l", 0.0, 0.0, 0.0, 1.0) for f in range(3)], [(6, f, True, "l", [0.0, 2.0, 2.0][f], 0.0, 0.0, 1.0) for f in range(3)]
    odd = [(7, f, f != 1, None, None, float("nan"), 0.0, None) for f in range(4)], [(7, f, None, "l", 1.0, 0.0, None, float("nan")) for f in range(4)]
    return timeline(spark, scene(1), scene(2, during=10.0), scene(3, b_lane="lane_C"), scene(4, a_x=-10.0), apart, still, odd)


def test_all_five_facts(found):
    r = found[1]
    assert facts(r) == [True] * 5 and r.status == "pair_transition" and (r.transition_frame, r.source_agent, r.start, r.end) == (10, "agent_A", 10, 12)
    assert r.a_facts == ["changed_lane", "moved_from_behind_to_ahead", "entered_agent_B_lane"] and r.b_facts == ["maintained_lane", "reduced_speed"]
    assert (r.kind, r.modifiers) == ("overtake", ["with_lane_change", "with_yielding"])
    assert (r.a_before.relative_position, r.a_after.relative_position, r.a_before.lane_relation, r.a_after.lane_relation) == ("behind", "ahead", "different_lane", "same_lane")
    assert (r.a_before.frame_start, r.a_before.frame_end, r.a_after.frame_start, r.a_after.frame_end, r.a_after.frame_count) == (0, 9, 13, 32, 20)
    assert (r.b_before.relative_position, r.b_after.agent_A_lane_ids, r.a_changes, r.b_changes) == ("ahead", ["lane_B"], 1, 0)
    assert (r.b_speed_before, r.b_speed_min, r.deceleration_onset) == (10.0, 8.0, 10)


def test_no_yielding_without_loss_of_speed(found):
    r = found[2]
    assert facts(r) == [True, True, True, True, False] and r.b_facts == ["maintained_lane"] and r.deceleration_onset is None
    assert (r.kind, r.modifiers) == ("overtake", ["with_lane_change"])


def test_a_lane_change_beside_the_pair_is_none_of_it(found):
    r = found[3]
    assert facts(r) == [None] * 5 and r.transition_frame is None and r.status == "no_pair_transition_closest_approach_anchor"
    assert (r.start, r.end) == (7, 7) and r.a_changes == 1 and r.a_facts == [] and (r.kind, r.class_status) == ("unknown", "insufficient_evidence")


def test_behind_all_the_way(found):
    r = found[4]
    assert facts(r) == [True, True, True, False, True] and r.kind == "lane_change_with_yielding"


def test_odd_pairs(found):
    assert 5 not in found
    assert found[6].start == 1  # a distance of zero ranks behind others
    r = found[7]
    assert (r.start, r.a_during.lane_relation, r.a_during.relative_position, r.a_before.frame_count, r.a_before.lane_relation, r.b_speed_before) == (0, "unknown", None, 0, None, None)


def test_which_transition_is_the_pairs(spark):
    """A goes 1 to 2 at frame 5 (relation as before), 2 to 3 at 12 where B is; B leaves 3 for 4 at 20. Entering the same lane wins over leaving it."""
    lane_a = [1] * 5 + [2] * 7 + [3] * 15
    lane_b = [3] * 20 + [4] * 7
    a = [(1, f, True, str(v), 0.0, 0.0, 0.0, 5.0) for f, v in enumerate(lane_a)]
    b = [(1, f, True, str(v), 9.0, 0.0, 0.0, 5.0) for f, v in enumerate(lane_b)]
    r = timeline(spark, (a, b))[1]
    assert (r.transition_frame, r.source_agent, r.a_changes, r.b_changes) == (12, "agent_A", 2, 1)
    b = [(1, f, True, str(v), 9.0 if f < 7 else -9.0, 0.0, 0.0, 5.0) for f, v in enumerate([3] * 5 + [9] * 22)]  # both change at 5; the order flips at 7
    r = timeline(spark, (a, b))[1]
    assert (r.transition_frame, r.source_agent, r.a_behind_to_ahead, r.b_maintained_lane) == (5, "agent_A", True, False)


def test_a_short_lane_does_not_count(spark):
    a = [(1, f, True, v, 0.0, 0.0, 0.0, 5.0) for f, v in enumerate("aaabbaaa")]
    b = [(1, f, True, "b", 9.0, 0.0, 0.0, 5.0) for f in range(8)]
    assert timeline(spark, (a, b))[1].a_changes == 0
    assert timeline(spark, ([], [])) == {}
