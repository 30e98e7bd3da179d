import pytest
from pyspark.sql import functions as F

from tramline.operators import behaviour_graph as bg

FIELDS = "subject reference behavior_type behavior_subtype interaction_type before_lane before_position target_matches after_lane after_position subject_motion reference_motion direction order_flip".split()
SCHEMA = "i int, " + ", ".join(f"{f} {'boolean' if f in ('target_matches', 'order_flip') else 'string'}" for f in FIELDS)
SAME_AHEAD = {"after_lane": "same_lane", "after_position": "ahead"}
PAIR = {"subject": "396", "reference": "260", "behavior_type": "lane_change"}

#: (record, selected keys, caption, missing required facts)
CASES = [
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_overtake", "order_flip": True}, ["lane_change", "behind_to_ahead"], "A396 overtakes A260 by changing to the left lane.", []),
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_overtake"}, ["lane_change"], "A396 changes to the left lane.", ["behind_to_ahead"]),
    ({"subject": "1409", "reference": "1443", "behavior_type": "merge", "interaction_type": "lane_change_merge", "target_matches": True}, ["merge"], "A1409 merges into the lane occupied by A1443.", []),
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_parallel", "after_lane": "adjacent_lane"}, ["lane_change", "final_adjacent_lanes"], "A396 changes to the left lane while A260 remains in the adjacent lane.", []),
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_parallel", "after_lane": "different_lane"}, ["lane_change", "final_separate_lanes"], "A396 changes to the left lane while A260 remains in a separate lane.", []),
    ({**PAIR, "interaction_type": "lane_change_parallel", "after_lane": "elsewhere"}, ["lane_change"], "A396 changes lanes.", []),
    ({"subject": "396", "behavior_type": "lane_change", "behavior_subtype": "right", "interaction_type": "lane_change"}, ["lane_change"], "A396 changes to the right lane.", []),
    ({"subject": "1638", "reference": "1646", "behavior_type": "merge", "interaction_type": "lane_change_merge", "target_matches": True, **SAME_AHEAD, "reference_motion": "stable"}, ["merge", "final_position", "reference_stable"],
     "A1638 merges into the lane occupied by A1646 and ends ahead of A1646.\nA1646 remains in the lane and maintains a relatively steady speed.", []),
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_overtake", "target_matches": True, "before_lane": "same_lane", "before_position": "behind", **SAME_AHEAD, "subject_motion": "accelerating", "reference_motion": "decelerating"},
     ["lane_change", "behind_to_ahead", "reference_decelerating"], "A396 overtakes A260 by changing to the left lane.\nA260 decelerates during the maneuver.", []),
    ({**PAIR, "behavior_subtype": "left", "interaction_type": "lane_change_parallel", "target_matches": True, **SAME_AHEAD, "reference_motion": "stable"}, ["lane_change", "reference_stable"], "A396 changes to the left lane.\nA260 maintains a relatively steady speed.", []),
    ({"subject": "7", "reference": "5", "behavior_type": "lane_change", "behavior_subtype": "left", "interaction_type": "lane_change_merge", "target_matches": True, **SAME_AHEAD, "reference_motion": "stable"}, ["lane_change", "final_position", "reference_stable"],
     "A7 moves left into A5's lane and ends ahead of A5.\nA5 remains in the lane and maintains a relatively steady speed.", []),
    ({"subject": "A7", "reference": "5", "behavior_type": "lane_change", "direction": "right", "interaction_type": "lane_change_merge", "target_matches": True, "reference_motion": "decelerating"}, ["lane_change", "reference_decelerating"], "A7 moves right into A5's lane.\nA5 decelerates during the maneuver.", []),
    ({"subject": "11", "reference": "12", "behavior_type": "follow_stop", "interaction_type": "stop_behind_lead", "after_lane": "same_lane", "after_position": "behind"}, ["following", "stop_behind_reference"], "A11 stops behind A12.", []),
    ({"subject": "0", "reference": "55", "behavior_type": "follow_stop", "behavior_subtype": "follow_lead", "direction": "left", "interaction_type": "follow_stable", "after_lane": "same_lane", "after_position": "behind"}, ["following", "final_same_lane"], "A0 follows behind A55 in the same lane.", []),
    ({"subject": "1646", "reference": "1638", "behavior_type": "pass", "interaction_type": "pass", "before_lane": "same_lane", "before_position": "behind", **SAME_AHEAD, "order_flip": True}, ["pass", "behind_to_ahead"], "A1646 passes A1638, moving from behind to ahead.", []),
    ({"subject": "1", "behavior_type": "pass", "interaction_type": "pass"}, ["pass"], "A1 passes another vehicle.", ["behind_to_ahead"]),
    ({}, ["unknown"], "The subject vehicle performs unknown.", []), ({"subject": "3", "behavior_type": "slow_roll", "subject_motion": "stable"}, ["slow_roll"], "A3 performs slow roll.", []),
    ({"subject": "3", "behavior_type": "follow_stop", "interaction_type": "follow_approaching", "subject_motion": "accelerating"}, ["following", "subject_speed_trend"], "A3 follows the lead vehicle.\nA3 accelerates during the maneuver.", []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, *[c.get(f) for f in FIELDS]) for i, (c, *_) in enumerate(CASES)], SCHEMA)
    d = bg.policy_audit(bg.select_facts(bg.behaviour_graph(df))).withColumn("caption", bg.caption())
    return {r.i: r for r in d.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_facts_and_captions(found, i):
    _, keys, text, missing = CASES[i]
    r = found[i]
    assert ([f.key for f in r.facts], r.caption, r.missing_required) == (keys, text, missing)


def test_facts_are_whole(found):
    assert [tuple(f) for f in found[7].facts] == [("merge", "primary_behavior", "merge", 100), ("final_position", "final_longitudinal_relation", "subject_ahead", 70), ("reference_stable", "reference_motion", "stable", 35)]
    assert found[7].enters and found[7].turns is None and found[8].turns == "left" and not found[8].enters


def test_graph_keeps_what_may_be_said(spark):
    rows = [(0, "1", "2", "lane_change", "left", "lane_change_merge", "different_lane", "behind", True, "same_lane", "ahead", "accelerating", "stable", None, None), (1, "1", "2", "follow_stop", "", None, "adjacent", "ahead", None, "same_lane", "alongside", "odd", None, "right", False)]
    a, b = (r.graph for r in bg.behaviour_graph(spark.createDataFrame(rows, SCHEMA)).orderBy("i").collect())
    assert (a.lanes_before, a.position_before, a.lanes_after, a.position_after, a.direction, a.order_flip, a.initiator_motion) == ("different_lanes", None, "same_lane", "ahead", "left", False, "accelerating")
    assert (b.interaction_type, b.behavior_subtype, b.direction, b.lanes_before, b.position_after, b.initiator_motion, b.reference_motion) == ("follow_stop", None, "right", "adjacent_lanes", None, None, None)


def test_a_caption_tells_selected_facts_only(spark):
    """With the order change taken out of the selection, it isn't told."""
    df = spark.createDataFrame([(0, *[CASES[0][0].get(f) for f in FIELDS])], SCHEMA)
    d = bg.select_facts(bg.behaviour_graph(df)).withColumn("facts", F.filter("facts", lambda f: f["type"] == "primary_behavior"))
    assert d.select(bg.caption()).first()[0] == "A396 changes to the left lane."
