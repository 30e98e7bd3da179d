import json

import pytest
from pyspark.sql import functions as F

from tramline.operators import validation as v

ROUTE = {**dict.fromkeys(v.ROUTE_TRANSITION), "route_transition": False, "transitions": []}
ROLE = {"physical_lateral_maneuver": {}, "speed_change": {}, "heading_motion": {**dict.fromkeys(v.HEADING_MOTION, 0.0), "turning_episode": {}}, "route_transition": ROUTE}
WHOLE = {
    "schema_version": "pair_physical_facts_v1",
    "pair": {"agent_A": {"id": 10, "object_type": 1, "is_object_of_interest": True}, "agent_B": {"id": 20, "object_type": 1, "is_object_of_interest": True}},
    "physical_facts": {
        "agent_A": ROLE, "agent_B": ROLE,
        "pair_relation": {"common_valid_frame_count": 1, "travel_channel": {}, "longitudinal": {}, "per_frame": [{"frame": 0, "distance_m": 3.0, "travel_channel_relation": "s", "longitudinal_relation": "a"}]},
        "pair_geometry": {
            "heading_relation": {"status": "uncertain", "dominant": "uncertain", "frame_counts": {"uncertain": 1}, "runs": [], "heading_difference_summary_deg": {"median": 0.0, "min": 0.0, "max": 0.0}},
            "closest_approach": {"status": "unavailable"}, "distance_evolution": {"status": "x", "overall": "y"}, "path_geometry": dict.fromkeys(v.PATH_GEOMETRY),
        },
        "map_context": {**dict.fromkeys(v.MAP_CONTEXT), "intersection_evidence": dict.fromkeys(v.INTERSECTION)},
    },
}

GONE = object()
P = "physical_facts."
CASES = [
    ({}, []),
    ({"schema_version": "v2"}, ["schema_version='v2'"]), ({"schema_version": GONE}, ["schema_version=None"]), ({"schema_version": 3}, ["schema_version=3"]),
    ({"pair.agent_A.is_object_of_interest": False}, ["pair.agent_A.is_object_of_interest is not true"]), ({"pair.agent_A.is_object_of_interest": 1}, ["pair.agent_A.is_object_of_interest is not true"]),
    ({"pair.agent_B.id": 21, "pair.agent_B.object_type": None}, ["pair.agent_B.id mismatch", "pair.agent_B.object_type is not vehicle"]), ({"pair.agent_B.id": "20"}, []), ({"pair.agent_A": []}, ["missing pair.agent_A"]),
    ({P + "agent_A.physical_lateral_maneuver": GONE}, ["missing physical_facts.agent_A.lateral_motion_evidence"]), ({P + "agent_A.speed_change": None}, []), ({P + "agent_B.speed_change": GONE}, ["missing physical_facts.agent_B.speed_change"]),
    ({P + "agent_A.heading_motion": None}, ["missing physical_facts.agent_A.heading_motion"]), ({P + "agent_A.heading_motion.end_frame": GONE}, ["missing physical_facts.agent_A.heading_motion.end_frame"]),
    ({P + "agent_A.route_transition.transitions": {}}, ["physical_facts.agent_A.route_transition.transitions is not a list"]),
    ({P + "agent_A.route_transition.primary_transition": 3}, ["physical_facts.agent_A.route_transition.primary_transition is not an object or null"]), ({P + "agent_A.route_transition.primary_transition": {}}, []),
    ({P + "agent_B.route_transition.transitions": [5, {**dict.fromkeys(v.TRANSITION), "transition_frame": 1}, dict.fromkeys(v.TRANSITION)]}, ["physical_facts.agent_B.route_transition.transitions[0] is not an object", "missing physical_facts.agent_B.route_transition.transitions[2].transition_frame"]),
    ({P + "pair_relation.per_frame": [{"frame": 1}]}, ["incomplete pair_relation.per_frame entry"]), ({P + "pair_relation.per_frame": [None]}, ["incomplete pair_relation.per_frame entry"]), ({P + "pair_relation.per_frame": []}, []),
    ({P + "pair_relation.per_frame": GONE}, ["missing physical_facts.pair_relation.per_frame", "physical_facts.pair_relation.per_frame is not a list"]),
    ({P + "pair_geometry.heading_relation.runs": None, P + "pair_geometry.heading_relation.heading_difference_summary_deg.max": GONE}, ["pair_geometry.heading_relation.runs is not a list", "incomplete pair_geometry.heading_relation.heading_difference_summary_deg"]),
    ({P + "pair_geometry.closest_approach.status": "available"}, ["missing pair_geometry.closest_approach.frame", "missing pair_geometry.closest_approach.distance_m"]),
    ({P + "pair_geometry.path_geometry": "none"}, ["missing physical_facts.pair_geometry.path_geometry"]),
    ({P + "pair_geometry.distance_evolution": GONE}, ["missing physical_facts.pair_geometry.distance_evolution", "missing pair_geometry.distance_evolution.status", "missing pair_geometry.distance_evolution.overall"]),
    ({P + "map_context": GONE}, ["missing physical_facts.map_context"]), ({P + "map_context.intersection_evidence": None}, ["physical_facts.map_context.intersection_evidence is not an object"]),
    ({P + "map_context.intersection_evidence.nearby_stop_sign": GONE}, ["missing physical_facts.map_context.intersection_evidence.nearby_stop_sign"]),
]


def changed(changes):
    out = json.loads(json.dumps(WHOLE))
    for path, value in changes.items():
        *way, last = path.split(".")
        at = out
        for k in way:
            at = at[k]
        if value is GONE:
            del at[last]
        else:
            at[last] = value
    return json.dumps(out)


def test_every_rule(spark):
    df = spark.createDataFrame([(i, changed(c)) for i, (c, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", v.pair_facts_errors(F.col("t"), F.lit(10), F.lit(20)).alias("e")).collect()}
    assert [(c, got[i]) for i, (c, _) in enumerate(CASES)] == [(c, list(want)) for c, want in CASES]


@pytest.mark.parametrize("text, first, n", [(None, "not_json_safe", 1), ("{", "not_json_safe", 1), ('{"a": NaN}', "not_json_safe", 1), ("{}", "schema_version=None", 36), ("[]", "schema_version=None", 36)])
def test_odd_texts(spark, text, first, n):
    errors = spark.createDataFrame([(text,)], "t string").select(v.pair_facts_errors(F.col("t"), F.lit(10), F.lit(20))).first()[0]
    assert errors[0] == first and (n == 1) == (len(errors) == 1)
