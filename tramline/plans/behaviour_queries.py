"""Queries over behaviour records made from order lines: graph, selected facts and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import behaviour_graph as bg

from .registry import query, table

_K, _N = "l_orderkey", "l_linenumber"
#: field: (values, SQL of the number that picks one)
_VALUES = {
    "behavior_type": (("lane_change", "merge", "follow_stop", "pass", "overtake", "cut_in", "avoid", "slow_roll"), f"{_K} % 8"),
    "behavior_subtype": (("left", "right", "follow_lead", None), f"{_N} % 4"),
    "interaction_type": ((*bg.ALLOWED, None), f"({_K} + {_N}) % {len(bg.ALLOWED) + 1}"),
    "before_lane": (("same_lane", "different_lane", "adjacent", "elsewhere", None), f"{_K} % 5"),
    "before_position": (("behind", "ahead", "alongside"), f"{_N} % 3"),
    "target_matches": ((True, False, None), f"({_K} + {_N}) % 3"),
    "after_lane": (("same_lane", "adjacent_lanes", "different_lanes", None), f"(2 * {_K} + {_N}) % 4"),
    "after_position": (("ahead", "behind", "alongside"), f"({_K} + 2 * {_N}) % 3"),
    "subject_motion": (("accelerating", "decelerating", "stable", "odd"), f"(3 * {_K} + {_N}) % 4"),
    "reference_motion": (("decelerating", None, "stable", "accelerating", None), f"({_K} + 3 * {_N}) % 5"),
    "direction": (("left", None, "right"), f"{_K} % 3"),
    "order_flip": ((None, False, None, True), f"({_K} + {_N}) % 4"),
}


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


_CASES = {c: "CASE " + " ".join(f"WHEN {n} = {i} THEN {_literal(v)}" for i, v in enumerate(values)) + " END" for c, (values, n) in _VALUES.items()}
_ROW = [f"CAST({_K} % 1000 AS STRING) AS subject", f"CASE WHEN {_K} % 9 > 0 THEN CAST({_K} % 1000 + {_N} AS STRING) END AS reference", *[f"{sql} AS {c}" for c, sql in _CASES.items()]]


def _records(spark, d):
    return table(spark, d, "lineitem").selectExpr(_K, _N, *_ROW)


def _selected(spark, d):
    return bg.select_facts(bg.behaviour_graph(_records(spark, d)))


def _by_kind(table: dict) -> str:
    return "CASE interaction_type " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in table.items()) + " ELSE [] END"


_TREND = "CASE WHEN {c} IN ('accelerating', 'decelerating', 'stable') THEN {c} END"
_GRAPH = f"""WITH raw AS (SELECT {_K}, {_N}, {", ".join(_ROW).replace("STRING", "VARCHAR")} FROM lineitem),
g AS (SELECT {_K}, {_N}, 'A' || subject AS s, 'A' || reference AS r, behavior_type AS b, coalesce(interaction_type, behavior_type) AS interaction_type, CASE WHEN coalesce(behavior_subtype, direction) IN ('left', 'right') THEN coalesce(behavior_subtype, direction) END AS dir,
    coalesce(target_matches, false) AS target, CASE after_lane WHEN 'same_lane' THEN 'same' WHEN 'adjacent_lanes' THEN 'adjacent' WHEN 'different_lanes' THEN 'separate' END AS fin, CASE WHEN after_lane = 'same_lane' AND after_position <> 'alongside' THEN after_position END AS pos,
    coalesce(order_flip, false) OR coalesce(before_lane = 'same_lane' AND after_lane = 'same_lane' AND before_position = 'behind' AND after_position = 'ahead', false) AS flip,
    {_TREND.format(c="subject_motion")} AS sm, {_TREND.format(c="reference_motion")} AS rm FROM raw)"""
_FACTS = f"""{_GRAPH},
p AS (SELECT *, CASE WHEN interaction_type = 'stop_behind_lead' OR starts_with(interaction_type, 'follow_') THEN 'following' WHEN interaction_type IN ('lane_change_overtake', 'overtake') OR b IN ('lane_change', 'overtake', 'avoid', 'cut_in') THEN 'lane_change' WHEN b = 'follow_stop' THEN 'following' ELSE b END AS prim FROM g),
a AS (SELECT *, list_append({_by_kind(bg.ALLOWED)}, prim) AS may, {_by_kind(bg.REQUIRED)} AS need FROM p),
o AS (SELECT *, CASE WHEN list_contains(may, 'direction') THEN dir END AS turns, target AND list_contains(may, 'enters_reference_lane') AS enters,
    list_filter([CASE WHEN pos IS NOT NULL AND list_contains(may, 'final_position') THEN 'final_position' END, CASE WHEN fin = 'same' AND list_contains(may, 'final_same_lane') THEN 'final_same_lane' END,
      CASE WHEN fin = 'adjacent' AND list_contains(may, 'final_adjacent_lanes') THEN 'final_adjacent_lanes' END, CASE WHEN fin = 'separate' AND list_contains(may, 'final_separate_lanes') THEN 'final_separate_lanes' END,
      CASE WHEN interaction_type = 'stop_behind_lead' AND fin = 'same' AND pos = 'behind' THEN 'stop_behind_reference' END, CASE WHEN flip AND list_contains(may, 'behind_to_ahead') THEN 'behind_to_ahead' END], lambda x: x IS NOT NULL) AS rel,
    CASE WHEN rm IS NOT NULL AND list_contains(may, 'reference_motion') THEN 'reference_' || rm END AS refm, CASE WHEN sm IS NOT NULL AND list_contains(may, 'subject_speed_trend') THEN 'subject_speed_trend' END AS subm FROM a),
q AS (SELECT *, list_filter(need, lambda x: x <> prim AND list_contains(rel, x)) AS musts FROM o),
-- relations of priority 90 go first; among others the first of the record. A moving reference goes before the subject, whatever it does
t AS (SELECT *, CASE WHEN len(musts) = 0 THEN coalesce(list_filter(rel, lambda x: x IN ('behind_to_ahead', 'stop_behind_reference'))[1], rel[1]) END AS extra, coalesce(refm, subm) AS motion FROM q),
f AS (SELECT *, list_filter(list_concat([prim], musts, [extra, motion]), lambda x: x IS NOT NULL)[:3] AS keys FROM t)"""


@query("fct_33_semantic_graph", f"{_GRAPH} SELECT {_K}, {_N}, s AS initiator, r AS reference, b AS behavior_type, interaction_type, dir AS direction, fin AS lanes_after, pos AS position_after, flip AS order_flip, sm AS initiator_motion, rm AS reference_motion FROM g")
def _(spark, d):
    fields = ("initiator", "reference", "behavior_type", "interaction_type", "direction", "position_after", "order_flip", "initiator_motion", "reference_motion")
    after = F.when(F.col("graph.lanes_after") == "different_lanes", "separate").otherwise(F.regexp_replace("graph.lanes_after", "_lanes?$", ""))
    return bg.behaviour_graph(_records(spark, d)).select(_K, _N, *[F.col(f"graph.{c}").alias(c) for c in fields], after.alias("lanes_after"))


@query("fct_34_fact_selection", f"{_FACTS} SELECT {_K}, {_N}, array_to_string(keys, ',') AS facts, turns, enters, array_to_string(list_filter(need, lambda x: NOT list_contains(keys, x)), ',') AS missing FROM f")
def _(spark, d):
    keys = F.transform("facts", lambda f: f["key"])
    return bg.policy_audit(_selected(spark, d)).select(_K, _N, F.array_join(keys, ",").alias("facts"), "turns", "enters", F.array_join("missing_required", ",").alias("missing"))


@query(
    "fct_35_caption",
    f"""{_FACTS}, h AS (SELECT *, list_contains(keys, 'behind_to_ahead') AS ahead, list_contains(keys, 'final_same_lane') AS same, list_contains(keys, 'final_position') AS ends, keys[len(keys)] AS last FROM f),
    c AS (SELECT *, CASE prim WHEN 'lane_change' THEN CASE WHEN r IS NOT NULL AND ahead THEN s || ' overtakes ' || r || ' by changing ' || coalesce('to the ' || turns || ' lane', 'lanes') WHEN r IS NOT NULL AND enters THEN s || ' moves ' || coalesce(turns, 'laterally') || ' into ' || r || '''s lane'
          ELSE s || ' changes ' || coalesce('to the ' || turns || ' lane', 'lanes') END
        WHEN 'merge' THEN s || ' merges' || coalesce(' ' || turns, '') || CASE WHEN r IS NOT NULL AND enters THEN ' into the lane occupied by ' || r ELSE '' END
        WHEN 'following' THEN CASE WHEN r IS NOT NULL AND list_contains(keys, 'stop_behind_reference') THEN s || ' stops behind ' || r WHEN r IS NOT NULL AND same THEN s || ' follows behind ' || r || ' in the same lane' ELSE s || ' follows ' || coalesce(r, 'the lead vehicle') END
        WHEN 'pass' THEN CASE WHEN r IS NULL THEN s || ' passes another vehicle' WHEN ahead THEN s || ' passes ' || r || ', moving from behind to ahead' ELSE s || ' passes ' || r END ELSE s || ' performs ' || replace(prim, '_', ' ') END AS clause,
      CASE WHEN r IS NULL OR ahead THEN '' WHEN ends THEN ' and ends ' || pos || CASE pos WHEN 'ahead' THEN ' of ' ELSE ' ' END || r WHEN same AND NOT enters AND prim <> 'following' THEN ' and ends in the same lane as ' || r
        WHEN list_contains(keys, 'final_adjacent_lanes') THEN ' while ' || r || ' remains in the adjacent lane' WHEN list_contains(keys, 'final_separate_lanes') THEN ' while ' || r || ' remains in a separate lane' ELSE '' END AS tail,
      CASE WHEN last LIKE 'reference_%' AND r IS NOT NULL THEN CASE last WHEN 'reference_stable' THEN r || CASE WHEN enters OR same OR ends THEN ' remains in the lane and' ELSE '' END || ' maintains a relatively steady speed.' ELSE r || ' ' || replace(substr(last, 11), 'ating', 'ates') || ' during the maneuver.' END
        WHEN last = 'subject_speed_trend' THEN CASE sm WHEN 'stable' THEN s || ' maintains a relatively steady speed.' ELSE s || ' ' || replace(sm, 'ating', 'ates') || ' during the maneuver.' END END AS said FROM h)
    SELECT {_K}, {_N}, clause || tail || '.' || coalesce(chr(10) || said, '') AS caption FROM c""",
)
def _(spark, d):
    return _selected(spark, d).select(_K, _N, bg.caption().alias("caption"))
