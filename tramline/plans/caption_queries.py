"""Queries over captions: sentences made from orders, told against what was required of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tramline.functions import wording
from tramline.operators import grounding, validation

from .registry import query, table
from .surrogates import INTERVALS, intervals

#: What the sentences are made of; the parts of a sentence go by the order's and the customer's number.
PARTS = (
    "turns left", "makes a right turn", "changes lanes to the left", "changes lane right", "speeds up", "slows", "drifts a little", "continues straight", "keeps a steady speed", "makes a U-turn", "stands still",
)
KINDS = tuple(wording.BEHAVIOURS)


def _pick(words, number):
    return F.get(F.array(*map(F.lit, words)), (number % len(words)).cast("int"))


def _sql_pick(words, number: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][{number} % {len(words)} + 1]"


def _captions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    turn = wording.expected_turn(F.when(k % 7 == 0, "left_turn").when(k % 7 == 1, "right_turn"), F.when(c % 5 == 0, "increasing_ccw").when(c % 5 == 1, "decreasing_cw"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("The vehicle "), _pick(PARTS, k), F.lit(" and "), _pick(PARTS, c), F.lit(".")).alias("text"), turn.alias("turn"), F.array(_pick(KINDS, k + c), _pick(KINDS, k)).alias("required")
    )


def _told(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){'|'.join(p)}') THEN '{n}' END" for n, p in wording.BEHAVIOURS.items()) + "], lambda x: x IS NOT NULL)"


_CAPTIONS = f"""WITH captions AS (SELECT o_orderkey, 'The vehicle ' || {_sql_pick(PARTS, 'o_orderkey')} || ' and ' || {_sql_pick(PARTS, 'o_custkey')} || '.' AS text,
    CASE WHEN o_orderkey % 7 = 0 THEN 'left' WHEN o_orderkey % 7 = 1 THEN 'right' WHEN o_custkey % 5 = 0 THEN 'left' WHEN o_custkey % 5 = 1 THEN 'right' END AS turn,
    [{_sql_pick(KINDS, '(o_orderkey + o_custkey)')}, {_sql_pick(KINDS, 'o_orderkey')}] AS required FROM orders)"""


@query(
    "txt_04_forbidden_wording",
    _CAPTIONS + f""" SELECT o_orderkey, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i){wording.SHIFT_OR_DRIFT}') THEN 'shift_or_drift' END,
      CASE WHEN (turn = 'left' AND regexp_matches(text, '(?i){wording.TURN_RIGHT}')) OR (turn = 'right' AND regexp_matches(text, '(?i){wording.TURN_LEFT}')) THEN 'turn_conflicts' END,
      CASE WHEN regexp_matches(text, '(?i){wording.LANE_LEFT}') AND NOT list_contains(required, 'lane_change_left') THEN 'unrequired_left_lane_change' END,
      CASE WHEN regexp_matches(text, '(?i){wording.LANE_RIGHT}') AND NOT list_contains(required, 'lane_change_right') THEN 'unrequired_right_lane_change' END], lambda x: x IS NOT NULL), ',') AS broken FROM captions""",
)
def _(spark, d):
    return _captions(spark, d).select("o_orderkey", F.array_join(wording.violations(F.col("text"), F.col("turn"), F.col("required")), ",").alias("broken"))


@query(
    "txt_05_coverage",
    _CAPTIONS + f", told AS (SELECT *, {_told('text')} AS told FROM captions) SELECT o_orderkey, array_to_string(list_filter(required, lambda r: list_contains(told, r)), ',') AS covered, array_to_string(list_filter(required, lambda r: NOT list_contains(told, r)), ',') AS missing FROM told",
)
def _(spark, d):
    text, required = F.col("text"), F.col("required")
    return _captions(spark, d).select("o_orderkey", F.array_join(wording.covered(text, required), ",").alias("covered"), F.array_join(wording.missing(text, required), ",").alias("missing"))


_GROUND = f"""WITH RECURSIVE {INTERVALS}, i AS (SELECT agent // 10 AS record, interval_id, agent, start_frame AS s, start_frame + 200 + interval_id % 90 AS e FROM intervals),
seg AS (SELECT record, interval_id AS segment, s, e, {_told(_sql_pick(PARTS, 'interval_id') + " || ' and ' || " + _sql_pick(PARTS, 'agent'))} AS told FROM i WHERE interval_id % 2 = 1),
ep AS (SELECT record, interval_id AS episode, {_sql_pick(KINDS, 'interval_id')} AS type, CASE WHEN interval_id % 50 <> 0 THEN s END AS s, e FROM i WHERE interval_id % 2 = 0),
offers AS (SELECT ep.record, ep.type, ep.episode, seg.segment, CASE WHEN ep.s IS NULL THEN 1.0 ELSE greatest(0, least(seg.e, ep.e) - greatest(seg.s, ep.s) + 1)::DOUBLE / (ep.e - ep.s + 1) END AS share
  FROM ep JOIN seg ON seg.record = ep.record AND list_contains(seg.told, ep.type)),
lists AS (SELECT record, type, episode, list(segment ORDER BY share DESC, segment) AS segments, list(share ORDER BY share DESC, segment) AS shares, row_number() OVER (PARTITION BY record, type ORDER BY episode) AS n FROM offers WHERE share >= 0.5 GROUP BY record, type, episode),
fold AS (SELECT record, type, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS episode, NULL::BIGINT AS segment, NULL::DOUBLE AS share FROM (SELECT DISTINCT record, type FROM lists)
  UNION ALL SELECT record, type, n, CASE WHEN segment IS NULL THEN used ELSE list_append(used, segment) END, episode, segment, shares[list_position(segments, segment)] FROM (
    SELECT l.record, l.type, l.n, f.used, l.episode, l.segments, l.shares, list_filter(l.segments, lambda x: NOT list_contains(f.used, x))[1] AS segment FROM fold f JOIN lists l ON l.record = f.record AND l.type = f.type AND l.n = f.n + 1))
SELECT ep.record, ep.episode, ep.type, f.segment, round(f.share, 3) AS share FROM ep LEFT JOIN fold f ON f.record = ep.record AND f.type = ep.type AND f.episode = ep.episode"""


@query("txt_07_temporal_grounding", _GROUND)
def _(spark, d):
    n, c = F.col("interval_id"), F.col("agent")
    i = intervals(spark, d).select(F.floor(c / 10).alias("record"), "interval_id", "agent", "start_frame", (F.col("start_frame") + 200 + n % 90).alias("end_frame"))
    segments = i.where("interval_id % 2 = 1").select("record", n.alias("segment"), "start_frame", "end_frame", F.concat(_pick(PARTS, n), F.lit(" and "), _pick(PARTS, c)).alias("description"))
    episodes = i.where("interval_id % 2 = 0").select("record", n.alias("episode"), _pick(KINDS, n).alias("type"), F.when(n % 50 != 0, F.col("start_frame")).alias("start_frame"), "end_frame")
    return grounding.ground(segments, episodes, ["record"])


_ROLE = '{"speed_change": {}, "lateral_motion_evidence": [], "heading_motion": {' + ", ".join(f'"{k}": 0' for k in validation.HEADING_MOTION) + '}, "route_transition": {"transitions": [{"transition_frame": 1, ' + ", ".join(f'"{k}": null' for k in validation.TRANSITION) + "}], " + ", ".join(f'"{k}": null' for k in validation.ROUTE_TRANSITION if k != "transitions") + "}}"
_OBJECT = lambda keys: "{" + ", ".join(f'"{k}": null' for k in keys) + "}"
#: A valid record; ORDER and CUSTOMER stand for the two agents.
_RECORD = (
    '{"schema_version": "pair_physical_facts_v1", "pair": {"agent_A": {"id": ORDER, "object_type": 1, "is_object_of_interest": true}, "agent_B": {"id": CUSTOMER, "object_type": 1, "is_object_of_interest": true}}, "physical_facts": {"agent_A": '
    + _ROLE + ', "agent_B": ' + _ROLE + ', "pair_relation": {"common_valid_frame_count": 1, "travel_channel": {}, "longitudinal": {}, "per_frame": [' + _OBJECT(validation.FRAME)
    + ']}, "pair_geometry": {"heading_relation": {"status": "s", "dominant": "d", "frame_counts": {}, "runs": [], "heading_difference_summary_deg": ' + _OBJECT(validation.SUMMARY)
    + '}, "closest_approach": {"status": "none"}, "distance_evolution": {"status": "s", "overall": "o"}, "path_geometry": ' + _OBJECT(validation.PATH_GEOMETRY)
    + '}, "map_context": {"near_intersection": null, "nearby_crosswalk": null, "nearby_stop_sign": null, "nearby_traffic_signal": null, "intersection_evidence": ' + _OBJECT(validation.INTERSECTION) + "}}}"
)
#: (every n-th order, text to change, text in its place, the errors that this gives)
_DAMAGE = (
    (5, '_facts_v1"', '_facts_v2"', ["schema_version='pair_physical_facts_v2'"]),
    (7, '"id": CUSTOMER', '"id": -1', ["pair.agent_B.id mismatch"]),
    (11, '"speed_change": {}', '"speed": {}', ["missing physical_facts.agent_A.speed_change", "missing physical_facts.agent_B.speed_change"]),
    (13, '{"transition_frame": 1', '{"frame": 1', [f"missing physical_facts.{a}.route_transition.transitions[0].transition_frame" for a in ("agent_A", "agent_B")]),
    (17, '"runs": []', '"runs": {}', ["pair_geometry.heading_relation.runs is not a list"]),
    (19, '"status": "none"', '"status": "available", "frame": 3', ["missing pair_geometry.closest_approach.distance_m"]),
    (23, '"lane_graph_branching": null, ', "", ["missing physical_facts.map_context.intersection_evidence.lane_graph_branching"]),
)


def _record(order: Column, customer: Column) -> Column:
    """The text of an order's record with its damage: the pieces between what changes are literals."""

    def plain(text: str) -> Column:
        agents = {"ORDER": order, "CUSTOMER": customer}
        return F.concat(*(agents[p].cast("string") if p in agents else F.lit(p) for p in re.split("(ORDER|CUSTOMER)", text) if p))

    damage = {old: (n, new) for n, old, new, _ in _DAMAGE}
    pieces = [p for p in re.split("(" + "|".join(map(re.escape, damage)) + ")", _RECORD) if p]
    return F.concat(*(F.when(order % damage[p][0] == 0, damage[p][1]).otherwise(plain(p)) if p in damage else plain(p) for p in pieces))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WANTED = " || ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN {_quoted(''.join(e + ';' for e in errors))} ELSE '' END" for n, _, _, errors in _DAMAGE)


@query(
    "prj_18_structural_validator",
    # a record's errors come part by part: version, identities, agent_A, agent_B, the pair; so those of both agents are put in order by agent
    f"""WITH w AS (SELECT o_orderkey, string_split({_WANTED}, ';') AS e FROM orders),
    k AS (SELECT o_orderkey, list_filter(e, lambda x: x <> '') AS e FROM w),
    s AS (SELECT o_orderkey, list_concat(list_filter(e, lambda x: starts_with(x, 'schema')), list_filter(e, lambda x: contains(x, 'agent_A')), list_filter(e, lambda x: contains(x, 'agent_B')), list_filter(e, lambda x: NOT starts_with(x, 'schema') AND NOT contains(x, 'agent_'))) AS e FROM k)
    SELECT o_orderkey, len(e) = 0 AS valid, len(e) AS error_count, array_to_string(e, ';') AS errors FROM s""",
)
def _(spark, d):
    # two numbers a record are little to read and the record is much to check: a file's few splits are dealt to all cores
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    e = o.select("o_orderkey", validation.pair_facts_errors(_record(F.col("o_orderkey"), F.col("o_custkey")), F.col("o_orderkey"), F.col("o_custkey")).alias("e"))
    return e.select("o_orderkey", (F.size("e") == 0).alias("valid"), F.size("e").cast("long").alias("error_count"), F.array_join("e", ";").alias("errors"))
