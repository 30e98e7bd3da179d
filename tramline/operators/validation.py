"""Structural validation of pair-facts records: JSON text in, every violation with its path out, as one column expression.

The text is parsed to a variant once, each part of it is taken once, and the rules look at these; so a key that is absent, null, or of another
type is told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The schema's name, the object type of a vehicle, and the keys that the parts of a record must have.
SCHEMA_VERSION = "pair_physical_facts_v1"
VEHICLE = 1
HEADING_MOTION = ("status", "heading_start_deg", "heading_end_deg", "net_heading_change_deg", "heading_change_direction", "turning_episode", "start_frame", "end_frame")
TRANSITION = ("lane_before", "lane_after", "incoming_lane_heading_deg", "outgoing_lane_heading_deg", "lane_heading_change_deg", "connected_in_lane_graph")
ROUTE_TRANSITION = ("route_transition", "transitions", "primary_transition", *TRANSITION)
LATERAL = ("lateral_motion_evidence", "physical_lateral_motion_evidence", "physical_lateral_maneuver")
PAIR_RELATION = ("common_valid_frame_count", "travel_channel", "longitudinal", "per_frame")
FRAME = ("frame", "distance_m", "travel_channel_relation", "longitudinal_relation")
GEOMETRY = ("heading_relation", "closest_approach", "distance_evolution", "path_geometry")
HEADING_RELATION = ("status", "dominant", "frame_counts", "runs")
SUMMARY = ("median", "min", "max")
PATH_GEOMETRY = ("status", "min_path_distance_m", "closest_path_points", "spatial_overlap", "convergence_status")
MAP_CONTEXT = ("near_intersection", "intersection_evidence", "nearby_crosswalk", "nearby_stop_sign", "nearby_traffic_signal")
INTERSECTION = ("lane_graph_branching", "nearby_crosswalk", "nearby_traffic_signal", "nearby_stop_sign")


#: The keys of an object, without its values; null for what is no object.
KEYS = "map<string,struct<_:boolean>>"
ROLES = ("agent_A", "agent_B")
#: (path, type): all that is looked at, each once a record. Most are objects of which it is asked what keys they have.
PARTS = {
    "schema_version": "variant", "pair": KEYS, "physical_facts": KEYS,
    **{f"pair.{a}{k}": t for a in ROLES for k, t in (("", KEYS), (".id", "bigint"), (".is_object_of_interest", "variant"), (".object_type", "bigint"))},
    **{f"physical_facts.{a}{k}": t for a in ROLES for k, t in (
        ("", KEYS), (".heading_motion", KEYS), (".route_transition", KEYS), (".route_transition.transitions", f"array<{KEYS}>"), (".route_transition.primary_transition", "variant"),
    )},
    "physical_facts.pair_relation": KEYS, "physical_facts.pair_relation.per_frame": f"array<{KEYS}>",
    **{f"physical_facts.pair_geometry{k}": KEYS for k in ("", *(f".{k}" for k in GEOMETRY), ".heading_relation.frame_counts", ".heading_relation.heading_difference_summary_deg")},
    "physical_facts.pair_geometry.heading_relation.runs": "array<struct<_:boolean>>", "physical_facts.pair_geometry.closest_approach.status": "string",
    "physical_facts.map_context": KEYS, "physical_facts.map_context.intersection_evidence": KEYS,
}


class _Record:
    """Looks at the parts of a variant column; paths are dotted keys from its root."""

    def __init__(self, parts: Column):
        self.parts = parts

    @staticmethod
    def of(value: Column) -> Column:
        return F.struct(*(F.try_variant_get(value, "$." + path, kind).alias(path) for path, kind in PARTS.items()))

    def get(self, path: str) -> Column:
        return self.parts[path]

    def has(self, path: str) -> Column:
        """The key is there, with null too."""
        whole, _, key = path.rpartition(".")
        return F.coalesce(F.map_contains_key(self.get(whole), key), F.lit(False))

    def is_there(self, path: str) -> Column:
        """The value at the path is of the type of PARTS, such as an object."""
        return self.get(path).isNotNull()

    def is_true(self, path: str) -> Column:
        return F.coalesce((F.schema_of_variant(self.get(path)) == "BOOLEAN") & F.try_variant_get(self.get(path), "$", "boolean"), F.lit(False))

    def lacks(self, path: str, keys: tuple[str, ...], prefix: str) -> Column:
        """A message for each key that an object hasn't."""
        lost = F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.map_keys(self.get(path)), F.array().cast("array<string>")))
        return F.transform(lost, lambda k: F.concat(F.lit(f"{prefix}."), k))


def _list(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def _only(condition: Column, messages: Column) -> Column:
    return F.when(condition, messages).otherwise(F.array().cast("array<string>"))


def _agent(r: _Record, role: str, expected: Column) -> list[Column]:
    """Arrays of messages."""
    who, facts = f"pair.{role}", f"physical_facts.{role}"
    known = r.is_there(who)
    of = _list(
        F.when(~F.coalesce(r.get(f"{who}.id") == expected, F.lit(False)), f"{who}.id mismatch"),
        F.when(~r.is_true(f"{who}.is_object_of_interest"), f"{who}.is_object_of_interest is not true"),
        F.when(~F.coalesce(r.get(f"{who}.object_type") == VEHICLE, F.lit(False)), f"{who}.object_type is not vehicle"),
    )
    lateral = F.lit(False)
    for k in LATERAL:
        lateral = lateral | r.has(f"{facts}.{k}")
    heading, route = f"{facts}.heading_motion", f"{facts}.route_transition"
    primary = r.get(f"{route}.primary_transition")
    return [
        _list(F.when(~known, f"missing {who}")), _only(known, of), _list(F.when(~lateral, f"missing {facts}.lateral_motion_evidence"), F.when(~r.has(f"{facts}.speed_change"), f"missing {facts}.speed_change"), F.when(~r.is_there(heading), f"missing {heading}")),
        _only(r.is_there(heading), r.lacks(heading, HEADING_MOTION, f"missing {heading}")), _list(F.when(~r.is_there(route), f"missing {route}")),
        _only(r.is_there(route), F.concat(r.lacks(route, ROUTE_TRANSITION, f"missing {route}"), _list(
            F.when(~r.is_there(f"{route}.transitions"), f"{route}.transitions is not a list"),
            F.when(primary.isNotNull() & ~F.is_variant_null(primary) & F.try_variant_get(primary, "$", KEYS).isNull(), f"{route}.primary_transition is not an object or null"),
        ))),
        _transitions(r, role),
    ]


def _transitions(r: _Record, role: str) -> Column:
    """Messages of the single transitions, as an array."""
    path = f"physical_facts.{role}.route_transition.transitions"

    def one(keys: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        lost = [F.when(~F.map_contains_key(keys, k), F.concat(F.lit("missing "), at, F.lit(f".{k}"))) for k in ("transition_frame", *TRANSITION)]
        return F.when(keys.isNull(), F.array(F.concat(at, F.lit(" is not an object")))).otherwise(_list(*lost))

    return F.coalesce(F.flatten(F.transform(r.get(path), one)), F.array().cast("array<string>"))


def _pair(r: _Record) -> list[Column]:
    """Arrays of messages."""
    relation, geometry, context = "physical_facts.pair_relation", "physical_facts.pair_geometry", "physical_facts.map_context"
    frames = r.get(f"{relation}.per_frame")

    def incomplete(keys: Column) -> Column:
        lost = F.lit(False)
        for k in FRAME:
            lost = lost | ~F.map_contains_key(keys, k)
        return keys.isNull() | lost

    heading, closest, evolution, way = (f"{geometry}.{k}" for k in GEOMETRY)
    where = f"{context}.intersection_evidence"
    short = lambda k: f"missing pair_geometry.{k}"
    summary = f"{heading}.heading_difference_summary_deg"
    told = r.is_there(summary)
    for k in SUMMARY:
        told = told & r.has(f"{summary}.{k}")
    asked = lambda path: ~r.has(path) | r.is_there(path)  # noqa: E731  a part of another type is told once and not looked into
    available = F.coalesce(r.get(f"{closest}.status") == "available", F.lit(False))
    return [
        _list(F.when(~r.is_there(relation), f"missing {relation}")), r.lacks(relation, PAIR_RELATION, f"missing {relation}"),
        _list(
            F.when(frames.isNull(), f"{relation}.per_frame is not a list").when(F.exists(frames, incomplete), "incomplete pair_relation.per_frame entry"),
            F.when(~r.is_there(geometry), f"missing {geometry}"), *[F.when(~r.is_there(f"{geometry}.{k}"), f"missing {geometry}.{k}") for k in GEOMETRY],
        ),
        _only(asked(heading), F.concat(r.lacks(heading, HEADING_RELATION, short("heading_relation")), _list(
            F.when(~r.is_there(f"{heading}.runs"), "pair_geometry.heading_relation.runs is not a list"),
            F.when(~r.is_there(f"{heading}.frame_counts"), "pair_geometry.heading_relation.frame_counts is not an object"), F.when(~told, "incomplete pair_geometry.heading_relation.heading_difference_summary_deg"),
        ))),
        _only(asked(closest), F.concat(_list(F.when(~r.has(f"{closest}.status"), short("closest_approach.status"))), _only(available, r.lacks(closest, ("frame", "distance_m"), short("closest_approach"))))),
        _only(asked(evolution), r.lacks(evolution, ("status", "overall"), short("distance_evolution"))), _only(asked(way), r.lacks(way, PATH_GEOMETRY, short("path_geometry"))),
        _list(F.when(~r.is_there(context), f"missing {context}")),
        _only(r.is_there(context), F.concat(
            r.lacks(context, MAP_CONTEXT, f"missing {context}"), _list(F.when(~r.is_there(where), f"{where} is not an object")), _only(r.is_there(where), r.lacks(where, INTERSECTION, f"missing {where}")),
        )),
    ]


def pair_facts_errors(text: Column, agent_a: Column, agent_b: Column) -> Column:
    """All violations of a record of the pair (agent_a, agent_b), in the order of its parts; none for a valid one.

    Text that is null or no JSON (NaN is none) has the one error not_json_safe. Parts that are missing are told, and so is what they lack.
    """

    # a function's argument is evaluated once, an expression as often as it is named
    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def told(parts: Column) -> Column:
        r = _Record(parts)
        found = r.get("schema_version")
        version = F.try_variant_get(found, "$", "string")
        shown = F.when(version.isNull(), "None").when(F.schema_of_variant(found) == "STRING", F.concat(F.lit("'"), version, F.lit("'"))).otherwise(version)
        head = _list(F.when(~F.coalesce(version == SCHEMA_VERSION, F.lit(False)), F.concat(F.lit("schema_version="), shown)), *[F.when(~r.is_there(k), f"missing {k}") for k in ("pair", "physical_facts")])
        return F.concat(head, *_agent(r, "agent_A", agent_a), *_agent(r, "agent_B", agent_b), *_pair(r))

    return once(F.try_parse_json(text), lambda value: F.when(value.isNull(), F.array(F.lit("not_json_safe"))).otherwise(once(_Record.of(value), told)))
