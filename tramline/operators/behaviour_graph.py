"""Semantic behaviour graph, fact selection under a policy, and captions composed of the selected facts: column expressions over records.

A record has the columns subject, reference, behavior_type, behavior_subtype, interaction_type, before_lane, before_position, target_matches, after_lane,
after_position, subject_motion, reference_motion, direction and order_flip; any of them may be null. Nothing is inferred: what a record
doesn't say safely is left out, and a caption tells what was selected only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priorities of facts, the number of facts, and the facts that an interaction may and must tell.
PRIORITY = {
    "primary_behavior": 100, "enters_reference_lane": 90, "behind_to_ahead": 90, "stop_behind_reference": 90, "final_same_lane": 70, "final_adjacent_lanes": 70, "final_separate_lanes": 70, "final_position": 70,
    "reference_decelerating": 65, "reference_accelerating": 55, "reference_stable": 35, "subject_speed_trend": 30,
}
MOST = 3
ALLOWED = {
    "lane_change_merge": ("lane_change", "merge", "direction", "enters_reference_lane", "final_same_lane", "final_position", "reference_motion", "subject_speed_trend"),
    "lane_change_parallel": ("lane_change", "direction", "final_adjacent_lanes", "final_separate_lanes", "reference_motion"),
    "lane_change_overtake": ("lane_change", "direction", "behind_to_ahead", "final_same_lane", "reference_motion"),
    "overtake": ("lane_change", "direction", "behind_to_ahead", "final_same_lane", "reference_motion"),
    "pass": ("behind_to_ahead", "final_same_lane", "reference_motion"),
    "stop_behind_lead": ("following", "stop_behind_reference", "final_same_lane", "reference_motion"),
    "follow_approaching": ("following", "final_same_lane", "stop_behind_reference", "reference_motion", "subject_speed_trend", "distance_change"),
    "follow_decelerating": ("following", "final_same_lane", "stop_behind_reference", "reference_motion", "subject_speed_trend"),
    "follow_stable": ("following", "final_same_lane", "stop_behind_reference", "reference_motion", "subject_speed_trend"),
    "lane_change": ("lane_change", "direction", "reference_motion"),
}
REQUIRED = {
    "lane_change_overtake": ("lane_change", "behind_to_ahead"), "overtake": ("lane_change", "behind_to_ahead"), "pass": ("behind_to_ahead",), "stop_behind_lead": ("following", "stop_behind_reference"),
    "follow_approaching": ("following",), "follow_decelerating": ("following",), "follow_stable": ("following",), "lane_change": ("lane_change",),
}
LANES = {"same_lane": "same_lane", "different_lane": "different_lanes", "different_lanes": "different_lanes", "adjacent": "adjacent_lanes", "adjacent_lane": "adjacent_lanes", "adjacent_lanes": "adjacent_lanes"}
RELATIONS = ("final_lane_relation", "final_longitudinal_relation", "longitudinal_order_change", "stopping_relation")
MOTIONS = ("subject_motion", "reference_motion")

_FACT = "array<struct<key:string,type:string,value:string,priority:int>>"


def _lookup(table: dict, key: Column, kind: str = "string") -> Column:
    put = (lambda v: F.lit(v)) if kind == "string" else (lambda v: F.array(*map(F.lit, v)))
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), put(v))]), key)


def _among(c: Column, *values: str) -> Column:
    return F.when(c.isin(*values), c)


def behaviour_graph(records: DataFrame) -> DataFrame:
    """Adds ``graph``: the interaction with the names of its agents and what may be said of it.

    The record's interaction type stands; the behaviour type is taken where there is none. A position counts in the same lane only. A
    subtype that is no direction hides the evidence's direction.
    """
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    name = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c).cast("string").startswith("A"), F.col(c).cast("string")).otherwise(F.concat(F.lit("A"), F.col(c).cast("string"))))
    behaviour = F.coalesce(blank("behavior_type"), F.lit("unknown"))
    lane = lambda p: _lookup(LANES, F.coalesce(F.col(f"{p}_lane"), F.lit("")))
    place = lambda p: F.when(F.col(f"{p}_lane") == "same_lane", _among(F.col(f"{p}_position"), "ahead", "behind"))
    flip = F.coalesce(F.col("order_flip"), F.lit(False)) | F.coalesce((place("before") == "behind") & (place("after") == "ahead"), F.lit(False))
    trend = lambda c: _among(F.col(c), "accelerating", "decelerating", "stable")
    return records.withColumn(
        "graph",
        F.struct(
            name("subject").alias("initiator"), name("reference").alias("reference"), behaviour.alias("behavior_type"), blank("behavior_subtype").alias("behavior_subtype"), F.coalesce(blank("interaction_type"), behaviour).alias("interaction_type"),
            _among(F.coalesce(blank("behavior_subtype"), F.col("direction")), "left", "right").alias("direction"), lane("before").alias("lanes_before"), place("before").alias("position_before"),
            F.col("target_matches").alias("target_matches"), lane("after").alias("lanes_after"), place("after").alias("position_after"), flip.alias("order_flip"), trend("subject_motion").alias("initiator_motion"), trend("reference_motion").alias("reference_motion"),
        ),
    )


def primary_behaviour(behaviour: Column, interaction: Column) -> Column:
    following = (interaction == "stop_behind_lead") | interaction.startswith("follow_")
    changing = interaction.isin("lane_change_overtake", "overtake") | behaviour.isin("lane_change", "overtake", "avoid", "evasive_lane_change", "cut_in")
    return F.when(following, "following").when(changing, "lane_change").when(behaviour == "follow_stop", "following").otherwise(behaviour)


def select_facts(graphs: DataFrame) -> DataFrame:
    """Adds ``primary``, ``facts`` (key, type, value, priority), ``enters`` and ``turns``: at most MOST facts that the interaction may tell.

    The primary behaviour comes first, with its direction and the lane it enters where these may be told; then required facts that are known,
    one relation if none is among them, one motion likewise, by priority and in order of the record.
    """
    gr = lambda c: F.col(f"graph.{c}")
    primary = primary_behaviour(gr("behavior_type"), gr("interaction_type"))
    none = F.array().cast("array<string>")
    d = graphs.withColumn("primary", primary)
    d = d.withColumns({
        "_allowed": F.array_distinct(F.concat(F.array("primary"), F.coalesce(_lookup(ALLOWED, gr("interaction_type"), "list"), none))),
        "_required": F.coalesce(_lookup(REQUIRED, gr("interaction_type"), "list"), none),
    })
    may = lambda key: F.array_contains("_allowed", key)
    fact = lambda key, kind, value, priority: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit(priority).cast("int").alias("priority"))
    at_end = gr("lanes_after") == "same_lane"
    relations = [
        (gr("position_after").isNotNull(), "final_position", "final_longitudinal_relation", F.concat(F.lit("subject_"), gr("position_after"))), (at_end, "final_same_lane", "final_lane_relation", F.lit("same_lane")),
        (gr("lanes_after") == "adjacent_lanes", "final_adjacent_lanes", "final_lane_relation", F.lit("adjacent_lanes")), (gr("lanes_after") == "different_lanes", "final_separate_lanes", "final_lane_relation", F.lit("separate_lanes")),
        ((gr("interaction_type") == "stop_behind_lead") & at_end & (gr("position_after") == "behind"), "stop_behind_reference", "stopping_relation", F.lit("stop_behind_reference")),
        (gr("order_flip"), "behind_to_ahead", "longitudinal_order_change", F.lit("behind_to_ahead")),
    ]
    motions = [(gr("initiator_motion").isNotNull(), "subject_speed_trend", "subject_motion", gr("initiator_motion"))] + [(gr("reference_motion") == t, f"reference_{t}", "reference_motion", F.lit(t)) for t in ("decelerating", "accelerating", "stable")]
    offer = lambda rules: F.array_compact(F.array(*[F.when(c & (may(k) | may(t)), fact(k, t, v, PRIORITY[k])) for c, k, t, v in rules])).cast(_FACT)
    first = F.array(fact("", "primary_behavior", F.col("primary"), PRIORITY["primary_behavior"]).withField("key", F.col("primary"))).cast(_FACT)
    d = d.withColumns({"_relations": offer(relations), "_motions": offer(motions), "facts": first})

    def with_required(acc: Column, key: Column) -> Column:
        found = F.get(F.filter(F.concat("_relations", "_motions"), lambda f: f["key"] == key), 0)
        taken = F.exists(acc, lambda f: f["key"] == key) | (F.size(acc) >= MOST) | found.isNull()
        return F.when(taken, acc).otherwise(F.array_append(acc, found))

    d = d.withColumn("facts", F.aggregate("_required", F.col("facts"), with_required))
    for name, kinds in (("_relations", RELATIONS), ("_motions", MOTIONS)):
        top = F.array_max(F.transform(name, lambda f: f["priority"]))
        best = F.get(F.filter(name, lambda f: f["priority"] == top), 0)
        full = (F.size("facts") >= MOST) | F.exists("facts", lambda f: f["type"].isin(*kinds)) | best.isNull()
        d = d.withColumn("facts", F.when(full, F.col("facts")).otherwise(F.array_append("facts", best)))
    turns, enters = F.when(may("direction"), gr("direction")), F.coalesce(gr("target_matches") & may("enters_reference_lane"), F.lit(False))
    return d.withColumns({"turns": turns, "enters": enters}).drop("_relations", "_motions")


def policy_audit(selected: DataFrame) -> DataFrame:
    """Adds ``missing_required``: required facts that weren't selected, in order; ``select_facts`` gives what is asked."""
    told = F.concat(F.transform("facts", lambda f: f["key"]), F.when(F.col("turns").isNotNull(), F.array(F.lit("direction"))).otherwise(F.array().cast("array<string>")), F.when(F.col("enters"), F.array(F.lit("enters_reference_lane"))).otherwise(F.array().cast("array<string>")))
    return selected.withColumn("missing_required", F.array_except("_required", told))


def _chain(*cases: tuple[Column, Column], default: Column) -> Column:
    """The first case that holds; an unknown condition doesn't."""
    return reduce(lambda rest, case: F.when(F.coalesce(case[0], F.lit(False)), case[1]).otherwise(rest), reversed(cases), default)


def caption(graph: str = "graph") -> Column:
    """One sentence of the behaviour, and one of the motion on a line of its own where one was selected."""
    subject, reference = F.coalesce(F.col(f"{graph}.initiator"), F.lit("The subject vehicle")), F.col(f"{graph}.reference")
    has = lambda key: F.exists("facts", lambda f: f["key"] == key)
    of = lambda kind: F.get(F.filter("facts", lambda f: f["type"] == kind), 0)["value"]
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    known, turned, flip = reference.isNotNull(), F.col("turns").isNotNull(), has("behind_to_ahead")
    same, end = has("final_same_lane"), F.get(F.filter("facts", lambda f: f["key"] == "final_position"), 0)["value"]
    change = _chain(
        (known & flip, say(subject, " overtakes ", reference, " by ", F.when(turned, say("changing to the ", F.col("turns"), " lane")).otherwise("changing lanes"))),
        (known & F.col("enters"), say(subject, " ", F.when(turned, say("moves ", F.col("turns"))).otherwise("moves laterally"), " into ", reference, "'s lane")),
        default=say(subject, " changes ", F.when(turned, say("to the ", F.col("turns"), " lane")).otherwise("lanes")),
    )
    merge = say(subject, " merges", F.when(turned, say(" ", F.col("turns"))).otherwise(""), F.when(known & F.col("enters"), say(" into the lane occupied by ", reference)).otherwise(""))
    follow = _chain((known & has("stop_behind_reference"), say(subject, " stops behind ", reference)), (known & same, say(subject, " follows behind ", reference, " in the same lane")), default=say(subject, " follows ", F.coalesce(reference, F.lit("the lead vehicle"))))
    passing = _chain((known & flip, say(subject, " passes ", reference, ", moving from behind to ahead")), (known, say(subject, " passes ", reference)), default=say(subject, " passes another vehicle"))
    what = F.col("primary")
    clause = _chain((what == "lane_change", change), (what == "merge", merge), (what == "following", follow), (what == "pass", passing), default=say(subject, " performs ", F.replace(what, F.lit("_"), F.lit(" "))))
    tail = F.when(known & ~flip, _chain(
        (end == "subject_ahead", say(" and ends ahead of ", reference)), (end == "subject_behind", say(" and ends behind ", reference)), (same & ~F.col("enters") & (what != "following"), say(" and ends in the same lane as ", reference)),
        (has("final_adjacent_lanes"), say(" while ", reference, " remains in the adjacent lane")), (has("final_separate_lanes"), say(" while ", reference, " remains in a separate lane")), default=F.lit(""),
    )).otherwise("")
    other, own = of("reference_motion"), of("subject_motion")
    near = F.col("enters") | same | end.isNotNull()
    motion = _chain(
        (known & (other == "decelerating"), say(reference, " decelerates during the maneuver.")), (known & (other == "accelerating"), say(reference, " accelerates during the maneuver.")),
        (known & (other == "stable"), say(reference, F.when(near, " remains in the lane and maintains a relatively steady speed.").otherwise(" maintains a relatively steady speed."))),
        (own == "decelerating", say(subject, " decelerates during the maneuver.")), (own == "accelerating", say(subject, " accelerates during the maneuver.")), (own == "stable", say(subject, " maintains a relatively steady speed.")), default=F.lit(""),
    )
    return say(clause, tail, ".", F.when(motion != "", say("\n", motion)).otherwise(""))
