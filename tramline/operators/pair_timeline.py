"""Pair timeline: the lane transition that changes a pair's relation, three phases around it and five three-valued facts.

``a`` and ``b`` have (key columns of the pair, frame, valid, lane_id, x, y, heading, speed), one row for each frame of either agent.
All joins are by key and frame; what is gathered for a pair is at most a phase of CONTEXT frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr

#: Frames of a stable lane, frames of the phases before and after, frames of the speed before, the loss of speed that counts
#: (m/s), and the distance along the reference's heading that counts as beside (m).
STABLE = 3
CONTEXT = 20
SPEED_FRAMES = 10
SLOWED = 0.5
BESIDE = 0.5

_STATE = ("valid", "lane_id", "x", "y", "heading", "speed")


def relative_position(x: Column, y: Column, of_x: Column, of_y: Column, heading: Column) -> Column:
    """'ahead', 'behind' or 'alongside' of a reference, along its heading; null where anything is unknown or not finite."""
    along = (x - of_x) * F.cos(heading) + (y - of_y) * F.sin(heading)
    known = along.isNotNull() & ~F.isnan(along) & (F.abs(along) != float("inf"))
    return F.when(known, F.when(along > BESIDE, "ahead").when(along < -BESIDE, "behind").otherwise("alongside"))


def lane_transitions(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, from_lane, to_lane, transition_frame, start_frame, end_frame): stable lanes that differ, in a row. Frames without a valid lane
    end a run, and runs under STABLE frames don't count."""
    runs = fr.runs(states.where("valid and lane_id is not null"), key, "frame", "lane_id", gaps=True).where(F.col("n") >= STABLE)
    w = Window.partitionBy(*key).orderBy("start_frame")
    r = runs.withColumns({"to_lane": F.lead("lane_id").over(w), "transition_frame": F.lead("start_frame").over(w), "_end": F.lead("end_frame").over(w)})
    return r.where("lane_id <> to_lane").select(*key, F.col("lane_id").alias("from_lane"), "to_lane", "transition_frame", "start_frame", F.col("_end").alias("end_frame"))


def paired_frames(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Every frame of either agent: both states, ``common``, ``distance``, and the relations of lanes and positions, from both sides."""
    side = lambda df, p: df.select(*key, "frame", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in _STATE])
    f = side(a, "a").join(side(b, "b"), [*key, "frame"], "full")
    lane = lambda p: F.when(F.col(f"{p}_valid"), F.col(f"{p}_lane_id"))
    both = F.col("a_valid") & F.col("b_valid")
    of = lambda s, r: F.when(both, relative_position(F.col(f"{s}_x"), F.col(f"{s}_y"), F.col(f"{r}_x"), F.col(f"{r}_y"), F.col(f"{r}_heading")))
    away = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    f = f.withColumns({
        "a_lane": lane("a"), "b_lane": lane("b"), "common": F.coalesce(F.col("a_here") & F.col("b_here"), F.lit(False)),
        "a_position": of("a", "b"), "b_position": of("b", "a"), "distance": F.when(both & ~F.isnan(away) & (away != float("inf")), away),
    })
    same = F.coalesce(F.col("a_lane") == F.col("b_lane"), F.lit(False))
    relation = F.when(same, "same_lane").when(F.col("a_lane").isNotNull() & F.col("b_lane").isNotNull(), "different_lane").otherwise("unknown")
    return f.withColumns({"same": same, "lane_relation": relation})


def pair_event(frames: DataFrame, a_events: DataFrame, b_events: DataFrame, key: list[str]) -> DataFrame:
    """(key, source_agent, transition_frame): the transition with most evidence of those that change whether the lanes are the same, or the
    order of the two. Same lane afterwards counts first, then the order, then the earlier, then agent_A's."""
    events = a_events.select(*key, "transition_frame", F.lit("agent_A").alias("source_agent")).unionByName(b_events.select(*key, "transition_frame", F.lit("agent_B").alias("source_agent")))
    at = lambda p, shift: frames.select(*key, (F.col("frame") - shift).alias("transition_frame"), F.col("same").alias(f"{p}_same"), F.col("a_position").alias(f"{p}_position"))
    j = events.join(at("before", -1), [*key, "transition_frame"], "left").join(at("after", STABLE - 1), [*key, "transition_frame"], "left").fillna(False, ["before_same", "after_same"])
    flip = F.coalesce(F.col("before_position") != F.col("after_position"), F.lit(False))
    j = j.withColumn("flip", flip).where((F.col("before_same") != F.col("after_same")) | F.col("flip"))
    best = Window.partitionBy(*key).orderBy(F.desc("after_same"), F.desc("flip"), "transition_frame", "source_agent")
    return j.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*key, "source_agent", "transition_frame")


def _first_mode(values: Column) -> Column:
    """Of an array, without nulls: the commonest value, the first met of equals; null if there is none."""
    some = F.array_compact(values)
    ranked = F.transform(F.array_distinct(some), lambda v, i: F.struct((-F.size(F.filter(some, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.array_min(ranked)["v"]


def _phase(rows: Column, p: str) -> Column:
    """From a phase's (frame, lane_relation, position, ...) in order; ``p`` is the agent whose position is told."""
    field = lambda name: F.transform(rows, lambda s: s[name])
    lanes = lambda name: F.array_sort(F.array_distinct(F.array_compact(field(name))))
    n = F.size(rows)
    return F.struct(
        F.get(rows, 0)["frame"].alias("frame_start"), F.get(rows, n - 1)["frame"].alias("frame_end"), n.alias("frame_count"),
        F.when(n > 0, _first_mode(field("lane_relation"))).alias("lane_relation"), _first_mode(field(f"{p}_position")).alias("relative_position"), lanes("a_lane").alias("agent_A_lane_ids"), lanes("b_lane").alias("agent_B_lane_ids"),
    )


def pair_timeline(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row a pair that has a common frame: the window, the phases, the facts and what they say of each agent.

    Without a pair event the window is the frame of closest approach (an unknown distance last, one of exactly zero before that), and the
    five facts are null. ``lane_change_events`` counts all of an agent's transitions, also those that aren't the pair's.
    """
    frames = paired_frames(a, b, key)
    a_events, b_events = lane_transitions(a, key), lane_transitions(b, key)
    event = pair_event(frames, a_events, b_events, key)
    order = F.struct(F.col("distance").isNull(), F.coalesce(F.nullif("distance", F.lit(0.0)), F.lit(float("inf"))), "frame")
    nearest = frames.where("common").groupBy(*key).agg(F.min_by("frame", order).alias("_nearest"))
    window = nearest.join(event, key, "left").withColumns({"start": F.coalesce("transition_frame", "_nearest"), "end": F.coalesce(F.col("transition_frame") + (STABLE - 1), "_nearest")}).drop("_nearest")
    f = frames.where("common").join(window.select(*key, "start", "end"), key)
    phase = F.when(F.col("frame") < F.col("start"), "before").when(F.col("frame") > F.col("end"), "after").otherwise("during")
    f = f.withColumn("phase", phase)
    w = Window.partitionBy(*key, "phase")
    near = F.when(F.col("phase") == "before", F.row_number().over(w.orderBy(F.desc("frame")))).otherwise(F.row_number().over(w.orderBy("frame")))
    f = f.withColumn("_k", near).where((F.col("phase") == "during") | (F.col("_k") <= CONTEXT))
    row = F.struct("frame", "lane_relation", "a_position", "b_position", "a_lane", "b_lane", "b_speed", "_k")
    rows = lambda name: F.sort_array(F.collect_list(F.when(F.col("phase") == name, row)))
    g = f.groupBy(*key).agg(*[rows(p).alias(p) for p in ("before", "during", "after")])
    speeds = lambda c: F.filter(F.transform(c, lambda s: s["b_speed"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    recent = speeds(F.filter("before", lambda s: s["_k"] <= SPEED_FRAMES))
    g = g.withColumns({"_recent": recent, "_now": speeds(F.col("during")), "_b": F.element_at(F.when(F.size("before") > 0, F.col("before")), -1), "_a": F.get("after", 0)})
    mean = F.when(F.size("_recent") > 0, F.aggregate("_recent", F.lit(0.0), lambda s, v: s + v) / F.size("_recent"))
    g = g.withColumns({"b_speed_before": mean, "b_speed_min": F.array_min("_now")})
    count = lambda e, name: e.groupBy(*key).agg(F.count("*").alias(name))
    own = a_events.select(*key, "transition_frame", F.lit(True).alias("_own")).distinct()
    t = window.join(g, key).join(count(a_events, "a_changes"), key, "left").join(count(b_events, "b_changes"), key, "left").join(own, [*key, "transition_frame"], "left")
    found = F.col("transition_frame").isNotNull()
    fact = lambda c: F.when(found, F.coalesce(c, F.lit(False)))
    before, after = _phase(F.col("before"), "a"), _phase(F.col("after"), "a")
    facts = {
        "a_changed_lane": fact(F.col("_own")), "b_maintained_lane": fact(F.col("_b.b_lane") == F.col("_a.b_lane")),
        "a_entered_b_lane": fact((F.col("_a.a_lane") == F.col("_a.b_lane")) & ~F.col("_b.a_lane").eqNullSafe(F.col("_a.a_lane"))),
        "a_behind_to_ahead": fact((before["relative_position"] == "behind") & (after["relative_position"] == "ahead")),
        "b_speed_reduced": fact(F.col("b_speed_before") - F.col("b_speed_min") >= SLOWED),
    }
    slow = lambda s: ~F.isnan(s["b_speed"]) & (s["b_speed"] <= F.col("b_speed_before") - SLOWED)
    t = t.withColumns({**facts, "deceleration_onset": F.get(F.filter("during", slow), 0)["frame"]})
    said = lambda *pairs: F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in pairs]))
    phases = {f"{p}_{q}": _phase(F.col(q), p) for p in "ab" for q in ("before", "during", "after")}
    return t.select(
        *key, F.when(found, "pair_transition").otherwise("no_pair_transition_closest_approach_anchor").alias("status"), "transition_frame", "source_agent", "start", "end",
        *[v.alias(n) for n, v in phases.items()], *facts, "b_speed_before", "b_speed_min", "deceleration_onset", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_changes", "b_changes")],
        said(("a_changed_lane", "changed_lane"), ("a_behind_to_ahead", "moved_from_behind_to_ahead"), ("a_entered_b_lane", "entered_agent_B_lane")).alias("a_facts"),
        said(("b_maintained_lane", "maintained_lane"), ("b_speed_reduced", "reduced_speed")).alias("b_facts"),
    )
