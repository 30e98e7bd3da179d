"""From a track's lane matches to lane behaviour: reliable runs, transitions told by the lane topology, route transitions.

Tables: ``matches`` has (entity columns, frame, valid, available, lane_id, group_id, confidence, x, y), one row for every frame of a
track; ``lanes`` has (lane_id, group_id, points, exits, entries, left, right), where ``left`` and ``right`` are arrays of
(lane_id, first, last): a neighbour along the points first to last of this lane, or along all of it where these are null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geometry as g

from . import frames as fr
from . import kernels as k

#: Least confidence of a reliable match, frames between a transition and the lateral episode that confirms it, and
#: frames on each side of a transition that give its headings.
CONFIDENCE = 0.30
REACH = 8
HEADING_FRAMES = 5


def stabilised(matches: DataFrame, entity: list[str], passes: int | None = None) -> DataFrame:
    """``matches`` and ``raw`` (the matched lane), ``reliable`` (where the confidence suffices), ``stable`` (without flickers).

    A flicker is a short return A-B-A of lower confidence; A-B-C stays. All flickers go, or the first ``passes`` of a track. Invalid and unmatched frames are null in all three.
    """
    seen = F.col("valid") & F.col("available")
    raw = F.when(seen, F.col("lane_id")).cast("long")
    m = matches.withColumn("raw", raw).withColumn("reliable", F.when(F.coalesce("confidence", F.lit(0.0)) >= CONFIDENCE, F.col("raw")))
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*entity, "frame")) + ", stable long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        values = [None if v is None or v != v else int(v) for v in pdf["reliable"]]
        return pdf[[*entity, "frame"]].assign(stable=pd.array(k.drop_flickers(values, [c if a else None for a, c in zip(pdf["available"], pdf["confidence"])], passes=passes)[0], dtype="Int64"))

    held = m.select(*entity, "frame", "reliable", "available", "confidence").groupBy(*entity).applyInPandas(run, schema)
    return m.join(held, [*entity, "frame"])


def reliable_runs(stable: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, lane_id, continuous_lane_id, start_frame, end_frame, x, y): runs of ``stable``, with the last frame's position."""
    s = fr.run_ids(stable.where("stable is not null"), entity, "frame", "stable", gaps=True)
    last = F.max_by(F.struct("x", "y"), "frame")
    r = s.groupBy(*entity, "run", "stable").agg(F.min_by("group_id", "frame").alias("continuous_lane_id"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), last.alias("_at"))
    return r.select(*entity, F.col("stable").alias("lane_id"), "continuous_lane_id", "start_frame", "end_frame", "_at.x", "_at.y")


def neighbour_side(s: Column, to_lane: Column, points: Column, left: Column, right: Column) -> Column:
    """'left' or 'right' if the lane names ``to_lane`` there at arc length ``s`` (anywhere, if either is unknown); else null."""

    def names(ids: Column) -> Column:
        def holds(n: Column) -> Column:
            a, b = g.arc_at(points, n["first"]), g.arc_at(points, n["last"])
            inside = s.between(F.least(a, b), F.greatest(a, b))
            return (n["lane_id"] == to_lane) & (s.isNull() | n["first"].isNull() | n["last"].isNull() | inside)

        return F.coalesce(F.exists(ids, holds), F.lit(False))

    return F.when(names(left), "left").when(names(right), "right")


def transitions(runs: DataFrame, lanes: DataFrame, lateral: DataFrame, entity: list[str]) -> DataFrame:
    """Changes of the lane between runs without a frame between them, in order of what proves them: a continuation that either
    lane declares, a neighbour at the place, one continuous lane, or unknown.

    ``lateral``: (entity, start_frame, end_frame, direction), the episodes of lateral motion; those within REACH frames are listed by
    their number in order of time. A lane change is supported where an episode goes to the side of the neighbour.
    """
    w = Window.partitionBy(*entity).orderBy("start_frame")
    step = runs.withColumns({"to_lane": F.lead("lane_id").over(w), "transition_frame": F.lead("start_frame").over(w), "to_frame": F.lead("end_frame").over(w)})
    step = step.where((F.col("end_frame") + 1 == F.col("transition_frame")) & (F.col("lane_id") != F.col("to_lane"))).withColumnsRenamed({"lane_id": "from_lane", "start_frame": "from_frame"})
    a = lanes.select(F.col("lane_id").alias("from_lane"), F.lit(True).alias("_known"), F.col("group_id").alias("from_group"), "points", "exits", "left", "right")
    b = lanes.select(F.col("lane_id").alias("to_lane"), F.col("group_id").alias("to_group"), "entries")
    episode = F.struct("start_frame", "end_frame", "direction")
    episodes = lateral.groupBy(*entity).agg(F.sort_array(F.collect_list(episode)).alias("_e"))
    j = step.join(a, "from_lane", "left").join(b, "to_lane", "left").join(episodes, entity, "left")
    j = j.withColumn("source_s", F.when(F.col("_known"), g.project(F.col("x"), F.col("y"), F.col("points"))["s"]))
    j = j.withColumn("side", neighbour_side(F.col("source_s"), F.col("to_lane"), F.col("points"), F.col("left"), F.col("right")))
    exits, entries = (F.coalesce(F.array_contains(ids, lane), F.lit(False)) for ids, lane in (("exits", F.col("to_lane")), ("entries", F.col("from_lane"))))
    relation = (
        F.when(exits | entries, "continuation").when(F.col("side").isNotNull(), F.concat("side", F.lit("_neighbor")))
        .when(F.col("from_group").eqNullSafe(F.col("to_group")), "same_continuous_lane_group").otherwise("unknown")
    )
    evidence = F.array_compact(
        F.array(
            F.when(exits, "source_exit_lane"), F.when(entries, "target_entry_lane"), F.when(F.col("side").isNotNull() & ~exits & ~entries, F.concat(F.lit("source_"), "side", F.lit("_neighbor"))),
            F.when(F.col("relation") == "same_continuous_lane_group", "continuous_lane_group_audit_only"),
        )
    )
    near = lambda e: (e["start_frame"] <= F.col("transition_frame") + REACH) & (e["end_frame"] >= F.col("transition_frame") - REACH)
    numbered = F.filter(F.transform(F.coalesce("_e", F.array().cast("array<struct<start_frame:bigint,end_frame:bigint,direction:string>>")), lambda e, i: F.struct(i.alias("i"), near(e).alias("near"), e["direction"].alias("d"))), lambda e: e["near"])
    j = j.withColumn("relation", relation).withColumn("_near", numbered)
    return j.select(
        *entity, "transition_frame", "from_lane", "to_lane", "from_group", "to_group", "from_frame", "to_frame", "relation", evidence.alias("evidence"), F.round("source_s", 3).alias("source_s"), "side",
        F.transform("_near", lambda e: e["i"]).alias("episodes"), F.coalesce(F.exists("_near", lambda e: e["d"] == F.col("side")), F.lit(False)).alias("supported"),
    )


def unresolved_gaps(stable: DataFrame, runs: DataFrame, lanes: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, start_frame, end_frame, before_lane, after_lane, gap_types): frames without a reliable lane between runs on
    different lanes that are no one continuous lane."""
    w = Window.partitionBy(*entity).orderBy("start_frame")
    pairs = runs.withColumns({"after_lane": F.lead("lane_id").over(w), "_next": F.lead("start_frame").over(w)})
    pairs = pairs.where((F.col("_next") - F.col("end_frame") > 1) & (F.col("lane_id") != F.col("after_lane"))).select(*entity, F.col("lane_id").alias("before_lane"), "after_lane", (F.col("end_frame") + 1).alias("start_frame"), (F.col("_next") - 1).alias("end_frame"))
    of = lambda side: lanes.select(F.col("lane_id").alias(f"{side}_lane"), F.col("group_id").alias(f"_{side}"))
    pairs = pairs.join(of("before"), "before_lane", "left").join(of("after"), "after_lane", "left").where(~F.coalesce(F.col("_before") == F.col("_after"), F.lit(False)))
    empty = fr.run_ids(stable.withColumn("_none", F.col("stable").isNull()), entity, "frame", "_none", gaps=True).where("_none")
    spans = empty.groupBy(*entity, "run").agg(F.min("frame").alias("start_frame"), F.bool_or(F.col("raw").isNotNull()).alias("_rejected"), F.bool_or(F.col("raw").isNull()).alias("_missing"))
    kinds = F.array_compact(F.array(F.when(F.col("_rejected"), "confidence_rejected"), F.when(F.col("_missing"), "match_unavailable")))
    return pairs.join(spans.drop("run"), [*entity, "start_frame"]).select(*entity, "start_frame", "end_frame", "before_lane", "after_lane", kinds.alias("gap_types"))


def lane_behaviour(stable: DataFrame, runs: DataFrame, changes: DataFrame, gaps: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, status, lane_chain, gaps, behavior), one row a track.

    Unknown without a run, over an unresolved gap, or where a transition is unknown or a neighbour without the motion; else the change to
    the one side, mixed behaviour for both, or lane_keep.
    """
    every = stable.select(*entity).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("start_frame", "lane_id")))
    chain = runs.groupBy(*entity).agg(F.transform(ordered, lambda s: s["lane_id"]).alias("_c"))
    chain = chain.select(*entity, F.filter("_c", lambda x, i: (i == 0) | (F.get("_c", i - 1) != x)).alias("lane_chain"))
    told = changes.groupBy(*entity).agg(F.sort_array(F.collect_set(F.when(F.col("supported"), F.col("side")))).alias("_sides"), F.bool_or(F.col("relation").isin("unknown", "left_neighbor", "right_neighbor")).alias("_open"))
    n = gaps.groupBy(*entity).agg(F.count("*").alias("gaps"))
    j = every.join(chain, entity, "left").join(told, entity, "left").join(n, entity, "left")
    sides = F.coalesce(F.size("_sides"), F.lit(0))
    behaviour = (
        F.when(F.col("lane_chain").isNull() | (F.col("gaps") > 0), "unknown").when(sides == 1, F.concat(F.get("_sides", 0), F.lit("_lane_change"))).when(sides > 1, "mixed_lane_behavior")
        .when(F.col("_open"), "unknown").otherwise("lane_keep")
    )
    status = F.when(F.col("lane_chain").isNull(), "unknown").otherwise("available")
    return j.select(*entity, status.alias("status"), F.coalesce("lane_chain", F.array().cast("array<bigint>")).alias("lane_chain"), F.coalesce("gaps", F.lit(0)).alias("gaps"), behaviour.alias("behavior"))


def lane_heading(x: Column, y: Column, points: Column) -> Column:
    """Degrees from 0 to 360 of a lane's direction at its vertex nearest to a position, the first of equals."""
    n = F.size(points)
    near = F.array_min(F.transform(points, lambda p, i: F.struct((F.pow(p["x"] - x, 2) + F.pow(p["y"] - y, 2)).alias("d"), i.alias("i"))))["i"]
    a, b = F.get(points, F.greatest(near - 1, F.lit(0))), F.get(points, F.least(near + 1, n - 1))
    return F.round(F.pmod(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), F.lit(360.0)), 3)


def circular_median(degrees: Column) -> Column:
    """Of an array of headings, unwrapped around its first; null where it is empty."""
    first = F.get(degrees, 0)
    near = F.sort_array(F.transform(degrees, lambda h: first + F.degrees(g.wrap(F.radians(h - first)))))
    n = F.size(degrees)
    middle = (F.get(near, ((n - 1) / 2).cast("int")) + F.get(near, (n / 2).cast("int"))) / 2
    return F.when(n > 0, F.round(F.pmod(middle, F.lit(360.0)), 3))


def route_transitions(stable: DataFrame, changes: DataFrame, lanes: DataFrame, entity: list[str], group: str = "stable_group", digits: int = 3) -> DataFrame:
    """(entity, transition_frame, lane_before, lane_after, incoming, outgoing, change, primary): continuations only.

    The headings are circular medians over up to HEADING_FRAMES frames before and from the transition, in its two runs, where the frame is
    valid, surely matched and in the run's continuous lane (also by ``group``, the stabilised one of ``stable``). The primary one
    has the largest change of heading, as rounded to ``digits``; the earliest of equals.
    """
    c = changes.where("relation = 'continuation'").select(*entity, "transition_frame", "from_frame", "to_frame", F.col("from_group").alias("lane_before"), F.col("to_group").alias("lane_after"))
    side = F.explode(F.array(F.struct(F.lit("in").alias("side"), F.col("lane_before").alias("want")), F.struct(F.lit("out").alias("side"), F.col("lane_after").alias("want"))))
    frame = F.when(F.col("side") == "in", F.col("transition_frame") - 1 - F.col("_k")).otherwise(F.col("transition_frame") + F.col("_k"))
    probes = c.select(*entity, "transition_frame", "from_frame", "to_frame", side.alias("_s")).select("*", "_s.*").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(HEADING_FRAMES - 1)))).withColumn("frame", frame)
    probes = probes.where(F.col("frame").between(F.col("from_frame"), F.col("to_frame"))).select(*entity, "transition_frame", "side", "want", "_k", "frame")
    m = stable.where(F.col("valid") & F.col("available") & (F.col("confidence") >= CONFIDENCE)).select(*entity, "frame", F.col("lane_id"), "group_id", F.col(group).alias("_g"), "x", "y")
    hit = probes.join(m, [*entity, "frame"]).where((F.col("_g") == F.col("want")) & (F.col("group_id") == F.col("want"))).join(lanes.select("lane_id", "points"), "lane_id")
    heading = hit.select(*entity, "transition_frame", "side", "_k", lane_heading(F.col("x"), F.col("y"), F.col("points")).alias("h"))
    of = lambda s: circular_median(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("_k", "h")))), lambda v: v["h"]))
    found = heading.groupBy(*entity, "transition_frame").agg(of("in").alias("incoming"), of("out").alias("outgoing"))
    j = c.join(found, [*entity, "transition_frame"], "left").withColumn("change", F.round(F.degrees(g.wrap(F.radians(F.col("outgoing") - F.col("incoming")))), digits))
    best = F.row_number().over(Window.partitionBy(*entity).orderBy(F.coalesce(F.abs("change"), F.lit(-1.0)).desc(), "transition_frame")) == 1
    return j.select(*entity, "transition_frame", "lane_before", "lane_after", "incoming", "outgoing", "change", best.alias("primary"))
