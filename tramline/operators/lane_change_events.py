"""Lane changes of matched states: stable runs on neighbouring lanes, with a lateral motion away from the one and toward the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts as ft
from . import frames as fr

# Frames of a stable run, least confidence of a match and share of matched frames, metres of lateral motion, frames of evidence.
STABLE = 3
CONFIDENCE = 0.5
MATCHED = 0.5
MOVED = 0.05
EVIDENCE = 4


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _trend(value: Column, inside: Column) -> Column:
    """Last less first known value of the frames that are ``inside``, as an aggregate; null for fewer than two."""
    known = F.sort_array(F.collect_list(F.when(inside & value.isNotNull(), F.struct("frame", value.alias("v")))))
    n = F.size(known)
    return F.when(n >= 2, F.get(known, n - 1)["v"] - F.get(known, 0)["v"])


def lane_change_events(states: DataFrame, lanes: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, from_lane, to_lane, start_frame, transition_frame, end_frame, direction, confidence).

    ``states``: (entity, frame, valid, matched, lane_id, confidence, centerline, offset); ``lanes``: (lane_id, left, right, next, prev) with arrays of
    ids. Runs of STABLE matched frames that touch, on lanes of which one names the other as a neighbour and neither as its continuation;
    over the last EVIDENCE frames of the old lane the distance from its centre (or the offset) grows, over the first of the new one it
    shrinks. The confidence is 0.4 of the matches' mean there, 0.2 of the runs' stability and 0.4.
    """
    ok = F.coalesce(F.col("valid") & F.col("matched") & F.col("lane_id").isNotNull() & (_finite(F.col("confidence")) >= CONFIDENCE), F.lit(False))
    s = fr.run_ids(states.where(ok), entity, "frame", "lane_id", gaps=True)
    run = Window.partitionBy(*entity, "run")
    s = s.withColumns({"_head": F.row_number().over(run.orderBy("frame")) <= EVIDENCE, "_tail": F.row_number().over(run.orderBy(F.desc("frame"))) <= EVIDENCE})
    away, aside = _finite(F.col("centerline")), F.abs(_finite(F.col("offset")))
    r = s.groupBy(*entity, "run", "lane_id").agg(
        F.min("frame").alias("s"), F.max("frame").alias("e"), F.count("*").alias("n"), *[_trend(v, F.col(at)).alias(f"{name}{at}") for at in ("_head", "_tail") for name, v in (("away", away), ("aside", aside))],
        *[f(F.when(F.col(at), F.col("confidence"))).alias(f"{name}{at}") for at in ("_head", "_tail") for name, f in (("sum", F.sum), ("count", F.count))],
    ).where(F.col("n") >= STABLE)
    w = Window.partitionBy(*entity).orderBy("s")
    after = {f"next_{c}": F.lead(c).over(w) for c in ("lane_id", "s", "n", "away_head", "aside_head", "sum_head", "count_head")}
    j = r.withColumns(after).where((F.col("e") + 1 == F.col("next_s")) & (F.col("lane_id") != F.col("next_lane_id")))
    of = lambda side, lane: lanes.select(F.col("lane_id").alias(lane), *[F.col(c).alias(f"{side}_{c}") for c in ("left", "right", "next", "prev")])
    j = j.join(of("a", "lane_id"), "lane_id").join(of("b", "next_lane_id"), "next_lane_id")
    names = lambda ids, lane: F.coalesce(F.array_contains(ids, F.col(lane)), F.lit(False))
    direction = ft.adjacent_direction(F.col("lane_id"), F.col("next_lane_id"), F.col("a_left"), F.col("a_right"), F.col("b_left"), F.col("b_right"))
    j = j.where(~names("a_next", "next_lane_id") & ~names("b_prev", "lane_id")).withColumn("direction", direction)
    grew, shrank = (F.coalesce(F.greatest("away_tail", "aside_tail") >= MOVED, F.lit(False)), F.coalesce(F.least("next_away_head", "next_aside_head") <= -MOVED, F.lit(False)))
    match = (F.col("sum_tail") + F.col("next_sum_head")) / (F.col("count_tail") + F.col("next_count_head"))
    stability = F.least(F.lit(1.0), F.least("n", "next_n") / F.lit(float(STABLE + 2)))
    return j.where(F.col("direction").isNotNull() & grew & shrank).select(
        *entity, F.col("lane_id").alias("from_lane"), F.col("next_lane_id").alias("to_lane"), (F.col("e") - F.least(F.lit(EVIDENCE), "n") + 1).alias("start_frame"), F.col("next_s").alias("transition_frame"),
        (F.col("next_s") + F.least(F.lit(EVIDENCE), "next_n") - 1).alias("end_frame"), "direction", F.round(0.4 * match + 0.2 * stability + 0.2 + 0.2, 6).alias("confidence"),
    )


def lane_change_verdict(states: DataFrame, events: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, lane_change_detected, confidence, events): null where under two stable runs' frames are valid, or too few of them matched."""
    ok = F.col("valid") & F.col("matched") & F.col("lane_id").isNotNull() & (_finite(F.col("confidence")) >= CONFIDENCE)
    base = states.groupBy(*entity).agg(F.count_if("valid").alias("_v"), F.count_if(ok).alias("_m"))
    e = events.groupBy(*entity).agg(F.count("*").alias("events"), F.max("confidence").alias("confidence"))
    enough = (F.col("_v") >= 2 * STABLE) & (F.col("_m") / F.greatest("_v", F.lit(1)) >= MATCHED)
    j = base.join(e, entity, "left")
    return j.select(*entity, F.when(enough, F.col("events").isNotNull()).alias("lane_change_detected"), F.when(enough, F.col("confidence")).alias("confidence"), F.when(enough, F.coalesce("events", F.lit(0))).otherwise(0).cast("long").alias("events"))
