"""Class of a pair's interaction from its evidence: who changed lanes, merged, cut in, or shared a lane, with confidence and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pair_timeline import relative_position

# M of a small gap, m by which a gap shrinks, m/s by which a reference slows, frames and share of a shared lane, confidence of a merge.
SMALL_GAP = 15.0
GAP_SHRINKS = 1.0
SLOWS = 1.0
SHARED_FRAMES, SHARED_RATIO = 3, 0.5
MERGE = 0.75


def longitudinal_gap(subject: Column, reference: Column) -> Column:
    """Between two states (x, y, heading), along the reference's heading; null where anything is unknown or infinite."""
    along = (subject["x"] - reference["x"]) * F.cos(reference["heading"]) + (subject["y"] - reference["y"]) * F.sin(reference["heading"])
    return F.when(~F.isnan(along) & (F.abs(along) != float("inf")), F.abs(along))


def change_evidence(before: Column, ref_before: Column, after: Column, ref_after: Column) -> Column:
    """What a lane change did to the pair: (entered, relation_before, relation_after, gap_before, gap_after, small_gap, gap_shrank, slowed).

    States are structs of x, y, heading, speed and group (of continuous lanes), those of the frame before the transition and of a stable frame
    after it; a null state is unknown. Unknown evidence is false, unknown relations and gaps are null.
    """
    relation = lambda s, r: relative_position(s["x"], s["y"], r["x"], r["y"], r["heading"])
    g0, g1 = longitudinal_gap(before, ref_before), longitudinal_gap(after, ref_after)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        sure(after["group"] == ref_after["group"]).alias("entered"), relation(before, ref_before).alias("relation_before"), relation(after, ref_after).alias("relation_after"), g0.alias("gap_before"), g1.alias("gap_after"),
        sure(g1 <= SMALL_GAP).alias("small_gap"), sure(g0 - g1 >= GAP_SHRINKS).alias("gap_shrank"), sure(ref_before["speed"] - ref_after["speed"] >= SLOWS).alias("slowed"),
    )


def interaction_class(changers: Column, merges: Column, has_event: Column, evidence: Column, confidence: Column, direction: Column, shared: Column, frames: Column, meaningful: Column) -> Column:
    """(type, subtype, confidence, status): the first rule that holds.

    Two changers are unknown; a merge needs none; one whose change is no part of the interaction (``has_event`` false) is insufficient. A cut-in
    enters the reference's lane, stands in a known relation to it, and leaves a small gap, shrinks it, or makes the reference slow down; its
    confidence is the change's times the share of these five. Any other change is a lane change to its side. Without one, enough frames in
    one lane (``shared`` of ``frames``, some of them ``meaningful``) are a same-lane interaction; else it is unknown.
    """
    known = evidence["relation_before"].isNotNull() | evidence["relation_after"].isNotNull()
    proofs = [evidence["small_gap"], evidence["gap_shrank"], evidence["slowed"]]
    cuts = evidence["entered"] & known & (proofs[0] | proofs[1] | proofs[2])
    score = sum((p.cast("int") for p in proofs), F.lit(2)) / 5
    ratio = F.when(frames > 0, shared / frames).otherwise(0.0)
    together = (shared >= SHARED_FRAMES) & (ratio >= SHARED_RATIO) & meaningful
    told = lambda kind, subtype, sure, status: F.struct(F.lit(kind).alias("type"), subtype.cast("string").alias("subtype"), sure.cast("double").alias("confidence"), F.lit(status).alias("status"))
    none = F.lit(None)
    sure = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(changers > 1, told("unknown", none, none, "classified")).when((changers == 0) & sure(merges), told("merge", none, F.lit(MERGE), "labeled"))
        .when((changers == 1) & ~sure(has_event), told("unknown", none, none, "insufficient_evidence")).when((changers == 1) & sure(cuts), told("cut_in", none, F.round(confidence * score, 6), "labeled"))
        .when(changers == 1, told("lane_change", direction, confidence, "labeled"))
        .when(sure(together), told("same_lane_interaction", none, F.round(F.least(F.lit(1.0), 0.5 * ratio + 0.5 * F.least(F.lit(1.0), shared / 10)), 6), "labeled"))
        .when(frames < SHARED_FRAMES, told("unknown", none, none, "insufficient_evidence")).otherwise(told("unknown", none, none, "classified"))
    )
