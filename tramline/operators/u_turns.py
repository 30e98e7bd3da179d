"""U-turn evidence of a track: how far and how steadily its heading turns, and whether its path comes back.

The longest run of valid frames is looked at, as windows and one aggregation by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr

# Frames on each side of the smoothed heading, degrees a frame that count as rotation, degrees of a direction of rotation.
SMOOTH = 2
RATE = 1.0
NET = 10.0
# The whole U-turn: degrees, frames, share of one direction, cosine between the ends, path by displacement; and frames at each end.
TURN, FRAMES, CONSISTENCY, DOT, RATIO = 135.0, 8, 0.75, -0.35, 1.15
EDGE = 5
# The partial one, and the tail whose rotation shows that it goes on.
PART_TURN, PART_FRAMES, PART_CONSISTENCY, PART_DOT, PART_RATIO = 90.0, 8, 0.70, 0.55, 1.05
TAIL, TAIL_CHANGE, TAIL_SHARE = 12, 8.0, 0.35


def _last(value: Column, at: Column) -> Column:
    """The value where ``at`` holds, of the one frame where it does."""
    return F.max(F.when(at, value))


def u_turn_evidence(states: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, status, start_frame, end_frame, heading_change, rotation, consistency, longest_rotation, reversal, edge_dot, path_length, displacement,
    path_ratio, at_boundary, stable_exit, evidence, partial_evidence), one row a track.

    ``states``: (entity, frame, valid, x, y, yaw) with a row for every frame. Status is supported, partial_supported, not_supported, or
    insufficient_data without two valid frames in a row or with an unknown or infinite state in the run; the numbers are null then.
    """
    key = [*entity]
    valid_last = states.where("valid").groupBy(*key).agg(F.max("frame").alias("_last"))
    run = fr.longest_run(states, key, "frame", "valid").where("n >= 2").join(valid_last, key).select(*key, "start_frame", "end_frame", "n", (F.col("_last") <= F.col("end_frame")).alias("at_boundary"))
    f = states.join(run, key).where(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    bad = F.lit(False)
    for c in ("x", "y", "yaw"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    f = f.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    w = Window.partitionBy(*key).orderBy("frame")
    f = f.withColumns({"_i": (F.col("frame") - F.col("start_frame")).cast("int"), "_u": F.degrees(fr.unwrapped("yaw", key, "frame"))})
    f = f.withColumn("_s", fr.rolling_median(F.col("_u"), key, "frame", SMOOTH))
    f = f.withColumns({"_inc": F.col("_s") - F.lag("_s").over(w), "_step": F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))})
    f = f.withColumn("_sign", F.when(F.col("_inc") >= RATE, 1).when(F.col("_inc") <= -RATE, -1).otherwise(0))
    f = fr.run_ids(f, key, "frame", "_sign", name="_run").withColumn("_length", F.count("*").over(Window.partitionBy(*key, "_run")))
    edge = F.least(F.lit(EDGE), F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 3)))
    tail = F.greatest(F.lit(0), F.col("n") - 1 - F.least(F.lit(TAIL), F.greatest(F.lit(1), F.col("n") - 1)))
    i, end = F.col("_i"), F.col("n") - 1
    rotating = F.col("_sign") != 0
    g = f.withColumns({"_edge": edge, "_tail": tail}).groupBy(*key, "start_frame", "end_frame", "n", "at_boundary").agg(
        F.bool_or("_bad").alias("bad"), _last(F.col("_u"), i == end).alias("u1"), _last(F.col("_u"), i == 0).alias("u0"), F.count_if(F.col("_sign") > 0).alias("left"), F.count_if(F.col("_sign") < 0).alias("right"),
        F.max(F.when(F.col("_sign") > 0, F.col("_length"))).alias("long_left"), F.max(F.when(F.col("_sign") < 0, F.col("_length"))).alias("long_right"), F.sum("_step").alias("path_length"),
        *[_last(F.col(c), at).alias(f"{c}{name}") for c in "xy" for name, at in (("0", i == 0), ("1", i == end), ("a", i == F.col("_edge")), ("b", i == end - F.col("_edge")))],
        (_last(F.col("_s"), i == end) - _last(F.col("_s"), i == F.col("_tail"))).alias("tail_change"), F.avg(F.when(i > F.col("_tail"), rotating.cast("double"))).alias("tail_share"),
    )
    active = F.col("left") + F.col("right")
    way = F.when(active == 0, 0).when(F.col("left") >= F.col("right"), 1).otherwise(-1)
    sx, sy, ex, ey = F.col("xa") - F.col("x0"), F.col("ya") - F.col("y0"), F.col("x1") - F.col("xb"), F.col("y1") - F.col("yb")
    norm = lambda x, y: F.sqrt(x * x + y * y)
    moved = (norm(sx, sy) > 1e-6) & (norm(ex, ey) > 1e-6)
    g = g.withColumns({
        "heading_change": F.col("u1") - F.col("u0"), "way": way, "active": active, "consistency": F.when(active > 0, F.greatest("left", "right") / active).otherwise(0.0),
        "longest_rotation": F.coalesce(F.when(way > 0, F.col("long_left")).when(way < 0, F.col("long_right")), F.lit(0)), "edge_dot": F.when(moved, (sx * ex + sy * ey) / (norm(sx, sy) * norm(ex, ey))),
        "displacement": norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "stable_exit": (F.abs("tail_change") <= TAIL_CHANGE) & (F.coalesce("tail_share", F.lit(0.0)) <= TAIL_SHARE),
    })
    g = g.withColumn("path_ratio", F.when(F.col("displacement") > 1e-6, F.col("path_length") / F.col("displacement")))
    turned, straight = F.abs("heading_change"), F.col("way") == F.when(F.col("heading_change") > 0, 1).otherwise(-1)
    rotates = lambda n, share: (F.col("active") >= n) & (F.col("consistency") >= share) & (F.col("longest_rotation") >= n) & straight
    holds = lambda c: F.coalesce(c, F.lit(False))
    back = holds((F.col("edge_dot") <= DOT) & (F.col("path_ratio") >= RATIO))
    shape = holds(F.col("edge_dot") <= PART_DOT) | holds(F.col("path_ratio") >= PART_RATIO)
    whole = (("large_global_heading_reversal", turned >= TURN), ("sustained_same_direction_rotation", rotates(FRAMES, CONSISTENCY)), ("trajectory_entry_exit_direction_reversal", back), ("curved_return_path_shape", back))
    part = (
        ("large_partial_global_heading_change", turned >= PART_TURN), ("sustained_same_direction_partial_rotation", rotates(PART_FRAMES, PART_CONSISTENCY)), ("partial_trajectory_return_shape", shape),
        ("observation_reaches_track_boundary_without_stable_exit", F.col("at_boundary") & ~F.col("stable_exit")),
    )
    told = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    g = g.withColumns({"evidence": told(whole), "partial_evidence": told(part)})
    status = F.when(F.size("evidence") == len(whole), "supported").when(F.size("partial_evidence") == len(part), "partial_supported").otherwise("not_supported")
    rotation = F.when(F.col("heading_change") > NET, "increasing_ccw").when(F.col("heading_change") < -NET, "decreasing_cw").otherwise("roughly_stable")
    reversal = F.when(F.col("edge_dot").isNull(), "insufficient_data").when(F.col("edge_dot") <= DOT, "supported").otherwise("not_supported")
    known = lambda c: F.when(~F.col("bad"), c)
    number = lambda c: known(F.round(c, 3)).alias(c)
    none = F.array().cast("array<string>")
    found = g.select(
        *key, F.when(F.col("bad"), "insufficient_data").otherwise(status).alias("status"), "start_frame", "end_frame", number("heading_change"), F.when(F.col("bad"), "uncertain").otherwise(rotation).alias("rotation"), number("consistency"),
        known(F.col("longest_rotation")).alias("longest_rotation"), F.when(F.col("bad"), "uncertain").otherwise(reversal).alias("reversal"), *[number(c) for c in ("edge_dot", "path_length", "displacement", "path_ratio")],
        known(F.col("at_boundary")).alias("at_boundary"), known(F.col("stable_exit")).alias("stable_exit"), *[F.when(F.col("bad"), none).otherwise(F.col(c)).alias(c) for c in ("evidence", "partial_evidence")],
    )
    return states.select(*key).distinct().join(found, key, "left").fillna("insufficient_data", ["status"])
