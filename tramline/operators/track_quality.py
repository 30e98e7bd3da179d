"""Quality of a raw track: what is wrong from one valid frame to the next, and when speed jumps make a track suspicious.

Only neighbouring valid frames are compared; nothing is bridged, mended or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frames, degrees, m/s2, m and m/s of the rules.
LONG_GAP = 5
HEADING = 30.0
SPEED_WARNING, SPEED_MODERATE, SPEED_SEVERE = 8.0, 15.0, 30.0
REPEAT_FRAMES = 5
POSITION_ERROR, POSITION_RATIO = 2.0, 0.75
DIRECTION, DIRECTION_SPEED, DIRECTION_STEP = 60.0, 0.5, 0.2

#: All but the last are issues at once.
KINDS = ("nonfinite_state", "long_validity_gap", "heading_jump", "position_velocity_mismatch", "position_velocity_direction_mismatch", "velocity_jump")


def _norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def _wrapped(radians: Column) -> Column:
    return F.pmod(radians + F.pi(), 2 * F.pi()) - F.pi()


def _compared(states: DataFrame, entity: list[str]) -> DataFrame:
    """Valid frames with ``gap`` (frames since the last valid one, less one), ``finite`` and, of comparable neighbours, the differences."""
    w = Window.partitionBy(*entity).orderBy("frame")
    fields = ("x", "y", "vx", "vy", "yaw")
    known = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in fields]
    finite = known[0] & known[1] & known[2] & known[3] & known[4]
    v = states.where("valid").withColumn("finite", finite)
    v = v.withColumns({f"_{c}": F.lag(c).over(w) for c in (*fields, "frame", "time", "finite")})
    dt = F.col("time") - F.col("_time")
    checked = F.coalesce((F.col("frame") - F.col("_frame") == 1) & (dt > 1e-6) & F.col("finite") & F.col("_finite"), F.lit(False))
    v = v.withColumns({"gap": F.col("frame") - F.col("_frame") - 1, "checked": checked, "dt": dt})
    only = lambda c: F.when(F.col("checked"), c)
    speed, before = _norm(F.col("vx"), F.col("vy")), _norm(F.col("_vx"), F.col("_vy"))
    step = _norm(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    mx, my = 0.5 * (F.col("vx") + F.col("_vx")), 0.5 * (F.col("vy") + F.col("_vy"))
    return v.withColumns({
        "turned": only(F.degrees(_wrapped(F.col("yaw") - F.col("_yaw")))), "gained": only(speed - before), "step": only(step), "expected": only(0.5 * (before + speed) * F.col("dt")),
        "mean_speed": only(_norm(mx, my)), "along": only((F.col("x") - F.col("_x")) * mx + (F.col("y") - F.col("_y")) * my),
    })


def quality_events(states: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, frame, type, value, severity): every rule that a valid frame breaks. ``states``: (entity, frame, valid, time, x, y, vx, vy, yaw).

    ``value`` is the gap's frames, the degrees, the rate of the speed or the error in metres. Only speed jumps have a severity. A null, NaN or
    infinite field makes a state nonfinite, and it is compared with none.
    """
    v = _compared(states, entity)
    rate = F.abs("gained") / F.col("dt")
    error = F.abs(F.col("step") - F.col("expected"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("along") / (F.col("step") * F.col("mean_speed"))))
    moving = (F.col("step") >= DIRECTION_STEP) & (F.col("mean_speed") >= DIRECTION_SPEED)
    apart = F.when(moving, F.degrees(F.acos(cosine)))
    severity = F.when(rate >= SPEED_SEVERE, "severe").when(rate >= SPEED_MODERATE, "moderate").otherwise("warning")
    rules = (
        (~F.col("finite"), None, None), (F.col("gap") > LONG_GAP, F.col("gap"), None), (F.abs("turned") >= HEADING, F.col("turned"), None),
        (error >= F.greatest(F.lit(POSITION_ERROR), POSITION_RATIO * F.col("expected")), error, None), (apart >= DIRECTION, apart, None), (rate >= SPEED_WARNING, rate, severity),
    )
    told = [F.when(broken, F.struct(F.lit(kind).alias("type"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(None) if s is None else s).cast("string").alias("severity"))) for kind, (broken, value, s) in zip(KINDS, rules)]
    return v.select(*entity, "frame", F.explode(F.array_compact(F.array(*told))).alias("_e")).select(*entity, "frame", "_e.*")


def track_quality(states: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, status, valid_frames, checked_pairs, a count for each kind, warnings): one row a track.

    Speed jumps alone are a warning. One that is severe, two within REPEAT_FRAMES frames or any other issue make the track suspicious,
    and the jumps issues too (``warnings`` is then 0).
    """
    base = _compared(states, entity).groupBy(*entity).agg(F.count("*").alias("valid_frames"), F.count_if("checked").alias("checked_pairs"))
    every = states.select(*entity).distinct()
    events = quality_events(states, entity)
    w = Window.partitionBy(*entity, "type").orderBy("frame")
    jump = F.col("type") == "velocity_jump"
    e = events.withColumn("_near", jump & (F.col("frame") - F.lag("frame").over(w) <= REPEAT_FRAMES))
    promoted = F.coalesce(F.bool_or("_near"), F.lit(False)) | (F.count_if(F.col("severity") == "severe") > 0) | (F.count_if(~jump) > 0)
    n = e.groupBy(*entity).agg(*[F.count_if(F.col("type") == k).alias(k) for k in KINDS], promoted.alias("_bad"))
    j = every.join(base, entity, "left").join(n, entity, "left").fillna(0, ["valid_frames", "checked_pairs", *KINDS]).fillna(False, ["_bad"])
    status = F.when(F.col("_bad"), "suspicious").when(F.col("velocity_jump") > 0, "warning").otherwise("clean")
    return j.select(*entity, status.alias("status"), "valid_frames", "checked_pairs", *KINDS, F.when(F.col("_bad"), 0).otherwise(F.col("velocity_jump")).cast("long").alias("warnings"))
