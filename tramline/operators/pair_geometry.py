"""Pair geometry over common frames: the relation of two headings, the closest approach, and how the distance goes around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr

# Degrees of the relations, least common frames of a relation, frames and least points of a window, points at its edges, metres.
ALIGNED, ROUGHLY, OPPOSING = 10.0, 45.0, 135.0
COMMON = 2
WINDOW, POINTS, EDGE, MOVED = 10, 5, 3, 0.3


def heading_relation(degrees: Column) -> Column:
    """Of an absolute difference; unknown or infinite is uncertain."""
    known = degrees.isNotNull() & ~F.isnan(degrees) & (F.abs(degrees) != float("inf"))
    relation = F.when(degrees <= ALIGNED, "aligned").when(degrees <= ROUGHLY, "roughly_aligned").when(degrees >= OPPOSING, "opposing").otherwise("cross_direction")
    return F.when(known, relation).otherwise("uncertain")


def heading_relations(frames: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, status, dominant, share, frames, median, least, most) of ``frames`` (pair, frame, yaw, other_yaw), the jointly valid ones.

    The dominant relation is the commonest of the known ones, the last by name of equals, and ``share`` its part of them; both are null,
    and the status is insufficient_data, for fewer than COMMON frames.
    """
    apart = F.abs(F.degrees(fr.wrap_angle(F.col("yaw") - F.col("other_yaw"))))
    f = frames.withColumn("_d", F.when(~F.isnan(apart), apart)).withColumn("_r", heading_relation(F.col("_d")))
    n = f.groupBy(*pair, "_r").agg(F.count("*").alias("_n"))
    known = F.col("_r") != "uncertain"
    best = n.groupBy(*pair).agg(F.sum("_n").alias("frames"), F.max(F.when(known, F.struct("_n", "_r"))).alias("_b"), F.sum(F.when(known, F.col("_n"))).alias("_k"))
    d = f.groupBy(*pair).agg(F.round(fr.median_of(F.collect_list("_d")), 3).alias("median"), F.round(F.min("_d"), 3).alias("least"), F.round(F.max("_d"), 3).alias("most"))
    enough = F.col("frames") >= COMMON
    return best.join(d, pair).select(
        *pair, F.when(enough, "available").otherwise("insufficient_data").alias("status"), F.when(enough, F.col("_b._r")).alias("dominant"), F.when(enough, F.round(F.col("_b._n") / F.col("_k"), 4)).alias("share"), "frames", "median", "least", "most"
    )


def _window(rows: Column) -> Column:
    """(status, label, start_frame, end_frame, delta) of a side's (frame, distance) in order: medians of its edges, compared."""
    n = F.size(rows)
    edge = F.least(F.lit(EDGE), F.floor(n / 2).cast("int"))
    value = lambda part: fr.median_of(F.transform(part, lambda s: s["distance"]))
    delta = value(F.slice(rows, n - edge + 1, edge)) - value(F.slice(rows, F.lit(1), edge))
    label = F.when(delta <= -MOVED, "approaching").when(delta >= MOVED, "separating").otherwise("roughly_stable")
    told = F.struct(F.lit("available").alias("status"), label.alias("label"), F.get(rows, 0)["frame"].alias("start_frame"), F.get(rows, n - 1)["frame"].alias("end_frame"), F.round(delta, 3).alias("delta"))
    short = F.struct(F.lit("insufficient_data").alias("status"), F.lit("uncertain").alias("label"), F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"), F.lit(None).cast("double").alias("delta"))
    return F.when(n >= POINTS, told).otherwise(short)


def distance_evolution(samples: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, status, overall, closest_frame, minimum_distance, before, after) of ``samples`` (pair, frame, distance).

    The closest frame is the exact least distance, the first of equals; unknown and infinite distances are no samples, and a pair without any
    is absent. The windows are the last WINDOW samples before it and the first after it.
    """
    ok = samples.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") != float("inf"))).select(*pair, F.col("frame").cast("long").alias("frame"), F.col("distance").cast("double").alias("distance"))
    least = F.min(F.struct("distance", "frame")).over(Window.partitionBy(*pair))
    s = ok.withColumn("_c", least).withColumn("_side", F.when(F.col("frame") < F.col("_c.frame"), "before").when(F.col("frame") > F.col("_c.frame"), "after"))
    k = F.row_number().over(Window.partitionBy(*pair, "_side").orderBy(F.abs(F.col("frame") - F.col("_c.frame"))))
    near = s.withColumn("_k", k).where(F.col("_side").isNull() | (F.col("_k") <= WINDOW))
    rows = lambda side: F.sort_array(F.collect_list(F.when(F.col("_side") == side, F.struct("frame", "distance"))))
    g = near.groupBy(*pair, "_c").agg(rows("before").alias("_before"), rows("after").alias("_after"))
    g = g.withColumns({"before": _window(F.col("_before")), "after": _window(F.col("_after"))})
    came, goes = F.col("before.label"), F.col("after.label")
    overall = (
        F.when((came == "approaching") & (goes == "separating"), "approaching_then_separating").when(came == "approaching", "approaching_only").when(goes == "separating", "separating_only")
        .when((came == "roughly_stable") & (goes == "roughly_stable"), "roughly_stable").otherwise("uncertain")
    )
    status = F.when((F.col("before.status") == "available") | (F.col("after.status") == "available"), "available").otherwise("insufficient_data")
    return g.select(*pair, status.alias("status"), overall.alias("overall"), F.col("_c.frame").alias("closest_frame"), F.round("_c.distance", 3).alias("minimum_distance"), "before", "after")
