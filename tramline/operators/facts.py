"""Physical facts and behaviour rules as column expressions and short plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as fr

# The speed up to which an agent stands (m/s), and the difference of times that stands for never (s).
STANDING = 0.001
NEVER = 100.0


def relation(longitudinal: Column, lateral: Column, channels: tuple[float, float], deadband: float) -> tuple[Column, Column]:
    """(channel, position) of another agent seen from one."""
    near, far = channels
    channel = F.when(F.abs(lateral) <= near, "same_channel").when(F.abs(lateral) <= far, "adjacent").otherwise("apart")
    position = F.when(longitudinal > deadband, "ahead").when(longitudinal < -deadband, "behind").otherwise("alongside")
    return channel, position


def delta_time(d1: Column, v1: Column, d2: Column, v2: Column) -> Column:
    """Difference of the times to a conflict point; 100 where either all but stands (up to 1 mm/s), null where a value is unknown."""
    moving = (v1 > STANDING) & (v2 > STANDING)
    return F.when(moving, F.abs(d1 / v1 - d2 / v2)).when(moving.isNotNull(), F.lit(NEVER))


def time_to_collision(gap: Column, side: Column, closing: Column, radius: float, lateral: float, epsilon: float = 1e-3) -> tuple[Column, Column]:
    """(status, seconds)."""
    over = (gap <= radius) & (side <= radius)
    status = F.when(over, "overlapping").when(side > lateral, "not_applicable").when(closing <= epsilon, "not_closing").otherwise("valid")
    seconds = F.when(over, F.lit(0.0)).when((side > lateral) | (closing <= epsilon), F.lit(None)).otherwise((gap - radius) / closing)
    return status, seconds


def adjacent_direction(from_lane: Column, to_lane: Column, left: Column, right: Column, to_left: Column, to_right: Column) -> Column:
    """'left' or 'right' if either lane names the other on that side (arrays of neighbour ids); null if neither does."""
    holds = lambda ids, x: F.coalesce(F.array_contains(ids, x), F.lit(False))
    return F.when(holds(left, to_lane) | holds(to_right, from_lane), "left").when(holds(right, to_lane) | holds(to_left, from_lane), "right")


def passes(df: DataFrame, entity: list[str], order: str, side: str, least: int) -> DataFrame:
    """(entity, before_frame, after_frame): a stable run behind followed by a stable run ahead."""
    r = fr.runs(df, entity, order, side).where(F.col("n") >= least)
    w = Window.partitionBy(*entity).orderBy("start_frame")
    r = r.withColumns({"_n": F.lead(side).over(w), "after_frame": F.lead("start_frame").over(w)})
    return r.where((F.col(side) == 1) & (F.col("_n") == -1)).select(*entity, F.col("end_frame").alias("before_frame"), "after_frame")


def rule_class(changed: Column, entered: Column, ahead: Column, slowed: Column) -> tuple[Column, Column, Column]:
    """(type, modifiers, status) of a pair by what the first agent did: changed its lane, entered the other's, went from
    behind to ahead; and whether the other slowed down. Facts are three-valued; null counts as not shown."""
    changed, entered, ahead, slowed = (F.coalesce(x, F.lit(False)) for x in (changed, entered, ahead, slowed))
    overtakes = entered & ahead
    kind = F.when(overtakes, "overtake").when(entered & slowed, "lane_change_with_yielding").when(entered, "merge").when(changed, "lane_change").otherwise("unknown")
    none = F.array().cast("array<string>")
    modifiers = F.when(overtakes, F.concat(F.array(F.lit("with_lane_change")), F.when(slowed, F.array(F.lit("with_yielding"))).otherwise(none))).otherwise(none)
    return kind, modifiers, F.when(kind == "unknown", "insufficient_evidence").otherwise("classified")


def strength(distance: Column, pet: Column, ttc: Column, near: tuple[float, float], soon: tuple[float, float], ttc_strong: float) -> Column:
    return F.when((distance < near[0]) | (pet < soon[0]) | (ttc < ttc_strong), "strong").when((distance < near[1]) | (pet < soon[1]), "moderate").otherwise("weak")


def window_of(start: Column, context: int, size: int, frames: int) -> tuple[Column, Column]:
    """A window of fixed size that begins ``context`` frames earlier; shifted, not shortened, at the ends."""
    first = F.greatest(F.lit(0), F.least(start - context, F.lit(frames - size)))
    return first, first + (size - 1)


def densified(entities: DataFrame, rows: DataFrame, entity: list[str], order: str, first: int, last: int) -> DataFrame:
    """Every entity with every frame of the window; frames without a row have nulls."""
    dense = entities.withColumn(order, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return dense.join(rows, [*entity, order], "left")
