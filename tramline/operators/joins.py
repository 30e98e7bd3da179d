"""Joins of trajectory analytics: pair enumeration, range and overlap joins, nearest frames, repairs, last-writer lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, scene: list[str], member: str) -> DataFrame:
    """(scene, a, b): unordered pairs of a scene's distinct members, a < b; an equi-join with a theta condition."""
    m = df.select(*scene, member).where(F.col(member).isNotNull()).distinct()
    left, right = m.withColumnRenamed(member, "a"), m.withColumnRenamed(member, "b")
    return left.join(right, scene).where("a < b")


def gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Frames between two inclusive intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Frames that two inclusive intervals share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def range_join(left: DataFrame, right: DataFrame, on: list[str], reach: int, width: int = 64) -> DataFrame:
    """Pairs with equal ``on`` whose inclusive intervals (start_frame, end_frame) lie at most ``reach`` frames apart.

    Intervals are posted to the buckets of ``width`` frames that they touch, the left ones widened by ``reach``; a pair is kept
    in the first bucket that both touch. So an entity with very many intervals is joined in parts. Right columns get the
    prefix ``r_``.
    """
    def buckets(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / width), F.floor(end / width))

    a = left.withColumn("_b", F.explode(buckets(F.col("start_frame") - reach, F.col("end_frame") + reach)))
    b = right.select(*(F.col(c).alias(c if c in on else f"r_{c}") for c in right.columns))
    b = b.withColumn("_b", F.explode(buckets(F.col("r_start_frame"), F.col("r_end_frame"))))
    j = a.join(b, [*on, "_b"])
    first = F.greatest(F.floor((F.col("start_frame") - reach) / width), F.floor(F.col("r_start_frame") / width))
    near = gap(F.col("start_frame"), F.col("end_frame"), F.col("r_start_frame"), F.col("r_end_frame")) <= reach
    return j.where(near & (F.col("_b") == first)).drop("_b")


def nearest_frame(probes: DataFrame, rows: DataFrame, on: list[str], at: str, order: str, value: list[str]) -> DataFrame:
    """Each probe with the row of its entity at the least |frame - at|, the earlier of equals; probes without rows are absent.

    One union and two windows instead of a join of every probe with every frame: the last row at or before and the first
    at or after are carried to the probe.
    """
    p = probes.select(*on, F.col(at).alias("_o"), F.lit(True).alias("_p"), F.lit(None).cast("struct<" + ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in [order, *value]) + ">").alias("_v"))
    r = rows.select(*on, F.col(order).alias("_o"), F.lit(False).alias("_p"), F.struct(order, *value).alias("_v"))
    w = Window.partitionBy(*on).orderBy("_o", "_p")
    u = p.unionByName(r)
    back = F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("_v", True).over(Window.partitionBy(*on).orderBy("_o", F.desc("_p")).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    u = u.withColumns({"_l": back, "_r": ahead}).where("_p")
    dl, dr = F.col("_o") - F.col(f"_l.{order}"), F.col(f"_r.{order}") - F.col("_o")
    pick = F.when(F.col("_r").isNull() | (dl <= dr), F.col("_l")).otherwise(F.col("_r"))
    return u.withColumn("_x", pick).where("_x is not null").select(*on, F.col("_o").alias(at), *(F.col(f"_x.{c}").alias(f"near_{c}") for c in [order, *value]))


def unique_donor(errors: DataFrame, donors: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Errors with ``fields`` from the donor of the same key, only if there is exactly one."""
    one = donors.groupBy(*key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in fields)).where("_n = 1").drop("_n")
    return errors.drop(*fields).join(one, key, "left")


def last_writer(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of their key, the others are appended."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def stable_distinct(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def grid_radius_join(points: DataFrame, targets: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of ``points`` (x, y) and ``targets`` (tx, ty) at most ``radius`` apart, with ``distance``.

    Targets are posted to the nine cells around theirs, points to their own, so each pair meets once.
    """
    on = on or []
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    t = targets.withColumn("_dx", near).withColumn("_dy", near).withColumn("_cx", cell("tx") + F.col("_dx")).withColumn("_cy", cell("ty") + F.col("_dy")).drop("_dx", "_dy")
    p = points.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    distance = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    return p.join(t, [*on, "_cx", "_cy"]).withColumn("distance", distance).where(F.col("distance") <= radius).drop("_cx", "_cy")


def in_lists(df: DataFrame, key: list[str], value: str, most: int = 1024) -> DataFrame:
    """(key, value as an array): a key's values in lists of at most ``most``, so that a row's size has a bound."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(value)) - 1
    return df.select(*key, value, F.floor(number / most).alias("_l")).groupBy(*key, "_l").agg(F.collect_list(value).alias(value)).drop("_l")
