"""Operators over per-frame rows of an entity: runs, gaps, rolling windows, differences, unwrapping.

All are windows partitioned by the entity; a run is found by a change flag and its running sum, so one shuffle by the
entity serves a chain of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(entity: list[str], order: str):
    return Window.partitionBy(*entity).orderBy(order)


def run_ids(df: DataFrame, entity: list[str], order: str, value: str, gaps: bool = False, name: str = "run") -> DataFrame:
    """Numbers maximal runs of null-safe equal ``value``; with ``gaps`` a missing frame ends a run too."""
    w = _over(entity, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()
    if gaps:
        new = new | (F.col(order) - F.lag(order).over(w) > 1)
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, entity: list[str], order: str, value: str, gaps: bool = False) -> DataFrame:
    """(entity, value, start_frame, end_frame, n): inclusive runs in order; null is a value."""
    numbered = run_ids(df, entity, order, value, gaps)
    return numbered.groupBy(*entity, "run", value).agg(F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count("*").alias("n")).drop("run")


def boolean_runs(df: DataFrame, entity: list[str], order: str, flag: str, least: int = 1) -> DataFrame:
    """Maximal true runs of at least ``least`` frames."""
    return runs(df, entity, order, flag, gaps=True).where(F.col(flag) & (F.col("n") >= least)).drop(flag)


def bridge_gaps(df: DataFrame, entity: list[str], order: str, flag: str, longest: int, name: str) -> DataFrame:
    """Adds ``name``: ``flag`` with false runs of up to ``longest`` rows filled where true stands on both sides."""
    numbered = run_ids(df, entity, order, flag, name="_run")
    r = Window.partitionBy(*entity, "_run")
    e = Window.partitionBy(*entity)
    inner = (F.col("_run") > 1) & (F.col("_run") < F.max("_run").over(e))
    return numbered.withColumn(name, F.col(flag) | (inner & ~F.col(flag) & (F.count("*").over(r) <= longest))).drop("_run")


def median_of(values: Column) -> Column:
    """Median of an array without nulls; null if empty."""
    s = F.array_sort(values)
    n = F.size(s)
    odd, low = F.get(s, F.floor(n / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int") - 1)
    return F.when(n > 0, F.when(n % 2 == 1, odd).otherwise((low + odd) / 2))


def rolling_median(value: Column, entity: list[str], order: str, radius: int) -> Column:
    """Centred, over finite values, cut at the edges."""
    w = _over(entity, order).rowsBetween(-radius, radius)
    return median_of(F.collect_list(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)).over(w))


def rolling_mode(value: Column, entity: list[str], order: str, radius: int) -> Column:
    """Centred; nulls don't count; ties go to the smallest value."""
    w = _over(entity, order).rowsBetween(-radius, radius)
    return _mode(F.collect_list(value).over(w))


def _mode(values: Column) -> Column:
    best = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(best)["v"]


def central_difference(value: str, entity: list[str], order: str, dt: float) -> Column:
    """(next - previous) / 2dt, one-sided at the ends, 0 for a single row."""
    w = _over(entity, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    return F.when(a.isNull() & b.isNull(), F.lit(0.0)).when(a.isNull(), (b - v) / dt).when(b.isNull(), (v - a) / dt).otherwise((b - a) / (2 * dt))


def valid_acceleration(smooth: str, valid: str, time: str, entity: list[str], order: str) -> Column:
    """Centred difference by time stamps where this frame and both neighbours are valid; else null."""
    w = _over(entity, order)
    ok = F.col(valid) & F.lag(valid).over(w) & F.lead(valid).over(w)
    dt = F.lead(time).over(w) - F.lag(time).over(w)
    return F.when(ok & (dt > 0), (F.lead(smooth).over(w) - F.lag(smooth).over(w)) / dt)


def fallback_acceleration(raw: str, velocity: str, entity: list[str], order: str, dt: float) -> tuple[Column, Column]:
    """(value, source): the raw value, else the difference from the previous row's velocity over the frames between."""
    w = _over(entity, order)
    before = F.lag(velocity).over(w)
    step = (F.col(order) - F.lag(order).over(w)) * dt
    derived = (F.col(velocity) - before) / step
    value = F.coalesce(raw, derived)
    source = F.when(F.col(raw).isNotNull(), F.lit("raw")).when(derived.isNotNull(), F.lit("derived_from_velocity")).otherwise(F.lit("insufficient_data"))
    return value, source


def wrap_angle(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def unwrapped(yaw: str, entity: list[str], order: str) -> Column:
    """Heading without jumps: the first value and the running sum of wrapped steps."""
    w = _over(entity, order)
    step = wrap_angle(F.col(yaw) - F.lag(yaw).over(w))
    return F.first(yaw).over(w) + F.sum(F.coalesce(step, F.lit(0.0))).over(w)


def longest_run(df: DataFrame, entity: list[str], order: str, flag: str) -> DataFrame:
    """(entity, start_frame, end_frame, n): the longest true run, the earliest of equals; entities without one are absent."""
    r = boolean_runs(df, entity, order, flag)
    best = F.min(F.struct((-F.col("n")).alias("m"), "start_frame", "end_frame")).alias("b")
    return r.groupBy(*entity).agg(best).select(*entity, "b.start_frame", "b.end_frame", (-F.col("b.m")).alias("n"))


def debounced(value: Column, entity: list[str], order: str, dwell: int) -> Column:
    """Hysteresis: a new value (null too) is taken over once it has stood for ``dwell`` frames. As an array by frame, in order.

    A fold over the entity's own frames; use with ``groupBy(entity).agg(...)``. The fold keeps where the value changes, and the frames between
    are filled afterwards, so its state doesn't grow with the frames.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"].cast("bigint"))
    kind = "struct<cur:bigint,cand:bigint,n:int,i:int,out:array<struct<i:int,v:bigint>>>"
    begin = F.from_json(F.lit('{"n":0,"i":0,"out":[]}'), kind)

    def step(acc: Column, v: Column) -> Column:
        n = F.when(v.eqNullSafe(acc["cand"]) & (acc["n"] > 0), acc["n"] + 1).otherwise(F.lit(1))
        first = acc["i"] == 0
        take = first | v.eqNullSafe(acc["cur"]) | (n >= dwell)
        new = first | (take & ~v.eqNullSafe(acc["cur"]))
        here = F.struct(acc["i"].alias("i"), v.alias("v"))
        return F.struct(
            F.when(take, v).otherwise(acc["cur"]).alias("cur"), v.alias("cand"), F.when(take, F.lit(0)).otherwise(n).cast("int").alias("n"), (acc["i"] + 1).alias("i"), F.when(new, F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"),
        )

    def filled(acc: Column) -> Column:
        length = lambda i: F.coalesce(F.get(acc["out"], i + 1)["i"], acc["i"]) - F.get(acc["out"], i)["i"]
        return F.flatten(F.transform(acc["out"], lambda c, i: F.array_repeat(c["v"], length(i))))

    return F.aggregate(rows, begin, step, filled)


def switches(df: DataFrame, entity: list[str], order: str, value: str, dwell: int) -> DataFrame:
    """Frames where ``value`` changes and both the old and the new value fill the ``dwell`` rows before and after (as far as there are)."""
    w = _over(entity, order)
    old = F.lag(value).over(w)
    before, after = w.rowsBetween(-dwell, -1), w.rowsBetween(0, dwell - 1)
    d = df.withColumn("old_value", old).withColumns(
        {"_b": F.collect_list(value).over(before), "_bn": F.count("*").over(before), "_a": F.collect_list(value).over(after), "_an": F.count("*").over(after)}
    )
    held = (F.size(F.filter("_b", lambda x: x == F.col("old_value"))) == F.col("_bn")) & (F.size(F.filter("_a", lambda x: x == F.col(value))) == F.col("_an"))
    return d.where((F.col("old_value") != F.col(value)) & held).select(*entity, order, "old_value", F.col(value).alias("new_value"))
