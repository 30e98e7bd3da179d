"""Column expressions over plane coordinates. Points are structs with x and y; polylines arrays of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def segments(points: Column) -> Column:
    """Consecutive point pairs (a, b)."""
    n = F.size(points)
    return F.when(n >= 2, F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def length(segment: Column) -> Column:
    return F.hypot(segment["b"]["x"] - segment["a"]["x"], segment["b"]["y"] - segment["a"]["y"])


def arc_length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda acc, s: acc + length(s))


def tangents(points: Column) -> Column:
    """Unit directions by point: central inside, one-sided at the ends, (1, 0) where there is none."""
    n = F.size(points)

    def one(i: Column) -> Column:
        a, b = F.get(points, F.greatest(i - 1, F.lit(0))), F.get(points, F.least(i + 1, n - 1))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        h = F.hypot(dx, dy)
        return F.struct(F.when(h > 0, dx / h).otherwise(1.0).alias("x"), F.when(h > 0, dy / h).otherwise(0.0).alias("y"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def project(px: Column, py: Column, points: Column) -> Column:
    """The nearest place of a polyline as (distance, segment, s, d, heading): its arc length, signed offset (left positive), direction.

    The first of equally near segments: distances count as equal to nine decimals, as two segments at their common point differ by
    the rounding of their parts. Null where the position is, or without a segment.
    """

    def laid(seg: Column) -> Column:
        ax, ay = seg["a"]["x"], seg["a"]["y"]
        return F.struct(ax.alias("ax"), ay.alias("ay"), (seg["b"]["x"] - ax).alias("dx"), (seg["b"]["y"] - ay).alias("dy"))

    def placed(q: Column) -> Column:
        h2 = q["dx"] * q["dx"] + q["dy"] * q["dy"]
        t = F.when(h2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - q["ax"]) * q["dx"] + (py - q["ay"]) * q["dy"]) / h2))).otherwise(0.0)
        return F.struct(*(q[c].alias(c) for c in ("ax", "ay", "dx", "dy")), t.alias("t"), F.hypot(q["dx"], q["dy"]).alias("h"))

    def measured(q: Column, i: Column) -> Column:
        away = F.hypot(px - (q["ax"] + q["t"] * q["dx"]), py - (q["ay"] + q["t"] * q["dy"]))
        return F.struct(F.round(away, 9).alias("near"), i.alias("segment"), away.alias("distance"), (q["t"] * q["h"]).alias("along"), cross(q["dx"], q["dy"], px - q["ax"], py - q["ay"]).alias("side"), F.atan2(q["dy"], q["dx"]).alias("heading"))

    pieces = segments(points)
    best = F.array_min(F.transform(F.transform(F.transform(pieces, laid), placed), measured))

    def whole(b: Column) -> Column:
        before = F.aggregate(F.slice(pieces, F.lit(1), b["segment"]), F.lit(0.0), lambda acc, s: acc + length(s))
        return F.struct(b["distance"].alias("distance"), b["segment"].alias("segment"), (before + b["along"]).alias("s"), F.when(b["side"] < 0, -b["distance"]).otherwise(b["distance"]).alias("d"), b["heading"].alias("heading"))

    known = px.isNotNull() & py.isNotNull()
    return F.get(F.transform(F.filter(F.array(F.when(known, best)), lambda b: b.isNotNull() & ~F.isnan(b["distance"])), whole), 0)


def arc_at(points: Column, index: Column) -> Column:
    """Arc length up to a point, by its place from 0; places outside are cut to the ends."""
    last = F.greatest(F.least(index, F.size(points) - 1), F.lit(0))
    return arc_length(F.slice(points, F.lit(1), (last + 1).cast("int")))


def segment_distance(s: Column, t: Column) -> Column:
    """Between two segments; 0 where they cross."""

    def side(a: Column, b: Column, p: Column) -> Column:
        return cross(b["x"] - a["x"], b["y"] - a["y"], p["x"] - a["x"], p["y"] - a["y"])

    crossing = (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)

    def near(p: Column, q: Column) -> Column:
        dx, dy = q["b"]["x"] - q["a"]["x"], q["b"]["y"] - q["a"]["y"]
        h2 = dx * dx + dy * dy
        u = F.when(h2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - q["a"]["x"]) * dx + (p["y"] - q["a"]["y"]) * dy) / h2))).otherwise(0.0)
        return F.hypot(p["x"] - (q["a"]["x"] + u * dx), p["y"] - (q["a"]["y"] + u * dy))

    return F.when(crossing, F.lit(0.0)).otherwise(F.least(near(s["a"], t), near(s["b"], t), near(t["a"], s), near(t["b"], s)))


def polyline_distance(a: Column, b: Column) -> Column:
    """The least over all pairs of segments; null if either has none."""
    return F.array_min(F.flatten(F.transform(segments(a), lambda s: F.transform(segments(b), lambda t: segment_distance(s, t)))))


def point_set_distance(a: Column, b: Column) -> Column:
    """The least between points; infinite if either is empty."""
    best = F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))))
    return F.coalesce(best, F.lit(float("inf")))


def nearest_index(points: Column, px: Column, py: Column) -> Column:
    """Place of the nearest point, from 0, the first of equals."""
    marked = F.transform(points, lambda p, i: F.struct(F.hypot(p["x"] - px, p["y"] - py).alias("d"), i.alias("i")))
    return F.array_min(marked)["i"]


def around(points: Column, at: Column, before: int, after: int) -> Column:
    """Points from ``before`` ahead of a place to ``after`` behind it, cut at the ends."""
    first = F.greatest(at - before, F.lit(0))
    return F.slice(points, first + 1, F.greatest(F.least(at + after, F.size(points) - 1) - first + 1, F.lit(0)))


def spaced(points: Column, least: float) -> Column:
    """Points over ``least`` from the last kept one; the first is always kept."""

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        keep = (F.size(acc) == 0) | (F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > least)
        return F.when(keep, F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), lambda acc, p: step(acc, F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))


def cut(points: Column, reach: float) -> Column:
    """The end point after going ``reach`` along the polyline: interpolated, or beyond the last segment in its direction."""
    begin = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        h = length(s)
        left = reach - acc["run"]
        x = F.when(h > 0, s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * left / h).otherwise(s["a"]["x"])
        y = F.when(h > 0, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * left / h).otherwise(s["a"]["y"])
        keep = acc["done"] | ((h == 0) & acc["x"].isNotNull())
        return F.struct((acc["run"] + h).alias("run"), F.when(keep, acc["x"]).otherwise(x).alias("x"), F.when(keep, acc["y"]).otherwise(y).alias("y"), (acc["done"] | (acc["run"] + h >= reach)).alias("done"))

    out = F.aggregate(segments(points), begin, step)
    return F.when(out["x"].isNotNull(), F.struct(out["x"].alias("x"), out["y"].alias("y")))


def crossing_type(degrees: Column) -> Column:
    """By the angle between directions: parallel to 30, crossing under 150, opposing from there."""
    a = F.abs(degrees)
    return F.when(a <= 30, "P").when(a < 150, "C").otherwise("O")


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def corners(x: Column, y: Column, yaw: Column, long: Column, wide: Column) -> Column:
    """Corners of an oriented box, counter-clockwise from the front left."""
    out = []
    for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        rx, ry = rotated(long * (sx / 2), wide * (sy / 2), yaw)
        out.append(F.struct((x + rx).alias("x"), (y + ry).alias("y")))
    return F.array(*out)


def bankers_round(x: Column, digits: int) -> Column:
    """Half to even; null for values that aren't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, digits))
