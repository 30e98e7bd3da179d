"""Trajectory-shaped views of the benchmark tables, in DataFrame form and as SQL text.

An event user is an agent and its n-th event a frame. Coordinates and headings are whole multiples of binary fractions, so
that sums are the same in any order. Suppliers and parts are lanes and vehicles, orders are intervals, embeddings polylines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table


def states(spark: SparkSession, d: str) -> DataFrame:
    """(agent, frame, event_id, ts, speed, label, valid, lane, conf, x, y, yaw, ax): one row a frame, dense from 0."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    s = e.select(F.col("user_id").alias("agent"), frame.cast("long").alias("frame"), "event_id", "ts", F.col("value").alias("speed"), F.col("event_type").alias("label"))
    f, i = F.col("frame"), F.col("event_id")
    lane = F.when(i % 13 == 0, F.lit(None)).when(i % 11 < 9, F.floor(f / 8)).otherwise(i % 4)
    return s.withColumns(
        {
            "valid": F.col("label") != "error",
            "lane": lane.cast("long"),
            "conf": (i % 10) / 10.0,
            "x": f * 0.5 + (i % 7) * 0.25,
            "y": (i % 5) * 0.25,
            "yaw": ((f * 7 + i % 9) % 256) * 0.03125 - 4.0,
            "ax": F.when(i % 3 != 0, (i % 16) * 0.25),
        }
    )


STATES = """states AS (
  SELECT *, label <> 'error' AS valid,
    CAST(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 < 9 THEN floor(frame / 8.0) ELSE event_id % 4 END AS BIGINT) AS lane,
    (event_id % 10) / 10.0 AS conf, frame * 0.5 + (event_id % 7) * 0.25 AS x, (event_id % 5) * 0.25 AS y,
    ((frame * 7 + event_id % 9) % 256) * 0.03125 - 4.0 AS yaw,
    CASE WHEN event_id % 3 <> 0 THEN (event_id % 16) * 0.25 END AS ax
  FROM (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
          event_id, ts, value AS speed, event_type AS label FROM events))"""


def pairs_source(spark: SparkSession, d: str) -> DataFrame:
    """(scene, agent): suppliers of an order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("agent"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """(interval_id, agent, start_frame, end_frame, kind)"""
    o = table(spark, d, "orders")
    start = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("interval_id"), F.col("o_custkey").alias("agent"), start.alias("start_frame"), (start + F.col("o_orderkey") % 10).alias("end_frame"), F.col("o_orderpriority").alias("kind"))


INTERVALS = """intervals AS (
  SELECT o_orderkey AS interval_id, o_custkey AS agent, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start_frame,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 10 AS BIGINT) AS end_frame, o_orderpriority AS kind FROM orders)"""


def polylines(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, points array<struct<x, y>>): components in quarters, in pairs."""
    e = table(spark, d, "embeddings")
    at = lambda i: F.round(F.get("embedding", i) * 64, 0).cast("double") / 4
    n = F.sequence(F.lit(0), F.lit(31))
    return e.select(F.col("vec_id").alias("line_id"), F.transform(n, lambda i: F.struct(at(i * 2).alias("x"), at(i * 2 + 1).alias("y"))).alias("points"))


POLYLINES = """points AS (
  SELECT vec_id AS line_id, CAST(i AS BIGINT) AS seq, round(embedding[2 * i + 1] * 64, 0)::DOUBLE / 4 AS x, round(embedding[2 * i + 2] * 64, 0)::DOUBLE / 4 AS y
  FROM embeddings, range(32) t(i))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): lanes in chains of seven, by supplier key."""
    return table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))


EDGES = "edges AS (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier WHERE s_suppkey % 7 <> 0)"
