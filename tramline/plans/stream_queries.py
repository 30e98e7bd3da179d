"""Streaming operators over the events table, run as streams to their end, and the remote-model operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import tracks
from tramline.session import shared_path
from tramline.streaming import streams

from .registry import query, table


def run_to_end(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives of the stream of all events there are, as rows of the files it appends to."""
    at, state = shared_path(spark, name), shared_path(spark, name + "-state")
    # as a pattern, as the stream reader takes no single file by its path
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    out = build(events.withColumn("ts", F.col("ts").cast("timestamp")))
    q = out.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(at)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(at)


@query(
    "st_03_debounced_states",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(length(event_type) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, v AS cand, v AS cur, 0 AS n FROM e WHERE k = 1
      UNION ALL
      SELECT user_id, event_id, k, v, CASE WHEN v = cur OR m >= 3 THEN v ELSE cur END, CASE WHEN v = cur OR m >= 3 THEN 0 ELSE m END
      FROM (SELECT e.user_id, e.event_id, e.k, e.v, r.cur, CASE WHEN e.v = r.cand AND r.n > 0 THEN r.n + 1 ELSE 1 END AS m FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
    SELECT user_id, event_id, cur AS confirmed FROM r""",
)
def _(spark, d):
    return run_to_end(spark, d, lambda e: streams.debounced(e.select("user_id", "event_id", "ts", F.length("event_type").cast("long").alias("v")), "user_id", "event_id", "v", 3, "ts", idle="60 days"), "st_03")


@query("st_04_first_of_key", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return run_to_end(spark, d, lambda e: streams.first_reviews(e, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "st_04")


@query(
    "st_05_stream_pairs",
    """WITH s AS (SELECT user_id % 10 AS scene, event_id // 20 AS frame, ts, event_type, value AS x FROM events)
    SELECT a.scene, a.frame, round(abs(a.x - b.x), 6) AS distance FROM s a JOIN s b ON a.scene = b.scene AND a.frame = b.frame AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL '1 minute' AND a.ts + INTERVAL '1 minute'""",
)
def _(spark, d):
    def build(e: DataFrame) -> DataFrame:
        side = lambda kind: e.where(F.col("event_type") == kind).select(F.pmod("user_id", F.lit(10)).alias("scene"), F.floor(F.col("event_id") / 20).alias("frame"), "ts", F.col("value").alias("x"), F.lit(0.0).alias("y"))
        return streams.frame_pairs(side("click"), side("view"), "ts").select("scene", "frame", F.round("distance", 6).alias("distance"))

    return run_to_end(spark, d, build, "st_05")


@query(
    "st_06_closed_windows",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, start, n FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
)
def _(spark, d):
    """Windows that the watermark has passed; the others wait for late rows still."""
    return run_to_end(spark, d, lambda e: streams.windowed_counts(e, "ts", ["event_type"], "1 hour"), "st_06").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _unsteady() -> Callable[[dict], str]:
    """A client that fails ``k % 4`` times for each row, told by the attempt's number, so that a task that runs again sees the same."""

    def call(row: dict) -> str:
        if row["attempt"] <= row["k"] % 4:
            raise ConnectionError("busy")
        return row["name"].upper()

    return call


@query(
    "txt_11_remote_model",
    "SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 4 < 3 THEN upper(s_name) END AS answer, CASE WHEN s_suppkey % 4 < 3 THEN 'ok' ELSE 'failed' END AS status, least(s_suppkey % 4 + 1, 3) AS attempts FROM supplier",
)
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return tracks.generated(rows, _unsteady, "k long, name string, answer string, status string, attempts long", wait=0.0)
