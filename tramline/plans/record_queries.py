"""Queries over record files and scene files, which are written from the benchmark tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.session import shared_path
from tramline.sources import records

from .registry import query, table
from .surrogates import STATES, states


@query("src_04_record_files", "SELECT 's' || o_custkey AS scenario_id, count(*) AS records, true AS same FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Orders as scenario messages in seven files; each id's last record is read again by its place."""
    text = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    raw = F.concat(F.unhex(F.lit("2A")), F.unhex(F.lpad(F.hex(F.length(text)), 2, "0")), F.encode(text, "UTF-8"), F.unhex(F.lit("50")), F.unhex(F.lpad(F.hex(F.col("o_orderkey") % 128), 2, "0")))
    path = shared_path(spark, "records")
    records.write_records(table(spark, d, "orders").select(raw.alias("data")).repartition(7), path)
    r = records.read_records(spark, path, mode="failfast")
    ids = r.select(records.text_field(F.col("data"), records.SCENARIO_ID).alias("scenario_id"))
    again = records.records_at(records.scenario_places(r)).select("scenario_id", (records.text_field(F.col("data"), records.SCENARIO_ID) == F.col("scenario_id")).alias("same"))
    return ids.groupBy("scenario_id").agg(F.count("*").alias("records")).join(again, "scenario_id")


@query("src_06_scene_scan", f"WITH {STATES} SELECT 'scene_' || (agent % 16) AS scene, agent AS agent_id, frame AS scene_ts, x, y, yaw AS heading, ax FROM states")
def _(spark, d):
    """Tracks as sixteen scene files of several record batches, scanned by batch."""
    s = states(spark, d).select(F.concat(F.lit("scene_"), (F.col("agent") % 16).cast("string")).alias("scene"), F.col("agent").alias("agent_id"), F.col("frame").alias("scene_ts"), "x", "y", F.col("yaw").alias("heading"), "ax")
    path = shared_path(spark, "scenes")
    records.write_scenes(s, path, 500)
    return records.scenes(spark, path, "agent_id long, scene_ts long, x double, y double, heading double, ax double").drop("source_file")
