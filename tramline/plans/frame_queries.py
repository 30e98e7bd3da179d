"""Queries over per-frame windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import frames as fr

from .registry import query
from .surrogates import STATES, states

A = ["agent"]

_RUN = """, flagged AS (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR {v} IS DISTINCT FROM lag({v}) OVER w {gap} THEN 1 ELSE 0 END AS new_run FROM {src} WINDOW w AS (PARTITION BY agent ORDER BY frame)),
numbered AS (SELECT *, sum(new_run) OVER (PARTITION BY agent ORDER BY frame) AS run FROM flagged)"""


def _runs_sql(value: str, src: str = "states", gap: str = "", where: str = "", having: str = "", ctes: str = "") -> str:
    return (
        f"WITH {STATES}{ctes}{_RUN.format(v=value, gap=gap, src=src)} SELECT agent, {value}, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n "
        f"FROM numbered {where} GROUP BY agent, run, {value} {having}"
    )


@query("win_01_runs_dense", _runs_sql("lane"))
def _(spark, d):
    return fr.runs(states(spark, d), A, "frame", "lane")


@query("win_02_runs_sparse", _runs_sql("label", "kept", "OR frame - lag(frame) OVER w > 1", ctes=", kept AS (SELECT * FROM states WHERE valid)"))
def _(spark, d):
    return fr.runs(states(spark, d).where("valid"), A, "frame", "label", gaps=True)


@query("win_03_boolean_runs", "SELECT agent, start_frame, end_frame, n FROM (" + _runs_sql("valid", where="WHERE valid") + ") WHERE n >= 2")
def _(spark, d):
    return fr.boolean_runs(states(spark, d), A, "frame", "valid", 2)


@query(
    "win_04_bridge_gaps",
    f"WITH {STATES}{_RUN.format(v='valid', gap='', src='states')}, sized AS (SELECT *, count(*) OVER (PARTITION BY agent, run) AS len, max(run) OVER (PARTITION BY agent) AS last FROM numbered) "
    "SELECT agent, frame, valid, valid OR (run > 1 AND run < last AND len <= 2) AS bridged FROM sized",
)
def _(spark, d):
    return fr.bridge_gaps(states(spark, d), A, "frame", "valid", 2, "bridged").select("agent", "frame", "valid", "bridged")


@query("win_05_rolling_median", f"WITH {STATES} SELECT agent, frame, round(median(speed) OVER (PARTITION BY agent ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM states")
def _(spark, d):
    return states(spark, d).select("agent", "frame", F.round(fr.rolling_median(F.col("speed"), A, "frame", 2), 6).alias("smooth"))


@query(
    "win_06_rolling_mode",
    f"WITH {STATES}, near AS (SELECT a.agent, a.frame, b.lane, count(*) AS n FROM states a JOIN states b ON a.agent = b.agent AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 WHERE b.lane IS NOT NULL GROUP BY 1, 2, 3), "
    "best AS (SELECT agent, frame, lane, row_number() OVER (PARTITION BY agent, frame ORDER BY n DESC, lane) AS k FROM near) SELECT s.agent, s.frame, b.lane AS lane_mode FROM states s LEFT JOIN best b ON s.agent = b.agent AND s.frame = b.frame AND b.k = 1",
)
def _(spark, d):
    return states(spark, d).select("agent", "frame", fr.rolling_mode(F.col("lane"), A, "frame", 2).alias("lane_mode"))


@query(
    "win_09_hysteresis",
    f"""WITH RECURSIVE {STATES}, e AS (SELECT agent, frame, lane, row_number() OVER (PARTITION BY agent ORDER BY frame) AS k FROM states),
    r AS (SELECT agent, frame, k, lane AS cand, lane AS cur, 0 AS n FROM e WHERE k = 1
      UNION ALL
      SELECT agent, frame, k, lane, CASE WHEN lane IS NOT DISTINCT FROM cur OR m >= 3 THEN lane ELSE cur END, CASE WHEN lane IS NOT DISTINCT FROM cur OR m >= 3 THEN 0 ELSE m END
      FROM (SELECT e.agent, e.frame, e.k, e.lane, r.cur, CASE WHEN e.lane IS NOT DISTINCT FROM r.cand AND r.n > 0 THEN r.n + 1 ELSE 1 END AS m FROM r JOIN e ON e.agent = r.agent AND e.k = r.k + 1))
    SELECT agent, CAST(k - 1 AS BIGINT) AS frame, cur AS confirmed FROM r""",
)
def _(spark, d):
    g = states(spark, d).groupBy("agent").agg(fr.debounced(F.col("lane"), A, "frame", 3).alias("out"))
    return g.select("agent", F.posexplode("out").alias("frame", "confirmed")).withColumn("frame", F.col("frame").cast("long"))


@query(
    "win_11_central_difference",
    f"WITH {STATES} SELECT agent, frame, round(CASE WHEN lag(x) OVER w IS NULL AND lead(x) OVER w IS NULL THEN 0.0 WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / 0.125 "
    "WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / 0.125 ELSE (lead(x) OVER w - lag(x) OVER w) / 0.25 END, 6) AS dx FROM states WINDOW w AS (PARTITION BY agent ORDER BY frame)",
)
def _(spark, d):
    return states(spark, d).select("agent", "frame", F.round(fr.central_difference("x", A, "frame", 0.125), 6).alias("dx"))


@query(
    "win_12_valid_acceleration",
    f"WITH {STATES}, t AS (SELECT *, frame * 0.125 AS t FROM states) SELECT agent, frame, round(CASE WHEN valid AND lag(valid) OVER w AND lead(valid) OVER w THEN (lead(x) OVER w - lag(x) OVER w) / (lead(t) OVER w - lag(t) OVER w) END, 6) AS accel "
    "FROM t WINDOW w AS (PARTITION BY agent ORDER BY frame)",
)
def _(spark, d):
    s = states(spark, d).withColumn("t", F.col("frame") * 0.125)
    return s.select("agent", "frame", F.round(fr.valid_acceleration("x", "valid", "t", A, "frame"), 6).alias("accel"))


@query(
    "win_13_acceleration_fallback",
    f"WITH {STATES}, o AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN x END AS vx FROM states WHERE valid), e AS (SELECT *, (vx - lag(vx) OVER w) / ((frame - lag(frame) OVER w) * 0.125) AS derived FROM o WINDOW w AS (PARTITION BY agent ORDER BY frame)) "
    "SELECT agent, frame, round(coalesce(ax, derived), 6) AS ax_effective, CASE WHEN ax IS NOT NULL THEN 'raw' WHEN derived IS NOT NULL THEN 'derived_from_velocity' ELSE 'insufficient_data' END AS source FROM e",
)
def _(spark, d):
    s = states(spark, d).where("valid").withColumn("vx", F.when(F.col("event_id") % 5 != 0, F.col("x")))
    value, source = fr.fallback_acceleration("ax", "vx", A, "frame", 0.125)
    return s.select("agent", "frame", F.round(value, 6).alias("ax_effective"), source.alias("source"))


_UNWRAP = f"""WITH {STATES}, st AS (SELECT *, yaw - lag(yaw) OVER w AS dyaw FROM states WINDOW w AS (PARTITION BY agent ORDER BY frame)),
wr AS (SELECT *, coalesce(dyaw + pi() - 2 * pi() * floor((dyaw + pi()) / (2 * pi())) - pi(), 0) AS stp FROM st),
un AS (SELECT *, first_value(yaw) OVER w + sum(stp) OVER w AS heading FROM wr WINDOW w AS (PARTITION BY agent ORDER BY frame))"""


@query("win_15_heading_unwrap", _UNWRAP + " SELECT agent, frame, round(heading, 5) AS heading FROM un")
def _(spark, d):
    return states(spark, d).select("agent", "frame", F.round(fr.unwrapped("yaw", A, "frame"), 5).alias("heading"))


@query(
    "fct_05_heading_episodes",
    _UNWRAP
    + """, tr AS (SELECT *, CASE WHEN stp >= 0.017453292519943295 THEN 1 WHEN stp <= -0.017453292519943295 THEN -1 ELSE 0 END AS turning FROM un)"""
    + _RUN.format(v="turning", gap="", src="tr")
    + """ SELECT agent, turning, min(frame) AS start_frame, max(frame) AS end_frame, round(sum(stp) * 180 / pi(), 4) AS net_degrees FROM numbered WHERE turning <> 0 GROUP BY agent, run, turning HAVING count(*) >= 3 AND abs(sum(stp) * 180 / pi()) >= 10""",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame")
    step = F.coalesce(fr.wrap_angle(F.col("yaw") - F.lag("yaw").over(w)), F.lit(0.0))
    s = states(spark, d).withColumn("stp", step)
    one = 0.017453292519943295
    s = s.withColumn("turning", F.when(F.col("stp") >= one, 1).when(F.col("stp") <= -one, -1).otherwise(0))
    r = fr.run_ids(s, A, "frame", "turning").where("turning <> 0")
    net = F.degrees(F.sum("stp"))
    g = r.groupBy("agent", "run", "turning").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), net.alias("net"))
    return g.where((F.col("n") >= 3) & (F.abs("net") >= 10)).select("agent", "turning", "start_frame", "end_frame", F.round("net", 4).alias("net_degrees"))


@query(
    "win_16_switches",
    f"""WITH {STATES}, k AS (SELECT * FROM states WHERE lane IS NOT NULL), c AS (SELECT *, lag(lane) OVER w AS old_value, list(lane) OVER (PARTITION BY agent ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
      list(lane) OVER (PARTITION BY agent ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM k WINDOW w AS (PARTITION BY agent ORDER BY frame))
      SELECT agent, frame, old_value, lane AS new_value FROM c WHERE old_value <> lane AND len(list_filter(b, lambda v: v <> old_value)) = 0 AND len(list_filter(a, lambda v: v <> lane)) = 0""",
)
def _(spark, d):
    return fr.switches(states(spark, d).where("lane is not null"), A, "frame", "lane", 3)


@query("win_17_stable_runs", _runs_sql("lane", "kept", "OR frame - lag(frame) OVER w > 1", having="HAVING count(*) >= 3", ctes=", kept AS (SELECT * FROM states WHERE lane IS NOT NULL)"))
def _(spark, d):
    return fr.runs(states(spark, d).where("lane is not null"), A, "frame", "lane", gaps=True).where("n >= 3")


@query("win_18_confident_lane_runs", _runs_sql("lane", "kept", "OR frame - lag(frame) OVER w > 1", ctes=", kept AS (SELECT * FROM states WHERE lane IS NOT NULL AND conf >= 0.3)"))
def _(spark, d):
    return fr.runs(states(spark, d).where("lane is not null and conf >= 0.3"), A, "frame", "lane", gaps=True)


@query("win_19_ranked_first", f"WITH {STATES} SELECT agent, frame, event_id FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY label, conf DESC, frame) AS k FROM states) WHERE k = 1")
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("label", F.desc("conf"), "frame")
    return states(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("agent", "frame", "event_id")


@query("win_20_intensity_segments", "SELECT agent, start_frame, end_frame, n FROM (" + _runs_sql("hot", "h", ctes=", h AS (SELECT *, conf >= 0.4 AS hot FROM states)", where="WHERE hot") + ")")
def _(spark, d):
    return fr.boolean_runs(states(spark, d).withColumn("hot", F.col("conf") >= 0.4), A, "frame", "hot")


@query("win_21_lane_runs_for_changes", _runs_sql("lane", "kept", "OR frame - lag(frame) OVER w > 1", ctes=", kept AS (SELECT * FROM states WHERE valid AND lane IS NOT NULL AND conf >= 0.5)"))
def _(spark, d):
    return fr.runs(states(spark, d).where("valid and lane is not null and conf >= 0.5"), A, "frame", "lane", gaps=True)


@query("win_22_valid_range", f"WITH {STATES} SELECT agent, min(frame) FILTER (WHERE valid) AS first_valid, max(frame) FILTER (WHERE valid) AS last_valid FROM states GROUP BY agent")
def _(spark, d):
    f = F.when(F.col("valid"), F.col("frame"))
    return states(spark, d).groupBy("agent").agg(F.min(f).alias("first_valid"), F.max(f).alias("last_valid"))


@query(
    "agg_09_longest_valid_run",
    "SELECT agent, start_frame, end_frame, n FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, start_frame) AS k FROM (" + _runs_sql("valid", where="WHERE valid") + ")) WHERE k = 1",
)
def _(spark, d):
    return fr.longest_run(states(spark, d), A, "frame", "valid")


@query(
    "speed_episodes",
    f"""WITH {STATES}, sm AS (SELECT *, median(speed) OVER (PARTITION BY agent ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth, frame * 0.1 AS t FROM states),
    ac AS (SELECT *, CASE WHEN valid AND lag(valid) OVER w AND lead(valid) OVER w THEN round((lead(smooth) OVER w - lag(smooth) OVER w) / (lead(t) OVER w - lag(t) OVER w), 6) END AS accel FROM sm WINDOW w AS (PARTITION BY agent ORDER BY frame)),
    sg AS (SELECT *, CASE WHEN accel >= 20 THEN 'accelerate' WHEN accel <= -20 THEN 'decelerate' END AS trend FROM ac)"""
    + _RUN.format(v="trend", gap="", src="sg")
    + " SELECT agent, trend, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, round(max(abs(accel)), 4) AS peak FROM numbered WHERE trend IS NOT NULL GROUP BY agent, run, trend HAVING count(*) >= 2",
)
def speed_episodes(spark, d):
    """The flagship: smoothed speed, centred acceleration, thresholds, runs."""
    s = states(spark, d).withColumn("smooth", fr.rolling_median(F.col("speed"), A, "frame", 2)).withColumn("t", F.col("frame") * 0.1)
    s = s.withColumn("accel", F.round(fr.valid_acceleration("smooth", "valid", "t", A, "frame"), 6))
    s = s.withColumn("trend", F.when(F.col("accel") >= 20, "accelerate").when(F.col("accel") <= -20, "decelerate"))
    r = fr.run_ids(s, A, "frame", "trend").where("trend is not null")
    g = r.groupBy("agent", "run", "trend").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.round(F.max(F.abs("accel")), 4).alias("peak"))
    return g.where("n >= 2").drop("run")
