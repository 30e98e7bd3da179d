"""Queries over the numeric kernels, sources and sinks, with SQL where the surrogate data allow it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import geometry as g
from tramline.operators import frames as fr
from tramline.operators import tracks
from tramline.session import shared_path
from tramline.sources import files

from .frame_queries import _RUN
from .registry import query, table
from .surrogates import INTERVALS, POLYLINES, STATES, intervals, polylines, states

A = ["agent"]


def _scenarios(spark, d):
    """(scenario_id, source_file, record_index): orders as scenarios, spread over seven files."""
    o = table(spark, d, "orders")
    w = Window.partitionBy(F.col("o_orderkey") % 7).orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("scenario_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("source_file"), (F.row_number().over(w) - 1).cast("long").alias("record_index"))


_SCEN = "s AS (SELECT o_custkey AS scenario_id, 'f' || (o_orderkey % 7) AS source_file, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) - 1 AS record_index FROM orders)"


@query("src_02_scan_by_id", f"WITH {_SCEN} SELECT * FROM s WHERE scenario_id = (SELECT min(scenario_id) FROM s)")
def _(spark, d):
    s = _scenarios(spark, d)
    return files.by_id(s, table(spark, d, "orders").agg(F.min("o_custkey")).first()[0])


@query("src_03_scan_by_ordinal", f"WITH {_SCEN} SELECT * FROM s WHERE source_file = 'f3' AND record_index = 5")
def _(spark, d):
    return files.by_ordinal(_scenarios(spark, d), "f3", 5)


@query("src_04_scenario_index", f"WITH {_SCEN}, k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY source_file DESC, record_index DESC) AS k FROM s) SELECT scenario_id, source_file, record_index FROM k WHERE k = 1")
def _(spark, d):
    return files.scenario_index(_scenarios(spark, d))


@query("src_05_first_scenarios", f"WITH {_SCEN} SELECT * FROM s ORDER BY source_file, record_index LIMIT 25")
def _(spark, d):
    return files.first_scenarios(_scenarios(spark, d), 25)


@query("src_07_cache_root", "SELECT n_nationkey, coalesce(CASE WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey END) AS root FROM nation")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("c1"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("c2"))
    roots = n.where(F.expr("cast(substr(c1, 2) as int) % 2 = 0")).select(F.col("c1").alias("root")).union(n.where("n_nationkey % 3 = 0").select("c2"))
    return files.cache_root(n, roots, "n_nationkey", ["c1", "c2"])


def _out(spark, name: str) -> str:
    return shared_path(spark, name)


@query("src_08_typed_csv", "SELECT o_orderkey AS interaction_id, CAST(o_custkey AS VARCHAR) || ';7' AS track_id, CAST(o_orderkey % 90 AS INT) AS \"start\", CAST(o_orderkey % 90 + 5 AS INT) AS \"end\", o_totalprice AS intensity FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, d):
    k = F.col("o_orderkey")
    bad = F.when(k % 10 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    raw = table(spark, d, "orders").select(bad.alias("interaction_id"), F.concat(F.col("o_custkey").cast("string"), F.lit(";7")).alias("track_id"), (k % 90).alias("start"), (k % 90 + 5).alias("end"), F.col("o_totalprice").alias("intensity"))
    path = _out(spark, "src_08")
    raw.write.option("header", True).csv(path)
    return files.typed_csv(spark, path)[0]


@query("src_09_json_lines", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path = _out(spark, "src_09")
    files.write_json_lines(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    return files.json_lines(spark, path, spark.createDataFrame([], "event_id long, event_type string").schema)[0].select("event_id", "event_type")


@query("src_10_json_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path = _out(spark, "src_10")
    files.write_json_lines(table(spark, d, "events").select("event_type", "event_id", "value"), path, ["event_type"])
    return spark.read.json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("src_11_csv_cells", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS cell FROM customer")
def _(spark, d):
    return files.json_cells(table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("cell")))


@query("src_13_unfinished_work", "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) SELECT o_orderkey, expected FROM (SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS expected FROM orders) LEFT JOIN n ON o_orderkey = l_orderkey WHERE coalesce(n, 0) <> expected")
def _(spark, d):
    work = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("expected"))
    done = table(spark, d, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.unfinished(work, done, "o_orderkey", "expected")


@query("src_15_scene_batch", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey BETWEEN 5 + 2 * 3 AND 5 + 2 * 3 + 2")
def _(spark, d):
    return files.batch_of(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 5, 3, 2)


@query("prj_10_key_removal", "SELECT event_id, '{\"a\": ' || (event_id % 5) || ', \"b\": [{\"c\": 1}]}' AS body FROM events")
def _(spark, d):
    raw = F.format_string('{"policy": 1, "a": %d, "b": [{"x_audit_only": 2, "c": 1}]}', F.col("event_id") % 5)
    return table(spark, d, "events").select("event_id", tracks.without_keys(raw, ["policy"]).alias("body"))


@query("prj_15_relative_trajectory", f"WITH {STATES}, o AS (SELECT agent, arg_min(x, frame) FILTER (WHERE valid) AS x0 FROM states GROUP BY agent) SELECT s.agent, frame, CASE WHEN valid THEN x - x0 END AS rx FROM states s JOIN o ON s.agent = o.agent")
def _(spark, d):
    w = Window.partitionBy("agent")
    x0 = F.min_by("x", F.when(F.col("valid"), F.col("frame"))).over(w)
    return states(spark, d).select("agent", "frame", F.when(F.col("valid"), F.bround(F.col("x") - x0, 3)).alias("rx"))


@query("win_07_08_stable_lanes")
def _(spark, d):
    return tracks.stable_lanes(states(spark, d), "agent", "frame", "lane", "conf")


_SAVGOL = {-3: -2, -2: 3, -1: 6, 0: 7, 1: 6, 2: 3, 3: -2}


@query(
    "win_14_savgol_interior",
    f"WITH {STATES}, k AS (SELECT agent, frame, ("
    + " + ".join(f"({c}) * " + (f"lag(x, {-o}) OVER w" if o < 0 else f"lead(x, {o}) OVER w" if o else "x") for o, c in _SAVGOL.items())
    + ") / 21 AS smooth FROM states WINDOW w AS (PARTITION BY agent ORDER BY frame)) SELECT agent, frame, round(smooth, 5) AS smooth FROM k WHERE smooth IS NOT NULL",
)
def _(spark, d):
    s = tracks.smoothed(states(spark, d), "agent", "frame", "x")
    e = Window.partitionBy("agent")
    last = F.max("frame").over(e)
    return s.withColumn("last", last).where("frame >= 3 and frame <= last - 3").select("agent", "frame", F.round("smooth", 5).alias("smooth"))


@query("geo_12_box_overlap", f"WITH {STATES} SELECT agent, frame, round(CAST(greatest(0, 4 - abs(((event_id % 7) - 3) * 0.5)) * greatest(0, 2 - y) AS DOUBLE), 6) AS shared FROM states")
def _(spark, d):
    dx = (F.col("event_id") % 7 - 3) * 0.5
    zero = F.lit(0.0)
    return states(spark, d).select("agent", "frame", F.round(tracks.box_overlap(zero, zero, zero, dx.cast("double"), F.col("y"), zero, F.lit(4.0), F.lit(2.0)), 6).alias("shared"))


@query("geo_16_conflict_points")
def _(spark, d):
    p = polylines(spark, d)
    o = p.select((F.col("line_id") - 1).alias("line_id"), F.col("points").alias("other"))
    c = p.join(o, "line_id").select("line_id", tracks.conflict("points", "other").alias("c"))
    return c.where("c.x is not null").select("line_id", "c.*")


@query("fct_16_separation_effort")
def _(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_quantity")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("d1"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("d2"))
    j = a.join(b, "l_orderkey")
    # equal arrivals are searched once, and those that are apart already need no search
    cases = j.select("d1", "d2").distinct()
    apart = F.abs(F.col("d1") - F.col("d2")) / 10 >= 1.5
    cases = cases.withColumn("effort", F.when(apart, F.lit(0.0)).otherwise(tracks.separation_effort("d1", F.lit(10.0), "d2", F.lit(10.0))))
    return j.join(cases, ["d1", "d2"]).select("l_orderkey", F.round("effort", 2).alias("effort"))


@query("fct_04_speed_episodes")
def _(spark, d):
    return tracks.speed_episodes(states(spark, d).withColumn("v", F.col("x") * 0.5), "agent", "frame", "v")


@query("txt_06_segment_dedupe")
def _(spark, d):
    return tracks.deduped_segments(intervals(spark, d).select("agent", "interval_id", "start_frame", "end_frame", "kind"), "agent", "interval_id")


@query(
    "fct_03_lateral_evidence",
    f"WITH {STATES}, r AS (SELECT *, CASE WHEN (y - lag(y) OVER w) / 0.5 >= 0.5 THEN 1 WHEN (y - lag(y) OVER w) / 0.5 <= -0.5 THEN -1 ELSE 0 END AS drift FROM states WHERE valid WINDOW w AS (PARTITION BY agent ORDER BY frame))"
    + _RUN.format(v="drift", gap="OR frame - lag(frame) OVER w > 1", src="r")
    + ", e AS (SELECT agent, drift, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, max(y) - min(y) AS moved FROM numbered WHERE drift <> 0 GROUP BY agent, run, drift) SELECT agent, drift, start_frame, end_frame, n FROM e WHERE n >= 2 AND moved >= 0.25",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame")
    rate = (F.col("y") - F.lag("y").over(w)) / 0.5
    s = states(spark, d).where("valid").withColumn("drift", F.when(rate >= 0.5, 1).when(rate <= -0.5, -1).otherwise(0))
    r = fr.run_ids(s, A, "frame", "drift", gaps=True).where("drift <> 0")
    e = r.groupBy("agent", "run", "drift").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("moved"))
    return e.where("n >= 2 and moved >= 0.25").drop("run", "moved")


@query("fct_07_turn_gate", f"WITH {STATES}, t AS (SELECT agent, arg_max(yaw, frame) - arg_min(yaw, frame) AS net, arg_max(y, frame) - arg_min(y, frame) AS path FROM states WHERE valid GROUP BY agent) SELECT agent, CASE WHEN abs(degrees(net)) >= 25 AND abs(path) >= 0.25 AND sign(net) = sign(path) THEN CASE WHEN net > 0 THEN 'left' ELSE 'right' END ELSE 'none' END AS turn FROM t")
def _(spark, d):
    f = F.col("frame")
    t = states(spark, d).where("valid").groupBy("agent").agg((F.max_by("yaw", f) - F.min_by("yaw", f)).alias("net"), (F.max_by("y", f) - F.min_by("y", f)).alias("path"))
    ok = (F.abs(F.degrees("net")) >= 25) & (F.abs("path") >= 0.25) & (F.signum("net") == F.signum("path"))
    return t.select("agent", F.when(ok, F.when(F.col("net") > 0, "left").otherwise("right")).otherwise("none").alias("turn"))


@query(
    "fct_20_path_labels",
    f"WITH {STATES}, t AS (SELECT agent, frame, degrees(yaw) AS deg, lag(degrees(yaw), 4) OVER (PARTITION BY agent ORDER BY frame) AS before FROM states) SELECT agent, frame, CASE WHEN abs(before - deg) < 10 THEN 'S' WHEN before - deg BETWEEN -170 AND -10 AND before - deg <> -10 THEN 'L' WHEN before - deg BETWEEN 10 AND 170 AND before - deg <> 10 THEN 'R' ELSE 'U' END AS turn FROM t WHERE before IS NOT NULL",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame")
    s = states(spark, d).select("agent", "frame", F.degrees("yaw").alias("deg")).withColumn("a", F.lag("deg", 4).over(w) - F.col("deg")).where("a is not null")
    a = F.col("a")
    turn = F.when(F.abs(a) < 10, "S").when((a >= -170) & (a < -10), "L").when((a > 10) & (a <= 170), "R").otherwise("U")
    return s.select("agent", "frame", turn.alias("turn"))


@query("fct_38_local_map_input", f"WITH {POLYLINES} SELECT line_id, count(*) AS n FROM points WHERE sqrt(x * x + y * y) <= 6 GROUP BY line_id HAVING count(*) >= 3")
def _(spark, d):
    p = polylines(spark, d).withColumn("near", F.filter("points", lambda q: F.hypot(q["x"], q["y"]) <= 6)).where(F.size("near") >= 3)
    return p.select("line_id", F.size("near").cast("long").alias("n"))


@query("fct_43_motion_rows", f"WITH {STATES} SELECT agent, frame, x, x - lag(x) OVER (PARTITION BY agent ORDER BY frame) AS vx FROM states")
def _(spark, d):
    s = states(spark, d).groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("states"))
    rows = s.select("agent", F.explode("states").alias("s")).select("agent", "s.*")
    return rows.withColumn("vx", F.col("x") - F.lag("x").over(Window.partitionBy("agent").orderBy("frame")))


@query(
    "fct_44_box_collisions",
    f"WITH {STATES}, {INTERVALS}, i AS (SELECT interval_id, agent, interval_id % 40 AS s, interval_id % 40 + 8 AS e FROM intervals) SELECT interval_id, count(x) AS frames, 9 - count(x) AS missing, max(CASE WHEN x IS NOT NULL THEN greatest(0, 4 - abs(x - 10)) END) AS most FROM i LEFT JOIN states t ON t.agent = i.agent AND frame BETWEEN s AND e AND valid GROUP BY interval_id",
)
def _(spark, d):
    i = intervals(spark, d).select("interval_id", "agent", F.explode(F.sequence(F.col("interval_id") % 40, F.col("interval_id") % 40 + 8)).alias("frame"))
    s = states(spark, d).where("valid").select("agent", "frame", "x")
    j = i.join(s, ["agent", "frame"], "left")
    zero = F.lit(0.0)
    shared = F.when(F.col("x").isNotNull(), tracks.box_overlap(zero, zero, zero, F.coalesce("x", F.lit(1e6)) - 10, zero, zero, F.lit(4.0), F.lit(1.0)))
    j = j.withColumn("shared", shared)
    return j.groupBy("interval_id").agg(F.count("x").alias("frames"), (9 - F.count("x")).alias("missing"), F.round(F.max("shared"), 6).alias("most"))


@query("geo_09_segment_distance", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey % 9 END AS DOUBLE) AS apart FROM supplier")
def _(spark, d):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), (y if not isinstance(y, (int, float)) else F.lit(y)).cast("double").alias("y"))
    s = F.struct(p(0.0, 0.0).alias("a"), p(10.0, 0.0).alias("b"))
    t = F.struct(p(2.0, F.col("s_suppkey") % 9).alias("a"), p(8.0, F.col("s_suppkey") % 9).alias("b"))
    return table(spark, d, "supplier").select("s_suppkey", g.segment_distance(s, t).alias("apart"))


@query("st_01_windowed_counts", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from tramline.streaming.streams import windowed_counts

    return windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "st_02_session_episodes",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(spark, d):
    from tramline.streaming.streams import session_episodes

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return session_episodes(e, "ts", ["user_id"], "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
