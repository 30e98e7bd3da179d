"""Queries over aggregates and reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import frames as fr

from .registry import query, table
from .surrogates import STATES, states


@query("agg_01_status_counts", "SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("status")).agg(F.count("*").alias("n"))


@query("agg_02_contingency", "SELECT coalesce(lang, 'None') AS k1, coalesce(source, 'None') AS k2, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    name = lambda c: F.coalesce(c, F.lit("None"))
    return table(spark, d, "documents").groupBy(name(F.col("lang")).alias("k1"), name(F.col("source")).alias("k2")).agg(F.count("*").alias("n"))


@query("agg_03_summary_report", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def _(spark, d):
    table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").createOrReplaceTempView("agg_03_lines")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, grouping_id(l_returnflag, l_linestatus) AS level FROM agg_03_lines GROUP BY l_returnflag, l_linestatus GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")


@query("agg_04_scenario_summary", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, array_to_string(list(DISTINCT l_suppkey ORDER BY l_suppkey), ',') AS ids, count(DISTINCT l_suppkey) * (count(DISTINCT l_suppkey) - 1) // 2 AS pairs FROM lineitem GROUP BY 1")
def _(spark, d):
    ids = F.array_sort(F.collect_set("l_suppkey"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), ids.alias("i"))
    k = F.size("i").cast("long")
    return g.select("l_orderkey", "n", "returned", F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"), F.floor(k * (k - 1) / 2).alias("pairs"))


@query(
    "agg_05_track_motion",
    f"""WITH {STATES}, v AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame - lag(frame) OVER w AS df FROM states WHERE valid WINDOW w AS (PARTITION BY agent ORDER BY frame))
    SELECT agent, count(*) AS valid_count, round(max(speed), 6) AS max_speed, round(quantile_cont(speed, 0.95), 6) AS p95, round(sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)), 6) AS displacement,
      round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)), 6) AS extent, round(coalesce(sum(sqrt(dx * dx + dy * dy)) FILTER (WHERE df = 1), 0), 4) AS path FROM v GROUP BY agent""",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame")
    s = states(spark, d).where("valid")
    s = s.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "df": F.col("frame") - F.lag("frame").over(w)})
    end = lambda c: F.pow(F.max_by(c, "frame") - F.min_by(c, "frame"), 2)
    box = lambda c: F.pow(F.max(c) - F.min(c), 2)
    step = F.when(F.col("df") == 1, F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    return s.groupBy("agent").agg(
        F.count("*").alias("valid_count"), F.round(F.max("speed"), 6).alias("max_speed"), F.round(F.percentile("speed", 0.95), 6).alias("p95"), F.round(F.sqrt(end("x") + end("y")), 6).alias("displacement"),
        F.round(F.sqrt(box("x") + box("y")), 6).alias("extent"), F.round(F.coalesce(F.sum(step), F.lit(0.0)), 4).alias("path"),
    )


@query(
    "agg_06_speed_summary",
    f"WITH {STATES}, m AS (SELECT agent, valid, median(speed) OVER (PARTITION BY agent ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM states) SELECT agent, round(median(sm), 6) AS mid, round(min(sm), 6) AS low, round(max(sm), 6) AS high FROM m WHERE valid GROUP BY agent",
)
def _(spark, d):
    s = states(spark, d).withColumn("sm", fr.rolling_median(F.col("speed"), ["agent"], "frame", 2)).where("valid")
    return s.groupBy("agent").agg(F.round(F.median("sm"), 6).alias("mid"), F.round(F.min("sm"), 6).alias("low"), F.round(F.max("sm"), 6).alias("high"))


@query(
    "agg_07_dominant_category",
    f"WITH {STATES}, c AS (SELECT agent, label, count(*) AS n FROM states GROUP BY 1, 2), k AS (SELECT *, sum(n) FILTER (WHERE label <> 'error') OVER (PARTITION BY agent) AS known, row_number() OVER (PARTITION BY agent ORDER BY label = 'error', n DESC, label DESC) AS r FROM c) SELECT agent, label AS dominant, round(CAST(n AS DOUBLE) / known, 4) AS dominance FROM k WHERE r = 1",
)
def _(spark, d):
    c = states(spark, d).groupBy("agent", "label").agg(F.count("*").alias("n")).where("label <> 'error'")
    g = c.groupBy("agent").agg(F.max(F.struct("n", "label")).alias("b"), F.sum("n").alias("known"))
    return g.select("agent", F.col("b.label").alias("dominant"), F.round(F.col("b.n") / F.col("known"), 4).alias("dominance"))


@query(
    "agg_08_modes",
    f"WITH {STATES}, c AS (SELECT agent, lane, count(*) AS n, min(frame) AS f FROM states WHERE lane IS NOT NULL GROUP BY 1, 2) SELECT agent, arg_min(lane, struct_pack(a := -n, b := lane)) AS by_value, arg_min(lane, struct_pack(a := -n, b := f)) AS by_first FROM c GROUP BY agent",
)
def _(spark, d):
    c = states(spark, d).where("lane is not null").groupBy("agent", "lane").agg(F.count("*").alias("n"), F.min("frame").alias("f")).withColumn("m", -F.col("n"))
    return c.groupBy("agent").agg(F.min(F.struct("m", "lane"))["lane"].alias("by_value"), F.min_by("lane", F.struct("m", "f")).alias("by_first"))


@query(
    "agg_12_agent_summary",
    f"WITH {STATES} SELECT agent, arg_min(x, frame) FILTER (WHERE valid) AS first_x, arg_max(x, frame) FILTER (WHERE valid) AS last_x, round(max(speed) FILTER (WHERE valid), 6) AS top, round(min(speed) FILTER (WHERE valid), 6) AS low FROM states GROUP BY agent",
)
def _(spark, d):
    return states(spark, d).groupBy("agent").agg(
        F.min_by("x", F.when(F.col("valid"), F.col("frame"))).alias("first_x"), F.max_by("x", F.when(F.col("valid"), F.col("frame"))).alias("last_x"),
        F.round(F.max(F.when(F.col("valid"), F.col("speed"))), 6).alias("top"), F.round(F.min(F.when(F.col("valid"), F.col("speed"))), 6).alias("low"),
    )


@query(
    "agg_13_intensity_and_pet",
    f"""WITH {STATES}, h AS (SELECT agent, min(frame) AS s, max(frame) AS e FROM states WHERE conf >= 0.8 GROUP BY agent), f AS (SELECT agent, s, e, unnest(generate_series(s, e)) AS frame FROM h WHERE e - s > 3)
    SELECT f.agent, s AS start_frame, e AS end_frame, max(coalesce(CASE WHEN valid THEN conf END, 0)) AS intensity, min(coalesce(CASE WHEN valid THEN y END, 0)) AS pet FROM f LEFT JOIN states t ON f.agent = t.agent AND f.frame = t.frame GROUP BY 1, 2, 3""",
)
def _(spark, d):
    s = states(spark, d)
    h = s.where("conf >= 0.8").groupBy("agent").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).where("end_frame - start_frame > 3")
    f = h.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame"))).join(s.where("valid").select("agent", "frame", "conf", "y"), ["agent", "frame"], "left")
    return f.groupBy("agent", "start_frame", "end_frame").agg(F.max(F.coalesce("conf", F.lit(0.0))).alias("intensity"), F.min(F.coalesce("y", F.lit(0.0))).alias("pet"))


@query(
    "agg_14_key_pair",
    "WITH m AS (SELECT l_orderkey AS scene, l_suppkey AS agent, max(l_quantity) AS peak FROM lineitem GROUP BY 1, 2), p AS (SELECT x.scene, x.agent AS a, y.agent AS b, x.peak + y.peak AS total FROM m x JOIN m y ON x.scene = y.scene AND x.agent < y.agent), k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY total DESC, a, b) AS k FROM p) SELECT scene, a, b, CAST(total AS DOUBLE) AS total FROM k WHERE k = 1",
)
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("agent")).agg(F.max("l_quantity").alias("peak"))
    p = m.select("scene", F.col("agent").alias("a"), F.col("peak").alias("pa")).join(m.select("scene", F.col("agent").alias("b"), F.col("peak").alias("pb")), "scene").where("a < b")
    return p.groupBy("scene").agg(F.min(F.struct((-(F.col("pa") + F.col("pb"))).alias("t"), "a", "b")).alias("m")).select("scene", "m.a", "m.b", (-F.col("m.t")).alias("total"))


@query("agg_15_durations", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN (o_orderkey % 100) / 20.0 ELSE (o_orderkey % 100) / 10.0 END AS seconds, len(string_split(o_orderpriority, '-')) AS tracks, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'done' ELSE o_orderstatus END AS folded FROM orders")
def _(spark, d):
    n = F.col("o_orderkey") % 100
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", n / 20).otherwise(n / 10).alias("seconds"), F.size(F.split("o_orderpriority", "-")).cast("long").alias("tracks"), F.when(F.col("o_orderstatus").isin("F", "O"), "done").otherwise(F.col("o_orderstatus")).alias("folded"))


@query(
    "agg_16_gaussian_kde",
    "WITH b AS (SELECT c_acctbal AS x FROM customer), h AS (SELECT stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM b), g AS (SELECT i, lo + (hi - lo) * i / 99 AS pos, h FROM h, range(100) t(i)) SELECT i AS step, round(pos, 4) AS pos, round(avg(exp(-0.5 * pow((pos - x) / h, 2))) / (any_value(h) * sqrt(2 * pi())) * 1e6, 5) AS density FROM g, b GROUP BY i, pos",
)
def _(spark, d):
    b = table(spark, d, "customer").select(F.col("c_acctbal").alias("x"))
    s = b.agg((F.stddev_samp("x") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = s.select("h", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("step")).withColumn("pos", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / 99)
    # the sample runs against a fixed grid of 100 points
    j = b.join(F.broadcast(g)).groupBy("step", "pos", "h").agg(F.avg(F.exp(-0.5 * F.pow((F.col("pos") - F.col("x")) / F.col("h"), 2))).alias("k"))
    return j.select(F.col("step").cast("long").alias("step"), F.round("pos", 4).alias("pos"), F.round(F.col("k") / (F.col("h") * math.sqrt(2 * math.pi)) * 1e6, 5).alias("density"))


@query("agg_17_top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@query(
    "agg_18_violation_counts",
    "WITH v AS (SELECT doc_id, unnest([CASE WHEN text LIKE '%token%' THEN 'secret' END, CASE WHEN text LIKE '%@%' THEN 'email' END, CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN lower(text) LIKE '%stupid%' THEN 'toxic' END]) AS rule FROM documents) SELECT rule, count(*) AS n, min(doc_id) AS example FROM v WHERE rule IS NOT NULL GROUP BY rule",
)
def _(spark, d):
    t = F.col("text")
    rules = F.array(F.when(F.contains(t, F.lit("token")), F.lit("secret")), F.when(F.contains(t, F.lit("@")), F.lit("email")), F.when(F.length(t) > 5000, F.lit("long")), F.when(F.contains(F.lower(t), F.lit("stupid")), F.lit("toxic")))
    v = table(spark, d, "documents").select("doc_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("example"))


@query("agg_19_audit_invariants", "SELECT count(*) FILTER (WHERE l_quantity <= 0) AS bad_quantity, count(*) FILTER (WHERE l_discount > 0.1) AS bad_discount, count(*) FILTER (WHERE l_tax < 0) AS bad_tax, count(*) FILTER (WHERE l_extendedprice <= 0) AS bad_price, count(*) FILTER (WHERE l_linenumber > 7) AS bad_number FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if(F.col("l_discount") > 0.1).alias("bad_discount"), F.count_if(F.col("l_tax") < 0).alias("bad_tax"),
        F.count_if(F.col("l_extendedprice") <= 0).alias("bad_price"), F.count_if(F.col("l_linenumber") > 7).alias("bad_number"),
    )


@query("agg_20_quality_counts", "SELECT o_custkey, count(*) AS events, count(*) FILTER (WHERE o_orderstatus = 'F') AS eligible, count(*) FILTER (WHERE o_totalprice > 200000) AS needs_review FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("events"), F.count_if(F.col("o_orderstatus") == "F").alias("eligible"), F.count_if(F.col("o_totalprice") > 200000).alias("needs_review"))


@query("agg_21_radius_source", f"WITH {STATES} SELECT agent, CASE WHEN bool_and(y > 0) THEN 'state_dimensions' WHEN bool_or(y > 0) THEN 'mixed' ELSE 'default' END AS source FROM states WHERE valid GROUP BY agent")
def _(spark, d):
    g = states(spark, d).where("valid").groupBy("agent").agg(F.bool_and(F.col("y") > 0).alias("every"), F.bool_or(F.col("y") > 0).alias("some"))
    return g.select("agent", F.when(F.col("every"), "state_dimensions").when(F.col("some"), "mixed").otherwise("default").alias("source"))


@query(
    "agg_22_episodes_by_type",
    "WITH t AS (SELECT l_suppkey, l_returnflag, min(CASE WHEN l_linenumber < 6 THEN l_orderkey END) AS s, max(CASE WHEN l_linenumber < 6 THEN l_orderkey END) AS e FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_returnflag, s, e, row_number() OVER (PARTITION BY l_suppkey ORDER BY s NULLS LAST, l_returnflag) AS place FROM t",
)
def _(spark, d):
    k = F.when(F.col("l_linenumber") < 6, F.col("l_orderkey"))
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min(k).alias("s"), F.max(k).alias("e"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.asc_nulls_last("s"), "l_returnflag")))
