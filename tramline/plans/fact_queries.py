"""Queries over physical facts and behaviour rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import frames as fr
from tramline.operators import facts as ft
from tramline.operators import interaction_class as ic
from tramline.operators import joins as jn

from .frame_queries import _RUN
from .join_queries import _FRAME_PAIRS, frame_pairs
from .registry import query, table
from .surrogates import INTERVALS, STATES, intervals, states

A = ["agent"]


@query("fct_01_track_extraction", f"WITH {STATES} SELECT agent, count(*) AS frames, count(*) FILTER (WHERE valid) AS valid_frames, agent % 10 = 0 AS is_ego FROM states GROUP BY agent")
def _(spark, d):
    return states(spark, d).groupBy("agent").agg(F.count("*").alias("frames"), F.count_if("valid").alias("valid_frames")).withColumn("is_ego", F.col("agent") % 10 == 0)


@query("fct_10_frame_relation", f"WITH {STATES}, r AS (SELECT a.agent, a.frame, b.x - a.x AS lo, b.y - a.y AS la FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1) SELECT agent, frame, CASE WHEN abs(la) <= 0.5 THEN 'same_channel' WHEN abs(la) <= 0.75 THEN 'adjacent' ELSE 'apart' END AS channel, CASE WHEN lo > 1 THEN 'ahead' WHEN lo < -1 THEN 'behind' ELSE 'alongside' END AS position FROM r")
def _(spark, d):
    s = states(spark, d).select("agent", "frame", "x", "y")
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", F.col("x").alias("ox"), F.col("y").alias("oy"))
    channel, position = ft.relation(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), (0.5, 0.75), 1.0)
    return s.join(o, ["agent", "frame"]).select("agent", "frame", channel.alias("channel"), position.alias("position"))


@query(
    "fct_13_map_context",
    f"WITH {STATES}, f AS (SELECT s_suppkey AS id, CAST(s_suppkey % 60 AS DOUBLE) / 2 AS fx, CASE s_suppkey % 4 WHEN 0 THEN 'branching' WHEN 1 THEN 'crosswalk' WHEN 2 THEN 'stop_sign' ELSE 'signal' END AS kind FROM supplier), j AS (SELECT s.agent, s.frame, bool_or(kind = 'branching' AND abs(x - fx) <= 0.5) AS br, bool_or(kind = 'crosswalk') AS cw, bool_or(kind = 'stop_sign') AS st, bool_or(kind = 'signal') AS sg FROM states s LEFT JOIN f ON abs(x - fx) <= 1 GROUP BY 1, 2) SELECT agent, frame, coalesce(br OR cw OR sg, false) AS near_intersection, coalesce(st, false) AS stop_sign FROM j",
)
def _(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "branching").when(k % 4 == 1, "crosswalk").when(k % 4 == 2, "stop_sign").otherwise("signal")
    f = table(spark, d, "supplier").select((k % 60 / 2).alias("tx"), F.lit(0.0).alias("ty"), kind.alias("kind"))
    s = states(spark, d).select("agent", "frame", "x").withColumn("y", F.lit(0.0))
    # features of a kind at one place count once, and states at one place see the same
    near = jn.grid_radius_join(s.select("x", "y").distinct(), f.distinct(), 1.0)
    flags = near.groupBy("x").agg(
        F.bool_or((F.col("kind") == "branching") & (F.col("distance") <= 0.5) | F.col("kind").isin("crosswalk", "signal")).alias("hit"), F.bool_or(F.col("kind") == "stop_sign").alias("stop")
    )
    no = F.lit(False)
    return s.select("agent", "frame", "x").join(flags, "x", "left").select("agent", "frame", F.coalesce("hit", no).alias("near_intersection"), F.coalesce("stop", no).alias("stop_sign"))


@query("fct_14_pair_record", _FRAME_PAIRS + " SELECT a, b, count(*) AS common, min(distance) AS closest, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN min(distance) <= 2 THEN 'overlap' ELSE 'apart' END AS geometry FROM r WHERE ok GROUP BY a, b")
def _(spark, d):
    g = frame_pairs(spark, d).where("ok").groupBy("a", "b").agg(F.count("*").alias("common"), F.min("distance").alias("closest"))
    r = g.select(F.struct("a", "b").alias("pair"), F.struct("common", "closest", F.when(F.col("common") < 2, "insufficient").when(F.col("closest") <= 2, "overlap").otherwise("apart").alias("geometry")).alias("facts"))
    return r.select("pair.*", "facts.*")


@query("fct_15_vehicle_record", f"WITH {STATES}, v AS (SELECT agent, count(*) AS n, round(max(speed), 4) AS top FROM states WHERE valid AND lane IS NOT NULL GROUP BY agent), a AS (SELECT DISTINCT agent FROM states UNION SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) SELECT a.agent, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient_data' ELSE 'ok' END AS status, top FROM a LEFT JOIN v ON a.agent = v.agent")
def _(spark, d):
    s = states(spark, d)
    v = s.where("valid and lane is not null").groupBy("agent").agg(F.count("*").alias("n"), F.round(F.max("speed"), 4).alias("top"))
    everyone = s.select("agent").union(table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_custkey")).distinct()
    return everyone.join(v, "agent", "left").select("agent", F.when(F.coalesce("n", F.lit(0)) < 2, "insufficient_data").otherwise("ok").alias("status"), "top")


@query("fct_17_time_to_conflict", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 AND l_linenumber % 3 > 0 THEN round(abs(l_quantity / (l_linenumber - 1) - l_tax * 100 / (l_linenumber % 3)), 6) ELSE 100.0::DOUBLE END AS delta, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity / 10 - l_tax * 10, 6) END AS pet FROM lineitem")
def _(spark, d):
    n = F.col("l_linenumber")
    delta = ft.delta_time(F.col("l_quantity"), n - 1, F.col("l_tax") * 100, n % 3)  # agents that stand are among them
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(delta, 6).alias("delta"), F.when(n % 2 == 0, F.round(F.col("l_quantity") / 10 - F.col("l_tax") * 10, 6)).alias("pet"))


@query("fct_19_moving_filter", f"WITH {STATES} SELECT agent, frame FROM states WHERE coalesce(ax, 0) <> 0")
def _(spark, d):
    return states(spark, d).where("coalesce(ax, 0) <> 0").select("agent", "frame")


@query(
    "fct_22_ttc",
    f"WITH {STATES}, r AS (SELECT a.agent, a.frame, b.x - a.x AS gap, abs(b.y - a.y) AS side, coalesce(a.ax, 0) - coalesce(b.ax, 0) AS closing FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1) SELECT agent, frame, CASE WHEN abs(gap) <= 0.5 AND side <= 0.5 THEN 'overlapping' WHEN side > 0.75 THEN 'not_applicable' WHEN closing <= 0.001 THEN 'not_closing' ELSE 'valid' END AS status, CASE WHEN abs(gap) <= 0.5 AND side <= 0.5 THEN 0.0 WHEN side > 0.75 OR closing <= 0.001 THEN NULL ELSE round((abs(gap) - 0.5) / closing, 6) END AS ttc FROM r",
)
def _(spark, d):
    s = states(spark, d).select("agent", "frame", "x", "y", F.coalesce("ax", F.lit(0.0)).alias("v"))
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("v").alias("ov"))
    status, ttc = ft.time_to_collision(F.abs(F.col("ox") - F.col("x")), F.abs(F.col("oy") - F.col("y")), F.col("v") - F.col("ov"), 0.5, 0.75)
    return s.join(o, ["agent", "frame"]).select("agent", "frame", status.alias("status"), F.round(ttc, 6).alias("ttc"))


_LANE_RUNS = f"WITH {STATES}, kept AS (SELECT * FROM states WHERE lane IS NOT NULL){_RUN.format(v='lane', gap='OR frame - lag(frame) OVER w > 1', src='kept')}, runs AS (SELECT agent, lane, min(frame) AS s, max(frame) AS e, count(*) AS n, avg(y) AS my FROM numbered GROUP BY agent, run, lane HAVING count(*) >= 3)"


@query(
    "fct_24_interaction_classifier",
    # an order's first three lines are an agent before and after a change and the pair's frames; x, speed and group come from a line's numbers
    """WITH l AS (SELECT l_orderkey AS scene, l_linenumber AS n, l_quantity AS x, l_suppkey % 3 AS grp, l_tax * 100 AS v, l_partkey % 20 AS f FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
    j AS (SELECT a.scene, a.x AS x0, b.x AS r0, c.x AS x1, d.x AS r1, c.grp AS g1, d.grp AS gr1, b.v AS v0, d.v AS v1, least(a.f, 2) AS changers, a.f % 4 = 0 AS merges, a.f <> 7 AS event, b.f AS frames, least(b.f, c.f) AS shared, d.f % 2 = 0 AS meaningful
      FROM l a JOIN l b ON b.scene = a.scene AND a.n = 1 AND b.n = 2 JOIN l c ON c.scene = a.scene AND c.n = 3 JOIN l d ON d.scene = a.scene AND d.n = 4),
    k AS (SELECT *, CASE WHEN changers > 1 AND scene % 2 = 0 THEN 1 WHEN scene % 3 = 0 THEN 0 ELSE changers END AS ch, g1 = gr1 AS entered, abs(x1 - r1) <= 15 AS small, abs(x0 - r0) - abs(x1 - r1) >= 1 AS shrank, v0 - v1 >= 1 AS slowed FROM j)
    SELECT scene, CASE WHEN ch > 1 THEN 'unknown' WHEN ch = 0 AND merges THEN 'merge' WHEN ch = 1 AND NOT event THEN 'unknown' WHEN ch = 1 AND entered AND (small OR shrank OR slowed) THEN 'cut_in' WHEN ch = 1 THEN 'lane_change'
        WHEN shared >= 3 AND shared >= 0.5 * frames AND meaningful THEN 'same_lane_interaction' ELSE 'unknown' END AS kind,
      CASE WHEN ch > 1 THEN NULL WHEN ch = 0 AND merges THEN 0.75 WHEN ch = 1 AND NOT event THEN NULL WHEN ch = 1 AND entered AND (small OR shrank OR slowed) THEN round(0.9::DOUBLE * ((2 + small::INT + shrank::INT + slowed::INT) / 5::DOUBLE), 6) WHEN ch = 1 THEN 0.9
        WHEN shared >= 3 AND shared >= 0.5 * frames AND meaningful THEN round(least(1, 0.5::DOUBLE * (shared / frames::DOUBLE) + 0.5::DOUBLE * least(1, shared / 10::DOUBLE)), 6) END::DOUBLE AS confidence,
      CASE WHEN ch > 1 THEN 'classified' WHEN ch = 0 AND merges THEN 'labeled' WHEN ch = 1 AND NOT event THEN 'insufficient_evidence' WHEN ch = 1 THEN 'labeled' WHEN shared >= 3 AND shared >= 0.5 * frames AND meaningful THEN 'labeled' WHEN frames < 3 THEN 'insufficient_evidence' ELSE 'classified' END AS status FROM k""",
)
def _(spark, d):
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    li = table(spark, d, "lineitem").where("l_linenumber <= 4").withColumn("_r", first).where("_r = 1")
    state = F.struct(F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"), (F.col("l_tax") * 100).alias("speed"), (F.col("l_suppkey") % 3).alias("group"))
    line = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, c))
    g = li.groupBy(F.col("l_orderkey").alias("scene")).agg(*[line(n, state).alias(f"s{n}") for n in (1, 2, 3, 4)], *[line(n, F.col("l_partkey") % 20).alias(f"f{n}") for n in (1, 2, 3, 4)])
    g = g.where("s1 is not null and s2 is not null and s3 is not null and s4 is not null").withColumn("c", F.least("f1", F.lit(2)))
    changers = F.when((F.col("c") > 1) & (F.col("scene") % 2 == 0), 1).when(F.col("scene") % 3 == 0, 0).otherwise(F.col("c"))
    e = ic.change_evidence(*(F.col(c) for c in ("s1", "s2", "s3", "s4")))
    k = ic.interaction_class(changers, F.col("f1") % 4 == 0, F.col("f1") != 7, e, F.lit(0.9), F.lit("left"), F.least("f2", "f3"), F.col("f2"), F.col("f4") % 2 == 0)
    return g.select("scene", k.alias("k")).select("scene", F.col("k.type").alias("kind"), "k.confidence", "k.status")


_FOLLOW = f"WITH {STATES}, r AS (SELECT a.agent, a.frame, a.lane = b.lane AND b.x - a.x BETWEEN 0.25 AND 30 AND abs(coalesce(a.ax, 0) - coalesce(b.ax, 0)) <= 3 AND a.valid AND b.valid AS follows FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1)"


@query("fct_25_follow", _FOLLOW + _RUN.format(v="follows", gap="OR frame - lag(frame) OVER w > 1", src="r") + " SELECT agent, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM numbered WHERE follows GROUP BY agent, run HAVING count(*) >= 2")
def _(spark, d):
    s = states(spark, d).select("agent", "frame", "x", "lane", "valid", F.coalesce("ax", F.lit(0.0)).alias("v"))
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", *(F.col(c).alias("o" + c) for c in ("x", "lane", "valid", "v")))
    j = s.join(o, ["agent", "frame"])
    flag = (F.col("lane") == F.col("olane")) & (F.col("ox") - F.col("x")).between(0.25, 30) & (F.abs(F.col("v") - F.col("ov")) <= 3) & F.col("valid") & F.col("ovalid")
    return fr.boolean_runs(j.withColumn("follows", flag), A, "frame", "follows", 2)


@query(
    "fct_26_pass",
    f"""WITH {STATES}, r AS (SELECT a.agent, a.frame, CASE WHEN b.x - a.x >= 0.5 THEN 1 WHEN a.x - b.x >= 0.5 THEN -1 END AS side FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1 WHERE a.valid AND b.valid), kept AS (SELECT * FROM r WHERE side IS NOT NULL)
    {_RUN.format(v='side', gap='', src='kept')}, st AS (SELECT agent, side, min(frame) AS s, max(frame) AS e FROM numbered GROUP BY agent, run, side HAVING count(*) >= 2) SELECT agent, e AS before_frame, next_s AS after_frame FROM (SELECT *, lead(side) OVER w AS next_side, lead(s) OVER w AS next_s FROM st WINDOW w AS (PARTITION BY agent ORDER BY s)) WHERE side = 1 AND next_side = -1""",
)
def _(spark, d):
    s = states(spark, d).where("valid").select("agent", "frame", "x")
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", F.col("x").alias("ox"))
    gap = F.col("ox") - F.col("x")
    j = s.join(o, ["agent", "frame"]).withColumn("side", F.when(gap >= 0.5, 1).when(gap <= -0.5, -1)).where("side is not null")
    return ft.passes(j, A, "frame", "side", 2)


@query(
    "fct_27_merge_candidates",
    f"""WITH {STATES}, r AS (SELECT a.agent, a.frame, a.lane = b.lane AS same FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1 WHERE a.lane IS NOT NULL AND b.lane IS NOT NULL)
    {_RUN.format(v='same', gap='', src='r')}, st AS (SELECT agent, same, min(frame) AS s, max(frame) AS e, count(*) AS n FROM numbered GROUP BY agent, run, same) SELECT agent, e AS apart_until, next_s AS together_from FROM (SELECT *, lead(same) OVER w AS next_same, lead(s) OVER w AS next_s, lead(n) OVER w AS next_n FROM st WINDOW w AS (PARTITION BY agent ORDER BY s)) WHERE NOT same AND next_same AND n >= 2 AND next_n >= 2""",
)
def _(spark, d):
    s = states(spark, d).where("lane is not null").select("agent", "frame", "lane")
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", F.col("lane").alias("ol"))
    r = fr.runs(s.join(o, ["agent", "frame"]).withColumn("same", F.col("lane") == F.col("ol")), A, "frame", "same")
    w = Window.partitionBy("agent").orderBy("start_frame")
    r = r.withColumns({"ns": F.lead("same").over(w), "nf": F.lead("start_frame").over(w), "nn": F.lead("n").over(w)})
    return r.where("not same and ns and n >= 2 and nn >= 2").select("agent", F.col("end_frame").alias("apart_until"), F.col("nf").alias("together_from"))


_IV = f"WITH {INTERVALS}"


@query("fct_28_behavior_records", _IV + " SELECT a.interval_id, CASE WHEN EXISTS (SELECT 1 FROM intervals b WHERE b.agent = a.agent AND b.kind = '1-URGENT' AND b.interval_id <> a.interval_id AND least(a.end_frame, b.end_frame) >= greatest(a.start_frame, b.start_frame)) THEN 'suppressed' ELSE 'kept' END AS state, a.end_frame - a.start_frame < 2 AS needs_review FROM intervals a WHERE a.kind <> '1-URGENT'")
def _(spark, d):
    i = intervals(spark, d)
    hit = jn.range_join(i.where("kind <> '1-URGENT'"), i.where("kind = '1-URGENT'"), ["agent"], 0).select("interval_id").distinct().withColumn("hit", F.lit(True))
    j = i.where("kind <> '1-URGENT'").join(hit, "interval_id", "left")
    return j.select("interval_id", F.when(F.col("hit"), "suppressed").otherwise("kept").alias("state"), (F.col("end_frame") - F.col("start_frame") < 2).alias("needs_review"))


@query("fct_29_trends", f"WITH {STATES}, t AS (SELECT agent, arg_max(x, frame) FILTER (WHERE frame <= 20) - arg_min(x, frame) FILTER (WHERE frame >= 10) AS dx, avg(y) FILTER (WHERE frame BETWEEN 10 AND 20) - avg(y) FILTER (WHERE frame < 10) AS dv FROM states GROUP BY agent) SELECT agent, CASE WHEN dx > 0.25 THEN 'growing' WHEN dx < -0.25 THEN 'shrinking' ELSE 'steady' END AS distance_trend, CASE WHEN round(dv, 9) >= 0.3 THEN 'faster' WHEN round(dv, 9) <= -0.3 THEN 'slower' ELSE 'similar' END AS speed_relation FROM t")
def _(spark, d):
    f = F.col("frame")
    mean = lambda c: F.avg(F.when(c, F.col("y")))
    t = states(spark, d).groupBy("agent").agg(
        (F.max_by("x", F.when(f <= 20, f)) - F.min_by("x", F.when(f >= 10, f))).alias("dx"), F.round(mean(f.between(10, 20)) - mean(f < 10), 9).alias("dv")
    )
    distance = F.when(F.col("dx") > 0.25, "growing").when(F.col("dx") < -0.25, "shrinking").otherwise("steady")
    speed = F.when(F.col("dv") >= 0.3, "faster").when(F.col("dv") <= -0.3, "slower").otherwise("similar")
    return t.select("agent", distance.alias("distance_trend"), speed.alias("speed_relation"))


@query(
    "fct_31_rule_classification",
    """WITH f AS (SELECT c_custkey, bool_or(o_orderpriority = '1-URGENT') AS changed, bool_or(o_orderpriority = '5-LOW') AS entered, bool_or(o_totalprice > 350000) AS ahead, bool_or(o_orderstatus = 'P') AS slowed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_custkey, CASE WHEN entered THEN CASE WHEN ahead THEN 'overtake' WHEN slowed THEN 'lane_change_with_yielding' ELSE 'merge' END WHEN changed THEN 'lane_change' ELSE 'unknown' END AS kind,
      CASE WHEN entered AND ahead THEN CASE WHEN slowed THEN 'with_lane_change,with_yielding' ELSE 'with_lane_change' END ELSE '' END AS modifiers,
      CASE WHEN entered OR changed THEN 'classified' ELSE 'insufficient_evidence' END AS status FROM f""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    f = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == o.o_custkey, "left").groupBy("c_custkey").agg(
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("changed"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("entered"),
        F.bool_or(F.col("o_totalprice") > 350000).alias("ahead"), F.bool_or(F.col("o_orderstatus") == "P").alias("slowed"),
    )
    kind, modifiers, status = ft.rule_class(*(F.col(c) for c in ("changed", "entered", "ahead", "slowed")))
    return f.select("c_custkey", kind.alias("kind"), F.array_join(modifiers, ",").alias("modifiers"), status.alias("status"))


@query("fct_32_interaction_strength", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 OR l_tax < 0.01 OR l_discount < 0.01 THEN 'strong' WHEN l_quantity < 15 OR l_tax < 0.03 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ft.strength(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), (5, 15), (0.01, 0.03), 0.01).alias("strength"))


@query("fct_36_stationary_gate", f"WITH {STATES}, m AS (SELECT agent, count(*) AS n, max(x) - min(x) AS span, max(y) - min(y) AS yspan FROM states WHERE valid GROUP BY agent) SELECT agent, CASE WHEN n < 5 THEN 'insufficient' WHEN span <= 1 AND yspan <= 1 THEN 'stationary' ELSE 'moving' END AS gate FROM m")
def _(spark, d):
    m = states(spark, d).where("valid").groupBy("agent").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), (F.max("y") - F.min("y")).alias("yspan"))
    return m.select("agent", F.when(F.col("n") < 5, "insufficient").when((F.col("span") <= 1) & (F.col("yspan") <= 1), "stationary").otherwise("moving").alias("gate"))


@query("fct_37_required_episodes", _IV + " SELECT a.interval_id, a.kind FROM intervals a WHERE NOT (a.kind = '5-LOW' AND EXISTS (SELECT 1 FROM intervals b WHERE b.agent = a.agent AND b.kind = '1-URGENT' AND b.start_frame - a.end_frame BETWEEN 0 AND 10))")
def _(spark, d):
    i = intervals(spark, d)
    near = jn.range_join(i.where("kind = '5-LOW'"), i.where("kind = '1-URGENT'"), ["agent"], 10).where("r_start_frame - end_frame between 0 and 10").select("interval_id").distinct()
    return i.join(near, "interval_id", "left_anti").select("interval_id", "kind")


@query("fct_39_event_flattening", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.family'), ''), CASE WHEN event_type = 'error' THEN 'fault' END, event_type) AS family FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.nullif(F.get_json_object("props", "$.family"), F.lit("")), F.when(F.col("event_type") == "error", "fault"), "event_type").alias("family"))


@query("fct_40_fusion_audit", _IV + ", k AS (SELECT *, row_number() OVER (PARTITION BY agent, start_frame ORDER BY interval_id) AS d FROM intervals) SELECT interval_id, CASE WHEN d > 1 THEN 'deduplicated' WHEN end_frame - start_frame < 2 THEN 'filtered' WHEN kind = '5-LOW' THEN 'absorbed' ELSE 'primary' END AS outcome FROM k")
def _(spark, d):
    w = Window.partitionBy("agent", "start_frame").orderBy("interval_id")
    i = intervals(spark, d).withColumn("d", F.row_number().over(w))
    return i.select("interval_id", F.when(F.col("d") > 1, "deduplicated").when(F.col("end_frame") - F.col("start_frame") < 2, "filtered").when(F.col("kind") == "5-LOW", "absorbed").otherwise("primary").alias("outcome"))


@query("fct_41_window_resolution", _IV + " SELECT interval_id, greatest(0, least(start_frame - 30, 2600 - 80)) AS window_start, greatest(0, least(start_frame - 30, 2600 - 80)) + 79 AS window_end FROM intervals")
def _(spark, d):
    start, end = ft.window_of(F.col("start_frame"), 30, 80, 2600)
    return intervals(spark, d).select("interval_id", start.alias("window_start"), end.alias("window_end"))


@query("fct_42_densified_frames", f"WITH {STATES}, r AS (SELECT agent, unnest(generate_series(0, 30)) AS frame FROM (SELECT DISTINCT agent FROM states)) SELECT r.agent, r.frame, x, coalesce(valid, false) AS valid FROM r LEFT JOIN (SELECT * FROM states WHERE valid) s ON r.agent = s.agent AND r.frame = s.frame")
def _(spark, d):
    s = states(spark, d)
    return ft.densified(s.select("agent").distinct(), s.where("valid").select("agent", "frame", "x", "valid"), A, "frame", 0, 30).withColumn("valid", F.coalesce("valid", F.lit(False)))


@query("fct_18_interaction_groups", "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)) SELECT a AS root, array_to_string([a, b], ';') AS members FROM e")
def _(spark, d):
    from tramline.operators.graphs import components

    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    e = n.where("node % 3 = 1").select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(n.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    g = components(n, e).groupBy("group").agg(F.array_sort(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    return g.select(F.col("group").alias("root"), F.array_join(F.col("m").cast("array<string>"), ";").alias("members"))
