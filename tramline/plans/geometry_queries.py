"""Queries over geometry and lane graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.functions import geometry as g
from tramline.operators import graphs

from .registry import query, table
from .surrogates import EDGES, POLYLINES, STATES, edges, polylines, states


@query("geo_01_angle_wrap", f"WITH {STATES} SELECT agent, frame, round(yaw * 3 + pi() - 2 * pi() * floor((yaw * 3 + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM states")
def _(spark, d):
    return states(spark, d).select("agent", "frame", F.round(g.wrap(F.col("yaw") * 3), 6).alias("wrapped"))


@query("geo_02_vectors", f"WITH {STATES} SELECT agent, frame, round(cos(yaw), 6) AS hx, round(sin(yaw), 6) AS hy, round(cos(yaw) * y - sin(yaw) * x, 6) AS cr, round(cos(yaw) * x + sin(yaw) * y, 6) AS dt FROM states")
def _(spark, d):
    hx, hy = F.cos("yaw"), F.sin("yaw")
    x, y = F.col("x"), F.col("y")
    return states(spark, d).select("agent", "frame", F.round(hx, 6).alias("hx"), F.round(hy, 6).alias("hy"), F.round(g.cross(hx, hy, x, y), 6).alias("cr"), F.round(g.dot(hx, hy, x, y), 6).alias("dt"))


_TAN = ", t AS (SELECT line_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM points WINDOW w AS (PARTITION BY line_id ORDER BY seq))"


@query("geo_03_tangents", f"WITH {POLYLINES}{_TAN} SELECT line_id, seq, CASE WHEN dx = 0 AND dy = 0 THEN 1.0 ELSE round(dx / sqrt(dx * dx + dy * dy), 6) END AS tx, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE round(dy / sqrt(dx * dx + dy * dy), 6) END AS ty FROM t")
def _(spark, d):
    t = polylines(spark, d).select("line_id", F.posexplode(g.tangents(F.col("points"))).alias("seq", "t"))
    return t.select("line_id", F.col("seq").cast("long").alias("seq"), F.round("t.x", 6).alias("tx"), F.round("t.y", 6).alias("ty"))


_SEG = ", sg AS (SELECT line_id, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM points WINDOW w AS (PARTITION BY line_id ORDER BY seq)), seg AS (SELECT * FROM sg WHERE bx IS NOT NULL)"


@query("geo_04_arc_length", f"WITH {POLYLINES}{_SEG} SELECT line_id, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 4) AS arc FROM seg GROUP BY line_id")
def _(spark, d):
    return polylines(spark, d).select("line_id", F.round(g.arc_length(F.col("points")), 4).alias("arc"))


_PROJ = f"""WITH {POLYLINES}{_SEG}, l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS h FROM seg), r AS (SELECT *, sum(h) OVER (PARTITION BY line_id ORDER BY seq) - h AS run,
  CASE WHEN h > 0 THEN greatest(0, least(1, ((1.5 - ax) * (bx - ax) + (0.75 - ay) * (by_ - ay)) / (h * h))) ELSE 0 END AS t FROM l),
  a AS (SELECT *, sqrt(pow(1.5 - (ax + t * (bx - ax)), 2) + pow(0.75 - (ay + t * (by_ - ay)), 2)) AS away FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY round(away, 9), seq) AS k FROM a)"""


@query("geo_05_projection", _PROJ + " SELECT line_id, round(away, 4) AS distance, round(run + t * h, 3) AS s, round(CASE WHEN (bx - ax) * (0.75 - ay) - (by_ - ay) * (1.5 - ax) < 0 THEN -away ELSE away END, 4) AS d FROM k WHERE k = 1")
def _(spark, d):
    p = polylines(spark, d).select("line_id", g.project(F.lit(1.5), F.lit(0.75), F.col("points")).alias("p"))
    return p.select("line_id", F.round("p.distance", 4).alias("distance"), F.round("p.s", 3).alias("s"), F.round("p.d", 4).alias("d"))


@query("geo_06_projection_gate", _PROJ + " SELECT line_id FROM k WHERE k = 1 AND round(away, 4) <= 2.25 AND abs(degrees(atan2(by_ - ay, bx - ax))) <= 30")
def _(spark, d):
    near = lambda p: (F.round(p["distance"], 4) <= 2.25) & (F.abs(F.degrees(p["heading"])) <= 30)
    return polylines(spark, d).where(F.exists(F.array(g.project(F.lit(1.5), F.lit(0.75), F.col("points"))), near)).select("line_id")


@query("geo_08_common_direction", f"WITH {STATES} SELECT a.agent, a.frame, CASE WHEN cos(a.yaw - b.yaw) >= cos(pi() / 4) THEN round(atan2(sin(a.yaw) + sin(b.yaw), cos(a.yaw) + cos(b.yaw)), 6) END AS direction FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1")
def _(spark, d):
    s = states(spark, d).select("agent", "frame", "yaw")
    o = s.select((F.col("agent") - 1).alias("agent"), "frame", F.col("yaw").alias("o"))
    both = F.atan2(F.sin("yaw") + F.sin("o"), F.cos("yaw") + F.cos("o"))
    return s.join(o, ["agent", "frame"]).select("agent", "frame", F.when(F.cos(F.col("yaw") - F.col("o")) >= F.cos(F.lit(0.7853981633974483)), F.round(both, 6)).alias("direction"))


@query("geo_11_point_set_distance", f"WITH {POLYLINES} SELECT a.line_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM points a JOIN points b ON b.line_id = a.line_id + 1 GROUP BY a.line_id")
def _(spark, d):
    p = polylines(spark, d)
    o = p.select((F.col("line_id") - 1).alias("line_id"), F.col("points").alias("other"))
    return p.join(o, "line_id").select("line_id", F.round(g.point_set_distance(F.col("points"), F.col("other")), 6).alias("distance"))


_ND = "sqrt(pow({p}x - ({q}ax + CASE WHEN pow({q}bx - {q}ax, 2) + pow({q}by_ - {q}ay, 2) > 0 THEN greatest(0, least(1, (({p}x - {q}ax) * ({q}bx - {q}ax) + ({p}y - {q}ay) * ({q}by_ - {q}ay)) / (pow({q}bx - {q}ax, 2) + pow({q}by_ - {q}ay, 2)))) ELSE 0 END * ({q}bx - {q}ax)), 2) + pow({p}y - ({q}ay + CASE WHEN pow({q}bx - {q}ax, 2) + pow({q}by_ - {q}ay, 2) > 0 THEN greatest(0, least(1, (({p}x - {q}ax) * ({q}bx - {q}ax) + ({p}y - {q}ay) * ({q}by_ - {q}ay)) / (pow({q}bx - {q}ax, 2) + pow({q}by_ - {q}ay, 2)))) ELSE 0 END * ({q}by_ - {q}ay)), 2))"


def _near(point: str, q: str) -> str:
    x, y = point.split(",")
    return _ND.replace("{p}x", x).replace("{p}y", y).replace("{q}", q)


@query(
    "geo_10_path_distance",
    f"""WITH {POLYLINES}{_SEG}, c AS (SELECT s.line_id, ((s.bx - s.ax) * (t.ay - s.ay) - (s.by_ - s.ay) * (t.ax - s.ax)) * ((s.bx - s.ax) * (t.by_ - s.ay) - (s.by_ - s.ay) * (t.bx - s.ax)) < 0
      AND ((t.bx - t.ax) * (s.ay - t.ay) - (t.by_ - t.ay) * (s.ax - t.ax)) * ((t.bx - t.ax) * (s.by_ - t.ay) - (t.by_ - t.ay) * (s.bx - t.ax)) < 0 AS crossing,
      least({_near('s.ax,s.ay', 't.')}, {_near('s.bx,s.by_', 't.')}, {_near('t.ax,t.ay', 's.')}, {_near('t.bx,t.by_', 's.')}) AS apart
      FROM seg s JOIN seg t ON t.line_id = s.line_id + 1)
    SELECT line_id, round(min(CASE WHEN crossing THEN 0 ELSE apart END), 5) AS distance FROM c GROUP BY line_id""",
)
def _(spark, d):
    p = polylines(spark, d)
    o = p.select((F.col("line_id") - 1).alias("line_id"), F.col("points").alias("other"))
    return p.join(o, "line_id").select("line_id", F.round(g.polyline_distance(F.col("points"), F.col("other")), 5).alias("distance"))


@query(
    "geo_13_motion_heading",
    f"WITH {STATES}, m AS (SELECT agent, frame, yaw, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(x) OVER w AS x1, last_value(y) OVER w AS y1 FROM states WINDOW w AS (PARTITION BY agent ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT agent, frame, round(CASE WHEN sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 0.2 THEN atan2(y1 - y0, x1 - x0) ELSE yaw END, 6) AS heading, CASE WHEN sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 0.2 THEN 'motion' ELSE 'raw' END AS method FROM m",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame").rowsBetween(-2, 2)
    dx, dy = F.last("x").over(w) - F.first("x").over(w), F.last("y").over(w) - F.first("y").over(w)
    s = states(spark, d).withColumns({"dx": dx, "dy": dy}).withColumn("moved", F.hypot("dx", "dy") >= 0.2)
    return s.select("agent", "frame", F.round(F.when(F.col("moved"), F.atan2("dy", "dx")).otherwise(F.col("yaw")), 6).alias("heading"), F.when(F.col("moved"), "motion").otherwise("raw").alias("method"))


@query("geo_14_future_polyline", f"WITH {STATES} SELECT agent, frame, len(list(x) OVER w) AS n, last_value(x) OVER w AS end_x FROM states WHERE NOT (x = 0 AND y = 0) WINDOW w AS (PARTITION BY agent ORDER BY frame ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)")
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame").rowsBetween(0, 9)
    s = states(spark, d).where("not (x = 0 and y = 0)").withColumn("future", F.collect_list(F.struct("x", "y")).over(w))
    return s.select("agent", "frame", F.size("future").cast("long").alias("n"), F.element_at("future", -1)["x"].alias("end_x"))


@query(
    "geo_18_window_around_point",
    f"WITH {POLYLINES}, k AS (SELECT line_id, arg_min(seq, struct_pack(a := round(sqrt(x * x + y * y), 9), b := seq)) AS at_seq FROM points GROUP BY 1) SELECT k.line_id, at_seq, count(*) AS n, sum(x) AS sx FROM k JOIN points p ON p.line_id = k.line_id AND p.seq BETWEEN at_seq - 2 AND at_seq + 6 GROUP BY 1, 2",
)
def _(spark, d):
    p = polylines(spark, d).withColumn("at_seq", g.nearest_index(F.col("points"), F.lit(0.0), F.lit(0.0)))
    p = p.withColumn("part", g.around(F.col("points"), F.col("at_seq"), 2, 6))
    return p.select("line_id", F.col("at_seq").cast("long").alias("at_seq"), F.size("part").cast("long").alias("n"), F.aggregate("part", F.lit(0.0), lambda a, q: a + q["x"]).alias("sx"))


@query("geo_19_spaced_points")
def _(spark, d):
    return polylines(spark, d).select("line_id", F.size(g.spaced(F.col("points"), 2.0)).alias("n"))


@query("geo_20_crossing_type", f"WITH {STATES}, a AS (SELECT agent, frame, abs(degrees(yaw - 2 * pi() * floor((yaw + pi()) / (2 * pi())))) AS deg FROM states) SELECT agent, frame, CASE WHEN deg <= 30 THEN 'P' WHEN deg < 150 THEN 'C' ELSE 'O' END AS kind FROM a")
def _(spark, d):
    return states(spark, d).select("agent", "frame", g.crossing_type(F.degrees(g.wrap(F.col("yaw")))).alias("kind"))


@query("geo_21_cut_by_distance", f"WITH {POLYLINES}{_SEG}, l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS h FROM seg), r AS (SELECT *, sum(h) OVER (PARTITION BY line_id ORDER BY seq) AS run FROM l WHERE h > 0), k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY run < 12.5, CASE WHEN run < 12.5 THEN -seq ELSE seq END) AS k FROM r) SELECT line_id, round(ax + (bx - ax) * (12.5 - (run - h)) / h, 4) AS x, round(ay + (by_ - ay) * (12.5 - (run - h)) / h, 4) AS y FROM k WHERE k = 1")
def _(spark, d):
    p = polylines(spark, d).select("line_id", g.cut(F.col("points"), 12.5).alias("p"))
    return p.select("line_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("geo_22_rotated_box", f"WITH {STATES} SELECT agent, frame, round(x + 2.25 * cos(yaw) - 0.9 * sin(yaw), 5) AS fx, round(y + 2.25 * sin(yaw) + 0.9 * cos(yaw), 5) AS fy FROM states")
def _(spark, d):
    c = F.get(g.corners(F.col("x"), F.col("y"), F.col("yaw"), F.lit(4.5), F.lit(1.8)), 0)
    return states(spark, d).select("agent", "frame", F.round(c["x"], 5).alias("fx"), F.round(c["y"], 5).alias("fy"))


@query(
    "geo_24_nearest_lane",
    f"WITH {STATES}, l AS (SELECT s_suppkey AS lane_id, CAST(s_suppkey % 40 AS DOUBLE) / 2 AS lx, s_nationkey / 4.0 AS ly, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE 1.5 END AS la FROM supplier), j AS (SELECT agent, frame, lane_id, sqrt(pow(x - lx, 2) + pow(y - ly, 2)) AS dist, cos(yaw - la) AS al FROM states JOIN l ON sqrt(pow(x - lx, 2) + pow(y - ly, 2)) <= 3), k AS (SELECT *, row_number() OVER (PARTITION BY agent, frame ORDER BY round(dist + 1 - al, 9), lane_id) AS k FROM j WHERE al >= 0) SELECT agent, frame, lane_id FROM k WHERE k = 1",
)
def _(spark, d):
    from tramline.operators.joins import grid_radius_join

    k = F.col("s_suppkey")
    lanes = table(spark, d, "supplier").select(k.alias("lane_id"), (k % 40 / 2).alias("tx"), (F.col("s_nationkey") / 4).alias("ty"), F.when(k % 2 == 0, 0.0).otherwise(1.5).alias("la"))
    # lanes that lie alike differ by their number only, and states that lie alike have one lane
    lanes = lanes.groupBy("tx", "ty", "la").agg(F.min("lane_id").alias("lane_id"))
    s, pose = states(spark, d).select("agent", "frame", "x", "y", "yaw"), ["x", "y", "yaw"]
    j = grid_radius_join(s.select(*pose).distinct(), lanes, 3.0).withColumn("al", F.cos(F.col("yaw") - F.col("la"))).where("al >= 0")
    best = j.groupBy(*pose).agg(F.min(F.struct(F.round(F.col("distance") + 1 - F.col("al"), 9).alias("score"), "lane_id"))["lane_id"].alias("lane_id"))
    return s.join(best, pose).select("agent", "frame", "lane_id")


@query("math_01_bankers_round", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey // 4 WHEN s_suppkey % 4 = 3 THEN s_suppkey // 4 + 1 WHEN s_suppkey % 4 = 0 THEN s_suppkey // 4 ELSE s_suppkey // 4 + (s_suppkey // 4) % 2 END AS DOUBLE) AS r FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", g.bankers_round(F.col("s_suppkey") / 4, 0).alias("r"))


@query("math_03_median_dt", f"WITH {STATES}, t AS (SELECT agent, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS dt FROM states WINDOW w AS (PARTITION BY agent ORDER BY frame)) SELECT agent, round(coalesce(median(dt) FILTER (WHERE dt > 0), 0.1), 3) AS dt FROM t GROUP BY agent")
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    dt = (us - F.lag(us).over(w)) / 1e6
    s = states(spark, d).withColumn("dt", dt)
    return s.groupBy("agent").agg(F.round(F.coalesce(F.median(F.when(F.col("dt") > 0, F.col("dt"))), F.lit(0.1)), 3).alias("dt"))


_COST = "e AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_quantity) AS cost FROM lineitem GROUP BY 1, 2)"


@query("grf_02_mutual_best", f"WITH {_COST}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cost, dst) AS o, row_number() OVER (PARTITION BY dst ORDER BY cost, src) AS i FROM e) SELECT src, dst, CAST(cost AS DOUBLE) AS cost FROM k WHERE o = 1 AND i = 1")
def _(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.min("l_quantity").alias("cost"))
    return graphs.mutual_best(e)


@query("grf_03_components", f"WITH RECURSIVE {EDGES}, n AS (SELECT s_suppkey AS node FROM supplier), w AS (SELECT node, node AS g FROM n UNION SELECT e.dst, w.g FROM w JOIN edges e ON e.src = w.node) SELECT node, min(g) AS \"group\" FROM w WHERE node IN (SELECT node FROM n) GROUP BY node")
def _(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    e = edges(spark, d).join(n.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    return graphs.components(n, e)


@query("grf_04_group_neighbours", "SELECT s_nationkey AS \"group\", array_to_string(list(DISTINCT o ORDER BY o), ',') AS others FROM (SELECT a.s_nationkey, b.s_nationkey AS o FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 1, a.s_suppkey - 1) WHERE a.s_nationkey <> b.s_nationkey) GROUP BY 1")
def _(spark, d):
    s = table(spark, d, "supplier")
    groups = s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("group"))
    e = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return graphs.group_neighbours(groups, e).select("group", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("grf_05_neighbour_at", "SELECT o_orderkey, s_suppkey AS neighbour FROM (SELECT o_orderkey, s_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY s_suppkey) AS k FROM orders JOIN supplier ON s_nationkey = o_custkey % 25 AND o_orderkey % 100 BETWEEN s_suppkey % 50 AND s_suppkey % 50 + 30) WHERE k = 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("n"), (F.col("o_orderkey") % 100).alias("at"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey")
    lo = F.col("s_suppkey") % 50
    return o.join(s, "n").where(F.col("at").between(lo, lo + 30)).groupBy("o_orderkey").agg(F.min("s_suppkey").alias("neighbour"))


@query("grf_06_topology_relation", f"WITH {EDGES} SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE src = a.s_suppkey AND dst = b.s_suppkey) THEN 'exit' WHEN EXISTS (SELECT 1 FROM edges WHERE src = b.s_suppkey AND dst = a.s_suppkey) THEN 'entry' ELSE 'none' END AS relation FROM supplier a JOIN supplier b ON b.s_suppkey BETWEEN a.s_suppkey - 2 AND a.s_suppkey + 2 AND a.s_suppkey <> b.s_suppkey")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    p = s.select("a", F.explode(F.array(*(F.col("a") + i for i in (-2, -1, 1, 2)))).alias("b")).join(s.select(F.col("a").alias("b")), "b", "left_semi")
    e = edges(spark, d)
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("o"))
    into = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("i"))
    j = p.join(out, ["a", "b"], "left").join(into, ["a", "b"], "left")
    return j.select("a", "b", F.when(F.col("o"), "exit").when(F.col("i"), "entry").otherwise("none").alias("relation"))


@query("grf_07_reachability", f"WITH RECURSIVE {EDGES}, r AS (SELECT src, dst, 1 AS hops FROM edges UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN edges e ON e.src = r.dst WHERE hops < 5) SELECT src, dst, min(hops) AS hops FROM r GROUP BY 1, 2")
def _(spark, d):
    return graphs.reachable(edges(spark, d), 5)


@query(
    "grf_10_lane_scores",
    f"""WITH {STATES}, l AS (SELECT s_suppkey AS lane_id, CAST(s_suppkey % 40 AS DOUBLE) / 2 AS lx, s_nationkey / 4.0 AS ly, s_suppkey % 6 * 0.5 AS la FROM supplier),
    j AS (SELECT agent, frame, lane_id, (0.2 + 0.8 * cos(yaw - la)) / (pow(x - lx, 2) + pow(y - ly, 2) + 0.25) AS score FROM states JOIN l ON sqrt(pow(x - lx, 2) + pow(y - ly, 2)) <= 2 WHERE cos(yaw - la) >= 0.25),
    k AS (SELECT *, sum(score) OVER (PARTITION BY agent, frame) AS total, row_number() OVER (PARTITION BY agent, frame ORDER BY round(score, 9) DESC, lane_id) AS k FROM j) SELECT agent, frame, lane_id AS best, round(score / total, 4) AS confidence FROM k WHERE k = 1""",
)
def _(spark, d):
    from tramline.operators.joins import grid_radius_join

    k = F.col("s_suppkey")
    lanes = table(spark, d, "supplier").select(k.alias("lane_id"), (k % 40 / 2).alias("tx"), (F.col("s_nationkey") / 4).alias("ty"), (k % 6 * 0.5).alias("la"))
    # lanes that lie alike have one score and count as often as there are, and states that lie alike have the same scores
    lanes = lanes.groupBy("tx", "ty", "la").agg(F.min("lane_id").alias("lane_id"), F.count("*").alias("n"))
    s, pose = states(spark, d).select("agent", "frame", "x", "y", "yaw"), ["x", "y", "yaw"]
    j = grid_radius_join(s.select(*pose).distinct(), lanes, 2.0).withColumn("al", F.cos(F.col("yaw") - F.col("la"))).where("al >= 0.25")
    j = j.withColumn("score", (0.2 + 0.8 * F.col("al")) / (F.col("distance") * F.col("distance") + 0.25))
    best = F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("lane_id")).alias("n"), "score"))
    a = j.groupBy(*pose).agg(best.alias("b"), F.sum(F.col("score") * F.col("n")).alias("total"))
    a = a.select(*pose, (-F.col("b.n")).alias("best"), F.round(F.col("b.score") / F.col("total"), 4).alias("confidence"))
    return s.join(a, pose).select("agent", "frame", "best", "confidence")
