"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import joins as jn
from tramline.session import written

from .registry import query, table
from .surrogates import INTERVALS, STATES, intervals, pairs_source, states

_PAIRS = "m AS (SELECT DISTINCT l_orderkey AS scene, l_suppkey AS agent FROM lineitem), p AS (SELECT x.scene, x.agent AS a, y.agent AS b FROM m x JOIN m y ON x.scene = y.scene AND x.agent < y.agent)"


@query("join_01_pairs", f"WITH {_PAIRS} SELECT scene, a, b FROM p")
def _(spark, d):
    return jn.pairs(pairs_source(spark, d), ["scene"], "agent")


_FRAME_PAIRS = f"""WITH {STATES}, f AS (SELECT a.agent AS a, b.agent AS b, a.frame, a.x AS ax_, a.y AS ay_, b.x AS bx_, b.y AS by_, a.valid AND b.valid AS ok FROM states a JOIN states b ON a.frame = b.frame AND b.agent = a.agent + 1),
r AS (SELECT a, b, frame, ok, round(sqrt((ax_ - bx_) * (ax_ - bx_) + (ay_ - by_) * (ay_ - by_)), 3) AS distance FROM f)"""


def frame_pairs(spark, d):
    """(a, b, frame, ok, distance): neighbouring agents on common frames."""
    s = states(spark, d).select("agent", "frame", "x", "y", "valid")
    a = s.select(F.col("agent").alias("a"), (F.col("agent") + 1).alias("b"), "frame", "x", "y", "valid")
    b = s.select(F.col("agent").alias("b"), "frame", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("valid").alias("bv"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return a.join(b, ["b", "frame"]).select("a", "b", "frame", (F.col("valid") & F.col("bv")).alias("ok"), F.round(F.sqrt(dx * dx + dy * dy), 3).alias("distance"))


@query("join_02_frame_pairs", _FRAME_PAIRS + " SELECT a, b, frame, distance FROM r WHERE ok")
def _(spark, d):
    return frame_pairs(spark, d).where("ok").drop("ok")


@query(
    "join_03_ids_with_tracks",
    "WITH w AS (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT DISTINCT o_custkey + 1000000 FROM orders WHERE o_orderkey % 50 = 0) SELECT id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey % 2 = 0 THEN 'vehicle' ELSE 'nonvehicle' END AS kind FROM w LEFT JOIN customer ON id = c_custkey",
)
def _(spark, d):
    o = table(spark, d, "orders")
    ids = o.select(F.col("o_custkey").alias("id")).union(o.where("o_orderkey % 50 = 0").select(F.col("o_custkey") + 1000000)).distinct()
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    kind = F.when(F.col("c_custkey").isNull(), "missing").when(F.col("c_nationkey") % 2 == 0, "vehicle").otherwise("nonvehicle")
    return ids.join(c, ids.id == c.c_custkey, "left").select("id", kind.alias("kind"))


_HALVES = f"WITH {INTERVALS}, l AS (SELECT * FROM intervals WHERE kind < '3'), g AS (SELECT * FROM intervals WHERE kind >= '3')"


def _halves(spark, d):
    i = intervals(spark, d)
    return i.where("kind < '3'"), i.where("kind >= '3'")


@query(
    "join_04_gap_join",
    _HALVES + " SELECT l.interval_id AS left_id, g.interval_id AS right_id, greatest(0, g.start_frame - l.end_frame, l.start_frame - g.end_frame) AS gap FROM l JOIN g ON l.agent = g.agent AND greatest(0, g.start_frame - l.end_frame, l.start_frame - g.end_frame) <= 5",
)
def _(spark, d):
    a, b = _halves(spark, d)
    j = jn.range_join(a, b, ["agent"], 5)
    g = jn.gap(F.col("start_frame"), F.col("end_frame"), F.col("r_start_frame"), F.col("r_end_frame"))
    return j.select(F.col("interval_id").alias("left_id"), F.col("r_interval_id").alias("right_id"), g.alias("gap"))


@query(
    "join_05_overlap_join",
    _HALVES
    + ", j AS (SELECT l.interval_id AS left_id, g.interval_id AS right_id, least(l.end_frame, g.end_frame) - greatest(l.start_frame, g.start_frame) + 1 AS shared, row_number() OVER (PARTITION BY l.interval_id ORDER BY abs((g.start_frame + g.end_frame) - (l.start_frame + l.end_frame)), g.interval_id) AS k FROM l JOIN g ON l.agent = g.agent AND least(l.end_frame, g.end_frame) >= greatest(l.start_frame, g.start_frame)) SELECT left_id, right_id, shared FROM j WHERE k = 1",
)
def _(spark, d):
    a, b = _halves(spark, d)
    j = jn.range_join(a, b, ["agent"], 0)
    shared = jn.overlap(F.col("start_frame"), F.col("end_frame"), F.col("r_start_frame"), F.col("r_end_frame"))
    away = F.abs(F.col("r_start_frame") + F.col("r_end_frame") - F.col("start_frame") - F.col("end_frame"))
    best = F.min(F.struct(away.alias("d"), F.col("r_interval_id").alias("right_id"), shared.alias("shared"))).alias("m")
    return j.groupBy(F.col("interval_id").alias("left_id")).agg(best).select("left_id", "m.right_id", "m.shared")


@query(
    "join_06_nearest_frame",
    f"WITH {STATES}, {INTERVALS}, pr AS (SELECT DISTINCT agent, end_frame % 70 AS at_frame FROM intervals), v AS (SELECT * FROM states WHERE valid), "
    "j AS (SELECT pr.agent, at_frame, v.frame, v.event_id, row_number() OVER (PARTITION BY pr.agent, at_frame ORDER BY abs(v.frame - at_frame), v.frame) AS k FROM pr JOIN v ON pr.agent = v.agent) SELECT agent, at_frame, frame AS near_frame, event_id AS near_event_id FROM j WHERE k = 1",
)
def _(spark, d):
    p = intervals(spark, d).select("agent", (F.col("end_frame") % 70).alias("at_frame")).distinct()
    return jn.nearest_frame(p, states(spark, d).where("valid"), ["agent"], "at_frame", "frame", ["event_id"])


@query(
    "join_07_nearest_position",
    f"WITH {STATES}, j AS (SELECT agent, frame, abs(x - 10.25) + abs(y - 0.5) AS away, row_number() OVER (PARTITION BY agent ORDER BY abs(x - 10.25) + abs(y - 0.5), frame) AS k FROM states WHERE valid) SELECT agent, frame, away FROM j WHERE k = 1 AND away <= 0.5",
)
def _(spark, d):
    away = F.abs(F.col("x") - 10.25) + F.abs(F.col("y") - 0.5)
    best = F.min(F.struct(away.alias("away"), "frame")).alias("m")
    return states(spark, d).where("valid").groupBy("agent").agg(best).select("agent", "m.frame", "m.away").where("away <= 0.5")


@query(
    "join_08_offset_search",
    f"""WITH {STATES}, r AS (SELECT agent, min(frame) FILTER (WHERE valid) AS lo, max(frame) FILTER (WHERE valid) AS hi FROM states GROUP BY agent),
    e AS (SELECT s.agent, s.frame AS off, count(*) FILTER (WHERE NOT t.valid) AS err FROM states s JOIN r ON s.agent = r.agent JOIN states t ON t.agent = s.agent AND t.frame BETWEEN s.frame AND s.frame + 7 WHERE s.frame BETWEEN lo AND least(hi, lo + 20) AND s.frame + 7 <= hi GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY err, off) AS k FROM e) SELECT agent, off AS best_offset, err AS error_frames FROM b WHERE k = 1 AND err <= 1""",
)
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("frame").rowsBetween(0, 7)
    e = Window.partitionBy("agent")
    f = F.when(F.col("valid"), F.col("frame"))
    s = states(spark, d).withColumns({"err": F.sum((~F.col("valid")).cast("long")).over(w), "lo": F.min(f).over(e), "hi": F.max(f).over(e)})
    ok = s.where("frame between lo and least(hi, lo + 20) and frame + 7 <= hi")
    return ok.groupBy("agent").agg(F.min(F.struct("err", "frame")).alias("m")).select("agent", F.col("m.frame").alias("best_offset"), F.col("m.err").alias("error_frames")).where("error_frames <= 1")


@query(
    "join_09_alignment_fallback",
    f"""WITH {STATES}, p AS (SELECT agent, frame, row_number() OVER (PARTITION BY agent ORDER BY abs(x - 10.25) + abs(y - 0.5), frame) AS k, abs(x - 10.25) + abs(y - 0.5) AS away FROM states WHERE valid),
    f AS (SELECT agent, min(frame) AS frame FROM states WHERE valid AND conf >= 0.9 GROUP BY agent), g AS (SELECT DISTINCT agent FROM states)
    SELECT g.agent, coalesce(p.frame, f.frame) AS aligned, CASE WHEN p.frame IS NOT NULL THEN 'position' WHEN f.frame IS NOT NULL THEN 'offset' ELSE 'failed' END AS method FROM g LEFT JOIN p ON g.agent = p.agent AND p.k = 1 AND p.away <= 0.5 LEFT JOIN f ON g.agent = f.agent""",
)
def _(spark, d):
    s = states(spark, d)
    away = F.when(F.col("valid"), F.abs(F.col("x") - 10.25) + F.abs(F.col("y") - 0.5))
    g = s.groupBy("agent").agg(F.min(F.when(away.isNotNull(), F.struct(away.alias("away"), "frame"))).alias("m"), F.min(F.when(F.col("valid") & (F.col("conf") >= 0.9), F.col("frame"))).alias("f"))
    p = F.when(F.col("m.away") <= 0.5, F.col("m.frame"))
    return g.select("agent", F.coalesce(p, "f").alias("aligned"), F.when(p.isNotNull(), "position").when(F.col("f").isNotNull(), "offset").otherwise("failed").alias("method"))


@query(
    "join_10_event_pair_association",
    _HALVES
    + """, j AS (SELECT l.interval_id, count(g.interval_id) AS others, max(greatest(0, least(l.end_frame, g.end_frame) - greatest(l.start_frame, g.start_frame) + 1)) AS shared,
      max(CAST(g.kind = '5-LOW' AS INT)) + max(CAST(g.interval_id % 2 = 0 AS INT)) + max(CAST(g.start_frame > l.start_frame AS INT)) + max(CAST(g.end_frame % 3 = 0 AS INT)) AS evidence
      FROM l LEFT JOIN g ON l.agent = g.agent GROUP BY 1)
    SELECT interval_id, CASE WHEN others = 0 THEN 'unrelated' WHEN shared > 0 THEN 'overlap' WHEN evidence >= 2 THEN 'associated_but_outside' ELSE 'nearby_unverified' END AS association FROM j""",
)
def _(spark, d):
    a, b = _halves(spark, d)
    g = b.select("agent", F.col("interval_id").alias("g_id"), F.col("kind").alias("g_kind"), F.col("start_frame").alias("gs"), F.col("end_frame").alias("ge"))
    yes = lambda c: F.max(c.cast("int"))
    j = a.join(g, "agent", "left").groupBy("interval_id").agg(
        F.count("g_id").alias("others"), F.max(jn.overlap(F.col("start_frame"), F.col("end_frame"), F.col("gs"), F.col("ge"))).alias("shared"),
        (yes(F.col("g_kind") == "5-LOW") + yes(F.col("g_id") % 2 == 0) + yes(F.col("gs") > F.col("start_frame")) + yes(F.col("ge") % 3 == 0)).alias("evidence"),
    )
    c = F.when(F.col("others") == 0, "unrelated").when(F.col("shared") > 0, "overlap").when(F.col("evidence") >= 2, "associated_but_outside").otherwise("nearby_unverified")
    return j.select("interval_id", c.alias("association"))


@query(
    "join_11_manifest_lookups",
    "WITH q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT c_custkey, o_orderkey, n_name, CASE WHEN o_orderkey IS NULL THEN 'missing_output' WHEN o_orderstatus <> 'F' THEN 'invalid' ELSE 'ok' END AS status FROM customer LEFT JOIN q ON c_custkey = o_custkey AND k = 1 LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, d):
    o = jn.last_writer(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(o, c.c_custkey == o.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    status = F.when(F.col("o_orderkey").isNull(), "missing_output").when(F.col("o_orderstatus") != "F", "invalid").otherwise("ok")
    return j.select("c_custkey", "o_orderkey", "n_name", status.alias("status"))


@query(
    "join_12_full_coverage_comparison",
    "WITH v1 AS (SELECT s_suppkey AS k, s_acctbal AS a FROM supplier WHERE s_suppkey % 5 <> 0), v2 AS (SELECT s_suppkey AS k, s_nationkey AS b FROM supplier WHERE s_suppkey % 4 <> 0) SELECT coalesce(v1.k, v2.k) AS k, CASE WHEN v1.k IS NULL THEN 'v2_only' WHEN v2.k IS NULL THEN 'v1_only' ELSE 'both' END AS side, a, b FROM v1 FULL JOIN v2 ON v1.k = v2.k",
)
def _(spark, d):
    s = table(spark, d, "supplier")
    a = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"), F.lit(1).alias("l"))
    b = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"), F.lit(1).alias("r"))
    return a.join(b, "k", "full").select("k", F.when(F.col("l").isNull(), "v2_only").when(F.col("r").isNull(), "v1_only").otherwise("both").alias("side"), "a", "b")


@query(
    "join_13_duplicate_semi",
    _HALVES + " SELECT interval_id FROM l WHERE EXISTS (SELECT 1 FROM g WHERE g.agent = l.agent AND least(l.end_frame, g.end_frame) >= greatest(l.start_frame, g.start_frame))",
)
def _(spark, d):
    a, b = _halves(spark, d)
    return jn.range_join(a, b, ["agent"], 0).select("interval_id").distinct()


@query(
    "join_14_unique_donor",
    "WITH e AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT l_orderkey, count(*) AS n, min(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) = 1) SELECT e.l_orderkey, e.l_linenumber, g.tax FROM e LEFT JOIN g ON e.l_orderkey = g.l_orderkey",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_tax").alias("tax"))
    return jn.unique_donor(li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), li.where("l_returnflag = 'A'"), ["l_orderkey"], ["tax"])


@query(
    "join_15_grid_radius",
    f"WITH {STATES}, p AS (SELECT agent, frame, x, y FROM states), t AS (SELECT s_suppkey AS lane_id, s_suppkey % 60 * 0.5 AS tx, s_nationkey * 0.25 AS ty FROM supplier) SELECT agent, frame, lane_id, round(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), 6) AS distance FROM p JOIN t ON sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) <= 1.5",
)
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lane_id"), (F.col("s_suppkey") % 60 * 0.5).alias("tx"), (F.col("s_nationkey") * 0.25).alias("ty"))
    p = written(states(spark, d).select("agent", "frame", "x", "y"), "placed_states")
    # distances are found once for the places; a state then meets lists of the lanes of a place, so its pairs aren't shuffled
    near = jn.grid_radius_join(p.select("x", "y").distinct(), t.select("tx", "ty").distinct(), 1.5).withColumn("distance", F.round("distance", 6))
    lanes = near.join(jn.in_lists(t, ["tx", "ty"], "lane_id"), ["tx", "ty"]).select("x", "y", "distance", "lane_id")
    # written first, so that Spark sees how few places there are
    return p.join(written(lanes, "near_lanes"), ["x", "y"]).select("agent", "frame", F.explode("lane_id").alias("lane_id"), "distance")


@query(
    "join_16_reference_agent",
    "WITH o AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN n = 1 THEN a WHEN n = 2 THEN b END AS reference, CASE WHEN o_orderkey % 4 = 0 THEN 'record' WHEN n = 1 THEN 'scene' WHEN n = 2 THEN 'other_key_agent' ELSE 'unresolved' END AS provenance FROM orders LEFT JOIN o ON o_orderkey = l_orderkey",
)
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(s, F.col("o_orderkey") == s.l_orderkey, "left")
    own = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey"))
    scene, other = F.when(F.col("n") == 1, F.col("a")), F.when(F.col("n") == 2, F.col("b"))
    name = F.when(own.isNotNull(), "record").when(scene.isNotNull(), "scene").when(other.isNotNull(), "other_key_agent").otherwise("unresolved")
    return o.select("o_orderkey", F.coalesce(own, scene, other).alias("reference"), name.alias("provenance"))


@query(
    "join_17_last_review",
    "WITH r AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT doc_id, turn, role, n FROM documents LEFT JOIN r ON doc_id = conv_id AND k = 1",
)
def _(spark, d):
    r = jn.last_writer(table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")), ["conv_id"], ["turn"])
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(r, docs.doc_id == r.conv_id, "left").select("doc_id", "turn", "role", "n")


@query("set_01_union", "SELECT s_suppkey AS k, 'supplier' AS src FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("src"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src")))


@query("set_02_difference", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.distinct().join(o, "k", "left_anti")


@query("set_03_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "events").select(F.col("user_id").alias("k")))


@query("set_04_stable_distinct", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def _(spark, d):
    return jn.stable_distinct(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("sort_01_top_k", f"WITH {STATES} SELECT agent, frame, conf, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY conf DESC, event_id) AS k FROM states) WHERE k <= 3")
def _(spark, d):
    w = Window.partitionBy("agent").orderBy(F.desc("conf"), "event_id")
    return states(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("agent", "frame", "conf", "place")


@query("sort_02_event_order", f"WITH {INTERVALS} SELECT interval_id, row_number() OVER (PARTITION BY agent ORDER BY start_frame, kind, interval_id) AS place FROM intervals")
def _(spark, d):
    w = Window.partitionBy("agent").orderBy("start_frame", "kind", "interval_id")
    return intervals(spark, d).select("interval_id", F.row_number().over(w).alias("place"))


@query("sort_03_capped_lists", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k <= 5")
def _(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 5").select("p_brand", "p_partkey")


@query("fct_21_agent_typing", "WITH m AS (SELECT l_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(ids, lambda i: CASE WHEN i % 10 = 0 THEN 'AV' ELSE 'HV' END), ';') AS types FROM m")
def _(spark, d):
    ids = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids")).select("l_orderkey", F.array_join(F.transform("ids", lambda i: F.when(i % 10 == 0, "AV").otherwise("HV")), ";").alias("types"))


@query("agg_10_closest_approach", _FRAME_PAIRS + " SELECT a, b, distance, frame FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance, frame) AS k FROM r WHERE ok) WHERE k = 1")
def _(spark, d):
    g = frame_pairs(spark, d).where("ok").groupBy("a", "b").agg(F.min(F.struct("distance", "frame")).alias("m"))
    return g.select("a", "b", "m.distance", "m.frame")


@query(
    "agg_11_pair_summary",
    _FRAME_PAIRS + " SELECT a, b, min(distance) AS min_distance, arg_min(frame, struct_pack(d := distance, f := frame)) AS min_frame, max(distance) FILTER (WHERE frame = 10) AS at_start, arg_min(distance, frame) AS initial FROM r WHERE ok GROUP BY a, b",
)
def _(spark, d):
    best = F.min(F.struct("distance", "frame"))
    g = frame_pairs(spark, d).where("ok").groupBy("a", "b")
    return g.agg(F.min("distance").alias("min_distance"), best["frame"].alias("min_frame"), F.max(F.when(F.col("frame") == 10, F.col("distance"))).alias("at_start"), F.min_by("distance", "frame").alias("initial"))
