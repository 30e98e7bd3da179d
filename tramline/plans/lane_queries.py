"""Queries over lane matching, lane paths and the remaining geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tramline.functions import geometry as g
from tramline.operators import kernels as k
from tramline.operators import tracks
from tramline.operators.joins import grid_radius_join
from tramline.session import shared_path
from tramline.sources import files

from .registry import query, table
from .surrogates import EDGES, POLYLINES, STATES, edges, polylines, states


@query("src_01_resolved_paths")
def _(spark, d):
    return files.resolve(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file")).where(F.col("file").rlike(r"^[a-z]+\.parquet$"))


@query("src_12_batched_append", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    path = shared_path(spark, "src_12")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    files.append_batches(s, "s_suppkey", 0, 50, path)
    return spark.read.schema(s.schema).parquet(path).select(*s.columns)


@query("grf_01_lane_map", "SELECT s_nationkey AS scenario_id, s_suppkey AS lane_id, 2 AS points FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def _(spark, d):
    x = F.col("s_suppkey").cast("double")
    line = F.array(F.struct(x.alias("x"), F.lit(0.0).alias("y")), F.struct((x + 1).alias("x"), F.lit(0.0).alias("y")))
    feature = F.struct(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.struct(line.alias("polyline"))).alias("lane"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("scenario_id")).agg(F.collect_list(feature).alias("map_features"))
    return files.lane_map(s.where(F.exists("map_features", lambda f: f["lane"].isNotNull()))).select("scenario_id", "lane_id", F.size("polyline").alias("points"))


@query("grf_08_lane_paths", f"WITH {EDGES} SELECT s_suppkey AS lane, CASE WHEN s_suppkey % 7 BETWEEN 1 AND 4 AND s_suppkey + 2 <= (SELECT max(s_suppkey) FROM supplier) THEN s_suppkey || '>' || (s_suppkey + 1) || '>' || (s_suppkey + 2) || '>' || (s_suppkey + 3) END AS path FROM supplier")
def _(spark, d):
    # a chain has seven lanes, so each lane's surroundings are a bounded group
    block = F.floor((F.col("lane") - 1) / 7)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lane")).withColumn("block", block)
    e = edges(spark, d).select(F.col("src").alias("lane"), "dst")
    grouped = s.join(e, "lane", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        exits: dict = {}
        for a, b in zip(pdf.lane, pdf.dst):
            exits.setdefault(str(a), [])
            if b == b:
                exits[str(a)].append(str(int(b)))
        found = [k.lane_path(str(a), str(a + 3), exits) for a in pdf.lane]
        return pd.DataFrame({"lane": pdf.lane, "path": [None if p is None else ">".join(p) for p in found]})

    return grouped.groupBy("block").applyInPandas(run, "lane long, path string")


def _lanes_and_states(spark, d):
    """Straight lanes a unit apart, and the agents' states on them."""
    s = states(spark, d).select((F.col("agent") % 5).alias("scene"), "agent", "frame", "x", "y", F.lit(0.0).alias("heading"))
    n = spark.range(3).select(F.col("id").cast("double").alias("n"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    lane = n.select(F.format_string("L%d", F.col("n").cast("long")).alias("lane"), F.array(point(-5.0, F.col("n") * 0.5), point(5000.0, F.col("n") * 0.5)).alias("points"))
    beside = F.when(F.col("lane") == "L0", F.array(F.lit("L1"))).when(F.col("lane") == "L1", F.array(F.lit("L2"))).otherwise(F.array().cast("array<string>"))
    lanes = lane.withColumns({"next": F.array().cast("array<string>"), "beside": beside})
    return s, spark.range(5).select(F.col("id").alias("scene")).join(F.broadcast(lanes))  # three lanes for each of five scenes


@query("grf_09_viterbi_matching")
def _(spark, d):
    s, lanes = _lanes_and_states(spark, d)
    return tracks.matched_lanes(s, lanes, "scene", "agent", "frame")


@query("grf_11_frenet_assignment", f"WITH {STATES}, l AS (SELECT n, n * 0.5 AS ly FROM range(3) t(n)), j AS (SELECT agent, frame, n, 0.6 * (1 - abs(y - ly) / 2.25) + 0.4 * (1 - abs(degrees(yaw)) / 30) AS score FROM states, l WHERE abs(y - ly) <= 2.25 AND abs(degrees(yaw)) <= 30), k AS (SELECT *, row_number() OVER (PARTITION BY agent, frame ORDER BY round(score, 9) DESC, n) AS k FROM j) SELECT agent, frame, CAST(n AS BIGINT) AS lane, round(score, 6) AS score FROM k WHERE k = 1")
def _(spark, d):
    lanes = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(n * 0.5).alias("ly")) for n in range(3)))
    deg = F.abs(F.degrees("yaw"))
    near = F.filter(lanes, lambda v: F.abs(F.col("y") - v["ly"]) <= 2.25)
    scored = F.transform(near, lambda v: F.struct(F.round(0.6 * (1 - F.abs(F.col("y") - v["ly"]) / 2.25) + 0.4 * (1 - deg / 30), 9).alias("score"), (-v["n"]).alias("m")))
    s = states(spark, d).where(deg <= 30).withColumn("best", F.array_max(scored)).where("best is not null")
    return s.select("agent", "frame", (-F.col("best.m")).alias("lane"), F.round("best.score", 6).alias("score"))


@query("grf_12_lane_choice", f"WITH {STATES}, c AS (SELECT agent, frame, CASE WHEN conf >= 0.5 THEN lane END AS closest, lag(lane) OVER (PARTITION BY agent ORDER BY frame) AS previous FROM states) SELECT agent, frame, coalesce(closest, previous) AS lane FROM c")
def _(spark, d):
    before = F.lag("lane").over(Window.partitionBy("agent").orderBy("frame"))
    return states(spark, d).select("agent", "frame", F.coalesce(F.when(F.col("conf") >= 0.5, F.col("lane")), before).alias("lane"))


@query("win_10_held_excursions")
def _(spark, d):
    s = states(spark, d).select("agent", "frame", "lane")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        lanes = [None if v != v else int(v) for v in pdf.lane]
        near = [{a for a in lanes[max(0, i - 2) : i + 3] if a is not None} for i in range(len(lanes))]
        return pd.DataFrame({"agent": pdf.agent, "frame": pdf.frame, "held": pd.array(k.hold_excursions(lanes, near), dtype="Int64")})

    return s.groupBy("agent").applyInPandas(run, "agent long, frame long, held long")


@query(
    "geo_07_local_lane_frame",
    f"WITH {STATES}, l AS (SELECT s_suppkey AS lane_id, CAST(s_suppkey % 40 AS DOUBLE) / 2 AS lx, s_nationkey / 4.0 AS ly, s_suppkey % 6 * 0.5 AS la FROM supplier), j AS (SELECT agent, frame, x, y, coalesce(ax, 0) AS v, lx, ly, la, row_number() OVER (PARTITION BY agent, frame ORDER BY round(sqrt(pow(x - lx, 2) + pow(y - ly, 2)), 9), lane_id) AS k FROM states JOIN l ON sqrt(pow(x - lx, 2) + pow(y - ly, 2)) <= 2) SELECT agent, frame, round(v * cos(la), 5) AS v_long, round(-v * sin(la), 5) AS v_lat, round(-sin(la) * (x - lx) + cos(la) * (y - ly), 5) AS lateral FROM j WHERE k = 1",
)
def _(spark, d):
    key = F.col("s_suppkey")
    lanes = table(spark, d, "supplier").select(key.alias("lane_id"), (key % 40 / 2).alias("tx"), (F.col("s_nationkey") / 4).alias("ty"), (key % 6 * 0.5).alias("la"))
    # of lanes at one place the first is the nearest, and states at one place have one lane
    lanes = lanes.groupBy("tx", "ty").agg(F.min(F.struct("lane_id", "la")).alias("l")).select("tx", "ty", "l.*")
    s = states(spark, d).select("agent", "frame", "x", "y", F.coalesce("ax", F.lit(0.0)).alias("v"))
    j = grid_radius_join(s.select("x", "y").distinct(), lanes, 2.0)
    best = j.groupBy("x", "y").agg(F.min(F.struct(F.round("distance", 9).alias("r"), "lane_id", "tx", "ty", "la")).alias("b")).select("x", "y", "b.*")
    b = s.join(best, ["x", "y"])
    long, wide = b.v * F.cos("la"), -b.v * F.sin("la")
    lateral = g.cross(F.cos("la"), F.sin("la"), b.x - b.tx, b.y - b.ty)
    return b.select("agent", "frame", F.round(long, 5).alias("v_long"), F.round(wide, 5).alias("v_lat"), F.round(lateral, 5).alias("lateral"))


@query("geo_15_lane_extrapolation", "WITH h AS (SELECT s_suppkey, least(3, (7 - s_suppkey % 7) % 7, (SELECT max(s_suppkey) + 1 FROM supplier) - s_suppkey) AS hops FROM supplier) SELECT s_suppkey AS lane, s_suppkey + hops AS last, hops FROM h")
def _(spark, d):
    e = edges(spark, d)
    out = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lane"), F.col("s_suppkey").alias("last"), F.lit(0).alias("hops"))
    for i in range(3):
        step = e.groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("_s"), "dst")
        out = out.join(step, F.col("last") == F.col("_s"), "left").select("lane", F.coalesce("dst", "last").alias("last"), (F.col("hops") + F.col("dst").isNotNull().cast("int")).alias("hops"))
    return out.select("lane", "last", F.col("hops").cast("long").alias("hops"))


_SQUARE = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@pandas_udf(_SQUARE)
def _flat_hits(lines: pd.Series, edge: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(lines, edge):
        p = k.crossings(tracks.pairs_of(a), tracks.pairs_of(b))
        out.append((len(p), *(p[0].tolist() if len(p) else (None, None))))
    return pd.DataFrame(out, columns=["n", "x", "y"])


def _hits(lines: str, edge):
    return _flat_hits(tracks.flat(F.col(lines)), tracks.flat(edge))


def _edge(y: float):
    return F.array(F.struct(F.lit(-1e4).alias("x"), F.lit(y).alias("y")), F.struct(F.lit(1e4).alias("x"), F.lit(y).alias("y")))


_CROSS = f"WITH {POLYLINES}, sg AS (SELECT line_id, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points WINDOW w AS (PARTITION BY line_id ORDER BY seq)), h AS (SELECT line_id, seq, x + (nx - x) * (0.1 - y) / (ny - y) AS hx FROM sg WHERE (y < 0.1 AND ny > 0.1) OR (y > 0.1 AND ny < 0.1))"


@query("geo_17_inferred_intersection", _CROSS + " SELECT line_id, round(arg_min(hx, seq), 5) AS x FROM h GROUP BY line_id")
def _(spark, d):
    h = polylines(spark, d).select("line_id", _hits("points", _edge(0.1)).alias("h"))
    return h.where("h.n > 0").select("line_id", F.round("h.x", 5).alias("x"))


@query("geo_23_boundary_crossing", _CROSS + " SELECT line_id, count(*) AS n FROM h GROUP BY line_id")
def _(spark, d):
    return polylines(spark, d).select("line_id", _hits("points", _edge(0.1)).alias("h")).where("h.n > 0").select("line_id", "h.n")
