"""Runs the numeric kernels per entity: Arrow-batched groups, one entity's frames at a time (a track is bounded)."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tramline.functions import geometry as g

from . import kernels as k


def _values(s: pd.Series) -> list:
    return [None if v is None or v != v else int(v) for v in s]


def stable_lanes(df: DataFrame, entity: str, order: str, lane: str, confidence: str, dwell: int = 3) -> DataFrame:
    """(entity, order, lane, absorbed, unflickered): dwell absorption and the flicker filter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        raw = _values(pdf[lane])
        out = pd.DataFrame({entity: pdf[entity], order: pdf[order], lane: pd.array(raw, dtype="Int64")})
        out["absorbed"] = pd.array(k.absorb_short_runs(raw, dwell), dtype="Int64")
        out["unflickered"] = pd.array(k.drop_flickers(raw, list(pdf[confidence]))[0], dtype="Int64")
        return out

    return df.select(entity, order, lane, confidence).groupBy(entity).applyInPandas(run, f"{entity} long, {order} long, {lane} long, absorbed long, unflickered long")


def smoothed(df: DataFrame, entity: str, order: str, value: str, window: int = 7, degree: int = 2) -> DataFrame:
    """(entity, order, smooth): polynomial smoothing of each entity's series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({entity: pdf[entity], order: pdf[order], "smooth": k.savgol(pdf[value].to_numpy(dtype=float), window, degree)})

    return df.select(entity, order, value).groupBy(entity).applyInPandas(run, f"{entity} long, {order} long, smooth double")


def lane_candidates(df: DataFrame, lanes: DataFrame, scene: str, entity: str, order: str, reach: float = 3.0, turn: float = math.pi / 8, top: int = 5, cell: float = 16.0) -> DataFrame:
    """(scene, entity, order, candidates): for each frame the ``top`` lanes within ``reach`` whose nearest piece has about its heading.

    The pieces of the lanes are posted to the grid cells they come near, column by column, and meet the positions of their cell in
    an equi-join; so a frame meets the pieces around it and not its scene's map. Candidates are (cost, lane, next, beside), cheapest
    first, then by lane. Frames with an unknown or infinite position or heading have none and are absent.
    """
    point = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    pieces = F.when(F.size("points") == 1, F.transform("_p", lambda p: F.struct(p.alias("a"), p.alias("b")))).otherwise(g.segments(F.col("_p")))
    seg = lanes.withColumn("_p", point).select(scene, "lane", F.posexplode(pieces).alias("i", "s")).select(scene, "lane", "i", *[F.col(f"s.{e}.{c}").alias(e + c) for e in "ab" for c in "xy"])
    column = F.sequence(F.floor((F.least("ax", "bx") - reach) / cell), F.floor((F.greatest("ax", "bx") + reach) / cell))
    seg = seg.withColumn("_cx", F.explode(column))
    slope = F.when(F.abs(F.col("bx") - F.col("ax")) > 1e-9, (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    left, right = (F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx")) for x in (F.col("_cx") * cell - reach, (F.col("_cx") + 1) * cell + reach))
    at = lambda x: F.coalesce(F.col("ay") + (x - F.col("ax")) * slope, F.col("ay"))
    low = F.when(slope.isNull(), F.least("ay", "by")).otherwise(F.least(at(left), at(right)))
    high = F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(F.greatest(at(left), at(right)))
    posted = seg.withColumn("_cy", F.explode(F.sequence(F.floor((low - reach) / cell), F.floor((high + reach) / cell))))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    own = df.where(finite("x") & finite("y") & finite("heading")).select(scene, entity, order, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "heading")])
    own = own.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    j = own.join(posted, [scene, "_cx", "_cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / n))).otherwise(0.0)
    away = F.hypot(F.col("x") - (F.col("ax") + t * dx), F.col("y") - (F.col("ay") + t * dy))
    near = j.withColumn("d", away).where(F.col("d") <= reach)
    best = near.groupBy(scene, entity, order, "lane").agg(F.min(F.struct("d", "i", F.atan2(dy, dx).alias("direction"), "heading")).alias("b"))
    off = F.abs(g.wrap(F.col("b.heading") - F.col("b.direction")))
    fit = best.withColumn("_off", off).where(F.col("_off") <= turn).select(scene, entity, order, "lane", (F.col("b.d") + 3.0 * F.col("_off")).alias("cost"))
    fit = fit.withColumn("_r", F.row_number().over(Window.partitionBy(scene, entity, order).orderBy("cost", "lane"))).where(F.col("_r") <= top)
    named = fit.join(lanes.select(scene, "lane", "next", "beside"), [scene, "lane"])
    return named.groupBy(scene, entity, order).agg(F.sort_array(F.collect_list(F.struct("cost", "lane", "next", "beside"))).alias("candidates"))


def matched_lanes(df: DataFrame, lanes: DataFrame, scene: str, entity: str, order: str, **near) -> DataFrame:
    """(scene, entity, order, lane): Viterbi matching of each entity to the lanes of its scene; null where no lane is near.

    ``lanes``: (scene, lane, points, next array, beside array). Candidates come from a join (``lane_candidates``); the dynamic program
    runs over one track at a time, and its topology is what its few candidates name.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        follows, beside, cands = set(), set(), []
        for frame in pdf.candidates:
            frame = [] if frame is None else frame
            cands.append([(c["cost"], c["lane"]) for c in frame])
            for c in frame:
                follows.update((c["lane"], n) for n in c["next"] if n is not None)
                beside.update((c["lane"], n) for n in c["beside"] if n is not None)
        found = k.choose_lanes(cands, lambda a, b: k.transition_cost(a, b, (a, b) in follows, (a, b) in beside or (b, a) in beside))
        return pd.DataFrame({scene: pdf[scene], entity: pdf[entity], order: pdf[order], "lane": found})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lane = lanes.schema["lane"].dataType.simpleString()
    keys = [scene, entity, order]
    return df.select(*keys).join(lane_candidates(df, lanes, scene, entity, order, **near), keys, "left").groupBy(scene, entity).applyInPandas(run, f"{scene} {kinds[scene]}, {entity} {kinds[entity]}, {order} {kinds[order]}, lane {lane}")


@pandas_udf(T.DoubleType())
def box_overlap(ax: pd.Series, ay: pd.Series, ah: pd.Series, bx: pd.Series, by: pd.Series, bh: pd.Series, length: pd.Series, width: pd.Series) -> pd.Series:
    """Shared area of two oriented boxes of one size."""
    rows = pd.DataFrame({"ax": ax, "ay": ay, "ah": ah, "bx": bx, "by": by, "bh": bh, "n": length, "w": width}).astype(float)
    place, cases = pd.factorize(pd.MultiIndex.from_frame(rows), use_na_sentinel=False)  # boxes that lie alike are cut once
    found = [k.overlap_area(k.box(x, y, h, n, w), k.box(u, v, g, n, w)) if np.hypot(x - u, y - v) <= np.hypot(n, w) else 0.0 for x, y, h, u, v, g, n, w in cases]
    return pd.Series(np.array(found, dtype=float)[place])


def flat(points: Column) -> Column:
    """The coordinates of a polyline as one array x, y, x, y: a Python task gets it as numbers and not as an object a point."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))


def pairs_of(v) -> np.ndarray:
    """The points of ``flat``; an unknown coordinate is NaN."""
    return np.asarray(v, dtype=float).reshape(-1, 2)


def conflict(a: Column | str, b: Column | str) -> Column:
    """Where two paths meet, and how far along each; nulls where they don't."""

    @pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "way_a", "way_b")]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(a, b):
            hit = k.conflict_point(pairs_of(p), pairs_of(q))
            out.append((None,) * 4 if hit is None else (float(hit[0][0]), float(hit[0][1]), hit[1], hit[2]))
        return pd.DataFrame(out, columns=["x", "y", "way_a", "way_b"])

    return run(*(flat(F.col(c) if isinstance(c, str) else c) for c in (a, b)))


@pandas_udf(T.DoubleType())
def separation_effort(d1: pd.Series, v1: pd.Series, d2: pd.Series, v2: pd.Series) -> pd.Series:
    """The least sum of accelerations that parts two arrivals; 0 where nothing parts them, as a failed search counts."""
    found = [k.separating_acceleration((a, c), (b, d)) for a, b, c, d in zip(d1, v1, d2, v2)]
    return pd.Series([0.0 if x != x else x for x in found])


def without_keys(column: Column, names: list[str], suffixes: tuple[str, ...] = ("_audit_only",)) -> Column:
    """JSON text without these keys at any depth; text that is no JSON gives null."""
    gone = frozenset(names)

    @pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(k.remove_keys(json.loads(x), gone, suffixes), sort_keys=True)
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(column)


def speed_episodes(df: DataFrame, entity: str, order: str, speed: str, dt: float = 0.1, least: float = 0.8) -> DataFrame:
    """(entity, start_frame, end_frame, sign): accelerations over a threshold, one-frame gaps bridged, near ones merged."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf[speed].to_numpy(dtype=float)
        a = np.gradient(v, dt) if len(v) > 1 else np.zeros(len(v))
        sign = np.where(a >= least, 1, np.where(a <= -least, -1, 0))
        for i in range(1, len(sign) - 1):
            if sign[i] == 0 and sign[i - 1] == sign[i + 1] != 0:
                sign[i] = sign[i - 1]
        starts, ends, held = k.run_table(sign.tolist())
        found = k.merge_episodes([(int(s), int(e), g) for s, e, g in zip(starts, ends, held) if g], v)
        frames = pdf[order].to_numpy()
        return pd.DataFrame([(pdf[entity].iloc[0], int(frames[s]), int(frames[e]), g) for s, e, g in found], columns=[entity, "start_frame", "end_frame", "sign"])

    return df.select(entity, order, speed).groupBy(entity).applyInPandas(run, f"{entity} long, start_frame long, end_frame long, sign int")


def deduped_segments(df: DataFrame, key: str, order: str, share: float = 0.8) -> DataFrame:
    """The rows (key, order, start_frame, end_frame, kind) that the greedy duplicate rule keeps, in ``order``: see ``kernels.dedupe_segments``.

    Only segments of one kind are duplicates, so a key's kinds are groups of their own.
    """
    own = [order, *(c for c in df.columns if c not in (key, order, "kind"))]
    size = lambda s: s["end_frame"] - s["start_frame"] + 1

    def same(q: Column, s: Column) -> Column:
        common = F.least(q["end_frame"], s["end_frame"]) - F.greatest(q["start_frame"], s["start_frame"]) + 1
        return F.coalesce(common >= share * F.least(size(q), size(s)), F.lit(False))

    def step(kept: Column, s: Column) -> Column:
        return F.when(F.exists(kept, lambda q: same(q, s)), kept).otherwise(F.concat(kept, F.array(s)))

    g = df.groupBy(key, "kind").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_s"))
    kept = F.aggregate("_s", F.filter("_s", lambda s: F.lit(False)), step)
    return g.select(key, "kind", F.explode(kept).alias("_r")).select(key, "kind", "_r.*").select(*df.columns)


def generated(rows: DataFrame, client, schema: str, tries: int = 3, wait: float = 3.0) -> DataFrame:
    """Rows through a remote model: ``client()`` makes a callable per task, tried ``tries`` times with growing waits.

    ``client`` is injected, so nothing here opens a connection, and is told the number of the attempt. A row that fails every time gets status 'failed'.
    """
    import time

    def run(batches):
        call = client()
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for attempt in range(1, tries + 1):
                    try:
                        out.append({**row, "answer": call({**row, "attempt": attempt}), "status": "ok", "attempts": attempt})
                        break
                    except Exception:
                        if attempt == tries:
                            out.append({**row, "answer": None, "status": "failed", "attempts": attempt})
                        else:
                            time.sleep(wait * attempt)
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)
