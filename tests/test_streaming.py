import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tramline.operators import frames as fr
from tramline.streaming import streams

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def drain(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def stream(spark, tmp_path, name, rows, schema, files=1):
    path = str(tmp_path / name)
    n = max(1, len(rows) // files)
    for i in range(0, len(rows), n):
        time.sleep(0.05)  # files come in the order of their times
        spark.createDataFrame(rows[i : i + n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_equal_batch(spark, tmp_path):
    rows = [(i % 3, at(i * 20)) for i in range(60)]
    s = stream(spark, tmp_path, "w", rows, "agent int, ts timestamp", 3)
    got = drain(spark, streams.windowed_counts(s, "ts", ["agent"], "2 minutes"), "complete", "w_counts")
    want = spark.createDataFrame(rows, "agent int, ts timestamp").groupBy(F.window("ts", "2 minutes"), "agent").count().select("agent", "window.start", "window.end", F.col("count").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    slid = streams.windowed_counts(spark.createDataFrame(rows, "agent int, ts timestamp"), "ts", [], "2 minutes", "1 minute")
    assert sum(r["n"] for r in slid.collect()) == 2 * len(rows)


def test_sessions_and_late_rows(spark, tmp_path):
    rows = [(1, at(0)), (1, at(30)), (1, at(400)), (1, at(9000)), (1, at(20000))]
    s = stream(spark, tmp_path, "s", rows, "agent int, ts timestamp", 5)
    got = drain(spark, streams.session_episodes(s, "ts", ["agent"], "1 minute", "1 minute"), "append", "sessions")
    assert [(r["start"], r["n"]) for r in got.orderBy("start").collect()][:2] == [(at(0), 2), (at(400), 1)]
    late = stream(spark, tmp_path, "l", [(1, at(0)), (1, at(10000)), (1, at(20000)), (1, at(5)), (1, at(30000))], "agent int, ts timestamp", 5)
    out = drain(spark, streams.windowed_counts(late, "ts", ["agent"], "1 minute", late="1 minute"), "append", "late_rows")
    # the first window is closed when the watermark is at 19940 s, so the row of 5 s, which comes after that, is dropped
    assert sorted((r["start"], r["n"]) for r in out.collect())[:3] == [(at(0), 1), (at(9960), 1), (at(19980), 1)]
    soon = stream(spark, tmp_path, "m", [(1, at(0)), (1, at(100)), (1, at(5)), (1, at(30000)), (1, at(40000))], "agent int, ts timestamp", 5)
    kept = drain(spark, streams.windowed_counts(soon, "ts", ["agent"], "1 minute", late="10 minutes"), "append", "kept_rows")
    assert sorted((r["start"], r["n"]) for r in kept.collect())[0] == (at(0), 2)


def test_reviews_dedupe(spark, tmp_path):
    rows = [("k1", at(0), "a"), ("k1", at(1), "b"), ("k2", at(2), "c")]
    s = stream(spark, tmp_path, "r", rows, "key string, ts timestamp, v string")
    assert drain(spark, streams.first_reviews(s, "ts", ["key"]), "append", "reviews").count() == 2


def test_pair_join(spark, tmp_path):
    schema = "scene string, frame long, ts timestamp, x double, y double"
    a = stream(spark, tmp_path, "a", [("s", i, at(i), float(i), 0.0) for i in range(5)], schema)
    b = stream(spark, tmp_path, "b", [("s", i, at(i), float(i), 3.0) for i in range(3)], schema)
    got = drain(spark, streams.frame_pairs(a, b, "ts"), "append", "pair_join")
    assert sorted((r["frame"], r["distance"]) for r in got.collect()) == [(0, 3.0), (1, 3.0), (2, 3.0)]


def test_debounce_equals_batch_fold(spark, tmp_path):
    lanes = [1, 1, 2, 1, 1, 2, 2, 2, None, None, 3, None, None, None, 3, 3, 3, 3]
    rows = [(k, i, v, at(i)) for k in (5, 6) for i, v in enumerate(lanes if k == 5 else lanes[::-1])]
    df = spark.createDataFrame(rows, "agent long, frame long, lane long, ts timestamp")
    want = df.groupBy("agent").agg(fr.debounced(F.col("lane"), ["agent"], "frame", 3).alias("o")).select("agent", F.posexplode("o").alias("frame", "confirmed"))
    s = stream(spark, tmp_path, "d", rows, "agent long, frame long, lane long, ts timestamp")
    got = drain(spark, streams.debounced(s, "agent", "frame", "lane", 3, "ts"), "append", "debounced")
    key = lambda r: tuple(-9 if v is None else v for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert [r["confirmed"] for r in want.where("agent = 5").orderBy("frame").collect()][:8] == [1, 1, 1, 1, 1, 1, 1, 2]


def test_debounce_forgets_idle_keys(spark, tmp_path):
    """Forty keys, one after the other, an hour apart: with a timer of two hours a few are held at a time; a key that comes back begins anew."""
    rows = [(k, f, v, at(3600 * k + f)) for k in range(40) for f, v in enumerate([1, 1, 2])] + [(0, 3, 2, at(3600 * 60)), (99, 0, 1, at(3600 * 90))]
    s = stream(spark, tmp_path, "idle", rows, "agent long, frame long, lane long, ts timestamp", 20)
    df = streams.debounced(s, "agent", "frame", "lane", 3, "ts", "1 minute", "2 hours")
    q = df.writeStream.format("memory").queryName("idle_keys").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    held = [int(p["stateOperators"][0]["numRowsTotal"]) for p in q.recentProgress if p["stateOperators"]]
    assert held and max(held) < 20 and held[-1] <= 2
    got = {(r.agent, r.frame): r.confirmed for r in spark.table("idle_keys").collect()}
    assert len(got) == len(rows) and got[1, 2] == 1 and got[0, 3] == 2  # without the timer, 1 would stand yet
