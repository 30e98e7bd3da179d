import pytest
from pyspark.sql import types as T

from tramline.sources import files


def test_resolving_and_scans(spark, tmp_path):
    for name in ("b.tfrecord", "a.tfrecord", "c.txt"):
        (tmp_path / name).write_text(name)
    found = [r["path"].rsplit("/", 1)[1] for r in files.resolve(spark, str(tmp_path), "*tfrecord*").collect()]
    assert found == ["a.tfrecord", "b.tfrecord"]
    with pytest.raises(FileNotFoundError):
        files.resolve(spark, str(tmp_path), "*.none")
    s = spark.createDataFrame([("s1", "f1", 0), ("s2", "f1", 1), ("s1", "f2", 0)], "scenario_id string, source_file string, record_index int")
    assert files.by_id(s, "s2").count() == 1 and files.by_ordinal(s, "f2", 0).first()["scenario_id"] == "s1"
    with pytest.raises(KeyError):
        files.by_id(s, "s9")
    assert {tuple(r) for r in files.scenario_index(s).collect()} == {("s1", "f2", 0), ("s2", "f1", 1)}
    assert [r["scenario_id"] for r in files.first_scenarios(s, 2).collect()] == ["s1", "s2"] and files.first_scenarios(s, 0).count() == 3


def test_typed_csv_with_rejects(spark, tmp_path):
    (tmp_path / "i.csv").write_text("interaction_id,track_id,start,end,intensity\n1,1;2,3,9,0.5\nx,1;2,3,9,0.5\n2,,4,,\n")
    rows, bad = files.typed_csv(spark, str(tmp_path / "i.csv"))
    assert [tuple(r) for r in rows.orderBy("interaction_id").collect()] == [(1, "1;2", 3, 9, 0.5), (2, None, 4, None, None)]
    assert [r["interaction_id"] for r in bad.collect()] == ["x"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('﻿{"a": 1}\n\n[1]\n{"a": 2}\nbroken{\n')
    rows, bad = files.json_lines(spark, str(tmp_path / "r.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert [(r["line"], r["a"]) for r in rows.orderBy("line").collect()] == [(1, 1), (4, 2)]
    assert sorted(r["line"] for r in bad.collect()) == [3, 5]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1.5, [1, 2]), ("s2", None, None)], "scene string, v double, ids array<int>")
    files.write_json_lines(df, str(tmp_path / "j"), ["scene"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(Exception, match="not finite"):
        files.write_json_lines(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "k"))
    files.write_summary_csv(df, str(tmp_path / "c"))
    got = {r["scene"]: r["ids"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    assert got == {"s1": "[1,2]", "s2": None}
    files.append_batch(df.limit(0), str(tmp_path / "p"))
    files.append_batch(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_resuming_and_slices(spark):
    work = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "scene string, expected int")
    done = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "scene string")
    assert {r["scene"] for r in files.unfinished(work, done, "scene", "expected").collect()} == {"b", "c"}
    assert [r["id"] for r in files.batch_of(spark.range(20), "id", 3, 5, 1).collect()] == [8, 9, 10, 11, 12]
    rows = spark.createDataFrame([(1, "x", "y"), (2, "z", "w")], "id int, c1 string, c2 string")
    roots = spark.createDataFrame([("y",), ("x",)], "root string")
    assert {tuple(r) for r in files.cache_root(rows, roots, "id", ["c1", "c2"]).collect()} == {(1, "x"), (2, None)}


SCENARIO = "scenario_id string, map_features array<struct<id:long,lane:struct<polyline:array<struct<x:double,y:double>>>>>, tracks array<struct<id:long,object_type:int,states:array<struct<valid:boolean,center_x:double,center_y:double>>>>"


def test_scenarios(spark):
    ok = spark.createDataFrame([("s", [(1, ([(0.0, 0.0), (1.0, 0.0)],)), (2, None)], [(396, 1, [(True, 0.0, 0.0), (True, 1.0, 4.0)]), (421, 1, [(True, 4.0, 4.0)])])], SCENARIO)
    assert [tuple(r)[:4] for r in files.states_from_scenarios(ok).orderBy("agent", "frame").collect()] == [("s", 396, 1, 0), ("s", 396, 1, 1), ("s", 421, 1, 0)]
    assert [r["lane_id"] for r in files.lane_map(ok).collect()] == [1]
    twice = spark.createDataFrame([("s", [(2, None)], [(7, 1, [(True, 0.0, 0.0)]), (7, 1, [(True, 0.0, 0.0)])])], SCENARIO)
    with pytest.raises(Exception, match="repeats"):
        files.states_from_scenarios(twice).collect()
    with pytest.raises(Exception, match="no lanes"):
        files.lane_map(twice).collect()
