"""Work that grows with the rows and not with the pieces they come in."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tramline.operators import kernels as k
from tramline.operators import tracks
from tramline.sources import files, records


def test_batches_are_appended_in_one_job(spark, tmp_path, monkeypatch):
    df = spark.range(-3, 120).select(F.col("id").alias("n"), (F.col("id") * 2).alias("v"))
    group, path = f"batches-{tmp_path.name}", str(tmp_path / "out")
    spark.sparkContext.setJobGroup(group, group)
    files.append_batches(df, "n", 0, 10, path)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 2  # the shuffle is a job of its own
    got = spark.read.parquet(path).groupBy("batch").agg(F.min("n"), F.max("n"), F.count("*")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(b, 10 * b, 10 * b + 9, 10) for b in range(12)]


def test_batched_append_does_not_append_batch_by_batch(spark, sf_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(files, "append_batch", lambda *a: calls.append(a))
    assert entry_module.queries()["src_12_batched_append"](spark, sf_dir).count() == 10
    assert not calls


def test_small_record_batches_share_a_partition(tmp_path):
    (tmp_path / "s").mkdir()
    t = pa.table({"agent_id": list(range(1000))})
    with pa.OSFile(str(tmp_path / "s" / "agent_data_dt0.10.feather"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=5)
    parts = records._SceneReader({"path": str(tmp_path), "partitionBytes": records.PARTITION_BYTES}, None).partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 200)]


@pytest.mark.parametrize("name", ["geo_16_conflict_points", "geo_17_inferred_intersection"])
def test_points_go_to_python_as_numbers(spark, sf_dir, name):
    plan = entry_module.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" in plan


def test_boxes_that_lie_alike_are_cut_once(monkeypatch):
    plain, calls = k.overlap_area, []
    monkeypatch.setattr(k, "overlap_area", lambda a, b: calls.append(1) or plain(a, b))
    n = 1000
    col = lambda v: pd.Series([v] * n)
    got = tracks.box_overlap.func(col(0.0), col(0.0), col(0.0), pd.Series([i % 2 * 1.0 for i in range(n)]), col(0.0), col(0.0), col(4.0), col(2.0))
    assert got.tolist() == [8.0, 6.0] * (n // 2)
    assert len(calls) == 2


def test_deduped_segments_run_in_spark(spark):
    rows = [(1, 1, 0, 9, "a"), (1, 2, 1, 9, "a"), (1, 3, 1, 9, "b"), (1, 4, 5, 20, "a"), (1, 5, 6, 20, "a"), (2, 6, 1, 9, "a"), (2, 7, 1, 9, None), (2, 8, 1, 9, None)]
    df = spark.createDataFrame(rows, "agent long, interval_id long, start_frame long, end_frame long, kind string")
    out = tracks.deduped_segments(df, "agent", "interval_id")
    kept = [[r[1] for i, r in enumerate(own) if i in k.dedupe_segments([x[2:] for x in own])] for own in (rows[:5], rows[5:])]
    assert sorted(r.interval_id for r in out.collect()) == sum(kept, []) == [1, 3, 4, 6, 7]
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString() and "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_stabilises_once(spark, sf_dir):
    plan = entry_module.queries()["fct_08_lane_chain"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
