import gzip
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline.sources import records as rec


def test_checksums():
    """Published values of CRC-32C, and a sum bit by bit at lengths around a lane."""
    assert rec.crc32c(b"123456789") == 0xE3069283 and rec.crc32c(b"") == 0 and rec.crc32c(b"a") == 0xC1D04330
    assert rec.crc32c(bytes(32)) == 0x8A9136AA and rec.crc32c(b"\xff" * 32) == 0x62A8AB43 and rec.crc32c(bytes(range(32))) == 0x46DD794E

    def plainly(data):
        state = 0xFFFFFFFF
        for b in data:
            state ^= b
            for _ in range(8):
                state = state >> 1 ^ (rec.POLYNOMIAL if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    rng = random.Random(1)
    for n in (1, 3, 4, 5, 1023, rec.SHORT - 1, rec.SHORT, rec.SHORT + 1, rec.SHORT + 1024, 20_000):
        data = rng.randbytes(n)
        assert rec.crc32c(data) == plainly(data), n


def message(scenario_id, more=b""):
    """A message with numbers before and after the id (field 5)."""
    text = scenario_id.encode()
    return b"\x09" + struct.pack("<d", 1.5) + b"\x50\x96\x01" + b"\x2a" + bytes([len(text)]) + text + b"\x12" + bytes([len(more)]) + more


def shard(path, ids):
    path.write_bytes(b"".join(rec.frame(message(i, b"x" * (k % 90))) for k, i in enumerate(ids)))


def test_read_index_and_seek(spark, tmp_path):
    shard(tmp_path / "b.tfrecord-1", ["s3", "s1", "s4"])
    shard(tmp_path / "a.tfrecord-0", [f"s{i}" for i in range(3)])
    (tmp_path / "notes.txt").write_text("no records")
    r = rec.read_records(spark, str(tmp_path))
    assert r.rdd.getNumPartitions() == 2
    rows = sorted(r.select(F.element_at(F.split("source_file", "/"), -1), "record_index", rec.text_field(F.col("data"), 5), "error").collect())
    assert rows == [("a.tfrecord-0", 0, "s0", None), ("a.tfrecord-0", 1, "s1", None), ("a.tfrecord-0", 2, "s2", None), ("b.tfrecord-1", 0, "s3", None), ("b.tfrecord-1", 1, "s1", None), ("b.tfrecord-1", 2, "s4", None)]
    places = rec.scenario_places(r)
    at = {p.scenario_id: (p.source_file.rsplit("/", 1)[1], p.record_index) for p in places.collect()}
    assert at == {"s0": ("a.tfrecord-0", 0), "s1": ("b.tfrecord-1", 1), "s2": ("a.tfrecord-0", 2), "s3": ("b.tfrecord-1", 0), "s4": ("b.tfrecord-1", 2)}
    again = rec.records_at(places).select("scenario_id", rec.text_field(F.col("data"), 5).alias("read"), "error").collect()
    assert len(again) == 5 and all(x.scenario_id == x.read and x.error is None for x in again)
    lost = spark.createDataFrame([(str(tmp_path / "a.tfrecord-0"), 3), (str(tmp_path / "a.tfrecord-0"), 10**6)], "source_file string, offset long")
    assert sorted(x.error for x in rec.records_at(lost).collect()) == ["length fails its checksum", "offset is outside the file"]
    with pytest.raises(Exception, match="no file matches"):
        rec.read_records(spark, str(tmp_path), pattern="*.none").count()


def test_write_and_read_back(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, rng.randbytes(rng.choice([0, 1, 50, 3000, 200_000]))) for i in range(60)]
    df = spark.createDataFrame(data, "i long, data binary").repartition(3)
    rec.write_records(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{i:05d}.tfrecord" for i in range(3)]
    back = rec.read_records(spark, str(tmp_path / "out")).collect()
    assert sorted(bytes(r.data) for r in back) == sorted(d for _, d in data) and all(r.error is None for r in back)


def test_damage(spark, tmp_path):
    frames = [rec.frame(message(f"s{i}")) for i in range(4)]
    spoilt = bytearray(frames[1])
    spoilt[14] ^= 1
    header = bytearray(frames[2])
    header[0] ^= 1
    cases = {
        "data": (frames[0] + bytes(spoilt) + frames[2], [None, "data fails its checksum", None]), "head": (frames[0] + bytes(header) + frames[3], [None, "length fails its checksum"]),
        "cut": (frames[0] + frames[1][:-3], [None, "record is cut off"]), "short": (frames[0] + b"\x01\x02", [None, "header is cut off"]), "empty": (b"", []),
    }
    for name, (raw, want) in cases.items():
        (tmp_path / f"{name}.tfrecord").write_bytes(raw)
        rows = rec.read_records(spark, str(tmp_path / f"{name}.tfrecord")).orderBy("record_index").collect()
        assert [r.error for r in rows] == want and all((r.data is None) == (r.error is not None) for r in rows)
    with pytest.raises(Exception, match="data fails its checksum"):
        rec.read_records(spark, str(tmp_path / "data.tfrecord"), mode="failfast").count()


def test_compressed(spark, tmp_path):
    frames = [rec.frame(message(f"s{i}", b"y" * 80)) for i in range(3000)]
    (tmp_path / "z.tfrecord").write_bytes(gzip.compress(b"".join(frames[:1500])) + gzip.compress(b"".join(frames[1500:])))
    r = rec.read_records(spark, str(tmp_path), compression="gzip")
    assert r.where("error is null").count() == 3000 and r.select(rec.text_field(F.col("data"), 5).alias("s")).distinct().count() == 3000


def test_fields_of_odd_messages():
    assert rec._text_field(None, 5) is None and rec._text_field(b"", 5) is None and rec._text_field(b"\x2a\x09abc", 5) is None and rec._text_field(b"\xff", 5) is None
    assert rec._text_field(b"\x2a\x01a\x2a\x01b", 5) == "b" and rec._text_field(b"\x2a\x01\xff", 5) is None and rec._text_field(b"\x2b", 5) is None


def feather(path, rows, batch=2, **more):
    path.parent.mkdir(parents=True, exist_ok=True)
    t = pa.table({"agent_id": [r[0] for r in rows], "scene_ts": [r[1] for r in rows], "x": [r[2] for r in rows], **more})
    with pa.ipc.new_file(str(path), t.schema) as w:
        w.write_table(t, max_chunksize=batch)


def test_scenes(spark, tmp_path):
    feather(tmp_path / "scene_1" / "agent_data_dt0.10.feather", [("b", 1, 1.0), ("a", 2, 2.0), ("a", 1, 3.0), ("b", 0, None), ("c", 0, 5.0)], extra=[1, 2, 3, 4, 5])
    feather(tmp_path / "scene_1" / "agent_data_dt0.50.feather", [("z", 1, 1.0)])
    feather(tmp_path / "scene_0" / "agent_data_dt0.10.feather", [("q", 1, 9.0)])
    schema = "agent_id string, scene_ts long, x double"
    df = rec.scenes(spark, str(tmp_path), schema)
    assert [(r.scene, r.agent_id, r.scene_ts, r.x) for r in df.collect()] == [("scene_0", "q", 1, 9.0), ("scene_1", "a", 1, 3.0), ("scene_1", "a", 2, 2.0), ("scene_1", "b", 0, None), ("scene_1", "b", 1, 1.0), ("scene_1", "c", 0, 5.0)]
    raw = spark.read.format("scene_files").schema(f"scene string, source_file string, {schema}").load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == 4  # three batches and one
    with pytest.raises(Exception, match="columns are missing.*heading"):
        rec.scenes(spark, str(tmp_path), schema + ", heading double").count()
    with pytest.raises(Exception, match="no file matches"):
        rec.scenes(spark, str(tmp_path / "scene_0"), schema).where("1=1").count() if not list((tmp_path / "scene_0").iterdir()) else rec.scenes(spark, str(tmp_path / "none"), schema).count()
