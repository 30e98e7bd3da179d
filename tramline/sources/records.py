"""Record files and scene files as Spark data sources.

``record_files`` reads length-framed records with masked CRC-32C sums (the TFRecord framing), one task a file, and knows each record's
offset, so that a record found once is read again by a seek. ``scene_files`` reads Arrow (feather) files, one task a record batch.
Paths go through pyarrow's file systems: local paths, file:, and what else they know.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import pandas_udf

# The reflected Castagnoli polynomial, and the constant of masked sums.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8

#: Bytes that one lane of the checksum takes; lanes run side by side.
LANE = 1024

#: Below this many bytes, one by one is faster.
SHORT = 16 * LANE

RECORD_SCHEMA = "source_file string, record_index long, offset long, data binary, error string"


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=1)
def _plain_table() -> list[int]:
    return _table().tolist()


@lru_cache(maxsize=1)
def _skip() -> list[list[int]]:
    """What LANE zero bytes make of each of the four bytes of a state."""
    table = _table()
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(LANE):
        state = table[state & 255] ^ (state >> 8)
    return state.reshape(4, 256).tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C. Leading zeros don't move a zero state, so the data is padded in front and its lanes are summed side by side."""
    if len(data) < SHORT:
        state, plain = 0xFFFFFFFF, _plain_table()
        for b in data:
            state = plain[(state ^ b) & 255] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    lanes = -(-len(data) // LANE)
    raw = np.zeros(lanes * LANE, np.uint8)
    raw[-len(data) :] = np.frombuffer(data, np.uint8)
    at = len(raw) - len(data)
    raw[at : at + 4] ^= 255  # the initial state of ones
    raw, state, table = np.ascontiguousarray(raw.reshape(lanes, LANE).T), np.zeros(lanes, np.uint32), _table()
    for row in raw:
        state = table[(state ^ row) & 255] ^ (state >> 8)
    total, (a, b, c, d) = 0, _skip()
    for s in state.tolist():
        total = a[total & 255] ^ b[total >> 8 & 255] ^ c[total >> 16 & 255] ^ d[total >> 24] ^ s
    return total ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(crc32c(size))) + data + struct.pack("<I", masked(crc32c(data)))


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    return store, name


def list_files(path: str, pattern: str, recursive: bool = False) -> list[str]:
    """A file as it is, else the files of a folder whose names match, sorted. None is an error."""
    from pyarrow import fs

    store, name = _open(path)
    info = store.get_file_info(name)
    prefix = "file://" if isinstance(store, fs.LocalFileSystem) else path.split("://", 1)[0] + "://"
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=recursive)) if info.type == fs.FileType.Directory else []
    names = sorted(prefix + i.path for i in found if i.type == fs.FileType.File and (i is info or fnmatch.fnmatch(i.base_name, pattern)) and not i.base_name.startswith((".", "_")))
    if not names:
        raise FileNotFoundError(f"no file matches {path} with {pattern}")
    return names


class _Inflating:
    """Reads a compressed stream in pieces."""

    def __init__(self, raw, kind: str):
        self.raw, self.kind, self.held = raw, kind, b""
        self.z = zlib.decompressobj(31 if kind == "gzip" else 15)

    def read(self, n: int) -> bytes:
        out = [self.held]
        have = len(self.held)
        while have < n:
            piece = self.raw.read(1 << 16)
            if not piece:
                break
            while piece:
                got = self.z.decompress(piece)
                out.append(got)
                have += len(got)
                piece = self.z.unused_data
                if piece:  # another member follows
                    self.z = zlib.decompressobj(31 if self.kind == "gzip" else 15)
        whole = b"".join(out)
        self.held = whole[n:]
        return whole[:n]


def read_frames(stream, offset: int = 0) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, data, error) of each record. A record whose data fails its sum is told and the next one follows; after a damaged or cut
    header nothing can be found any more, so that ends the file."""
    while True:
        head = stream.read(12)
        if not head:
            return
        if len(head) < 12:
            yield offset, None, "header is cut off"
            return
        size, check = struct.unpack("<QI", head)
        if masked(crc32c(head[:8])) != check:
            yield offset, None, "length fails its checksum"
            return
        data, tail = stream.read(size), stream.read(4)
        if len(data) < size or len(tail) < 4:
            yield offset, None, "record is cut off"
            return
        good = masked(crc32c(data)) == struct.unpack("<I", tail)[0]
        yield offset, data if good else None, None if good else "data fails its checksum"
        offset += 16 + size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*tfrecord*")
        self.kind, self.strict = options.get("compression", "").lower(), options.get("mode", "permissive").lower() == "failfast"

    def partitions(self):
        return [_File(p) for p in list_files(self.path, self.pattern)]

    def read(self, partition):
        store, name = _open(partition.path)
        with store.open_input_stream(name, compression=None) as raw:
            stream = _Inflating(raw, self.kind) if self.kind in ("gzip", "zlib") else raw
            for i, (offset, data, error) in enumerate(read_frames(stream)):
                if error and self.strict:
                    raise ValueError(f"{partition.path}, record {i} at {offset}: {error}")
                yield partition.path, i, offset, data, error


class _Written(WriterCommitMessage):
    def __init__(self, part: str, name: str):
        self.part, self.name = part, name


class _RecordWriter(DataSourceWriter):
    """Each task writes a hidden file of its own; the commit names them. A task that runs twice leaves one of its files hidden only till then."""

    def __init__(self, schema, options):
        self.base, self.column = options["path"], schema.names.index("data")

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = _open(self.base)
        store.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        part, name = f"{root}/.part-{uuid.uuid4().hex}", f"{root}/part-{number:05d}.tfrecord"
        with store.open_output_stream(part, compression=None) as f:
            for row in iterator:
                f.write(frame(bytes(row[self.column])))
        return _Written(part, name)

    def commit(self, messages):
        store, _ = _open(self.base)
        for m in messages:
            store.move(m.part, m.name)

    def abort(self, messages):
        store, _ = _open(self.base)
        for m in messages:
            if m is not None:
                store.delete_file(m.part)


class RecordFiles(DataSource):
    """format("record_files"): options path, pattern, compression (gzip or zlib), mode (permissive or failfast)."""

    @classmethod
    def name(cls):
        return "record_files"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return _RecordReader(self.options)

    def writer(self, schema, overwrite):
        return _RecordWriter(schema, self.options)


def read_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(source_file, record_index, offset, data, error): the records of a file or of a folder's files, in tasks by file."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").options(**options).load(path)


def write_records(df: DataFrame, path: str) -> None:
    """The binary column ``data``, a file for each partition."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.select("data").write.format("record_files").mode("append").save(path)


def records_at(places: DataFrame) -> DataFrame:
    """``places`` (source_file, offset, ...) with ``data`` and ``error``: each record by a seek in its uncompressed file.

    The places are sorted by file and offset in each partition, so that a task opens a file once and goes through it forwards.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in places.schema.fields)}, data binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, None
        for b in batches:
            data, errors = [], []
            for path, offset in zip(b.column("source_file").to_pylist(), b.column("offset").to_pylist()):
                if path != held:
                    if opened:
                        opened.close()
                    store, name = _open(path)
                    held, opened = path, store.open_input_file(name)
                if offset >= opened.size():
                    found = offset, None, "offset is outside the file"
                else:
                    opened.seek(offset)
                    found = next(read_frames(opened, offset))
                data.append(found[1])
                errors.append(found[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*b.schema.names, "data", "error"])
        if opened:
            opened.close()

    return places.repartition("source_file").sortWithinPartitions("source_file", "offset").mapInArrow(run, schema)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return value, at


def _text_field(data: bytes | None, number: int) -> str | None:
    """The last length-delimited field of this number in a protocol-buffer message, as text; null if there is none or it is no message."""
    at, found = 0, None
    try:
        while data and at < len(data):
            key, at = _varint(data, at)
            kind = key & 7
            if kind == 0:
                _, at = _varint(data, at)
            elif kind == 2:
                size, at = _varint(data, at)
                if at + size > len(data):
                    return None
                if key >> 3 == number:
                    found = data[at : at + size].decode()
                at += size
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            else:
                return None
    except (IndexError, UnicodeDecodeError):
        return None
    return found


def text_field(data: Column, number: int) -> Column:
    """One text of a serialized message by its field number, without the message's schema."""

    @pandas_udf("string")
    def run(s):
        return s.map(lambda x: _text_field(None if x is None else bytes(x), number))

    return run(data)


#: The number of the id's field in a scenario message (a fixed value).
SCENARIO_ID = 5


def scenario_places(records: DataFrame, number: int = SCENARIO_ID) -> DataFrame:
    """(scenario_id, source_file, record_index, offset): the last place of each id; damaged records have none."""
    ids = records.where("error is null").select(text_field(F.col("data"), number).alias("scenario_id"), "source_file", "record_index", "offset").where("scenario_id is not null")
    return ids.groupBy("scenario_id").agg(F.max(F.struct("source_file", "record_index", "offset")).alias("p")).select("scenario_id", "p.*")


#: Bytes of record batches that a task of ``scenes`` reads, one after the other, or a batch that has more.
PARTITION_BYTES = 4 << 20


class _Batches(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _scene_of(path: str) -> str:
    return path.rsplit("/", 2)[-2]


class _SceneReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.pattern, self.schema = options["path"], options.get("pattern", "agent_data_dt*.feather"), schema
        self.bytes = int(options.get("partitionBytes", 0))

    def partitions(self):
        first = {}
        for p in list_files(self.path, self.pattern, recursive=True):
            first.setdefault(_scene_of(p), p)
        out = []
        for p in first.values():
            store, name = _open(p)
            with store.open_input_file(name) as f:
                n = pa.ipc.open_file(f).num_record_batches
                step = max(1, self.bytes * n // f.size())
            out += [_Batches(p, i, min(i + step, n)) for i in range(0, n, step)]
        return out

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        own = [n for n in self.schema.names if n not in ("scene", "source_file")]
        cast = lambda a, t: a.dictionary_decode().cast(t) if pa.types.is_dictionary(a.type) else a.cast(t)
        store, name = _open(partition.path)
        with store.open_input_file(name) as f:
            file = pa.ipc.open_file(f)
            lost = sorted(set(own) - set(file.schema.names))
            if lost:
                raise ValueError(f"{partition.path}: columns are missing: {lost}")
            for i in range(partition.first, partition.last):
                batch = file.get_batch(i)
                n = batch.num_rows
                arrays = {c: batch.column(c) for c in own} | {"scene": pa.array([_scene_of(partition.path)] * n, pa.string()), "source_file": pa.array([partition.path] * n, pa.string())}
                yield pa.RecordBatch.from_arrays([cast(arrays[c], kinds.field(c).type) for c in self.schema.names], names=self.schema.names)


class SceneFiles(DataSource):
    """format("scene_files"): a folder of scene folders; the first file by name of each is its scene. Options path, pattern,
    partitionBytes (what a task reads of consecutive batches; a batch by default). Needs a schema."""

    @classmethod
    def name(cls):
        return "scene_files"

    def schema(self):
        raise ValueError("scene files are read with a schema")

    def reader(self, schema):
        return _SceneReader(self.options, schema)


def scenes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(scene, source_file, the columns of ``schema``), sorted by (scene, agent_id, scene_ts). A file without one of the columns is an error
    that names them; columns beside these aren't read."""
    spark.dataSource.register(SceneFiles)
    df = spark.read.format("scene_files").schema(f"scene string, source_file string, {schema}").option("partitionBytes", PARTITION_BYTES).load(path)
    return df.orderBy("scene", "agent_id", "scene_ts")


def write_scenes(df: DataFrame, path: str, batch: int = 10_000) -> int:
    """A folder and a feather file for each value of ``scene``, written whole and then renamed; gives the number of scenes. A scene's rows
    are one group, as one scene is one file."""

    def run(t: pa.Table) -> pa.Table:
        name = str(t.column("scene")[0].as_py())
        store, root = _open(f"{path}/{name}")
        store.create_dir(root, recursive=True)
        part = f"{root}/.{uuid.uuid4().hex}"
        own = t.drop_columns(["scene"])
        with store.open_output_stream(part) as f, pa.ipc.new_file(f, own.schema) as w:
            w.write_table(own, max_chunksize=batch)
        store.move(part, f"{root}/agent_data_dt0.10.feather")
        return pa.table({"scene": [name]})

    return df.groupBy("scene").applyInArrow(run, "scene string").count()
