"""Sources and sinks: path resolving, scenario scans, line-numbered JSON, typed CSV with rejects, resumable writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTION = T.StructType([T.StructField(n, k) for n, k in (("interaction_id", T.LongType()), ("track_id", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("intensity", T.DoubleType()))])


def resolve(spark: SparkSession, spec: str, pattern: str = "*") -> DataFrame:
    """(path, size): the files of a file, folder or glob, sorted by path; none is an error. Listing only, nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(spec).select("path", F.col("length").alias("size"))
    if files.isEmpty():
        raise FileNotFoundError(f"no file matches {spec} with {pattern}")
    return files.orderBy("path")


def by_id(scenarios: DataFrame, wanted: str | int, key: str = "scenario_id") -> DataFrame:
    """The scenario with this id; the filter reaches the scan. An id that isn't there is an error."""
    found = scenarios.where(F.col(key) == F.lit(wanted))
    if found.isEmpty():
        raise KeyError(wanted)
    return found


def by_ordinal(scenarios: DataFrame, file: str, index: int) -> DataFrame:
    return scenarios.where((F.col("source_file") == file) & (F.col("record_index") == index))


def scenario_index(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, source_file, record_index): the last place of each id."""
    place = F.struct("source_file", "record_index")
    return scenarios.groupBy("scenario_id").agg(F.max(place).alias("p")).select("scenario_id", "p.*")


def first_scenarios(scenarios: DataFrame, limit: int) -> DataFrame:
    """In file order; 0 is all."""
    ordered = scenarios.orderBy("source_file", "record_index")
    return ordered.limit(limit) if limit else ordered


def typed_csv(spark: SparkSession, path: str, schema: T.StructType = INTERACTION, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): every column read as text, then cast; a row with a text that doesn't cast goes to the rejects."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.option("header", True).option("sep", sep).schema(text).csv(path)
    cast = {f"_{f.name}": F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    both = raw.withColumns(cast)
    bad = F.lit(False)
    for f in schema.fields:
        bad = bad | (F.col(f"`{f.name}`").isNotNull() & F.col(f"_{f.name}").isNull())
    rows = both.where(~bad).select(*(F.col(f"_{f.name}").alias(f.name) for f in schema.fields))
    return rows, both.where(bad).select(*(F.col(f"`{f.name}`") for f in schema.fields))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with source_file and line, rejects): one object a line; blank lines are skipped, a byte order mark is dropped.

    The line's number comes from a window over the file's own lines, in the order of their offsets.
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("value"), F.monotonically_increasing_id().alias("_o"))
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy("source_file").orderBy("_o"))).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("r._bad").isNull() & F.trim("value").startswith("{")
    return parsed.where(ok).select("source_file", "line", *(F.col(f"r.`{f.name}`") for f in schema.fields)), parsed.where(~ok).select("source_file", "line", "value")


def write_json_lines(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, by partition columns if any. NaN and infinite numbers are an error, found before anything is written."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = F.lit(False)
    for c in doubles:
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    checked = df
    if doubles:
        first = doubles[0]
        checked = df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("number is not finite"))).otherwise(F.col(first)))
    w = checked.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def json_cells(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, booleans lower-case, for CSV."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields))


def write_summary_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_cells(df).write.mode(mode).option("header", True).option("quoteAll", False).csv(path)


def append_batch(df: DataFrame, path: str) -> None:
    """A batch of an extraction; an empty one still leaves a readable table."""
    df.write.mode("append").parquet(path)


def append_batches(df: DataFrame, ordinal: str, start: int, size: int, path: str) -> None:
    """All batches of ``size`` contiguous ordinals from ``start``, each a folder ``batch=n``, in one job over ``df``.

    Rows go to their batch by one shuffle and a task holds one file at a time; so the work grows with the rows and not with
    rows times batches. Ordinals before ``start`` or unknown are in no batch.
    """
    number = F.floor((F.col(ordinal) - start) / size)
    b = df.where(F.col(ordinal) >= start).withColumn("batch", number).repartition("batch").sortWithinPartitions("batch", ordinal)
    b.write.mode("append").partitionBy("batch").parquet(path)


def unfinished(work: DataFrame, done: DataFrame, key: str, expected: str) -> DataFrame:
    """Work items whose output doesn't hold as many rows as expected."""
    complete = done.groupBy(key).agg(F.count("*").alias("_n"))
    return work.join(complete, key, "left").where(F.coalesce("_n", F.lit(0)) != F.col(expected)).drop("_n")


def batch_of(df: DataFrame, ordinal: str, start: int, size: int, number: int) -> DataFrame:
    """Batch ``number`` of contiguous ordinals from ``start``."""
    first = start + size * number
    return df.where(F.col(ordinal).between(first, first + size - 1))


def cache_root(row: DataFrame, roots: DataFrame, key: str, candidates: list[str]) -> DataFrame:
    """Each row with the first of its candidate roots that exists; null if none does."""
    out, found = row, []
    for i, c in enumerate(candidates):
        r = roots.select(F.col("root").alias(f"_r{i}")).distinct()
        out = out.join(r, F.col(c) == F.col(f"_r{i}"), "left")
        found.append(F.col(f"_r{i}"))
    return out.select(key, F.coalesce(*found).alias("root"))


def states_from_scenarios(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, agent, frame, ...): nested tracks as rows, one a state; an id that repeats in a scenario is an error."""
    t = scenarios.select("scenario_id", F.explode("tracks").alias("t"))
    s = t.select("scenario_id", F.col("t.id").alias("agent"), F.col("t.object_type").alias("object_type"), F.posexplode("t.states").alias("frame", "s"))
    twice = F.count("*").over(Window.partitionBy("scenario_id", "agent", "frame")) > 1
    s = s.withColumn("agent", F.when(twice, F.raise_error(F.lit("track id repeats"))).otherwise(F.col("agent")))
    return s.select("scenario_id", "agent", "object_type", F.col("frame").cast("long").alias("frame"), "s.*")


def lane_map(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, lane_id, polyline): the lanes of each map; a scenario without any is an error."""
    empty = F.size(F.filter("map_features", lambda f: f["lane"].isNotNull())) == 0
    checked = F.when(empty, F.raise_error(F.lit("map has no lanes"))).otherwise(F.col("map_features"))
    return scenarios.select("scenario_id", F.explode(checked).alias("f")).where("f.lane is not null").select("scenario_id", F.col("f.id").alias("lane_id"), F.col("f.lane.polyline").alias("polyline"))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
