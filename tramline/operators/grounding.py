"""Temporal grounding of told behaviours: each required episode gets a segment that tells it and covers it, none twice for one kind.

``segments``: (record columns, segment, start_frame, end_frame, description); ``episodes``: (record columns, episode, type, start_frame,
end_frame), both numbered in their order. A record's lists are short; records are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import wording

#: The least share of an episode that its segment covers (a fixed value).
LEAST = 0.5


def covered_share(start: Column, end: Column, of_start: Column, of_end: Column) -> Column:
    """The share of an inclusive episode that a segment shares; all of an episode without bounds, none of one of no length."""
    shared = F.greatest(F.lit(0), F.least(end, of_end) - F.greatest(start, of_start) + 1)
    length = of_end - of_start + 1
    return F.when(of_start.isNull() | of_end.isNull(), 1.0).when(length > 0, F.coalesce(shared / length, F.lit(0.0))).otherwise(0.0)


def candidates(segments: DataFrame, episodes: DataFrame, record: list[str]) -> DataFrame:
    """(record, type, episode, segment, share): an equi-join by record and told behaviour."""
    told = segments.select(*record, "segment", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"), F.explode(wording.told_behaviours(F.col("description"))).alias("type"))
    share = covered_share(F.col("_s"), F.col("_e"), F.col("start_frame"), F.col("end_frame"))
    return episodes.join(told, [*record, "type"]).select(*record, "type", "episode", "segment", share.alias("share")).where(F.col("share") >= LEAST)


def ground(segments: DataFrame, episodes: DataFrame, record: list[str]) -> DataFrame:
    """(record, episode, type, segment, share): in order of the episodes, each takes the segment that covers most of it, the first of
    equals, among those that no earlier episode of its type took; null where there is none.

    Types don't take from each other, so each list of a record's episodes of one type is a fold of its own.
    """
    none = F.array().cast("array<bigint>")
    offer = F.struct((-F.col("share")).alias("n"), F.col("segment").cast("bigint").alias("segment"))
    some = candidates(segments, episodes, record).groupBy(*record, "type", "episode").agg(F.sort_array(F.collect_list(offer)).alias("offers"))
    rows = some.groupBy(*record, "type").agg(F.sort_array(F.collect_list(F.struct("episode", "offers"))).alias("_rows"))
    begin = F.struct(none.alias("used"), F.array().cast("array<struct<episode:bigint,segment:bigint,share:double>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        free = F.get(F.filter(row["offers"], lambda o: ~F.array_contains(acc["used"], o["segment"])), 0)
        taken = F.struct(row["episode"].cast("bigint").alias("episode"), free["segment"].alias("segment"), (-free["n"]).alias("share"))
        return F.when(free.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], free["segment"]).alias("used"), F.array_append(acc["out"], taken).alias("out")))

    taken = rows.select(*record, "type", F.explode(F.aggregate("_rows", begin, step)["out"]).alias("_o")).select(*record, "type", "_o.*")
    return episodes.select(*record, "episode", "type").join(taken, [*record, "episode", "type"], "left").select(*record, "episode", "type", "segment", F.round("share", 3).alias("share"))


def coverage(grounded: DataFrame, record: list[str]) -> DataFrame:
    """(record, required, covered, missing, all_covered): ``missing`` names each uncovered episode as type[number], in order."""
    gone = F.sort_array(F.collect_list(F.when(F.col("segment").isNull(), F.struct("episode", F.format_string("%s[%d]", "type", "episode").alias("name")))))
    g = grounded.groupBy(*record).agg(F.count("*").alias("required"), F.count("segment").alias("covered"), F.transform(gone, lambda s: s["name"]).alias("missing"))
    return g.withColumn("all_covered", F.size("missing") == 0)


def ungrounded_ranges(ranges: DataFrame, episodes: DataFrame, record: list[str]) -> DataFrame:
    """(record, segment, missing): supporting ranges that tell a required behaviour, and the told ones that no episode of theirs bears
    out; an empty array where all are. Ranges that tell no required behaviour aren't checked."""
    kinds = episodes.select(*record, "type").distinct()
    told = ranges.select(*record, "segment", F.explode(wording.told_behaviours(F.col("description"))).alias("type")).join(kinds, [*record, "type"], "left_semi")
    borne = candidates(ranges, episodes, record).select(*record, "segment", "type", F.lit(True).alias("_ok")).distinct()
    j = told.join(borne, [*record, "segment", "type"], "left")
    return j.groupBy(*record, "segment").agg(F.sort_array(F.collect_set(F.when(F.col("_ok").isNull(), F.col("type")))).alias("missing"))
