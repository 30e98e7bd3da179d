"""Lane topology: mutual-best continuations, components, reachability, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import shared_path


def mutual_best(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Edges (src, dst, cost) that are the cheapest both out of ``src`` and into ``dst``; ties go to the smaller other end."""
    out = Window.partitionBy("src").orderBy(cost, "dst")
    into = Window.partitionBy("dst").orderBy(cost, "src")
    ranked = edges.withColumns({"_o": F.row_number().over(out), "_i": F.row_number().over(into)})
    return ranked.where("_o = 1 and _i = 1").drop("_o", "_i")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, group): the smallest node reachable over undirected edges.

    Labels are taken from neighbours and then from the label's own label, so that paths shrink by half. Each round is
    checkpointed, so the lineage stays short and survives lost executors.
    """
    spark = nodes.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "graph"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other").distinct()
    labels = nodes.select("node", F.col("node").alias("group")).checkpoint()
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("group").alias("g")), "other").groupBy("node").agg(F.min("g").alias("g"))
        stepped = labels.join(near, "node", "left").select("node", F.least("group", F.coalesce("g", "group")).alias("group"), F.col("group").alias("old"))
        jump = stepped.select(F.col("node").alias("_n"), F.col("group").alias("_g"))
        new = stepped.join(jump, stepped["group"] == jump["_n"], "left").select("node", F.least("group", F.coalesce("_g", "group")).alias("group"), "old").checkpoint()
        changed = new.where("group <> old").limit(1).count()
        labels = new.select("node", "group")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def reachable(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops): every node within ``hops`` directed steps, with the least number; a chain of equi-joins."""
    first = edges.select("src", "dst").distinct()
    step = first.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    front, found = first.withColumn("hops", F.lit(1)), first.withColumn("hops", F.lit(1))
    for k in range(2, hops + 1):
        front = front.join(step, "dst").select("src", F.col("next").alias("dst"), F.lit(k).alias("hops")).distinct()
        found = found.unionByName(front)
    return found.groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def group_neighbours(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, others): the groups next to each, in either direction, sorted."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("a", "b")
    ga, gb = groups.select(F.col("node").alias("a"), F.col("group").alias("ga")), groups.select(F.col("node").alias("b"), F.col("group").alias("gb"))
    return both.join(ga, "a").join(gb, "b").where("ga <> gb").groupBy(F.col("ga").alias("group")).agg(F.array_sort(F.collect_set("gb")).alias("others"))
