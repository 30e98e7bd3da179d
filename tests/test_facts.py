"""Behaviour rules on facts, case by case."""

import itertools

import pytest
from pyspark.sql import functions as F

from tramline.functions import text as tx
from tramline.operators import facts as ft


def test_rule_class_over_all_facts(spark):
    values = (True, False, None)
    rows = list(itertools.product(values, repeat=4))
    kind, modifiers, status = ft.rule_class(*(F.col(c) for c in "abcd"))
    got = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean").select("a", "b", "c", "d", kind.alias("k"), modifiers.alias("m"), status.alias("s")).collect()
    assert len(got) == 81
    for changed, entered, ahead, slowed, k, m, s in got:
        if entered:
            want = "overtake" if ahead else "lane_change_with_yielding" if slowed else "merge"
        else:
            want = "lane_change" if changed else "unknown"
        assert k == want and s == ("insufficient_evidence" if want == "unknown" else "classified")
        assert m == (["with_lane_change", *(["with_yielding"] if slowed else [])] if want == "overtake" else [])


def test_pair_wording(spark):
    yes = ["It follows closely", "it FOLLOWED", "yields", "yielded", "overtook it", "cuts  in", "cut in front", "merges with", "merge with", "interacts", "gives way", "give way", "near vehicle 12", "Vehicle  3"]
    no = ["passes on", "leads", "crosses", "merges", "cuts", "following", "vehicle 7 stops", "vehicle 07", "vehicles 3", ""]
    df = spark.createDataFrame([(t, 7) for t in yes + no], "t string, own int").select("t", tx.names_others(F.col("t"), F.col("own")).alias("pair"))
    got = {r["t"]: r["pair"] for r in df.collect()}
    assert [t for t in yes if not got[t]] == [] and [t for t in no if got[t]] == []


def test_times_to_a_conflict_point_of_standing_agents(spark):
    rows = [(10.0, 5.0, 9.0, 3.0, 1.0), (10.0, 0.0, 9.0, 3.0, 100.0), (10.0, 5.0, 9.0, 0.001, 100.0), (10.0, 5.0, 9.0, 0.0011, None), (10.0, None, 9.0, 3.0, None), (10.0, None, 9.0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "d1 double, v1 double, d2 double, v2 double, want double")
    got = [r[0] for r in df.select(ft.delta_time(*(F.col(c) for c in ("d1", "v1", "d2", "v2")))).collect()]
    assert got[:3] == [1.0, 100.0, 100.0] and got[3] > 8000 and got[4:] == [None, 100.0]
