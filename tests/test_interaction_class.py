import pytest
from pyspark.sql import functions as F

from tramline.operators import interaction_class as ic

STATE = "struct<x:double,y:double,heading:double,speed:double,`group`:long>"
SCHEMA = f"i int, b {STATE}, rb {STATE}, a {STATE}, ra {STATE}, changers int, merges boolean, event boolean, confidence double, direction string, shared int, frames int, meaningful boolean"


def state(x, speed=10.0, group=1, heading=0.0, y=0.0):
    return x, y, heading, speed, group


#: A change: (subject before, reference before, subject after, reference after); the pair's other evidence; the class
ENTERS = (state(0.0, group=1), state(5.0, group=2), state(20.0, group=2), state(12.0, group=2))
CASES = [
    (ENTERS, dict(changers=2), ("unknown", None, None, "classified")),
    (ENTERS, dict(changers=0, merges=True), ("merge", None, 0.75, "labeled")),
    (ENTERS, dict(changers=1, merges=True), ("cut_in", None, 0.54, "labeled")),
    ((*ENTERS[:3], state(12.0, 8.5, 2)), dict(changers=1), ("cut_in", None, 0.72, "labeled")),
    ((state(0.0), state(9.5, group=2), state(20.0, group=2), state(12.0, 8.5, 2)), dict(changers=1), ("cut_in", None, 0.9, "labeled")),
    (ENTERS, dict(changers=1, event=False), ("unknown", None, None, "insufficient_evidence")),
    ((*ENTERS[:3], state(12.0, group=3)), dict(changers=1), ("lane_change", "left", 0.9, "labeled")),
    ((state(0.0), state(5.0), state(100.0, group=2), state(12.0, group=2)), dict(changers=1), ("lane_change", "left", 0.9, "labeled")),
    ((None, None, None, None), dict(changers=1), ("lane_change", "left", 0.9, "labeled")),
    (ENTERS, dict(changers=0, shared=6, frames=10), ("same_lane_interaction", None, 0.6, "labeled")),
    (ENTERS, dict(changers=0, shared=20, frames=20), ("same_lane_interaction", None, 1.0, "labeled")),
    (ENTERS, dict(changers=0, shared=6, frames=10, meaningful=False), ("unknown", None, None, "classified")),
    (ENTERS, dict(changers=0, shared=4, frames=10), ("unknown", None, None, "classified")),
    (ENTERS, dict(changers=0, shared=2, frames=2), ("unknown", None, None, "insufficient_evidence")),
    (ENTERS, dict(changers=0, shared=0, frames=0, meaningful=None, merges=None), ("unknown", None, None, "insufficient_evidence")),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for i, (change, more, _) in enumerate(CASES):
        v = dict(merges=False, event=True, confidence=0.9, direction="left", shared=0, frames=0, meaningful=True) | more
        rows.append((i, *change, v["changers"], v["merges"], v["event"], v["confidence"], v["direction"], v["shared"], v["frames"], v["meaningful"]))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("e", ic.change_evidence(*(F.col(c) for c in ("b", "rb", "a", "ra"))))
    k = ic.interaction_class(*(F.col(c) for c in ("changers", "merges", "event", "e", "confidence", "direction", "shared", "frames", "meaningful")))
    return {r.i: r for r in df.select("i", "e", k.alias("k")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_classes(found, i):
    assert tuple(found[i].k) == CASES[i][2]


def test_evidence_of_a_change(found):
    e = found[0].e
    assert (e.entered, e.relation_before, e.relation_after, e.gap_before, e.gap_after, e.small_gap, e.gap_shrank, e.slowed) == (True, "behind", "ahead", 5.0, 8.0, True, False, False)
    assert tuple(found[8].e) == (False, None, None, None, None, False, False, False)
