import random
import re

import pytest
from pyspark.sql import functions as F

from tramline.functions import wording
from tramline.operators import grounding

TEXTS = {
    "The car makes a U-turn.": ["u_turn"], "It turns around": ["u_turn"], "turned to the left": ["left_turn"], "A LEFT TURN": ["left_turn"], "turning  right": ["right_turn"], "Changes lanes to the left": ["lane_change_left"],
    "a right lane change": ["lane_change_right"], "change lane right": ["lane_change_right"], "speeds up": ["acceleration"], "gains speed": ["acceleration"], "accelerated": ["acceleration"], "slowing": ["deceleration"],
    "it decelerates, then reduces speed": ["deceleration"], "continues straight": ["forward_motion", "steady_motion"], "keeps a constant pace": ["forward_motion", "steady_motion"], "slowly": [], "leftturn": [], "stays left": [], None: [], "": [],
}


def test_told_behaviours(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", wording.told_behaviours(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == TEXTS
    r = spark.createDataFrame([("turns left and slows", ["left_turn", "u_turn", "left_turn", "other"])], "t string, r array<string>").select(wording.covered(F.col("t"), F.col("r")), wording.missing(F.col("t"), F.col("r"))).first()
    assert list(r) == [["left_turn", "left_turn"], ["u_turn", "other"]]


@pytest.mark.parametrize(
    "text, turn, required, want",
    [
        ("It drifts and is Shifted", None, [], ["shift_or_drift"]), ("a driftwood", None, [], []), ("turns right", "left", [], ["turn_conflicts"]), ("turns right", "right", [], []), ("turns right", None, [], []),
        ("left turn, then changes lanes left", "right", None, ["turn_conflicts", "unrequired_left_lane_change"]), ("changes lanes left", None, ["lane_change_left"], []), ("changes lanes right", None, ["lane_change_left"], ["unrequired_right_lane_change"]), (None, "left", [], []),
    ],
)
def test_violations(spark, text, turn, required, want):
    df = spark.createDataFrame([(text, turn, required)], "t string, d string, r array<string>")
    assert df.select(wording.violations(F.col("t"), F.col("d"), F.col("r"))).first()[0] == want


def test_expected_turn(spark):
    rows = [("left_turn", "decreasing_cw", "left"), ("right_turn", None, "right"), ("none", "increasing_ccw", "left"), (None, "decreasing_cw", "right"), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, h string, want string").select(wording.expected_turn(F.col("s"), F.col("h")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


PHRASE = {"left_turn": "turns left", "acceleration": "speeds up", "deceleration": "slows"}


def plainly(segments, episodes):
    """Greedy, one record at a time."""
    used, out = set(), []
    for record, n, kind, s, e in sorted(episodes):
        best = None
        for r, i, a, b, text in sorted(segments):
            if r != record or (r, i, kind) in used or not (kind in PHRASE and re.search(PHRASE[kind], text)):
                continue
            share = 1.0 if s is None or e is None else max(0, min(b, e) - max(a, s) + 1) / (e - s + 1) if e >= s else 0.0
            if share >= 0.5 and (best is None or share > best[0]):
                best = share, i
        if best:
            used.add((record, best[1], kind))
        out.append((record, n, kind, best and best[1], best and round(best[0], 3)))
    return out


def test_equals_plain_greedy_on_random_intervals(spark):
    rng = random.Random(4)
    segments, episodes = [], []
    for record in range(60):
        for i in range(rng.randrange(8)):
            a = rng.randrange(30)
            segments.append((record, i, a, a + rng.randrange(20), " and ".join(rng.sample(list(PHRASE.values()), rng.randrange(4)))))
        for n in range(rng.randrange(7)):
            s = rng.randrange(30)
            bounds = (None, None) if rng.random() < 0.1 else (s, s + rng.randrange(-1, 12))
            episodes.append((record, n, rng.choice([*PHRASE, "unheard"]), *bounds))
    sdf = spark.createDataFrame(segments, "record long, segment long, start_frame long, end_frame long, description string")
    edf = spark.createDataFrame(episodes, "record long, episode long, type string, start_frame long, end_frame long")
    got = grounding.ground(sdf, edf, ["record"])
    rows = sorted(map(tuple, got.collect()))
    want = plainly(segments, episodes)
    assert rows == want and sum(r[3] is not None for r in want) > 40
    cover = {r.record: r for r in grounding.coverage(got, ["record"]).collect()}
    for record in {e[0] for e in episodes}:
        lost = [f"{k}[{n}]" for r, n, k, seg, _ in want if r == record and seg is None]
        assert cover[record].missing == lost and cover[record].all_covered == (not lost)


def test_supporting_ranges(spark):
    ranges = spark.createDataFrame([(1, 0, 0, 9, "turns left"), (1, 1, 50, 60, "turns left and slows"), (1, 2, 0, 9, "speeds up"), (1, 3, 0, 1, "stands")], "record long, segment long, start_frame long, end_frame long, description string")
    episodes = spark.createDataFrame([(1, 0, "left_turn", 5, 12), (1, 1, "deceleration", 55, 58)], "record long, episode long, type string, start_frame long, end_frame long")
    assert {r.segment: r.missing for r in grounding.ungrounded_ranges(ranges, episodes, ["record"]).collect()} == {0: [], 1: ["left_turn"]}
