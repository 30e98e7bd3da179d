import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.operators import kernels as k
from tramline.operators import tracks


def test_short_runs_are_absorbed():
    assert k.absorb_short_runs([1, 1, 1, 2, 1, 1, 1], 3) == [1] * 7
    assert k.absorb_short_runs([1, 1, 1, 2, 3, 3, 3], 3) == [1, 1, 1, 2, 3, 3, 3]
    assert k.absorb_short_runs([None, 2, 3, 3, 3], 3) == [None, 3, 3, 3, 3]
    assert k.absorb_short_runs([1, 1, 1, 2, None], 3) == [1, 1, 1, 1, None]
    assert k.absorb_short_runs([], 3) == []


def test_flickers():
    lanes, conf = [4, 4, 4, 7, 4, 4, 4], [0.9, 0.9, 0.9, 0.3, 0.9, 0.9, 0.9]
    assert k.drop_flickers(lanes, conf) == ([4] * 7, [(3, 3)])
    assert k.drop_flickers(lanes, [0.9] * 7)[0] == lanes
    assert k.drop_flickers([4, 4, 7, 8, 8], [0.9, 0.9, 0.1, 0.9, 0.9])[0] == [4, 4, 7, 8, 8]
    assert k.drop_flickers([4, None, 7, None, 4], [0.9, None, 0.1, None, 0.9])[1] == []


def test_excursions_need_a_candidate():
    assert k.hold_excursions(["A", "B", "A"], [["A"], ["A", "B"], ["A"]]) == ["A", "A", "A"]
    assert k.hold_excursions(["A", "B", "A"], [["A"], ["B"], ["A"]]) == ["A", "B", "A"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=3, max_size=3), st.integers(7, 30), st.sampled_from([5, 7]))
def test_smoothing_keeps_parabolas(c, n, window):
    t = np.arange(n)
    x = c[0] + c[1] * t + c[2] * t * t
    assert np.allclose(k.savgol(x, window), x, atol=1e-6 * (1 + np.abs(x).max()))


def test_smoothing_short_series_stays():
    assert k.savgol([1, 5, 2], 5).tolist() == [1, 5, 2]


def brute_path(e, cost):
    from itertools import product

    return min(product(*(range(len(x)) for x in e)), key=lambda p: sum(e[t][i] for t, i in enumerate(p)) + sum(cost[p[t - 1]][p[t]] for t in range(1, len(p))))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        e = [rng.random(3) for _ in range(5)]
        cost = rng.random((3, 3))
        got, want = k.viterbi(e, lambda t, c=cost: c), brute_path(e, cost)
        total = lambda p: sum(e[t][i] for t, i in enumerate(p)) + sum(cost[p[t - 1]][p[t]] for t in range(1, 5))  # noqa: E731, B023
        assert math.isclose(total(got), total(want))


def test_lane_matching_fixture():
    lanes = {"A": np.array([[0, 0], [10, 0.0]]), "B": np.array([[10, 0], [20, 0.0]]), "C": np.array([[0, 2], [20, 2.0]])}
    x = [f + 1.0 for f in range(12)]
    y = [2.0 if f == 5 else 0.0 for f in range(12)]
    x[8] = 100.0
    got = k.match_lanes(x, y, [0.0] * 12, lanes, {("A", "B")}, {("A", "C")})
    assert got[:4] == ["A"] * 4 and got[5] == "A" and got[8] is None and got[11] == "B"


@settings(max_examples=80, deadline=None)
@given(st.floats(-3, 3), st.floats(-3, 3), st.floats(-4, 4), st.floats(-4, 4), st.floats(-4, 4))
def test_overlap_is_symmetric_and_turns_along(x, y, h, g, r):
    a, b = k.box(0, 0, h, 4.5, 1.8), k.box(x, y, g, 4.5, 1.8)
    v = k.overlap_area(a, b)
    assert 0 <= v <= 4.5 * 1.8 + 1e-6 and math.isclose(v, k.overlap_area(b, a), abs_tol=1e-6)
    turn = np.array([[math.cos(r), math.sin(r)], [-math.sin(r), math.cos(r)]])
    assert math.isclose(v, k.overlap_area(a @ turn, b @ turn), abs_tol=1e-6)


def test_overlap_of_known_boxes():
    assert math.isclose(k.overlap_area(k.box(0, 0, 0, 4, 2), k.box(1, 0, 0, 4, 2)), 6.0)
    assert k.overlap_area(k.box(0, 0, 0, 4, 2), k.box(9, 0, 0, 4, 2)) == 0


def test_crossings_and_conflict():
    a, b = np.array([[0, 0], [10, 0.0]]), np.array([[4, -3], [4, 3.0]])
    assert k.crossings(a, b).tolist() == [[4, 0]]
    at, way_a, way_b = k.conflict_point(a, b)
    assert (way_a, way_b) == (4, 3)
    assert k.conflict_point(a, b + 20) is None
    assert k.in_corridor(a, np.array([[5, 1], [5, 2], [11, 0.0]]), 1.5, 1.0).tolist() == [True, False, False]


def test_separation_effort():
    assert k.separating_acceleration((10, 40), (10, 10)) == 0
    tight = k.separating_acceleration((20, 22), (10, 10))
    assert 0 < tight < 10
    assert math.isclose(tight, k.separating_acceleration((22, 20), (10, 10)), rel_tol=1e-2)
    assert k.separating_acceleration((20, 30), (10, 10)) < tight


def test_episode_merging():
    v = np.concatenate([np.linspace(0, 5, 6), [5, 5], np.linspace(5.5, 9, 6)])
    assert k.merge_episodes([(0, 5, 1), (8, 13, 1)], v) == [(0, 13, 1)]
    flat = np.concatenate([np.linspace(0, 5, 6), [5] * 5, np.linspace(5.5, 9, 6)])
    assert k.merge_episodes([(0, 5, 1), (11, 16, 1)], flat) == [(0, 5, 1), (11, 16, 1)]
    assert k.merge_episodes([(0, 2, 1)], v) == []


def test_segments_chains_and_keys():
    assert k.dedupe_segments([(0, 10, "t"), (1, 10, "t"), (1, 10, "u"), (30, 40, "t")]) == [0, 2, 3]
    assert k.first_lane_chain("a", {"a": ["c", "b"], "b": ["d"], "d": ["a"]}) == ["a", "b", "d"]
    assert k.lane_path("a", "d", {"a": ["c", "b"], "b": ["d"], "c": []}) == ["a", "b", "d"] and k.lane_path("a", "z", {}) is None
    assert k.remove_keys({"policy": 1, "x": [{"y_audit_only": 2, "z": (3,)}]}, frozenset({"policy"}), ("_audit_only",)) == {"x": [{"z": [3]}]}


def test_tracks_over_frames(spark):
    rows = [("s", "v", f, f + 1.0, 2.0 if f == 5 else 0.0, 0.0) for f in range(10)]
    df = spark.createDataFrame(rows, "scene string, agent string, frame long, x double, y double, heading double")
    lanes = spark.createDataFrame(
        [("s", "A", [(0.0, 0.0), (20.0, 0.0)], [], ["C"]), ("s", "C", [(0.0, 2.0), (20.0, 2.0)], [], [])],
        "scene string, lane string, points array<struct<x:double,y:double>>, next array<string>, beside array<string>",
    )
    got = tracks.matched_lanes(df, lanes, "scene", "agent", "frame").collect()
    assert {r["lane"] for r in got} == {"A"} and len(got) == 10


def test_generation_retries(spark):
    def client():
        seen = {}

        def call(row):
            seen[row["id"]] = seen.get(row["id"], 0) + 1
            if row["id"] == 2 or seen[row["id"]] < row["id"] + 1:
                raise RuntimeError
            return f"text {row['id']}"

        return call

    df = spark.createDataFrame([(0,), (1,), (2,)], "id long").coalesce(1)
    got = {r["id"]: r for r in tracks.generated(df, client, "id long, answer string, status string, attempts int", tries=2, wait=0).collect()}
    assert got[0]["attempts"] == 1 and got[1]["answer"] == "text 1" and got[2]["status"] == "failed"


@pytest.mark.parametrize("n", [0, 1])
def test_empty_inputs(n):
    assert k.match_lanes([1.0] * n, [1.0] * n, [0.0] * n, {}, set(), set()) == [None] * n
    assert k.viterbi([], lambda t: None) == []


def test_flickers_go_one_by_one_until_none_is_left():
    """As when all runs are looked at anew after each removal."""
    import random

    def plain(values, c):
        out, gone = list(values), []
        while True:
            starts, ends, held = k.run_table(out)
            mid = [float(np.median(c[s : e + 1])) for s, e in zip(starts, ends)]
            low = (i for i in range(1, len(held) - 1) if held[i - 1] == held[i + 1] and ends[i] - starts[i] < 2 and all(mid[i] + 0.1 <= mid[j] and mid[i] <= mid[j] * 0.8 for j in (i - 1, i + 1)))
            i = next(low, None)
            if i is None:
                return out, gone
            out[starts[i] : ends[i] + 1] = [held[i - 1]] * (ends[i] - starts[i] + 1)
            gone.append((starts[i], ends[i]))

    r, most = random.Random(3), 0
    for _ in range(200):
        values = [r.choice([1, 1, 1, 1, 2, 3]) for _ in range(60)]
        c = [r.choice([0.3, 0.5, 0.9, 0.95]) for _ in values]
        got = k.drop_flickers(values, c, passes=None)
        assert got == plain(values, c)
        assert k.drop_flickers(values, c)[1] == got[1][:4]
        most = max(most, len(got[1]))
    assert most > 8
