"""Numeric kernels over one entity's frames, for what window functions can't say: sequential rewrites, dynamic programs, polygons.

All take and return plain arrays; ``tracks`` runs them per entity. A missing value is ``None`` in lists and NaN in arrays.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence

import numpy as np


def run_table(values: Sequence) -> tuple[np.ndarray, np.ndarray, list]:
    """(starts, ends, values) of the maximal runs; ends are inclusive."""
    n = len(values)
    if not n:
        return np.zeros(0, int), np.zeros(0, int), []
    cuts = [0, *(i for i in range(1, n) if values[i] != values[i - 1]), n]
    starts = np.array(cuts[:-1])
    return starts, np.array(cuts[1:]) - 1, [values[i] for i in starts]


def absorb_short_runs(values: Sequence, dwell: int, passes: int = 4) -> list:
    """Runs under ``dwell`` take the value of their neighbours where these agree or only one is known.

    All runs of a pass are judged by the runs as they were at its start.
    """
    out = list(values)
    for _ in range(passes):
        starts, ends, held = run_table(out)
        before, after = [None, *held[:-1]], [*held[1:], None]
        fresh = list(out)
        for s, e, v, p, q in zip(starts, ends, held, before, after):
            if v is None or e - s + 1 >= dwell:
                continue
            take = p if p is not None and q in (p, None) else q if p is None else None
            if take is not None:
                fresh[s : e + 1] = [take] * (e - s + 1)
        if fresh == out:
            break
        out = fresh
    return out


def drop_flickers(values: Sequence, confidence: Sequence, longest: int = 2, margin: float = 0.1, ratio: float = 0.8, passes: int | None = 4) -> tuple[list, list[tuple[int, int]]]:
    """(values, removed spans): short A-B-A excursions whose median confidence is clearly below both sides.

    A pass removes the first one, which makes one run of three; without a number of ``passes`` they go on until none is left.
    """
    out, gone = list(values), []
    c = [math.nan if x is None else float(x) for x in confidence]
    # a run: (start, end, value, its finite confidences in order)
    runs = [(int(s), int(e), v, sorted(x for x in c[s : e + 1] if math.isfinite(x))) for s, e, v in zip(*run_table(out))]

    def middle(part: list[float]) -> float:
        n = len(part)
        return (part[(n - 1) // 2] + part[n // 2]) / 2 if n else math.nan

    def flicker(before: tuple, run: tuple, after: tuple) -> bool:
        if run[2] is None or before[2] is None or before[2] != after[2] or run[1] - run[0] >= longest:
            return False
        own = middle(run[3])
        return all(own + margin <= x and own <= x * ratio for x in (middle(before[3]), middle(after[3])))  # false for NaN

    done, ahead = runs[:1], runs[:0:-1]
    while len(ahead) > 1 and (passes is None or len(gone) < passes):
        if not flicker(done[-1], ahead[-1], ahead[-2]):
            done.append(ahead.pop())
            continue
        before, run, after = done.pop(), ahead.pop(), ahead.pop()
        out[run[0] : run[1] + 1] = [before[2]] * (run[1] - run[0] + 1)
        gone.append(run[:2])
        *rest, most = sorted((before[3], run[3], after[3]), key=len)
        for x in (x for part in rest for x in part):
            bisect.insort(most, x)
        # of the runs before, only the last has a new neighbour
        ahead.append((before[0], after[1], before[2], most))
        if len(done) > 1:
            ahead.append(done.pop())
        elif not done:
            done.append(ahead.pop())
    return out, gone


def hold_excursions(selected: Sequence, candidates: Sequence[Sequence], longest: int = 2) -> list:
    """One- or two-frame jumps between frames of one lane go back to it where it is a candidate; earlier repairs count."""
    out, i = list(selected), 0
    while i < len(out):
        j = i
        while j + 1 < len(out) and out[j + 1] == out[i]:
            j += 1
        if out[i] is not None and j - i < longest and 0 < i and j + 1 < len(out) and out[i - 1] is not None and out[i - 1] == out[j + 1]:
            stay = out[i - 1]
            for k in range(i, j + 1):
                if stay in candidates[k]:
                    out[k] = stay
        i = j + 1
    return out


def savgol(x: Sequence[float], window: int, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends are read off the first and last window's polynomial. Short series stay."""
    x = np.asarray(x, dtype=float)
    if len(x) < window:
        return x.copy()
    half = window // 2
    t = np.arange(-half, half + 1, dtype=float)
    design = np.vander(t, order + 1, increasing=True)
    fit = np.linalg.pinv(design)
    out = np.convolve(x, fit[0][::-1], mode="same")
    out[:half] = design[:half] @ (fit @ x[:window])
    out[-half:] = design[half + 1 :] @ (fit @ x[-window:])
    return out


def viterbi(emissions: Sequence[np.ndarray], transition: Callable[[int], np.ndarray]) -> list[int]:
    """Cheapest candidate index by frame; ``transition(t)`` is the cost matrix from frame t - 1 to t; first of equals wins."""
    if not emissions:
        return []
    cost = np.asarray(emissions[0], dtype=float)
    back = []
    for t in range(1, len(emissions)):
        total = cost[:, None] + transition(t)
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0) + emissions[t]
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def project(points: np.ndarray, x: float, y: float) -> tuple[float, float, float]:
    """(distance, arc length, direction) of the nearest place on a polyline, the first of equals."""
    p = np.array([x, y])
    if len(points) == 1:
        return float(np.hypot(*(p - points[0]))), 0.0, 0.0
    a, v = points[:-1], np.diff(points, axis=0)
    n = (v * v).sum(1)
    t = np.clip(np.where(n > 0, ((p - a) * v).sum(1) / np.where(n > 0, n, 1), 0), 0, 1)
    d = np.hypot(*(p - (a + t[:, None] * v)).T)
    k = int(d.argmin())
    h = np.sqrt(n)
    return float(d[k]), float(h[:k].sum() + t[k] * h[k]), float(math.atan2(v[k][1], v[k][0]))


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


def match_lanes(
    x: Sequence[float], y: Sequence[float], heading: Sequence[float], lanes: dict[str, np.ndarray], follows: set[tuple], beside: set[tuple],
    reach: float = 3.0, turn: float = math.pi / 8, top: int = 5, weights: tuple[float, float] = (1.0, 3.0), costs: tuple[float, float, float, float] = (0.0, 0.25, 1.0, 20.0),
) -> list:
    """Lane by frame from position, heading and topology; None where no lane is near."""
    cands: list[list[tuple[float, str]]] = []
    for px, py, h in zip(x, y, heading):
        near = []
        if all(v is not None and math.isfinite(v) for v in (px, py, h)):
            for name, points in lanes.items():
                d, _, direction = project(points, px, py)
                off = abs(wrap(h - direction))
                if d <= reach and off <= turn:
                    near.append((weights[0] * d + weights[1] * off, name))
        cands.append(sorted(near, key=lambda c: c[0])[:top])
    return choose_lanes(cands, lambda a, b: transition_cost(a, b, (a, b) in follows, (a, b) in beside or (b, a) in beside, costs))


def transition_cost(a, b, follows: bool, beside: bool, costs: tuple[float, float, float, float] = (0.0, 0.25, 1.0, 20.0)) -> float:
    return costs[0] if a == b else costs[1] if follows else costs[2] if beside else costs[3]


def choose_lanes(cands: Sequence[Sequence[tuple]], step) -> list:
    """The cheapest lane by frame from candidates (cost, lane, ...); ``step`` gives the cost between two lanes. A frame without candidates has
    None and parts the track."""
    out: list = [None] * len(cands)
    i = 0
    while i < len(cands):
        j = i
        while j < len(cands) and cands[j]:
            j += 1
        if j > i:
            part = cands[i:j]
            path = viterbi([np.array([c[0] for c in f]) for f in part], lambda t: np.array([[step(a[1], b[1]) for b in part[t]] for a in part[t - 1]]))
            names = [part[k][p][1] for k, p in enumerate(path)]
            out[i:j] = hold_excursions(names, [[c[1] for c in f] for f in part])
        i = max(j, i + 1)
    return out


def box(x: float, y: float, heading: float, length: float, width: float) -> np.ndarray:
    """Corners of an oriented rectangle, counter-clockwise."""
    c, s = math.cos(heading), math.sin(heading)
    local = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]) * [length / 2, width / 2]
    return local @ np.array([[c, s], [-s, c]]) + [x, y]


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon.T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A convex polygon cut by another, both counter-clockwise: each edge keeps what lies left of it."""
    out = subject
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        edge = b - a
        side = edge[0] * (out[:, 1] - a[1]) - edge[1] * (out[:, 0] - a[0])
        nxt, side_next = np.roll(out, -1, axis=0), np.roll(side, -1)
        pieces = []
        for p, q, sp, sq in zip(out, nxt, side, side_next):
            if sp >= 0:
                pieces.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                pieces.append(p + (q - p) * sp / (sp - sq))
        out = np.array(pieces).reshape(-1, 2)
    return out


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    return area(clip(a, b))


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points where two polylines meet, in order along the first; parallel pieces don't count."""
    if len(a) < 2 or len(b) < 2:
        return np.zeros((0, 2))
    p, r = a[:-1, None, :], np.diff(a, axis=0)[:, None, :]
    q, s = b[None, :-1, :], np.diff(b, axis=0)[None, :, :]
    det = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    gap = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * s[..., 1] - gap[..., 1] * s[..., 0]) / det
        u = (gap[..., 0] * r[..., 1] - gap[..., 1] * r[..., 0]) / det
    i, j = np.nonzero((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    order = np.lexsort((j, t[i, j], i))
    i, j = i[order], j[order]
    return a[i] + t[i, j][:, None] * np.diff(a, axis=0)[i]


def conflict_point(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(point, way of a, way of b): where two paths meet first seen from the start of a; None if they don't."""
    hits = crossings(a, b)
    if not len(hits):
        return None
    at = hits[int(np.hypot(*(hits - a[0]).T).argmin())]
    return at, project(a, *at)[1], project(b, *at)[1]


def in_corridor(line: np.ndarray, points: np.ndarray, half: float, ahead: float = 0.0) -> np.ndarray:
    """Which points lie within ``half`` of a line and not past its end (less ``ahead``)."""
    total = float(np.hypot(*np.diff(line, axis=0).T).sum())
    found = [project(line, *p) for p in points]
    return np.array([d <= half and s <= total - ahead for d, s, _ in found], dtype=bool)


def separating_acceleration(d: Sequence[float], v: Sequence[float], apart: float = 1.5, slack: float = 0.1, horizon: float = 30.0) -> float:
    """The least sum of absolute constant accelerations that parts two arrivals at a point by ``apart`` seconds.

    Agent k starts ``d[k]`` before the point at speed ``v[k]``, may miss it by ``slack`` and never drives backwards. 0 if the
    arrivals are apart already; NaN if nothing within ``horizon`` parts them. A dense search over both arrival times and a
    refinement around the best; within 1e-3 of the optimum.
    """
    d, v = np.asarray(d, dtype=float), np.asarray(v, dtype=float)

    def cost(k: int, t: np.ndarray) -> np.ndarray:
        """The least acceleration that brings agent k to within the slack at t."""
        with np.errstate(divide="ignore", invalid="ignore"):
            low, high = 2 * (d[k] - slack - v[k] * t) / t**2, 2 * (d[k] + slack - v[k] * t) / t**2
        a = np.where(low > 0, low, np.where(high < 0, high, 0.0))
        a = np.where(v[k] + a * t < -1e-9, np.maximum(high, -v[k] / t), a)
        ok = (v[k] + a * t >= -1e-9) & (a >= low - 1e-9) & (a <= high + 1e-9) & (t > 0)
        return np.where(ok, np.abs(a), np.inf)

    best, center, width = np.inf, None, horizon
    for _ in range(6):
        grids = [np.linspace(0.01, horizon, 1501)] * 2 if center is None else [np.clip(np.linspace(c - width, c + width, 401), 0.01, horizon) for c in center]
        c0, c1 = cost(0, grids[0]), cost(1, grids[1])
        total = c0[:, None] + c1[None, :]
        total[np.abs(grids[0][:, None] - grids[1][None, :]) < apart - 1e-9] = np.inf
        i, j = np.unravel_index(int(total.argmin()), total.shape)
        if not np.isfinite(total[i, j]):
            break
        if total[i, j] <= best:
            best, center = float(total[i, j]), (grids[0][i], grids[1][j])
        width = width / 20 if width < horizon else 2 * horizon / 1500
    return best if np.isfinite(best) else math.nan


def merge_episodes(episodes: Sequence[tuple[int, int, int]], series: np.ndarray, reach: int = 5, least: int = 5, change: float = 0.6, plateau: tuple[int, float, float] = (5, 0.15, 0.25)) -> list[tuple[int, int, int]]:
    """Joins (start, end, sign) episodes of one sign with short gaps between, unless the gap is a plateau; then drops the weak."""
    out: list[list[int]] = []
    for s, e, sign in episodes:
        if out and out[-1][2] == sign and s - out[-1][1] - 1 <= reach:
            gap = series[out[-1][1] + 1 : s]
            flat = len(gap) >= plateau[0] and abs(gap[-1] - gap[0]) <= plateau[1] and gap.max() - gap.min() <= plateau[2]
            if not flat:
                out[-1][1] = e
                continue
        out.append([s, e, sign])
    return [(s, e, g) for s, e, g in out if e - s + 1 >= least and abs(series[e] - series[s]) >= change]


def dedupe_segments(segments: Sequence[tuple[int, int, str]], share: float = 0.8) -> list[int]:
    """Places of the segments that stay: of those with one signature whose overlap is ``share`` of the shorter, the first."""
    kept: list[int] = []
    for i, (s, e, name) in enumerate(segments):
        def same(k: int, s: int = s, e: int = e, name: str = name) -> bool:
            t, f, other = segments[k]
            common = min(e, f) - max(s, t) + 1
            return other == name and common >= share * min(e - s + 1, f - t + 1)

        if not any(map(same, kept)):
            kept.append(i)
    return kept


def first_lane_chain(start: str, exits: dict[str, Sequence[str]], depth: int = 3) -> list[str]:
    """A lane and its first exits, up to ``depth`` of them; a lane isn't entered twice."""
    out = [start]
    while len(out) <= depth:
        nxt = sorted(exits.get(out[-1], ()))
        if not nxt or nxt[0] in out:
            break
        out.append(nxt[0])
    return out


def lane_path(start: str, goal: str, exits: dict[str, Sequence[str]]) -> list[str] | None:
    """The first path of a depth-first search with exits in sorted order."""
    stack, seen = [(start, [start])], set()
    while stack:
        at, path = stack.pop()
        if at == goal:
            return path
        if at in seen:
            continue
        seen.add(at)
        stack += [(n, [*path, n]) for n in sorted(exits.get(at, ()), reverse=True) if n not in seen]
    return None


def remove_keys(value, names: frozenset[str], suffixes: tuple[str, ...] = ()):
    """A nested value without keys of these names or suffixes, at any depth."""
    if isinstance(value, dict):
        return {k: remove_keys(v, names, suffixes) for k, v in value.items() if k not in names and not k.endswith(suffixes or ("\0",))}
    return [remove_keys(v, names, suffixes) for v in value] if isinstance(value, (list, tuple)) else value
