"""Rules on generated descriptions: what wording is forbidden, and which behaviours a text tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the wording rules and of each behaviour, in any case.
SHIFT_OR_DRIFT = r"\b(?:shift|shifts|shifted|shifting|drift|drifts|drifted|drifting)\b"
TURN_LEFT = r"\b(?:turn|turns|turned|turning)\s+(?:to\s+the\s+)?left\b|\bleft\s+turn\b"
TURN_RIGHT = r"\b(?:turn|turns|turned|turning)\s+(?:to\s+the\s+)?right\b|\bright\s+turn\b"
LANE_LEFT = r"\b(?:change|changes|changed|changing)\s+lanes?\s+(?:to\s+the\s+)?left\b|\bleft\s+lane\s+change\b"
LANE_RIGHT = r"\b(?:change|changes|changed|changing)\s+lanes?\s+(?:to\s+the\s+)?right\b|\bright\s+lane\s+change\b"
ACCELERATION = r"\b(?:accelerat(?:e|es|ed|ing)|speed(?:s)?\s+up|gains?\s+speed)\b"
DECELERATION = r"\b(?:slow(?:s|ed|ing)?|decelerat(?:e|es|ed|ing)|reduces?\s+speed)\b"
U_TURN = r"\b(?:u[- ]turn|turns?\s+around)\b"
FORWARD = r"\b(?:continues?|continued|continuing|moves?|moving|travels?|traveling|proceeds?|proceeding)\s+(?:straight|forward)\b"
STEADY = r"\b(?:maintains?|maintaining|keeps?|keeping)\s+(?:a\s+)?(?:steady|constant)\s+(?:speed|pace)\b|\bsteady\s+speed\b"
BEHAVIOURS = {
    "u_turn": (U_TURN,), "left_turn": (TURN_LEFT,), "right_turn": (TURN_RIGHT,), "lane_change_left": (LANE_LEFT,), "lane_change_right": (LANE_RIGHT,),
    "acceleration": (ACCELERATION,), "deceleration": (DECELERATION,), "forward_motion": (FORWARD, STEADY), "steady_motion": (FORWARD, STEADY),
}


def says(text: Column, pattern: str) -> Column:
    """Null texts say nothing."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def told_behaviours(text: Column) -> Column:
    """The known behaviours whose wording the text has."""
    return F.array_compact(F.array(*[F.when(says(text, "|".join(p)), F.lit(name)) for name, p in BEHAVIOURS.items()]))


def covered(text: Column, required: Column) -> Column:
    """The required behaviours that the text tells, in their order, repeats too; a behaviour without patterns is never told."""
    told = told_behaviours(text)
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda r: F.array_contains(told, r))


def missing(text: Column, required: Column) -> Column:
    """The required behaviours that the text doesn't tell, in their order."""
    told = told_behaviours(text)
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda r: ~F.coalesce(F.array_contains(told, r), F.lit(False)))


def expected_turn(status: Column, heading_direction: Column) -> Column:
    """'left' or 'right' by the confirmed manoeuvre, else by the direction of the heading episode; null if neither tells."""
    return (
        F.when(status == "left_turn", "left").when(status == "right_turn", "right")
        .when(heading_direction == "increasing_ccw", "left").when(heading_direction == "decreasing_cw", "right")
    )


def violations(text: Column, turn: Column, required: Column) -> Column:
    """Names of the rules that the text breaks: ordinary shift or drift, a turn against the expected one (which needn't be told), and lane
    changes that aren't required."""
    needs = lambda name: F.coalesce(F.array_contains(required, name), F.lit(False))
    rules = (
        ("shift_or_drift", says(text, SHIFT_OR_DRIFT)),
        ("turn_conflicts", F.coalesce(((turn == "left") & says(text, TURN_RIGHT)) | ((turn == "right") & says(text, TURN_LEFT)), F.lit(False))),
        ("unrequired_left_lane_change", says(text, LANE_LEFT) & ~needs("lane_change_left")),
        ("unrequired_right_lane_change", says(text, LANE_RIGHT) & ~needs("lane_change_right")),
    )
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
