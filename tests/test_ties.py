"""What counts as equal in a choice between nearly equal values."""

import math

from pyspark.sql import functions as F

from tests.test_lane_chain import E, LANES, MATCHES, lane, track
from tramline.functions import geometry as g
from tramline.operators import lane_chain as lc

#: In quarters.
CORNERS = [[(-12, -5), (8, 3), (-2, -1)], [(7, -3), (1, 10), (7, -3)], [(8, 2), (-12, 6), (8, 2)], [(8, -11), (-10, -2), (2, -8)]]


def test_the_first_of_segments_that_differ_by_rounding_only(spark):
    """The nearest place is the end that two segments share; the second one gives a distance less by its rounding."""
    rows = [(i, [(x / 4, y / 4) for x, y in p]) for i, p in enumerate(CORNERS)]
    df = spark.createDataFrame(rows, "i long, points array<struct<x:double,y:double>>")
    got = df.select("i", g.project(F.lit(1.5), F.lit(0.75), F.col("points"))["segment"].alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [0] * len(rows)


def test_the_earliest_of_changes_that_are_equal_as_they_are_told(spark):
    """Turns of 20.001 and 20.003 degrees, told to two digits."""
    ray = lambda a: [(0.0, 0.0), (math.cos(math.radians(a)), math.sin(math.radians(a)))]
    lanes = spark.createDataFrame([lane(10, points=ray(0), exits=[20]), lane(20, points=ray(20.001), exits=[30]), lane(30, points=ray(40.004))], LANES)
    s = lc.stabilised(spark.createDataFrame(track([10, 10, 20, 20, 30, 30]), MATCHES), E).cache()
    none = spark.createDataFrame([], "track long, start_frame long, end_frame long, direction string")
    c = lc.transitions(lc.reliable_runs(s, E), lanes, none, E)
    primary = lambda digits: [(x.change, x.primary) for x in lc.route_transitions(s, c, lanes, E, digits=digits).orderBy("transition_frame").collect()]
    assert primary(2) == [(20.0, True), (20.0, False)]
    assert primary(3) == [(20.001, False), (20.003, True)]
