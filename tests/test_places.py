"""Queries by place: copies of rows at a place don't multiply the pairs that are looked at."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tramline.operators import joins
from tramline.plans import lane_queries

NAMES = [
    "geo_07_local_lane_frame",
    "geo_24_nearest_lane",
    "grf_10_lane_scores",
    "join_15_grid_radius",
    "fct_13_map_context",
]
COPIES = {"events": {"event_id": 6_300_000, "user_id": 1_000_000}, "supplier": {"s_suppkey": 1_200}}


@pytest.fixture(scope="module")
def larger(sf_dir, tmp_path_factory):
    """The tables with every row four times, with keys that leave the places as they are."""
    out = tmp_path_factory.mktemp("larger")
    for t, keys in COPIES.items():
        moved = ", ".join(f"CAST({c} + i * {k} AS BIGINT) AS {c}" for c, k in keys.items())
        duckdb.sql(f"COPY (SELECT * REPLACE ({moved}) FROM '{sf_dir}/{t}.parquet', range(4) r(i)) TO '{out}/{t}.parquet'")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_pairs_of_places_do_not_grow_with_copies(spark, sf_dir, larger, monkeypatch, name):
    plain, pairs = joins.grid_radius_join, []

    def counted(points, targets, radius, on=None):
        j = plain(points, targets, radius, on)
        pairs.append(j.count())
        return j

    monkeypatch.setattr(joins, "grid_radius_join", counted)
    monkeypatch.setattr(lane_queries, "grid_radius_join", counted)
    query = entry_module.queries()[name]
    rows, four = query(spark, sf_dir).count(), query(spark, larger).count()
    assert pairs[0] == pairs[1] > 0
    assert four == rows * (16 if name == "join_15_grid_radius" else 4)


def _dealt(plan) -> int:
    """The rows that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _dealt(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _dealt(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_dealt(plan.children().apply(i)) for i in range(plan.children().size()))


def test_lanes_near_states_are_not_shuffled(spark, sf_dir, larger, tmp_path):
    """A state goes to its place once, and not once for each place or lane near it."""
    duckdb.sql(f"COPY (FROM '{larger}/events.parquet') TO '{tmp_path}/events.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(s_suppkey + i * 11 AS BIGINT) AS s_suppkey) FROM '{sf_dir}/supplier.parquet', range(120) r(i)) TO '{tmp_path}/supplier.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry_module.queries()["join_15_grid_radius"](spark, str(tmp_path))
        rows = df.collect()
        states = spark.read.parquet(f"{tmp_path}/events.parquet").count()
        assert len(rows) > 10 * states
        assert 0 < _dealt(df._jdf.queryExecution().executedPlan()) < 2 * states
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_lists_are_cut(spark):
    df = spark.createDataFrame([(1.0, 0.0, i) for i in range(25)] + [(2.0, 0.0, 7), (None, 0.0, 8)], "tx double, ty double, n long")
    got = sorted((r.tx is None, r.tx, r.n) for r in joins.in_lists(df, ["tx", "ty"], "n", 10).collect())
    assert got == [(False, 1.0, list(range(10))), (False, 1.0, list(range(10, 20))), (False, 1.0, list(range(20, 25))), (False, 2.0, [7]), (True, None, [8])]
