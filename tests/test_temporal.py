"""Joins in time against plain loops: ties, nulls, repeated rows, hot keys, intervals of any length."""

import datetime as dt
import random

import pytest
from colloquy.operators.temporal import HOUR, asof, in_intervals, micros

START = dt.datetime(2024, 3, 30)


def made(spark, n, seed, columns="id long, k string, t timestamp_ntz, v long"):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(i, rng.choice(keys), START + dt.timedelta(minutes=rng.randrange(6000)) if rng.random() > 0.05 else None, rng.randrange(4)) for i in range(n)]
    return spark.createDataFrame(rows, columns), rows


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 3 * HOUR])
def test_asof_equals_a_loop(spark, strict, within):
    left, rows = made(spark, 300, 1)
    right, others = made(spark, 200, 2)
    got = asof(left.union(left.where("id = 5")), right, ["k"], "t", "t", "r", ["id"], strict=strict, hours=5, within=within)

    def newest(k, t):
        if k is None or t is None:
            return None
        fit = [(u, i) for i, key, u, _ in others if key == k and u is not None and (u < t if strict else u <= t)]
        best = max(fit, default=None)
        return best[1] if best and (within is None or t - best[0] <= dt.timedelta(microseconds=within)) else None

    want = sorted([(i, newest(k, t)) for i, k, t, _ in [*rows, rows[5]]], key=str)
    assert sorted([(r.id, r.r.id if r.r else None) for r in got.collect()], key=str) == want


def test_asof_without_rows_on_a_side(spark):
    left, rows = made(spark, 20, 3)
    assert all(r.r is None for r in asof(left, left.where("false"), ["k"], "t", "t", "r", ["id"]).collect())
    assert asof(left.where("false"), left, ["k"], "t", "t", "r", ["id"]).collect() == []


def test_asof_before_1970_and_over_many_spans(spark):
    times = [dt.datetime(1969, 12, 30), dt.datetime(1969, 12, 31, 23), dt.datetime(1970, 1, 1), dt.datetime(1975, 5, 5)]
    rows = spark.createDataFrame(list(enumerate(times)), "id long, t timestamp_ntz").selectExpr("id", "1 as k", "t")
    found = asof(rows, rows, ["k"], "t", "t", "r", ["id"], strict=True, hours=1)
    assert sorted((r.id, r.r and r.r.id) for r in found.collect()) == [(0, None), (1, 0), (2, 1), (3, 2)]


def test_intervals_of_any_length_equal_a_loop(spark):
    points, rows = made(spark, 200, 4)
    rng = random.Random(5)
    spans = [(i, rng.choice(["hot", "a", None]), START + dt.timedelta(minutes=rng.randrange(-500, 6000)), rng.choice([-5, 0, 1, 59, 60, 61, 700, 90_000])) for i in range(80)]
    made_of = [(i, k, a, a + dt.timedelta(minutes=m)) for i, k, a, m in spans]
    got = in_intervals(points, spark.createDataFrame(made_of, "n long, k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b")
    want = [(i, n) for i, k, t, _ in rows for n, key, a, b in made_of if k is not None and k == key and t is not None and a <= t < b]
    assert want and sorted((r.p.id, r.i.n) for r in got.collect()) == sorted(want)
    assert in_intervals(points, spark.createDataFrame([], "n long, k string, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b").collect() == []


def test_plans_compare_no_rows_of_a_key_with_one_another(spark):
    left, _ = made(spark, 20, 6)
    plan = asof(left, left, ["k"], "t", "t", "r", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_calendar_time_knows_no_summer_time(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        one = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 0, 7),)], "t timestamp_ntz")
        assert one.select(micros(one, "t").alias("m")).first().m == int((dt.datetime(2024, 3, 31, 2, 30) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + 7
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
