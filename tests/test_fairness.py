"""The daily sample against a sort of each day; pairs that differ in one marker; gaps that are flagged."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

import pytest
from colloquy.operators.fairness import counterfactual, daily_sample, minimal_pairs

DAY = dt.datetime(2024, 5, 1)
ROW = "post_id long, collected_at timestamp_ntz, content string"


@pytest.mark.parametrize("bins", [1, 2, 64, 4096])
def test_sample_equals_a_sort_of_each_day(spark, bins):
    rng = random.Random(bins)
    rows = [(i, DAY + dt.timedelta(hours=rng.choice([1, 1, 1, 30, 50, 75])) if i % 17 else None, None) for i in range(700)]
    rows += [(1000, DAY + dt.timedelta(days=9), None), (None, DAY, None)]
    days = defaultdict(list)
    for i, t, _ in rows:
        if i is not None and t is not None:
            days[t.date()].append((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i))
    want = sorted(i for own in days.values() for _, i in sorted(own)[: -(-len(own) * 5 // 100)])
    assert sorted(r.post_id for r in daily_sample(spark.createDataFrame(rows, ROW), "collected_at", "post_id", bins=bins).collect()) == want


def test_repeated_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(7, DAY, "x")] * 50, ROW)
    assert daily_sample(same, "collected_at", "post_id").count() == 3
    assert daily_sample(same.where("false"), "collected_at", "post_id").collect() == []


def test_pairs_differ_in_whole_markers_only(spark):
    rows = spark.createDataFrame([(1, DAY, "London, Londoners and London; Tokyo"), (2, DAY, None), (3, DAY, "nowhere"), (4, DAY, "")], ROW)
    got = sorted((r.post_id, r.marker, r.exchanged) for r in minimal_pairs(rows).collect())
    assert got == [(1, "London", "Lagos, Londoners and Lagos; Tokyo"), (1, "Tokyo", "London, Londoners and London; Nairobi")]


def test_a_lexicon_that_judges_places_is_flagged(spark):
    rows = spark.createDataFrame([(i, DAY + dt.timedelta(days=i), "good people of London") for i in range(10)], ROW)
    fair, unfair = (counterfactual(rows, lexicon={"good": 3} | more).collect() for more in ({}, {"lagos": -3}))
    assert len(fair) == len(unfair) == 10 and not any(r.flagged for r in fair)
    assert all(r.flagged and r.gap == 0.75 and (r.indicator_as_written, r.indicator_exchanged) == ("positive", "neutral") for r in unfair)
