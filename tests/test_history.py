"""Sketches over both tiers against exact answers."""

import datetime as dt
import math
import random

from colloquy.operators.history import BIN, LOG_K, QUANTILES, ranged, sketch_rollup
from pyspark.sql import functions as F

POSTS = "category string, content string, collected_at timestamp_ntz, comparative double"


def made_up(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), f"text {rng.randrange(n // 2)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(180 * 1440)), rng.choice([rng.gauss(0.1, 0.3), 0.0])) for _ in range(n)]


def asked(spark, rows, start, end, hot="2024-05-01"):
    posts = spark.createDataFrame(rows, POSTS)
    old = sketch_rollup(posts.where(F.col("collected_at") < F.lit(hot).cast("timestamp_ntz")))
    return {r.category: r for r in ranged(old, posts, start, end, F.lit(hot).cast("date")).collect()}


def test_bounds_hold_over_ranges_of_both_tiers(spark):
    rows = made_up(20_000)
    for start, end in (("2024-01-01", "2024-06-30"), ("2024-02-01", "2024-04-30"), ("2024-05-10", "2024-05-20"), ("2024-03-01", "2024-05-15")):
        low, high = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
        found = asked(spark, rows, start, end)
        for category in ("a", "b", None):
            own = [r for r in rows if r[0] == category and low <= r[2].date() <= high]
            r, exact = found[category], len({x[1] for x in own})
            assert r.total == len(own)
            assert abs(r.distinct_texts - exact) <= max(1, 4 * 1.04 / math.sqrt(1 << LOG_K) * exact)
            scores = sorted(x[3] for x in own)
            for q in QUANTILES:
                assert abs(r[f"p{round(100 * q)}"] - scores[math.ceil(q * len(scores)) - 1]) <= BIN / 2 + 1e-9


def test_coverage_names_both_tiers(spark):
    rows = made_up(3_000)
    r = asked(spark, rows, "2024-02-10", "2024-06-20")["a"]  # February only in part: no rollup answers for it
    assert (r.rollup_from, r.rollup_to) == (dt.date(2024, 3, 1), dt.date(2024, 4, 30)) and r.detail_from == dt.date(2024, 5, 1) and r.detail_to <= dt.date(2024, 6, 20)
    assert r.from_rollups == sum(1 for x in rows if x[0] == "a" and x[2].month in (3, 4))
    only = asked(spark, rows, "2024-05-02", "2024-05-09")["a"]
    assert only.rollup_from is None and only.from_rollups == 0
    assert asked(spark, rows, "2030-01-01", "2030-02-01") == {} and asked(spark, [], "2024-01-01", "2024-06-30") == {}


def test_rollups_of_parts_merge_to_the_whole(spark):
    posts = spark.createDataFrame(made_up(4_000), POSTS)
    whole, parts = sketch_rollup(posts), sketch_rollup(posts.where("length(content) % 2 = 0")).unionByName(sketch_rollup(posts.where("length(content) % 2 = 1")))
    hot = F.lit("2030-01-01").cast("date")
    one, other = ({r.category: tuple(r) for r in ranged(x, posts, "2024-01-01", "2024-12-31", hot).collect()} for x in (whole, parts))
    # registers merge exactly, but the estimator of merged ones is another: within the same bound, not equal
    assert len(one) == 3 and all(one[c][:2] == other[c][:2] and one[c][3:] == other[c][3:] and abs(one[c][2] - other[c][2]) <= 0.05 * one[c][2] for c in one)


def test_posts_without_time_or_score(spark):
    rows = [("a", "x", None, 0.5), ("a", None, dt.datetime(2024, 5, 2), None), ("a", "x", dt.datetime(2024, 5, 3), 0.5)]
    r = asked(spark, rows, "2024-05-01", "2024-05-31")["a"]
    assert r.total == 2 and r.distinct_texts == 1
