"""Sliding windows over many batches: late rows, refused rows, restarts and repeated batches."""

import datetime as dt
import random
from collections import Counter

import pytest
from colloquy.streaming.series import Series

START = dt.datetime(2024, 1, 1)
ROW = "at timestamp_ntz, kind string"


@pytest.fixture
def batches():
    rng = random.Random(3)
    made = []
    for i in range(5):
        on_time = [(START + dt.timedelta(minutes=i * 180 + rng.randrange(180)), rng.choice("ab")) for _ in range(40)]
        late = [(START + dt.timedelta(minutes=rng.randrange(i * 180 + 1)), "a") for _ in range(6)]
        made.append(on_time + late + [(None, "a"), (START, None), (START + dt.timedelta(days=9), "b")])
    return made


def series(spark, folder):
    return Series(spark, folder, "at", "kind", "2024-01-02 00:00:00")


def wanted(batches):
    """Windows by a plain loop: (start, kind) to rows on time and late."""
    on_time, late, newest = Counter(), Counter(), None
    for rows in batches:
        mark = newest and newest - dt.timedelta(hours=1)
        good = [(t, k) for t, k in rows if t is not None and k is not None and t <= dt.datetime(2024, 1, 2)]
        for t, k in good:
            quarter = START + (t - START) // dt.timedelta(minutes=15) * dt.timedelta(minutes=15)
            for n in range(4):
                start = quarter - n * dt.timedelta(minutes=15)
                (late if mark and start + dt.timedelta(hours=1) <= mark else on_time)[start, k] += 1
        newest = max([t for t, _ in good] + ([newest] if newest else []))
    return on_time, late, newest - dt.timedelta(hours=1)


def test_late_rows_are_counted_beside_the_rest_and_repeated_batches_replace_themselves(spark, tmp_path, batches):
    on_time, late, mark = wanted(batches)
    for i, rows in enumerate(batches):
        for _ in range(2 if i in (1, 4) else 1):
            series(spark, str(tmp_path)).batch(spark.createDataFrame(rows, ROW), i)
    got = series(spark, str(tmp_path)).series().collect()
    assert sum(late.values()) > 0 and {(r.start, r.kind): r.on_time for r in got if r.on_time} == on_time and {(r.start, r.kind): r.late for r in got if r.late} == late
    assert all(r.closed == (r.stop <= mark) for r in got) and {r.closed for r in got} == {True, False}
    assert sorted((r.reason, r.kind, r.n) for r in series(spark, str(tmp_path)).refused().collect()) == [("future", "b", 5), ("no kind", None, 5), ("no time", "a", 5)]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, batches):
    on_time, late, _ = wanted(batches)
    for half in (batches[:3], batches[3:]):
        for rows in half:
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        series(spark, f"{tmp_path}/out").run(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = series(spark, f"{tmp_path}/out").series().collect()
    assert {(r.start, r.kind): r.on_time + r.late for r in got} == on_time + late


def test_nothing_yet(spark, tmp_path):
    found = series(spark, str(tmp_path))
    assert found.series().collect() == [] and found.refused().collect() == []
    found.batch(spark.createDataFrame([], ROW), 0)
    assert found.series().collect() == [] and found.watermark().first().mark is None
