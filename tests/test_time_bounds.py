"""Pruning by the request's time range drops no row, whatever the zones of process and columns; crontabs of every spacing find their tick."""

from __future__ import annotations

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from asofar.plans.features import FeatureList
from asofar.plans.jobs import CalendarWindow, CronSchedule, Schedule
from asofar.sources.tables import EventTable


@pytest.fixture(params=["America/New_York", "Asia/Tokyo"])
def process_zone(request):
    before = os.environ.get("TZ")
    os.environ["TZ"] = request.param
    time.tzset()
    yield request.param
    os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
    time.tzset()


def _view(spark, kind):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 3_600_000_000)
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("u"), at.cast(kind).alias("ts"), F.lit(1.0).alias("value"))
    return EventTable(rows, "event_id", "ts").get_view()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_pruning_drops_nothing(spark, process_zone, kind):
    v = _view(spark, kind)
    g = v.groupby("u")
    fs = [
        g.aggregate_over("value", "sum", ["24h"], ["day"], Schedule("1h"))["day"],
        g.aggregate_over("value", "sum", [CalendarWindow("DAY", 2)], ["days"], CronSchedule("30 2 * * *", "Asia/Tokyo", "1h"))["days"],
        g.aggregate_over("value", "sum", [CalendarWindow("MONTH", 1)], ["month"], CronSchedule("0 0 1 * *"))["month"],
        g.forward_aggregate("value", "sum", "24h", "next", offset="12h"),
        g.aggregate_over("value", "latest", [None], ["last"], Schedule("1h"))["last"],
    ]
    req = v.df.filter("event_id in (200, 201, 260)").select("event_id", "u", F.col("ts").alias("POINT_IN_TIME"))
    both = [sorted(map(tuple, FeatureList(fs).compute_historical_features(req, prune=p).drop("POINT_IN_TIME").collect())) for p in (True, False)]
    assert both[0] == both[1]
    assert all(r[2] == 8.0 and r[5] == 8.0 for r in both[0])


def test_scans_are_pruned_on_both_sides(spark, tmp_path):
    _view(spark, "timestamp_ntz").df.write.parquet(str(tmp_path / "e"))
    v = EventTable(spark.read.parquet(str(tmp_path / "e")), "event_id", "ts").get_view()
    req = v.df.filter("event_id = 200").select("u", F.col("ts").alias("POINT_IN_TIME"))
    for f in (v.groupby("u").forward_aggregate("value", "sum", "24h", "next"), v.groupby("u").aggregate_over("value", "sum", [CalendarWindow("DAY", 2)], ["days"], CronSchedule("30 2 * * *"))["days"]):
        plan = FeatureList([f]).compute_historical_features(req)._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(ts," in plan and "GreaterThanOrEqual(ts," in plan


@pytest.mark.parametrize(
    ("crontab", "at", "expected"),
    [
        ("0 0 29 2 *", "2023-06-01 00:00:00", "2020-02-29 00:00:00"),
        ("0 0 29 2 *", "1903-06-01 00:00:00", "1896-02-29 00:00:00"),
        ("* * * * *", "2024-01-01 00:00:30", "2024-01-01 00:00:00"),
        ("* * * * *", "2024-01-01 00:00:00", "2023-12-31 23:59:00"),
        ("0 9 * * 1", "2024-01-03 12:00:00", "2024-01-01 09:00:00"),
        ("15 3 1 */3 *", "2024-03-05 00:00:00", "2024-01-01 03:15:00"),
    ],
)
def test_last_tick(spark, crontab, at, expected):
    points = spark.createDataFrame([(datetime.fromisoformat(at),)], "pit timestamp_ntz")
    got = CronSchedule(crontab).job_times(points, "pit").first()
    assert got["__job"] == datetime.fromisoformat(expected)


def test_crontabs_without_ticks():
    with pytest.raises(ValueError, match="never fires"):
        CronSchedule("0 0 30 2 *")
    with pytest.raises(ValueError, match="crontab field"):
        CronSchedule("61 0 * * *")


def test_ticks_follow_the_clock(spark):
    """An hour that a zone skips or repeats changes the pattern of two days only."""
    points = spark.createDataFrame([(datetime(2024, 3, 9, 12),), (datetime(2024, 3, 11, 12),)], "pit timestamp_ntz")
    got = {r["pit"].day: r["__job"] for r in CronSchedule("0 1 * * *", "America/New_York").job_times(points, "pit").collect()}
    assert got == {9: datetime(2024, 3, 9, 6), 11: datetime(2024, 3, 11, 5)}
