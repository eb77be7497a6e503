"""Tiles that a stream keeps, and plain windows on odd requests."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from asofar.plans.features import FeatureList
from asofar.plans.jobs import Schedule
from asofar.sources.tables import EventTable
from asofar.streaming import tiles

JOB = Schedule("1h", "0s", "0s")
T = datetime(2024, 1, 1)
KIND = "user int, ts timestamp_ntz, value double"


def _rows(first: int, n: int) -> list[tuple[int, datetime, float]]:
    return [(i % 3, T + timedelta(minutes=10 * i), float(i)) for i in range(first, first + n)]


def _sums(df) -> dict[tuple[int, int], tuple[int, float]]:
    return {(r.user, r.tile): (r.n_rows, r.sum) for r in df.collect()}


def test_stream_keeps_tiles(spark, tmp_path):
    source, path, mark = (str(tmp_path / n) for n in ("in", "tiles", "mark"))

    def run() -> None:
        query = tiles.maintain(spark.readStream.schema(KIND).parquet(source), path, mark, ["user"], "ts", "value", JOB)
        query.awaitTermination()

    everything = []
    for batch in range(4):
        # the second part repeats hours of the first: late rows
        everything += _rows(3 * batch, 20)
        spark.createDataFrame(_rows(3 * batch, 20), KIND).coalesce(1).write.mode("append").parquet(source)
        run()
        expected = _sums(tiles.tiles(spark.createDataFrame(everything, KIND), ["user"], "ts", "value", JOB))
        assert _sums(tiles.latest(spark, path)) == expected
    assert sorted(p.name for p in (tmp_path / "tiles").iterdir()) == ["generation=2", "generation=3"]
    # the last batch again, as after a failure before its commit
    for p in (tmp_path / "mark" / "commits").glob("*3*"):
        p.unlink()
    run()
    assert _sums(tiles.latest(spark, path)) == expected
    # a lost generation is an error, not an empty history
    shutil.rmtree(tmp_path / "tiles" / "generation=3")
    spark.createDataFrame(_rows(50, 5), KIND).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException, match="generation=3 is missing"):
        run()


def test_windows_of_odd_requests(spark):
    """Repeated requests, null keys and times, keys of another type, one key with most rows: as a brute-force search has it."""
    events = [(7, T + timedelta(minutes=7 * i), float(i) if i % 4 else None) for i in range(400)] + [(8, T, 1.0), (None, T, 5.0)]
    asked = [(7, T + timedelta(hours=h)) for h in range(60)] * 2 + [(8, T + timedelta(hours=1)), (9, T), (None, T), (8, None), (None, None)]
    source = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "event_id int, user int, ts timestamp_ntz, value double")
    request = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, user bigint, POINT_IN_TIME timestamp_ntz")
    g = EventTable(source, "event_id", "ts").get_view().groupby("user")
    features = [g.aggregate_over("value", m, ["5h", "2h"], [f"{m}5", f"{m}2"], JOB) for m in ("sum", "max", "na_count", "latest")]
    got = {r.id: r for r in FeatureList(features).compute_historical_features(request).collect()}
    assert len(got) == len(asked)
    for i, (user, at) in enumerate(asked):
        for hours in (5, 2):
            some = [] if user is None or at is None else [(t, v) for u, t, v in events if u == user and at - timedelta(hours=hours) <= t < at]
            known = [v for _, v in some if v is not None]
            assert got[i][f"sum{hours}"] == (sum(known) if known else None)
            assert got[i][f"max{hours}"] == (max(known) if known else None)
            assert got[i][f"na_count{hours}"] == (len(some) - len(known) if some else None)
            assert got[i][f"latest{hours}"] == (max(some)[1] if some else None)
