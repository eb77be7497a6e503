"""As-at aggregates other than sums and counts: brute force on odd histories, and no list of pairs of rows and times."""

from __future__ import annotations

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest

from asofar.operators import validity
from asofar.plans.features import FeatureList
from asofar.queries import QUERIES
from asofar.sources.tables import SCDTable

T = datetime(2024, 1, 1)
KIND = "id int, user int, kind string, since timestamp_ntz, till timestamp_ntz, value double, v array<double>"


def _rows(n: int) -> list[tuple]:
    """Open, closed, empty and reversed spans, null keys, times and values; user 7 has most rows."""
    dice = random.Random(1)
    out = []
    for i in range(n):
        since = T + timedelta(minutes=30 * dice.randrange(200))
        till = dice.choice([None, since + timedelta(minutes=30 * dice.randrange(-2, 150))])
        value = dice.choice([None, float(dice.randrange(20)), float(dice.randrange(20))])
        v = dice.choice([None, [], [value, 1.0, float(i)], [2.0, None, float(-i)]])
        out.append((i, dice.choice([7, 7, 7, 8, None]), dice.choice(["a", "b", None]), None if i % 29 == 0 else since, till, value, v))
    return out + [(n, 9, "a", T + timedelta(days=30), None, 1.0, [1.0])]


def _asked() -> list[tuple]:
    some = [(u, T + timedelta(minutes=45 * h)) for u in (7, 8) for h in range(-3, 160)]
    return some + some[:9] + [(9, T), (10, T), (None, T), (8, None), (None, None)]


def _std(known: list[float]) -> float | None:
    return statistics.stdev(known) if len(known) > 1 else None


def _vectors(rows: list[tuple], fold) -> list | None:
    vs = [r[6] for r in rows if r[6]]
    return [fold([v[i] for v in vs if v[i] is not None]) for i in range(3)] if vs else None


@pytest.mark.parametrize("widest", [2, 16])
@pytest.mark.parametrize("keyed", [True, False])
def test_like_brute_force(spark, monkeypatch, widest, keyed):
    monkeypatch.setattr(validity, "_TOP", widest)
    history, asked = _rows(400), _asked()
    view = SCDTable(spark.createDataFrame(history, KIND), "id", "since", end="till").get_view()
    request = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, user bigint, POINT_IN_TIME timestamp_ntz")
    g = view.groupby(["user"] if keyed else [])
    methods = ["min", "max", "std", "count_distinct"] + ([] if keyed else ["sum", "avg", "na_count"])
    features = [g.aggregate_asat("value", m, m) for m in methods] + [g.aggregate_asat("v", m, f"v_{m}") for m in ("sum", "max", "avg")]
    got = {r.n: r for r in FeatureList(features).compute_historical_features(request).collect()}
    assert len(got) == len(asked)
    for i, (user, at) in enumerate(asked):
        valid = [r for r in history if at is not None and (not keyed or user is not None and r[1] == user) and r[3] is not None and r[3] <= at and (r[4] is None or at < r[4])]
        known = [r[5] for r in valid if r[5] is not None]
        total, most, mean = (lambda x, f=f: f(x) if x else None for f in (sum, max, statistics.fmean))
        expected = {"min": min(known, default=None), "max": most(known), "std": _std(known), "count_distinct": len({r[5] for r in valid}) if valid else None}
        expected |= {"sum": total(known), "avg": mean(known), "na_count": len(valid) - len(known) if valid else None}
        for m in methods:
            assert got[i][m] == (None if expected[m] is None else pytest.approx(expected[m])), (m, user, at)
        for m, fold in (("sum", total), ("max", most), ("avg", mean)):
            vector = _vectors(valid, fold)
            assert got[i][f"v_{m}"] == (None if vector is None else [None if x is None else pytest.approx(x) for x in vector]), (m, user, at)


def test_categories_like_brute_force(spark):
    history, asked = _rows(400), _asked()
    view = SCDTable(spark.createDataFrame(history, KIND), "id", "since", end="till").get_view()
    request = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, user bigint, POINT_IN_TIME timestamp_ntz")
    g = view.groupby("user", category="kind")
    features = [g.aggregate_asat("value", m, m) for m in ("max", "count_distinct")]
    got = {r.n: r for r in FeatureList(features).compute_historical_features(request).collect()}
    for i, (user, at) in enumerate(asked):
        valid = [r for r in history if None not in (at, user, r[3]) and r[1] == user and r[3] <= at and (r[4] is None or at < r[4])]
        kinds = {r[2] for r in valid}
        of = lambda k: [r[5] for r in valid if r[2] == k]  # noqa: E731, B023
        largest = {k or "__MISSING__": max(x for x in of(k) if x is not None) for k in kinds if any(x is not None for x in of(k))}
        assert got[i]["max"] == (largest if valid else None)
        assert got[i]["count_distinct"] == ({k or "__MISSING__": len(set(of(k))) for k in kinds} if valid else None)


def test_no_join_lists_rows_valid_at_times(spark):
    """Joins are equalities on keys and whole numbers or times; a join by validity grows with the rows times the times of a key."""
    plan = QUERIES["asat_max"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if re.search(r"\bJoin\b", line)]
    assert joined and not [line for line in joined if "<" in line or ">" in line]


def test_entries_grow_by_a_logarithm(spark):
    """2000 rows and 2000 times of one key have two million pairs that are valid."""
    n = 2000
    asked = spark.range(n).selectExpr("1 as k", "id * 1000000000 as __t")
    rows = spark.range(n).selectExpr("1 as k", "id * 1000000000 as __a", "cast(null as bigint) as __b")
    asked, rows = validity.numbered(asked, rows, ["k"])
    assert validity.blocks(rows).count() <= 2 * 11 * n
    assert validity.holders(asked).count() <= 11 * n
