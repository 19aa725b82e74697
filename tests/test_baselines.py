"""Robust baselines against plain loops: exact sketches, stated error, nulls, hot keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.operators import baselines as bl

T0 = datetime(2020, 1, 1)
EPOCH = datetime(1970, 1, 1)


def middle(v, digits=3):
    unit = 10 ** max(len(str(abs(v))) - digits, 0)
    size = abs(v) // unit * unit + unit // 2
    return size if v > 0 else -size if v < 0 else 0


def lower_median(values):
    return sorted(values)[(len(values) + 1) // 2 - 1]


def block(at):
    return (at - EPOCH).days // 30


def base(rows, key, at, change=middle):
    held = [change(v) for k, t, v in rows if k == key and t is not None and v is not None and block(at) - 12 <= block(t) < block(at)]
    if not held:
        return 0, None, None
    m = lower_median(held)
    return len(held), m, lower_median([abs(v - m) for v in held])


@pytest.fixture(scope="module")
def points():
    draw = random.Random(7)
    rows = [(k, T0 + timedelta(days=draw.randrange(900), seconds=draw.randrange(86400)), int(draw.lognormvariate(11, 2)) * draw.choice([1, 1, 1, -1])) for k in ("a", "b", None) for _ in range(150)]
    rows += [("a", T0 + timedelta(days=100), 5000)] * 4  # repeated rows
    return rows + [("a", None, 10), ("b", T0 + timedelta(days=500), None), ("z", T0, None), ("one", T0, 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, v long")


def test_classes_are_within_the_stated_error(spark):
    values = [0, 1, 9, 10, 999, 1000, 1001, 1009, 99999, 100000, 123456789, 10**15 - 1, 10**15, 9 * 10**17 + 1]
    values += [-v for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", bl.leading(F.col("v")).alias("m")).collect()
    for r in got:
        assert r["m"] == middle(r["v"])
        assert abs(r["m"] - r["v"]) <= 0.005 * abs(r["v"]) and (abs(r["v"]) >= 1000 or r["m"] == r["v"])


@pytest.mark.parametrize("hot", [None, "20"])
def test_baselines_equal_a_loop(spark, points, hot):
    if hot:
        spark.conf.set("spark.tideglass.hotRows", hot)
    try:
        rows = bl.against_baseline(frame(spark, points), ["k"], "at", "v").collect()
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    assert len(rows) == len(points)
    for r in rows:
        if r["at"] is None:
            assert (r["n"], r["median"], r["deviation"]) == (None, None, None)
            continue
        assert (r["n"], r["median"], r["deviation"]) == base(points, r["k"], r["at"])


@pytest.mark.parametrize("digits", [1, 3])
def test_sparse_baselines_equal_a_loop(spark, points, digits):
    rows = bl.against_sparse_baseline(frame(spark, points), ["k"], "at", "v", digits=digits).collect()
    assert sorted(map(repr, ((r["k"], r["at"], r["v"]) for r in rows))) == sorted(map(repr, points))
    for r in rows:
        want = base(points, r["k"], r["at"], change=lambda v: middle(v, digits)) if r["at"] is not None else (None, None, None)
        assert (r["n"], r["median"], r["deviation"]) == want


def test_rows_of_an_account_are_moved_by_day_and_once_more(spark):
    """No class is sent to the twelve blocks ahead of it, and nothing is joined back."""
    df = spark.createDataFrame([], "account_id string, event_time timestamp_ntz, cents long")
    for found in (bl.balance_drains(df), bl.pattern_anomalies(df)):
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange") <= 3 and "Join" not in plan


def test_the_median_is_within_the_stated_error(spark, points):
    for r in bl.against_baseline(frame(spark, points), ["k"], "at", "v").filter("n > 0").collect():
        exact = base(points, r["k"], r["at"], change=lambda v: v)[1]
        assert abs(r["median"] - exact) <= 0.005 * abs(exact)


def test_a_far_transfer_fires_and_a_usual_one_does_not(spark):
    usual = [(f"u{i}", "p", "s", T0 + timedelta(days=10 * i), 10_000 + 100 * (i % 7)) for i in range(30)]
    rows = usual + [("far", "p", "s", T0 + timedelta(days=300), 90_000), ("new", "p", "other", T0 + timedelta(days=301), 10_900), ("known", "p", "s", T0 + timedelta(days=301), 10_900), ("early", "q", "s", T0, 10**9)]
    df = spark.createDataFrame(rows, "transfer_id string, payer_id string, beneficiary_id string, event_time timestamp_ntz, cents long")
    assert {r["transfer_id"] for r in bl.unusual_transfers(df).collect()} == {"far", "new"}


def test_a_drained_account_is_reported_once(spark):
    rows = [("a", T0 + timedelta(days=15 * i), 1000) for i in range(20)]
    rows += [("a", T0 + timedelta(days=305), -19_500), ("a", T0 + timedelta(days=306), -100), ("b", T0, -5), ("b", T0 + timedelta(days=40), -5), (None, None, 5)]
    df = spark.createDataFrame(rows, "account_id string, event_time timestamp_ntz, cents long")
    got = bl.balance_drains(df).collect()
    assert [(r["account_id"], r["day"], r["balance"]) for r in got] == [("a", T0 + timedelta(days=305), 500)]


def test_a_changed_pattern_is_reported(spark):
    rows = [("a", EPOCH + timedelta(days=18000 + 30 * i + d), c) for i in range(10) for d, c in ((1, 600), (2, -400))]
    rows += [("a", EPOCH + timedelta(days=18300), 10), ("a", EPOCH + timedelta(days=18301), -990)]
    df = spark.createDataFrame(rows, "account_id string, event_time timestamp_ntz, cents long")
    got = bl.pattern_anomalies(df).collect()
    assert [(r["account_id"], r["block_start"], r["debit_share"], r["median"]) for r in got] == [("a", EPOCH + timedelta(days=18300), 990, 400)]


def test_empty_tables(spark):
    assert bl.against_baseline(frame(spark, []), ["k"], "at", "v").count() == 0
    df = spark.createDataFrame([], "account_id string, event_time timestamp_ntz, cents long")
    assert bl.balance_drains(df).count() == 0 and bl.pattern_anomalies(df).count() == 0
