"""Adverse changes and levels of features, and features built only as far as they are named."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.operators import catalogue as cat, signal_catalogue as sc

T0 = datetime(2020, 1, 1)
POLICIES = [("WORSE", "a", "DOWN", 1.0, "HIGH"), ("MORE", "b", "UP", 2.0, "LOW"), ("FAR", "c", "LEVEL", 5, "HIGH"), ("FAR_A", "a", "LEVEL", 9, "LOW")]
ROWS = [
    ("x", 0, "a", 9.0, "VALUE"), ("x", 1, "a", None, "INVALID"), ("x", 2, "a", 8.0, "VALUE"), ("x", 3, "a", 7.5, "VALUE"), ("x", 0, "b", 0.0, "ZERO"), ("x", 1, "b", 2.0, "VALUE"),
    ("x", 0, "c", 5.0, "VALUE"), ("y", 0, "c", 4.9, "VALUE"), (None, 0, "a", 3.0, "VALUE"), (None, 1, "a", 1.0, "VALUE"), ("y", 1, "d", 99.0, "VALUE"), ("z", 1, "c", 7.0, "INVALID"),
]


@pytest.mark.parametrize("bounded", [True, False])
def test_trend(spark, bounded):
    rows = [(e, T0 + timedelta(days=d), f, v, s) for e, d, f, v, s in ROWS]
    df = spark.createDataFrame(rows, "entity_id string, observed_at timestamp_ntz, feature_name string, value double, state string")
    got = sc.trend(df, POLICIES, **({"hot": None} if bounded else {})).collect()
    assert sorted(map(repr, ((r["signal_type"], r["entity_id"], (r["observed_at"] - T0).days, r["value"]) for r in got))) == sorted(map(repr, [
        ("WORSE", "x", 2, 8.0), ("WORSE", None, 1, 1.0), ("MORE", "x", 1, 2.0), ("FAR", "x", 0, 5.0), ("FAR_A", "x", 0, 9.0),
    ]))


def test_features_are_built_as_far_as_they_are_named(spark):
    """The rows of the named features are those of the whole list."""
    quote = [(s, T0 + timedelta(days=d, hours=h), f"q{s}{d}{h}", float(10 + (7 * d + h) % 5), float(d % 3), 1.0) for s in (1, 2) for d in range(0, 40, 3) for h in (1, 2)]
    daily = cat.market_daily(spark.createDataFrame(quote, "security_id int, quote_time timestamp_ntz, quote_id string, price double, yield_pct double, volume double"))
    acts = [(i % 3, i, T0 + timedelta(days=20 * i), "AGENCY_A", "ABBBCCC"[i % 3 : i % 3 + 1]) for i in range(20)]
    acts = spark.createDataFrame(acts, "issuer_id int, action_id int, action_time timestamp_ntz, agency string, rating string")
    sums = ["revenue", "current_assets", "current_liabilities", "quick_assets", "ebitda", "total_debt", "debt_service", "interest_expense", "receivables", "inventory", "payables", "cost_of_goods", "operating_cash_flow", "capital_expenditure"]
    statements = spark.createDataFrame([(c, T0 + timedelta(days=91 * q)) for c in (1, 2) for q in range(6)], "counterparty_id int, period_start timestamp_ntz")
    statements = statements.select("*", *[(F.dayofyear("period_start") % (n + 2) + F.col("counterparty_id")).cast("decimal(20,2)").alias(c) for n, c in enumerate(sums)])
    for build, rows, names in (
        (cat.market_features, daily, {"bond_yield_change_bps_5d", "credit_spread_change_bps_30d"}), (cat.rating_features, acts, {"external_rating_notch_change"}),
        (cat.rating_features, acts, {"external_rating_notch_change_12m", "rating_migration_velocity"}), (cat.statement_ratios, statements, {"dscr", "tol_atnw"}),
        (cat.statement_levels, statements, {"cash_conversion_cycle"}), (cat.statement_changes, statements, {"revenue_yoy_change"}), (cat.statement_changes, statements, set()),
    ):
        want = [r for r in build(rows).collect() if r["feature_name"] in names]
        assert sorted(map(repr, build(rows, names).collect())) == sorted(map(repr, want))
        assert want or not names
    named = cat.market_features(daily, {"bond_yield_change_bps_5d"})._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in named and "max_by" in cat.market_features(daily)._jdf.queryExecution().optimizedPlan().toString()
