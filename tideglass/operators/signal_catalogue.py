"""Signal policies as rows over a few templates.

Thresholds are institution policy; the numbers here are defaults of this library and are meant to
be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideglass.operators.ordered import FIND, rolling, with_previous
from tideglass.sources.reference import values

# (signal, feature, operator, threshold, severity)
THRESHOLD = [
    ("OPERATING_CASH_FLOW_NEGATIVE", "operating_cash_flow", "LT", 0, "HIGH"),
    ("EBITDA_MARGIN_NEGATIVE", "ebitda_margin", "LT", 0, "HIGH"),
    ("REVENUE_MATERIAL_DECLINE", "revenue_yoy_change", "LT", -0.5, "HIGH"),
    ("BOND_PRICE_DISTRESS", "bond_price_drawdown_30d", "GTE", 0.95, "HIGH"),
    ("MARKET_PRICE_SHOCK", "bond_price_drawdown_5d", "GTE", 0.95, "CRITICAL"),
    ("CASH_BALANCE_MATERIAL_DECLINE", "cash_balance_change", "LT", -0.8, "MEDIUM"),
    ("NET_WORTH_EROSION", "tol_atnw", "GTE", 10, "HIGH"),
    ("DEBT_EBITDA_EXCESSIVE", "debt_ebitda", "GTE", 5, "MEDIUM"),
    ("REVENUE_COLLAPSE", "revenue_yoy_change", "LT", -0.9, "CRITICAL"),
]
# (signal, feature, adverse direction, change, severity)
TREND = [
    ("DSCR_DERIORATION", "dscr", "DOWN", 1.0, "HIGH"), ("CURRENT_RATIO_DERIORATION", "current_ratio", "DOWN", 1.0, "MEDIUM"),
    ("LEVERAGE_DERIORATION", "tol_atnw", "UP", 1.0, "HIGH"), ("QUICK_RATIO_DERIORATION", "quick_ratio", "DOWN", 1.0, "MEDIUM"),
    ("DEBT_EBITDA_DERIORATION", "debt_ebitda", "UP", 1.0, "HIGH"),
    ("INTEREST_COVERAGE_DERIORATION", "interest_coverage_ratio", "DOWN", 1.0, "HIGH"),
    ("EBITDA_MARGIN_MATERIAL_DECLINE", "ebitda_margin", "DOWN", 0.5, "HIGH"),
    ("EBITDA_MARGIN_DERIORATION", "ebitda_margin", "DOWN", 0.25, "MEDIUM"),
    ("RECEIVABLE_DAYS_DERIORATION", "receivable_days", "UP", 30, "MEDIUM"),
    ("INVENTORY_DAYS_DERIORATION", "inventory_days", "UP", 30, "MEDIUM"),
    ("CASH_FLOW_PROFIT_DIVERGENCE", "ocf_to_ebitda", "DOWN", 1.0, "MEDIUM"),
    ("CASH_CONVERSION_CYCLE_DIVERGENCE", "cash_conversion_cycle", "UP", 60, "MEDIUM"),
    ("EXTERNAL_RATING_DOWNGRADE", "external_rating_notch_change", "LEVEL", 2, "HIGH"),
    ("MARKET_IMPLIED_CREDIT_STRESS", "credit_spread_change_bps_30d", "LEVEL", 700, "HIGH"),
    ("BOND_YIELD_OR_SPREAD_STRESS", "bond_yield_change_bps_5d", "LEVEL", 700, "MEDIUM"),
    ("BOND_YIELD_MATERIAL_INCREASE", "bond_yield_change_bps_30d", "LEVEL", 750, "MEDIUM"),
]
# (signal, count feature, minimum, severity)
RECURRENCE = [
    ("MANAGEMENT_TURNOVER_CLUSTER", "clustered_key_departures_90d", 3, "HIGH"),
    ("COVENANT_WAIVER_FREQUENCY", "covenant_waiver_count_12m", 2, "HIGH"),
    ("NEW_SECURITY_INTEREST_ACTIVITY", "new_security_interest_count_90d", 2, "MEDIUM"),
    ("AMEND_AND_EXTEND_ACTIVITY", "credit_facility_amendment_count_12m", 3, "MEDIUM"),
    ("REFINANCING_RISK_INCREASE", "maturity_extension_count_24m", 3, "HIGH"),
    ("LEGAL_CREDITOR_PRESSURE", "adverse_legal_notice_count_90d", 2, "HIGH"),
    ("DIRECTOR_OR_OFFICER_FREQUENT_CHANGE", "director_turnover_12m", 3, "MEDIUM"),
    ("AUDITOR_FREQUENT_CHANGE", "auditor_change_count_24m", 3, "HIGH"),
    ("FINANCIAL_RESTATEMENT_MATERIAL", "financial_restatement_count_24m", 3, "HIGH"),
    ("INTERNAL_CONTROL_WEAKNESS", "material_control_weakness_count", 3, "MEDIUM"),
    ("REPEATED_LATE_PAYMENT", "late_payment_count_90d", 3, "MEDIUM"),
    ("TEMPORARY_LIMIT_DEPENDENCY", "temporary_limit_count_90d", 2, "MEDIUM"),
    ("MULTIPLE_LENDER_STRESS", "lender_exit_count_12m", 3, "HIGH"),
    ("LENDER_SUPPORT_WEAKENING", "lender_exit_count_12m", 2, "MEDIUM"),
    ("ADVERSE_NEWS_VELOCITY_SPIKE", "adverse_news_count_90d", 3, "MEDIUM"),
    ("CREDITOR_STRUCTURE_CHANGE", "ucc_amendments_12m", 5, "MEDIUM"),
]
# (signal, kind of event, severity)
STATE = [
    ("LC_DEVOLVEMENT", 24, "HIGH"), ("GUARANTEE_INVOCATION", 25, "HIGH"), ("KEY_MANAGEMENT_RESIGNATION", 1, "MEDIUM"),
    ("CFO_RESIGNATION", 2, "HIGH"), ("AUDITOR_RESIGNATION", 4, "HIGH"), ("MATERIAL_OWNERSHIP_OR_CONTROL_CHANGE", 5, "MEDIUM"),
    ("DEBT_ACCELERATION", 12, "CRITICAL"), ("GROUP_CROSS_DEFAULT", 48, "CRITICAL"), ("FORMAL_INSOLVENCY_PROCEEDING", 14, "CRITICAL"),
    ("FINANCIAL_REPORTING_RELIABILITY_CONCERN", 16, "HIGH"), ("RESTRUCTURING_REQUESTED", 26, "HIGH"),
    ("FORMAL_RESTRUCTURING_EVENT", 27, "CRITICAL"), ("MATERIAL_LITIGATION_FILED", 28, "MEDIUM"),
    ("REGULATORY_ENFORCEMENT_ACTION", 29, "HIGH"), ("STATUTORY_OR_TAX_DEFAULT_DISCLOSED", 30, "HIGH"),
    ("TAX_OR_STATUTORY_ATTACHMENT", 31, "HIGH"), ("COLLATERAL_INSURANCE_LAPSE", 32, "MEDIUM"),
    ("BORROWER_MONITORING_NON_COOPERATION", 33, "MEDIUM"), ("MATERIAL_OWNER_STAKE_REDUCTION", 34, "MEDIUM"),
    ("CONTROLLING_OWNER_PLEDGE_INCREASE", 35, "MEDIUM"), ("GOVERNANCE_ADVERSE_EVENT", 36, "MEDIUM"),
    ("MANAGEMENT_LITIGATION_MATERIAL", 37, "MEDIUM"), ("MANAGEMENT_DEFAULT_ASSOCIATION", 38, "HIGH"),
    ("SCHEDULED_OBLIGATION_MISSED", 40, "HIGH"), ("INTEREST_SERVICING_DELAY", 41, "MEDIUM"),
    ("INTERNAL_RATING_DOWNGRADE", 43, "MEDIUM"), ("FACILITY_RENEWAL_OR_REVIEW_DELAY", 45, "LOW"),
    ("SECURITY_CREATION_DELAY", 46, "MEDIUM"), ("SECURITY_PERFECTION_DELAY", 49, "MEDIUM"),
    ("DEVOLVED_OR_INVOKED_OBLIGATION_UNPAID", 50, "HIGH"), ("REPUTATIONAL_CONTROVERSY", 47, "LOW"),
    ("FINANCIAL_STATEMENT_DELAY", 51, "LOW"), ("ADVERSE_NEWS_MATERIAL", 52, "MEDIUM"), ("REQUIRED_MONITORING_INFORMATION_DELAY", 53, "MEDIUM"),
    ("DRAWING_POWER_REDUCTION", 54, "MEDIUM"),
]

COLUMNS = ["signal_type", "entity_id", "observed_at", "value", "severity"]


def _policies(features: DataFrame, rows: list[tuple], columns: list[str]) -> DataFrame:
    return values(features.sparkSession, ["signal_type", "feature_name", *columns], rows)


def threshold(features: DataFrame, rows=THRESHOLD) -> DataFrame:
    """value op threshold on usable values."""
    p = _policies(features, [(s, f, o, float(x), v) for s, f, o, x, v in rows], ["op", "threshold", "severity"])
    v, th = F.col("value"), F.col("threshold").cast("double")
    hit = F.when(F.col("op") == "LT", v < th).when(F.col("op") == "LTE", v <= th).when(F.col("op") == "GT", v > th).otherwise(v >= th)
    return features.filter(F.col("state").isin("VALUE", "ZERO")).join(p, "feature_name").filter(hit).select(*COLUMNS)


def trend(features: DataFrame, rows=TREND, hot: DataFrame | str | None = FIND) -> DataFrame:
    """Adverse change to the last usable value of the entity, or a change feature beyond its level, which needs no earlier value.

    ``hot``: hot (entity, feature) of the adverse changes, None where the calendar bounds them.
    """
    p = _policies(features, [(s, f, d, float(x), v) for s, f, d, x, v in rows], ["direction", "change", "severity"])
    named = lambda level: sorted({r[1] for r in rows if (r[2] not in ("UP", "DOWN")) == level})
    usable = features.filter(F.col("state").isin("VALUE", "ZERO"))
    moved = with_previous(usable.filter(F.col("feature_name").isin(named(False))), ["entity_id", "feature_name"], "observed_at", [], {"previous": "value"}, days=365, hot=hot)
    v, b, x, d = F.col("value"), F.col("previous"), F.col("change").cast("double"), F.col("direction")
    fell_or_rose = F.when(d == "UP", v - b >= x).when(d == "DOWN", b - v >= x)
    far = usable.filter(F.col("feature_name").isin(named(True))).join(p.filter(~d.isin("UP", "DOWN")), "feature_name").filter(v >= x)
    return moved.join(p, "feature_name").filter(fell_or_rose).select(*COLUMNS).unionByName(far.select(*COLUMNS))


def spike(points: DataFrame, keys: list[str], ts: str, value: str, days: int, factor: float, minimum: int) -> DataFrame:
    """Value at or above factor x the mean of the look-back before it, which needs enough points."""
    rows = rolling(points, keys, ts, days, {"_n": ("count", value), "_s": ("sum", value)}, max(1, days // 30), include_current=False)
    base = F.col("_s").cast("double") / F.col("_n")
    return rows.filter((F.col("_n") >= minimum) & (F.col(value).cast("double") >= factor * base)).withColumn("baseline", base).drop("_n", "_s")


def recurrence(counts: DataFrame, rows=RECURRENCE) -> DataFrame:
    p = _policies(counts, rows, ["minimum", "severity"])
    return counts.join(p, "feature_name").filter(F.col("value") >= F.col("minimum")).select(*COLUMNS)


def state(events: DataFrame, rows=STATE) -> DataFrame:
    p = values(events.sparkSession, ["signal_type", "kind_no", "severity"], rows)
    return events.join(p, "kind_no").select(
        "signal_type", F.col("counterparty_id").alias("entity_id"), F.col("event_time").alias("observed_at"), "event_id", "severity"
    )


def zscore(rows: DataFrame, z: str, limit: float, signal: str, liquid=None) -> DataFrame:
    """|z| beyond the limit, only where the quality gate lets the figure count."""
    gate = F.lit(True) if liquid is None else liquid
    return rows.filter((F.abs(F.col(z)) >= limit) & gate).withColumn("signal_type", F.lit(signal))


# (signal, series, direction, relative change, severity)
SERIES = [
    ("REGIONAL_ECONOMIC_STRESS", "revenue_by_market", "DOWN", 0.02, "MEDIUM"),
    ("COMMODITY_INPUT_PRICE_SHOCK", "price_by_type", "UP", 0.02, "MEDIUM"),
    ("INTEREST_RATE_SENSITIVITY_STRESS", "yield", "UP", 0.001, "LOW"),
    ("FX_EXPOSURE_STRESS", "flow_by_nation", "DOWN", 0.1, "LOW"),
]


def series_stress(series: DataFrame, rows=SERIES) -> DataFrame:
    """Relative change of sector and macro series to the period before, beyond a level.

    ``series`` has one row per (series, member, period).
    """
    p = values(series.sparkSession, ["signal_type", "series", "direction", "level", "severity"], [(s, n, d, float(x), v) for s, n, d, x, v in rows])
    moved = with_previous(series, ["series", "member"], "period", [], {"before": "total"}, days=3650)
    change = (F.col("total").cast("double") - F.col("before").cast("double")) / F.col("before").cast("double")
    adverse = F.when(F.col("direction") == "UP", F.col("change")).otherwise(-F.col("change"))
    out = moved.filter("before > 0").withColumn("change", change).join(p, "series").filter(adverse >= F.col("level").cast("double"))
    return out.select("signal_type", "member", "period", "change", "severity")


def document_integrity(reconciled: DataFrame, factor: float) -> DataFrame:
    """Figures that two sources do not share; a suspicion for review, never a finding."""
    a, b, r = F.col("value_a"), F.col("value_b"), F.col("reconciliation")
    kind = (
        F.when(r == "MISSING_B", "INVOICE_FABRICATION_SUSPECTED").when(r == "MISSING_A", "INVENTORY_OR_BORROWING_BASE_INCONSISTENCY")
        .when((r == "CONFLICTED") & (a >= b * factor), "TURNOVER_OVERSTATEMENT_SUSPECTED")
        .when((r == "CONFLICTED") & (b >= a * factor), "RECEIVABLE_OR_DEBTOR_DATA_ANOMALY")
        .when(r == "CONFLICTED", "FINANCIAL_DOCUMENT_INCONSISTENCY")
    )
    return reconciled.withColumn("signal_type", kind).filter("signal_type IS NOT NULL").withColumn("requires_review", F.lit(True))


# (signal, share of a payer's outflow, level); diversion and end-use mismatch of single drawings are traced in ``tracing``
FLOW = [
    ("FUND_DIVERSION_SUSPECTED", "related_share", 0.10), ("RELATED_PARTY_DIVERSION_PATTERN", "related_share", 0.15),
    ("FUND_SIPHONING_SUSPECTED", "distressed_share", 0.25), ("SHELL_ENTITY_EXPOSURE_SUSPECTED", "distressed_share", 0.35),
    ("OUTSIDE_AGREED_ROUTING_ANOMALY", "outside_share", 0.90), ("END_USE_MISMATCH_SUSPECTED", "outside_share", 0.95),
]


def flow_patterns(flows: DataFrame, rows=FLOW) -> DataFrame:
    """Shares of outflow by purpose against levels. ``flows`` has payer_id, amount and the three marks."""
    part = lambda mark: F.sum(F.when(F.col(mark), F.col("amount")).otherwise(0)).cast("double") / F.sum("amount").cast("double")
    per = flows.groupBy("payer_id").agg(
        part("related_party").alias("related_share"), part("distressed").alias("distressed_share"), part("outside").alias("outside_share")
    )
    hits = F.array(*[F.when(F.col(share) >= level, F.lit(signal)) for signal, share, level in rows])
    return per.select("payer_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("signal_type"))
