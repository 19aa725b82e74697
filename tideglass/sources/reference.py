"""Small governed reference tables, as literal rows.

Fixed values: registries, routes, aliases, ordered scales. All are literal and hence of known size,
so Catalyst may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def values(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Literal rows as a local relation whose size the optimizer knows."""
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows)} AS t({', '.join(columns)})")


def values_sql(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


RISK_DIMENSIONS = [
    "LIQUIDITY", "LEVERAGE_SOLVENCY", "PROFITABILITY_OPERATING_PERFORMANCE", "CASH_FLOW_DEBT_SERVICE",
    "REPAYMENT_CONDUCT", "COVENANT_DOCUMENTATION", "COLLATERAL_SECURITY", "REFINANCING_FUNDING",
    "MANAGEMENT_GOVERNANCE", "FRAUD_INTEGRITY", "EXTERNAL_MARKET_REPUTATION", "LEGAL_REGULATORY",
    "RELATIONSHIP_GROUP_CONTAGION", "SECTOR_MACRO",
]

# (feature, semantic scope, grain)
FEATURE_REGISTRY = [
    ("returned_payment_count_30d", "GLOBAL_CORE", "COUNTERPARTY"),
    ("current_dpd", "GLOBAL_PRODUCT_SPECIFIC", "COUNTERPARTY"),
    ("utilization_ratio", "GLOBAL_PRODUCT_SPECIFIC", "FACILITY"),
]

# (signal, status)
SIGNAL_REGISTRY = [
    ("REPEATED_PAYMENT_RETURN", "ACTIVE"), ("DPD_DERIORATION", "ACTIVE"), ("UTILIZATION_HIGH", "ACTIVE"),
    ("UTILIZATION_SPIKE", "ACTIVE"),
]

HYPOTHESIS_REGISTRY = [("EMERGING_LIQUIDITY_STRESS", "ACTIVE")]

# (deprecated name, canonical name, kind, treatment)
ALIASES = [
    ("TOL_ATNW_DERIORATION", "LEVERAGE_DERIORATION", "signal", "specialization"),
    ("EMI_OR_INSTALLMENT_MISSED", "SCHEDULED_OBLIGATION_MISSED", "signal", "subtype"),
    ("BG_INVOCATION", "GUARANTEE_INVOCATION", "signal", "rename"),
    ("ADHOC_LIMIT_DEPENDENCY", "TEMPORARY_LIMIT_DEPENDENCY", "signal", "rename"),
    ("GROUP_ENTITY_TRANSFER_SPIKE", "RELATED_ENTITY_TRANSFER_SPIKE", "signal", "rename"),
    ("OUTSIDE_BANK_ROUTING_ANOMALY", "OUTSIDE_AGREED_ROUTING_ANOMALY", "signal", "rename"),
    ("STOCK_STATEMENT_DELAY", "REQUIRED_MONITORING_INFORMATION_DELAY", "signal", "policy-subtype"),
    ("STOCK_AUDIT_NON_COOPERATION", "BORROWER_MONITORING_NON_COOPERATION", "signal", "subtype"),
    ("SITE_VISIT_NON_COOPERATION", "BORROWER_MONITORING_NON_COOPERATION", "signal", "subtype"),
    ("DEBTOR_LIST_ANOMALY", "RECEIVABLE_OR_DEBTOR_DATA_ANOMALY", "signal", "rename"),
    ("STOCK_STATEMENT_INCONSISTENCY", "INVENTORY_OR_BORROWING_BASE_INCONSISTENCY", "signal", "normalize"),
    ("SANCTION_TERM_MISUSE_SUSPECTED", "FINANCING_TERM_MISUSE_SUSPECTED", "signal", "rename"),
    ("PROMOTER_EXIT_OR_STAKE_REDUCTION", "MATERIAL_OWNER_STAKE_REDUCTION", "signal", "map"),
    ("PROMOTER_PLEDGE_INCREASE", "CONTROLLING_OWNER_PLEDGE_INCREASE", "signal", "map"),
    ("PROMOTER_LINKED_DISTRESS", "CONTROLLING_OWNER_LINKED_DISTRESS", "signal", "map"),
    ("DIRECTOR_DEFAULT_ASSOCIATION", "MANAGEMENT_DEFAULT_ASSOCIATION", "signal", "normalize"),
    ("INSOLVENCY_PROCEEDING_FILED", "FORMAL_INSOLVENCY_PROCEEDING", "signal", "normalize"),
    ("BANKRUPTCY_FILED", "FORMAL_INSOLVENCY_PROCEEDING", "signal", "normalize"),
    ("trade_finance.bg.invoked", "trade_finance.guarantee.invoked", "event", "rename"),
]
DEPRECATED_PREFIXES = ["PROMOTER_"]
PROHIBITED_SIGNAL_TYPES = [
    "ANALYTICAL_EWS", "IN_SMA_NPA", "US_SUPERVISORY_CLASSIFICATION", "US_ACCRUAL_STATUS", "US_CECL", "UK_SICR",
    "UK_IFRS9_STAGE", "UK_PRUDENTIAL_DEFAULT", "UK_IRB",
]

# (retention class, days kept)
RETENTION = [("R1", 7), ("R2", 14), ("R3", 30)]

# Kinds of corporate events: number, name, topic family.
CORPORATE_EVENT_KINDS = [
    (0, "KEY_MANAGEMENT_CHANGE", "governance"), (1, "KEY_MANAGEMENT_DEPARTURE", "governance"),
    (2, "CFO_CHANGE", "governance"), (3, "DIRECTOR_CHANGE", "governance"), (4, "AUDITOR_CHANGE", "governance"),
    (5, "OWNERSHIP_CONTROL_CHANGE", "governance"), (6, "FACILITY_AMENDMENT", "funding"),
    (7, "COVENANT_WAIVER", "funding"), (8, "MATURITY_EXTENSION", "funding"), (9, "SECURITY_INTEREST", "funding"),
    (10, "SECURITY_INTEREST_RELEASE", "funding"), (11, "DEBT_DEFAULT_DISCLOSURE", "legal"),
    (12, "DEBT_ACCELERATION", "legal"), (13, "ADVERSE_LEGAL_NOTICE", "legal"), (14, "INSOLVENCY_START", "legal"),
    (15, "INSOLVENCY_END", "legal"), (16, "NON_RELIANCE", "reporting"), (17, "CONTROL_WEAKNESS", "reporting"),
    (18, "RESTATEMENT", "reporting"), (19, "ACCOUNTS_FILED", "reporting"), (20, "PROFIT_WARNING", "reporting"),
    (21, "GUIDANCE_REVISION", "reporting"), (22, "REGISTERED_OFFICE_CHANGE", "registry"),
    (23, "STATUS_CHANGE", "registry"), (24, "LC_DEVOLVED", "trade"), (25, "GUARANTEE_INVOKED", "trade"),
    (26, "RESTRUCTURING_REQUEST", "conduct"), (27, "FORMAL_RESTRUCTURING", "legal"), (28, "LITIGATION_FILED", "legal"),
    (29, "ENFORCEMENT_ACTION", "legal"), (30, "TAX_DEFAULT_DISCLOSED", "legal"), (31, "TAX_ATTACHMENT", "legal"),
    (32, "INSURANCE_LAPSE", "collateral"), (33, "MONITORING_REFUSED", "monitoring"), (34, "STAKE_REDUCTION", "governance"),
    (35, "OWNER_PLEDGE", "governance"), (36, "GOVERNANCE_EVENT", "governance"), (37, "MANAGEMENT_LITIGATION", "governance"),
    (38, "MANAGEMENT_DEFAULT_LINK", "governance"), (39, "LATE_PAYMENT", "conduct"), (40, "OBLIGATION_MISSED", "conduct"),
    (41, "INTEREST_DELAY", "conduct"), (42, "TEMPORARY_LIMIT_USED", "conduct"), (43, "INTERNAL_DOWNGRADE", "conduct"),
    (44, "LENDER_EXIT", "funding"), (45, "RENEWAL_DELAY", "monitoring"), (46, "SECURITY_DELAY", "collateral"),
    (47, "ADVERSE_NEWS", "news"),
]
