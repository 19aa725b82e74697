"""Domain views over the given tables.

Each view is one SQL text that Spark and an ANSI engine read the same way. Ids use integers and
dates only, money is cast to DECIMAL(20,2) before any arithmetic.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SQL_VIEWS: dict[str, str] = {
    "b_payment_returned": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS event_id,
       l_suppkey AS account_id, l_shipdate AS event_time,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS amount,
       CASE l_returnflag WHEN 'R' THEN 'FINANCIAL' WHEN 'A' THEN 'TECHNICAL' ELSE 'BENEFICIARY_DETAIL' END
         AS return_reason_category
FROM lineitem""",
    "b_dpd_changed": """
SELECT event_id, ts AS event_time, user_id AS facility_id, user_id % 50 AS counterparty_id,
       CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value) AS INT) % 121 END AS current_dpd,
       event_type <> 'error' AS reconciled
FROM events""",
    "b_limit_changed": """
SELECT o_custkey AS facility_id, o_orderkey AS event_id, o_orderdate AS effective_at,
       CAST(o_totalprice AS DECIMAL(20,2)) AS limit_amount
FROM orders""",
    "b_outstanding_changed": """
SELECT o.o_custkey AS facility_id,
       concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_shipdate AS DATE)) AS event_id,
       l.l_shipdate AS effective_at, CAST(l.l_extendedprice * 5 AS DECIMAL(20,2)) AS outstanding
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "b_counterparty": """
SELECT c.c_custkey AS counterparty_id, c.c_mktsegment AS segment, n.n_name AS jurisdiction, r.r_name AS market,
       CAST(c.c_acctbal AS DECIMAL(20,2)) AS net_position, c.c_acctbal < 0 AS distressed
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "b_transfer": """
SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_shipdate AS DATE)) AS transfer_id,
       o.o_custkey AS payer_id, l.l_suppkey AS beneficiary_id, l.l_shipdate AS event_time,
       CAST(l.l_extendedprice AS DECIMAL(20,2)) AS amount, c.c_nationkey = s.s_nationkey AS related_party
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    # Money of an account: what it draws comes in, what it pays goes out.
    "b_movement": """
SELECT o_custkey AS account_id, o_orderdate AS event_time, CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 100 AS BIGINT) AS cents FROM orders
UNION ALL SELECT payer_id, event_time, CAST(-amount * 100 AS BIGINT) FROM b_transfer""",
    # Time-ordered payments between accounts: customers pay suppliers, a supplier hands half on to the next line's one, and refunds.
    "b_account_flow": """
SELECT concat('T-', transfer_id) AS flow_id, concat('C', payer_id) AS src, concat('S', beneficiary_id) AS dst, event_time AS paid_at, CAST(amount * 100 AS BIGINT) AS cents FROM b_transfer
UNION ALL
SELECT concat('R-', transfer_id), concat('S', beneficiary_id), concat('C', payer_id), event_time + INTERVAL 10 DAY, CAST(floor(amount * 25) AS BIGINT) FROM b_transfer WHERE NOT related_party
UNION ALL
SELECT concat_ws('-', 'H', a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, CAST(a.l_shipdate AS DATE), z.l_partkey, z.l_suppkey, CAST(z.l_shipdate AS DATE)), concat('S', a.l_suppkey), concat('S', z.l_suppkey),
       a.l_shipdate + INTERVAL 5 DAY, CAST(floor(CAST(a.l_extendedprice AS DECIMAL(20,2)) * 50) AS BIGINT)
FROM lineitem a JOIN lineitem z ON a.l_orderkey = z.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> z.l_suppkey""",
    # Drawings of a borrower, the suppliers each may pay, and where an account is at home.
    "b_drawing": """
SELECT concat('D', o_orderkey) AS drawing_id, concat('C', o_custkey) AS account, o_orderdate AS paid_at, CAST(CAST(o_totalprice AS DECIMAL(20,2)) * 100 AS BIGINT) AS cents FROM orders""",
    "b_agreed_use": """
SELECT DISTINCT concat('D', l_orderkey) AS drawing_id, concat('S', l_suppkey) AS dst FROM lineitem""",
    "b_account_home": """
SELECT concat('C', c_custkey) AS account, c_nationkey AS home FROM customer UNION ALL SELECT concat('S', s_suppkey), s_nationkey FROM supplier""",
    # Related parties' money: payments to suppliers, refunds to their payers, and what one supplier of an order hands to the next.
    "b_related_flow": """
SELECT concat('C', payer_id) AS src, concat('S', beneficiary_id) AS dst, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM b_transfer WHERE related_party GROUP BY 1, 2
UNION ALL
SELECT concat('S', l.l_suppkey), concat('C', o.o_custkey), CAST(sum(CAST(l.l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(38,2))
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY 1, 2
UNION ALL
SELECT concat('S', a.l_suppkey), concat('S', z.l_suppkey), CAST(sum(CAST(a.l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(38,2))
FROM lineitem a JOIN lineitem z ON a.l_orderkey = z.l_orderkey AND z.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> z.l_suppkey GROUP BY 1, 2""",
    "b_feature_history": """
SELECT event_id, user_id AS facility_id, ts AS effective_at, 1 AS revision,
       ts + INTERVAL 1 HOUR * CAST(event_id % 72 AS INT) AS knowledge_time, CAST(floor(value) AS INT) % 121 AS value_numeric
FROM events
UNION ALL
SELECT event_id, user_id, ts, 2, ts + INTERVAL 1 HOUR * CAST(event_id % 72 + 120 AS INT), CAST(floor(value) AS INT) % 121 + 5
FROM events WHERE event_id % 20 = 0""",
    "b_disposition": """
SELECT doc_id AS signal_no, CASE WHEN toxic = 1 THEN 'MARK_FALSE_POSITIVE' WHEN quality = 1 THEN 'ACCEPT' ELSE 'REJECT' END AS decision
FROM labels""",
    "b_evidence": """
SELECT doc_id AS evidence_id, source AS source_system, lang AS language, n_chars, text FROM documents""",
    # Quarterly statements: sums of a customer's orders by status and priority stand for the lines
    # of the balance sheet and the income statement.
    "b_statement": """
SELECT o_custkey AS counterparty_id, date_trunc('quarter', o_orderdate) AS period_start,
       max(o_orderdate) AS received_at,
       sum(CAST(o_totalprice AS DECIMAL(20,2))) AS revenue,
       sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS current_assets,
       sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS current_liabilities,
       sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS quick_assets,
       sum(CASE WHEN o_orderpriority = '1-URGENT' THEN -CAST(o_totalprice AS DECIMAL(20,2))
                ELSE CAST(o_totalprice AS DECIMAL(20,2)) END) AS ebitda,
       sum(CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS total_debt,
       sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS debt_service,
       sum(CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS interest_expense,
       sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS receivables,
       sum(CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS inventory,
       sum(CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS payables,
       sum(CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS cost_of_goods,
       sum(CASE WHEN o_orderstatus = 'P' THEN -CAST(o_totalprice AS DECIMAL(20,2))
                ELSE CAST(o_totalprice AS DECIMAL(20,2)) END) AS operating_cash_flow,
       sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS capital_expenditure
FROM orders GROUP BY o_custkey, date_trunc('quarter', o_orderdate)""",
    "b_rating_action": """
SELECT o_custkey AS issuer_id, o_orderkey AS action_id, o_orderdate AS action_time,
       CASE o_orderstatus WHEN 'F' THEN 'AGENCY_A' WHEN 'O' THEN 'AGENCY_B' ELSE 'AGENCY_C' END AS agency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CCC' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'BB'
            WHEN '4-NOT SPECIFIED' THEN 'BBB' ELSE 'A' END AS rating,
       CASE o_orderkey % 3 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'STABLE' ELSE 'POSITIVE' END AS outlook,
       o_orderkey % 7 = 0 AS on_watch
FROM orders""",
    # Corporate events: one line is one event, the part number selects its kind.
    "b_corporate_event": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS event_id,
       l_suppkey AS counterparty_id, l_shipdate AS event_time, CAST(l_partkey % 55 AS INT) AS kind_no,
       l_orderkey % 9 AS party_no, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount
FROM lineitem""",
    "b_market_quote": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS quote_id,
       l_suppkey AS security_id, l_shipdate AS quote_time,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS price,
       CAST(100 * l_tax + 10 * l_discount AS DECIMAL(10,4)) AS yield_pct,
       CAST(l_quantity AS DECIMAL(20,2)) AS volume
FROM lineitem""",
    "b_relationship": """
SELECT o.o_custkey AS owner_id, l.l_suppkey AS owned_id,
       CASE WHEN l.l_quantity >= 46 THEN 'CONTROL'
            WHEN l.l_returnflag = 'R' THEN 'GUARANTEE' ELSE 'TRADE' END AS edge_type,
       l.l_shipdate AS valid_from, l.l_shipdate + INTERVAL 365 DAY AS valid_to,
       CAST(l.l_quantity / 50 AS DECIMAL(6,4)) AS confidence
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    # Holdings in parts of ten thousand: customers hold suppliers, and suppliers hold customers back, so there are circles.
    "b_holding": """
SELECT concat('C', owner_id) AS src, concat('S', owned_id) AS dst, CAST(confidence * 500 AS BIGINT) AS weight, valid_from, valid_to FROM b_relationship WHERE edge_type = 'CONTROL'
UNION ALL SELECT concat('S', owned_id), concat('C', owner_id), CAST(confidence * 10000 AS BIGINT), valid_from, valid_to FROM b_relationship WHERE confidence <= 0.1""",
    # What a party depends on the other of a relation, by kind and strength; both ways.
    "b_dependency": """
SELECT concat('C', owner_id) AS src, concat('S', owned_id) AS dst, CAST(confidence * 100 AS BIGINT) * CASE edge_type WHEN 'CONTROL' THEN 5 ELSE 4 END AS weight, valid_from, valid_to FROM b_relationship WHERE edge_type IN ('CONTROL','GUARANTEE')
UNION ALL SELECT concat('S', owned_id), concat('C', owner_id), CAST(confidence * 100 AS BIGINT) * CASE edge_type WHEN 'CONTROL' THEN 5 ELSE 4 END, valid_from, valid_to FROM b_relationship WHERE edge_type IN ('CONTROL','GUARANTEE')""",
    # Contributors to hypotheses: a line is one detection about the counterparty named by its supplier.
    "b_contributor": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS contributor_id,
       l_suppkey AS counterparty_id, l_shipdate AS effective_at,
       CASE WHEN l_discount = 0.1 THEN 'PAYMENT_CURED' WHEN l_returnflag = 'R' THEN 'REPEATED_PAYMENT_RETURN'
            WHEN l_returnflag = 'A' THEN 'DPD_DERIORATION' WHEN l_linestatus = 'O' THEN 'UTILIZATION_HIGH'
            ELSE 'UTILIZATION_SPIKE' END AS analytical_type,
       CASE WHEN l_quantity > 45 THEN 'CRITICAL' WHEN l_quantity > 30 THEN 'HIGH' WHEN l_quantity > 15 THEN 'MEDIUM'
            WHEN l_quantity > 5 THEN 'LOW' ELSE 'INFO' END AS severity,
       CAST(CAST(100 - 7 * floor(l_discount * 100 + 0.5) AS INT) AS DECIMAL(6,2)) / 100 AS confidence,
       concat('L-', l_partkey % 37) AS lineage_group,
       CASE WHEN l_tax = 0.08 THEN 'REJECTED' WHEN l_tax = 0.07 THEN 'CLOSED' ELSE 'PROPOSED' END AS status,
       CASE WHEN l_tax = 0.04 THEN 'FALSE_POSITIVE' ELSE '' END AS disposition_tag,
       CASE WHEN l_tax = 0.05 THEN 'STALE' WHEN l_tax = 0.06 THEN 'INSUFFICIENT' ELSE 'COMPLETE' END AS quality_state
FROM lineitem""",
    # Policy versions: an order is one version of the policy named by its customer.
    "b_policy_version": """
SELECT concat('POL-', o_custkey) AS policy_key, o_orderkey AS version_no, 'REFERENCE_INSTITUTION' AS institution_id,
       CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'P' THEN 'APPROVED' ELSE 'DRAFT' END AS lifecycle,
       CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN 'IN' WHEN '3-MEDIUM' THEN 'IN,GB'
            WHEN '4-NOT SPECIFIED' THEN 'US' ELSE 'GB,US' END AS jurisdictions,
       o_orderdate AS effective_from,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS TIMESTAMP)
            ELSE o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 120 - 10 AS INT) END AS effective_to,
       CAST(floor(o_totalprice / 1000) AS INT) AS warning_value, CAST(o_orderkey % 400 AS INT) AS high_value,
       concat('maker-', o_custkey % 7) AS created_by,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('maker-', o_orderkey % 7) END AS approved_by,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('SIM-', o_orderkey) END AS simulation_run_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'NATIVE' WHEN 1 THEN 'DMN' WHEN 2 THEN 'DROOLS' ELSE 'NATIVE' END AS engine,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('artifact-', o_orderkey) END AS artifact_ref,
       CASE o_orderkey % 6 WHEN 0 THEN 'CLASSIFICATION_CANDIDATE' ELSE 'SIGNAL_CANDIDATE' END AS outcome_type,
       CASE o_orderkey % 5 WHEN 0 THEN 'JURISDICTION_EXTENSION' WHEN 1 THEN 'GLOBAL_CORE'
            ELSE 'INSTITUTION_POLICY_SPECIFIC' END AS semantic_scope
FROM orders""",
    # Policy rules: a line is one rule of the version named by its order.
    "b_policy_rule": """
SELECT l_orderkey AS version_no, concat('R-', l_linenumber) AS rule_id, CAST(l_quantity AS INT) * 10 AS priority,
       l_returnflag <> 'A' AS enabled,
       CASE l_linenumber WHEN 1 THEN 'PRIORITY' WHEN 2 THEN 'PRIORITY' WHEN 3 THEN 'FIRST_MATCH' ELSE 'ALL_MATCHES' END AS mode,
       CASE l_partkey % 5 WHEN 0 THEN 'current_dpd' WHEN 1 THEN 'utilization_ratio' WHEN 2 THEN 'returned_payment_count_30d'
            WHEN 3 THEN 'max_dpd_30d' ELSE 'current_dpd' END AS feature_name,
       CASE l_suppkey % 4 WHEN 0 THEN 'REPEATED_PAYMENT_RETURN' WHEN 1 THEN 'DPD_DERIORATION' WHEN 2 THEN 'UTILIZATION_HIGH'
            ELSE 'HIGH_UTILIZATION' END AS signal_code,
       CASE l_partkey % 3 WHEN 0 THEN 'LIQUIDITY' WHEN 1 THEN 'REPAYMENT_CONDUCT' ELSE 'LIQUIDITY_RISK' END AS risk_dimension,
       CASE l_partkey % 4 WHEN 0 THEN 'WARNING_LIMIT' ELSE 'HIGH_LIMIT' END AS parameter_name,
       CASE WHEN l_tax = 0 THEN 'COUNTERPARTY' ELSE 'FACILITY' END AS policy_grain
FROM lineitem""",
}


def with_views(sql: str) -> str:
    """Prefix the SQL with the definitions of every bound view it names, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bb_\w+", text):
            if name in SQL_VIEWS and name not in ordered:
                visit(SQL_VIEWS[name])
                ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS (\n{SQL_VIEWS[name].strip()}\n)" for name in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Given tables and the views above, each read or planned on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL that names given tables or bound views."""
        full = with_views(text)
        names = "|".join(BASE_TABLES)
        for name in sorted({m[1] for m in re.findall(rf"\b(FROM|JOIN)\s+({names})\b", full)}):
            self.base(name).createOrReplaceTempView(f"tg_{name}")
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 tg_\2", full))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    payment_returned = cached_property(lambda self: self.view("b_payment_returned"))
    dpd_changed = cached_property(lambda self: self.view("b_dpd_changed"))
    limit_changed = cached_property(lambda self: self.view("b_limit_changed"))
    outstanding_changed = cached_property(lambda self: self.view("b_outstanding_changed"))
    counterparty = cached_property(lambda self: self.view("b_counterparty"))
    transfer = cached_property(lambda self: self.view("b_transfer"))
    movement = cached_property(lambda self: self.view("b_movement"))
    account_flow = cached_property(lambda self: self.view("b_account_flow"))
    drawing = cached_property(lambda self: self.view("b_drawing"))
    agreed_use = cached_property(lambda self: self.view("b_agreed_use"))
    account_home = cached_property(lambda self: self.view("b_account_home"))
    related_flow = cached_property(lambda self: self.view("b_related_flow"))
    feature_history = cached_property(lambda self: self.view("b_feature_history"))
    disposition = cached_property(lambda self: self.view("b_disposition"))
    evidence = cached_property(lambda self: self.view("b_evidence"))
    statement = cached_property(lambda self: self.view("b_statement"))
    rating_action = cached_property(lambda self: self.view("b_rating_action"))
    corporate_event = cached_property(lambda self: self.view("b_corporate_event"))
    market_quote = cached_property(lambda self: self.view("b_market_quote"))
    relationship = cached_property(lambda self: self.view("b_relationship"))
    holding = cached_property(lambda self: self.view("b_holding"))
    dependency = cached_property(lambda self: self.view("b_dependency"))
    contributor = cached_property(lambda self: self.view("b_contributor"))
    policy_version = cached_property(lambda self: self.view("b_policy_version"))
    policy_rule = cached_property(lambda self: self.view("b_policy_rule"))
