"""Rule policies over utilisation, DPD and payment features."""

from dataclasses import replace

from pyspark.sql import functions as F

from tideglass.functions.scalars import usable_dpd, value_state
from tideglass.operators import features as feat, policy as pol, policy_windows as pw
from tideglass.operators.ordered import hot_keys
from tideglass.plans.sqltext import DPD_FEATURES, PAYMENT_POINTS, UTILIZATION
from tideglass.plans.utilization import util
from tideglass.registry import query
from tideglass.sources.reference import values, values_sql


def dpd_rows(t):
    usable = usable_dpd(F.col("current_dpd"), F.col("reconciled"))
    return t.dpd_changed.withColumn("current_dpd_state", value_state(F.col("current_dpd"), usable))


def util_rows(t):
    return util(t).withColumn("utilization_ratio_state", F.col("state"))


def payment_rows(t):
    p = feat.returned_payment_points(t.payment_returned)
    return p.withColumn("returned_payment_count_30d", F.col("return_count")).withColumn("returned_payment_count_30d_state", F.lit("VALUE"))


def flat(df, *cols):
    return df.select(
        *cols, F.col("result.status").alias("status"), F.coalesce("result.rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("result.severity", F.lit("")).alias("severity"),
    )


TREE = {
    "any": [
        {"all": [
            {"left": {"feature": "utilization_ratio"}, "operator": "BETWEEN", "right": {"literal": [0.5, 0.9]}},
            {"not": {"left": {"feature": "facility_id"}, "operator": "IN", "right": {"literal": [1, 2, 3]}}},
        ]},
        {"left": {"feature": "utilization_ratio"}, "operator": "IS_NULL"},
        {"left": {"feature": "utilization_ratio"}, "operator": "GT", "right": {"parameter": "LIMIT"}},
    ]
}


@query(
    "policy_compile",
    f"""WITH {UTILIZATION}, m AS (SELECT event_id, (utilization_ratio BETWEEN 0.5 AND 0.9 AND facility_id NOT IN (1,2,3)) OR utilization_ratio IS NULL OR utilization_ratio > 3 AS hit FROM util)
SELECT coalesce(hit, false) AS hit, count(*) AS n FROM m GROUP BY 1""",
)
def _(t):
    rows = util_rows(t).withColumn("facility_id_state", F.lit("VALUE"))
    hit = pol.Compiler({"LIMIT": 3}).condition(TREE)
    return rows.groupBy(F.coalesce(hit, F.lit(False)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


UTIL_CASE = """CASE WHEN state NOT IN ('VALUE','ZERO') THEN 'INSUFFICIENT_EVIDENCE' WHEN utilization_ratio >= {lo} THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status,
  CASE WHEN utilization_ratio >= {hi} THEN 'R-UTL-001' WHEN utilization_ratio >= {lo} THEN 'R-UTL-002' ELSE '' END AS rule_id,
  CASE WHEN utilization_ratio >= {hi} THEN 'HIGH' WHEN utilization_ratio >= {lo} THEN 'MEDIUM' ELSE '' END AS severity"""
DPD_CASE = """CASE WHEN NOT usable THEN '{missing}' WHEN current_dpd >= 15 THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status,
  CASE WHEN NOT usable THEN '' WHEN current_dpd >= 30 THEN 'R-DPD-001' WHEN current_dpd >= 15 THEN 'R-DPD-002' ELSE '' END AS rule_id,
  CASE WHEN NOT usable THEN '' WHEN current_dpd >= 30 THEN 'HIGH' WHEN current_dpd >= 15 THEN 'MEDIUM' ELSE '' END AS severity"""


@query("policy_eval_priority", f"WITH {UTILIZATION} SELECT event_id, {UTIL_CASE.format(lo=0.85, hi=0.95)} FROM util")
def _(t):
    return flat(pol.evaluate(util_rows(t), pol.HIGH_UTILIZATION), "event_id")


@query("policy_eval_first_match", f"WITH {DPD_FEATURES} SELECT event_id, {DPD_CASE.format(missing='INSUFFICIENT_EVIDENCE')} FROM dpdf")
def _(t):
    return flat(pol.evaluate(dpd_rows(t), replace(pol.DPD_DETERIORATION, mode="FIRST_MATCH")), "event_id")


@query(
    "policy_eval_all_matches",
    f"WITH {PAYMENT_POINTS} SELECT account_id, event_time, 'R-PPR-001' AS rule_id, 'REPEATED_PAYMENT_RETURN' AS outcome_code, 'HIGH' AS severity FROM pts WHERE return_count >= 3",
)
def _(t):
    out = pol.evaluate_all(payment_rows(t), pol.REPEATED_PAYMENT_RETURN)
    return out.select("account_id", "event_time", "match.rule_id", "match.outcome_code", "match.severity")


@query(
    "policy_missing_value",
    "WITH " + DPD_FEATURES + " " + " UNION ALL ".join(
        f"SELECT '{m}' AS missing_value_policy, status, count(*) AS n FROM (SELECT {DPD_CASE.format(missing=s)} FROM dpdf) GROUP BY status"
        for m, s in [("FAIL_EVALUATION", "FAILED"), ("RULE_NOT_MATCHED", "NOT_MATCHED"), ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE")]
    ),
)
def _(t):
    out = None
    for mode in ("FAIL_EVALUATION", "RULE_NOT_MATCHED", "INSUFFICIENT_EVIDENCE"):
        part = (
            flat(pol.evaluate(dpd_rows(t), replace(pol.DPD_DETERIORATION, missing=mode)), "event_id")
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("missing_value_policy"), "status", "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "policy_trace",
    f"""WITH {DPD_FEATURES}, r AS (SELECT event_id, usable, current_dpd, unnest(['R-DPD-001','R-DPD-002']) AS rule_id, unnest([30, 15]) AS threshold FROM dpdf)
SELECT event_id, rule_id, CAST(current_dpd AS DOUBLE) AS operand, CASE WHEN NOT usable THEN 'UNKNOWN' WHEN current_dpd >= threshold THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS verdict,
  CASE WHEN NOT usable THEN 'FEATURE_NOT_USABLE' WHEN current_dpd >= threshold THEN 'CONDITION_TRUE' ELSE 'CONDITION_FALSE' END AS reason FROM r""",
)
def _(t):
    rows = pol.trace(dpd_rows(t), pol.DPD_DETERIORATION).select("event_id", F.explode("trace").alias("x"))
    return rows.select("event_id", "x.rule_id", F.col("x.operands")[0].alias("operand"), "x.verdict", "x.reason")


OVERRIDES = [(0, 0.90, 0.98), (1, 0.70, 0.80)]


@query(
    "policy_institution_override",
    f"""WITH {UTILIZATION}, o AS (SELECT * FROM (VALUES {values_sql(OVERRIDES)}) v(institution, lo, hi)),
u AS (SELECT util.*, coalesce(lo, 0.85) AS lo, coalesce(hi, 0.95) AS hi FROM util LEFT JOIN o ON facility_id % 3 = institution)
SELECT event_id, {UTIL_CASE.replace('{lo}', 'lo').replace('{hi}', 'hi')} FROM u""",
)
def _(t):
    o = values(t.spark, ["institution", "lo", "hi"], OVERRIDES)
    rows = util_rows(t).withColumn("institution", F.col("facility_id") % 3).join(o, "institution", "left")
    given = {"UTILIZATION_HIGH_THRESHOLD": F.col("lo").cast("double"), "CRITICAL_UTILIZATION_THRESHOLD": F.col("hi").cast("double")}
    return flat(pol.evaluate(rows, pol.HIGH_UTILIZATION, given), "event_id")


CANDIDATE = {"DPD_WARNING_THRESHOLD": 7, "DPD_HIGH_THRESHOLD": 20}
SIM = f"""{DPD_FEATURES}, sim AS (SELECT event_id, entity_id, counterparty_id, usable, CASE WHEN NOT usable THEN 0 WHEN current_dpd >= 15 THEN 1 ELSE 0 END AS b, CASE WHEN NOT usable THEN 0 WHEN current_dpd >= 7 THEN 1 ELSE 0 END AS c,
  CASE WHEN NOT usable THEN NULL WHEN current_dpd >= 30 THEN 'R-DPD-001' WHEN current_dpd >= 15 THEN 'R-DPD-002' END AS br, CASE WHEN NOT usable THEN NULL WHEN current_dpd >= 20 THEN 'R-DPD-001' WHEN current_dpd >= 7 THEN 'R-DPD-002' END AS cr FROM dpdf)"""


def simulated(t):
    return pol.simulate(dpd_rows(t), pol.DPD_DETERIORATION, replace(pol.DPD_DETERIORATION, parameters=CANDIDATE, version=2))


@query("policy_simulate", f"WITH {SIM} SELECT event_id, coalesce(br, '') AS baseline_rule, coalesce(cr, '') AS candidate_rule FROM sim WHERE br IS DISTINCT FROM cr")
def _(t):
    s = simulated(t).filter(~F.col("baseline.rule_id").eqNullSafe(F.col("candidate.rule_id")))
    return s.select("event_id", F.coalesce("baseline.rule_id", F.lit("")).alias("baseline_rule"), F.coalesce("candidate.rule_id", F.lit("")).alias("candidate_rule"))


@query(
    "agg_simulation_summary",
    f"""WITH {SIM} SELECT count(*) AS evaluations, CAST(sum(c) AS BIGINT) AS matched, CAST(sum(CASE WHEN usable AND c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_matched, CAST(sum(CASE WHEN NOT usable THEN 1 ELSE 0 END) AS BIGINT) AS insufficient,
  CAST(0 AS BIGINT) AS failed, count(DISTINCT CASE WHEN c = 1 THEN entity_id END) AS unique_entities, CAST(sum(c) - sum(b) AS BIGINT) AS delta_matched FROM sim""",
)
def _(t):
    return pol.simulation_summary(simulated(t), "facility_id")


@query(
    "agg_rule_impact",
    f"""WITH {SIM}, x AS (SELECT cr AS rule_id, 1 AS c, 0 AS b FROM sim UNION ALL SELECT br, 0, 1 FROM sim)
SELECT rule_id, CAST(sum(c) AS BIGINT) AS candidate, CAST(sum(b) AS BIGINT) AS baseline, CAST(sum(c) - sum(b) AS BIGINT) AS delta FROM x WHERE rule_id IS NOT NULL GROUP BY rule_id""",
)
def _(t):
    return pol.rule_impact(simulated(t))


@query("agg_segment_impact", f"WITH {SIM} SELECT counterparty_id % 5 AS segment, CAST(sum(c) AS BIGINT) AS candidate, CAST(sum(b) AS BIGINT) AS baseline, CAST(sum(c) - sum(b) AS BIGINT) AS delta FROM sim GROUP BY 1")
def _(t):
    return pol.impact(simulated(t), F.col("counterparty_id") % 5, "segment")


# Rules with look-backs of their own: over utilisation itself, limit changes, rating actions and payments to related parties.
UNDER_PRESSURE = pol.Policy(
    "POL-CORP-FUNDING-PRESSURE-001", "FUNDING_PRESSURE", "PRIORITY", {"FULL": 1.0, "JUMP": 0.5, "TIMES": 2},
    (
        pol.Rule("R-FPR-001", 100, {"all": [
            {"exists": "rating_action", "days": 90, "where": {"left": {"feature": "rating"}, "operator": "IN", "right": {"literal": ["B", "CCC"]}}},
            {"left": {"count": "utilization_ratio", "days": 180, "where": {"left": {"feature": "utilization_ratio"}, "operator": "GTE", "right": {"parameter": "FULL"}}}, "operator": "GTE", "right": {"parameter": "TIMES"}},
        ]}, "FUNDING_PRESSURE", "HIGH", ("LIQUIDITY",)),
        pol.Rule("R-FPR-002", 200, {"all": [
            {"left": {"count": "limit_change", "days": 180}, "operator": "GTE", "right": {"parameter": "TIMES"}},
            {"left": {"percentage_change": "utilization_ratio", "days": 90}, "operator": "GTE", "right": {"parameter": "JUMP"}},
        ]}, "FUNDING_PRESSURE", "MEDIUM", ("LIQUIDITY",)),
    ),
    missing="RULE_NOT_MATCHED",
)
ROUTED_AWAY = pol.Policy(
    "POL-CORP-ROUTED-AWAY-001", "ROUTED_AWAY", "ALL_MATCHES", {"FULL": 1.0, "RISE": 1.0},
    (
        pol.Rule("R-RTA-001", 100, {"all": [
            {"exists": "transfer", "days": 30, "where": {"left": {"feature": "related_party"}, "operator": "EQ", "right": {"literal": True}}},
            {"left": {"changed_by": "utilization_ratio", "days": 90}, "operator": "GTE", "right": {"parameter": "RISE"}},
        ]}, "ROUTED_AWAY", "HIGH", ("LIQUIDITY",)),
        pol.Rule("R-RTA-002", 200, {"all": [
            # The same look-back as R-FPR-001 has: planned once for both policies.
            {"left": {"count": "utilization_ratio", "days": 180, "where": {"left": {"feature": "utilization_ratio"}, "operator": "GTE", "right": {"parameter": "FULL"}}}, "operator": "GTE", "right": {"literal": 3}},
            {"not": {"exists": "rating_action", "days": 90, "where": {"left": {"feature": "rating"}, "operator": "IN", "right": {"literal": ["B", "CCC"]}}}},
            {"left": {"age_days": "limit_at"}, "operator": "GTE", "right": {"literal": 30}},
        ]}, "ROUTED_AWAY", "LOW", ("LIQUIDITY",)),
    ),
)
WINDOWED = f"""{UTILIZATION}, lat AS (SELECT facility_id, effective_at AS limit_at, row_number() OVER (PARTITION BY facility_id ORDER BY effective_at DESC) AS rn FROM lims),
base AS (SELECT u.*, CASE WHEN state IN ('VALUE','ZERO') THEN utilization_ratio END AS v, limit_at FROM util u LEFT JOIN (SELECT * FROM lat WHERE rn = 1) l ON u.facility_id = l.facility_id),
pts AS (SELECT facility_id, effective_at, max(v) AS v FROM base WHERE v IS NOT NULL GROUP BY ALL),
own AS (SELECT b.*, p.v AS old, count(CASE WHEN b.v >= 1.0 THEN 1 END) OVER (PARTITION BY b.facility_id ORDER BY b.effective_at RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW) AS full_count
  FROM base b ASOF LEFT JOIN pts p ON b.facility_id = p.facility_id AND b.effective_at - INTERVAL 90 DAY >= p.effective_at),
wnd AS (SELECT event_id, effective_at, limit_at, v, full_count, v - old AS moved, CASE WHEN old <> 0 THEN (v - old) / abs(old) END AS share,
  (SELECT count(*) FROM b_limit_changed l WHERE l.facility_id = own.facility_id AND l.effective_at BETWEEN own.effective_at - INTERVAL 180 DAY AND own.effective_at) AS limits,
  (SELECT count(*) FROM b_rating_action r WHERE r.issuer_id = own.facility_id AND r.rating IN ('B','CCC') AND r.action_time BETWEEN own.effective_at - INTERVAL 90 DAY AND own.effective_at) AS ratings,
  (SELECT count(*) FROM b_transfer p WHERE p.payer_id = own.facility_id AND p.related_party AND p.event_time BETWEEN own.effective_at - INTERVAL 30 DAY AND own.effective_at) AS related,
  CASE WHEN limit_at IS NOT NULL THEN CAST(floor(CAST(epoch_us(effective_at) - epoch_us(limit_at) AS DOUBLE) / 86400000000.0) AS BIGINT) END AS age FROM own)"""


def windowed(t):
    """Utilisation with every look-back that the two policies name, and the policies over them."""
    latest = t.limit_changed.groupBy("facility_id").agg(F.max("effective_at").alias("limit_at"))
    # Rows of a facility lie together after the as-of, so the newest limit is joined there.
    with_latest = lambda rows, hot: rows.join(latest, "facility_id", "left")
    # Rating actions are the orders that limits are, transfers some of the lines that outstandings are: these two tell which facilities are hot in all.
    hot = hot_keys(t.outstanding_changed.select("facility_id").unionAll(t.limit_changed.select("facility_id")), ["facility_id"])
    rows = feat.utilization(t.outstanding_changed, t.limit_changed, with_latest, hot).withColumn("utilization_ratio_state", F.col("state"))
    rows = rows.select("facility_id", "event_id", "effective_at", "utilization_ratio", "utilization_ratio_state", "limit_at")
    sources = {
        "limit_change": pw.Source(t.limit_changed, ("facility_id",), "effective_at"),
        "rating_action": pw.Source(t.rating_action, ("issuer_id",), "action_time"),
        "transfer": pw.Source(t.transfer, ("payer_id",), "event_time"),
    }
    return pw.compile_policies(rows, ["facility_id"], "effective_at", [UNDER_PRESSURE, ROUTED_AWAY], sources, hot)


@query(
    "policy_window_values",
    f"WITH {WINDOWED} SELECT event_id, full_count, limits, ratings, related, round(moved, 6) AS moved, round(share, 6) AS share, age FROM wnd",
)
def _(t):
    rows, _, backs = windowed(t)
    column = {(b.kind, b.of): F.col(n) for b, n in backs.items()}
    return rows.select(
        "event_id", column["count", "utilization_ratio"].alias("full_count"), column["count", "limit_change"].alias("limits"),
        column["count", "rating_action"].alias("ratings"), column["count", "transfer"].alias("related"),
        F.round(column["changed_by", "utilization_ratio"], 6).alias("moved"), F.round(column["percentage_change", "utilization_ratio"], 6).alias("share"),
        column["age_days", "limit_at"].alias("age"),
    )


@query(
    "policy_window_priority",
    f"""WITH {WINDOWED} SELECT event_id, CASE WHEN ratings > 0 AND full_count >= 2 THEN 'R-FPR-001' WHEN limits >= 2 AND share >= 0.5 THEN 'R-FPR-002' ELSE '' END AS rule_id,
  CASE WHEN ratings > 0 AND full_count >= 2 THEN 'HIGH' WHEN limits >= 2 AND share >= 0.5 THEN 'MEDIUM' ELSE '' END AS severity,
  CASE WHEN (ratings > 0 AND full_count >= 2) OR (limits >= 2 AND share >= 0.5) THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status FROM wnd""",
)
def _(t):
    rows, (pressure, _), _ = windowed(t)
    return flat(pol.evaluate(rows, pressure), "event_id")


@query(
    "policy_window_all_matches",
    f"""WITH {WINDOWED} SELECT event_id, 'R-RTA-001' AS rule_id, 'HIGH' AS severity FROM wnd WHERE related > 0 AND moved >= 1.0
UNION ALL SELECT event_id, 'R-RTA-002', 'LOW' FROM wnd WHERE full_count >= 3 AND ratings = 0 AND age >= 30""",
)
def _(t):
    rows, (_, away), _ = windowed(t)
    return pol.evaluate_all(rows, away).select("event_id", "match.rule_id", "match.severity")
