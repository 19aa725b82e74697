"""Audits over policy, episode, hypothesis and assessment tables bound to the given data.

An order stands for one governed document and its lines for the parts of it, with natural and
derived defects, so every rule meets violations in volume.
"""

from pyspark.sql import functions as F

from tideglass.operators import audits as au
from tideglass.operators.episodes import EPISODE_TRANSITIONS, HYPOTHESIS_TRANSITIONS, episode_key
from tideglass.plans.joins import OVERLAP_SQL, versions
from tideglass.operators.joins import version_overlaps
from tideglass.registry import query
from tideglass.sources.reference import values, values_sql


def union(*checks):
    """SQL of findings: (rule, code, object, detail, FROM/WHERE clause)."""
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, '{c}' AS code, CAST({o} AS VARCHAR) AS object_id, coalesce(CAST({d} AS VARCHAR), '') AS detail FROM {w}" for r, c, o, d, w in checks
    )


RULES = "b_policy_rule WHERE "


@query("audit_policy_references", union(
    ("PSV-001", "UNKNOWN_PARAMETER", "version_no", "parameter_name", RULES + "parameter_name NOT IN ('WARNING_LIMIT')"),
    ("PSV-002", "UNKNOWN_FEATURE", "version_no", "feature_name", RULES + "feature_name NOT IN ('returned_payment_count_30d','current_dpd','utilization_ratio')"),
    ("PSV-003", "UNKNOWN_SIGNAL", "version_no", "signal_code", RULES + "signal_code NOT IN ('REPEATED_PAYMENT_RETURN','DPD_DERIORATION','UTILIZATION_HIGH','UTILIZATION_SPIKE')"),
    ("PSV-004", "UNKNOWN_RISK_DIMENSION", "version_no", "risk_dimension", RULES + "risk_dimension NOT IN ('LIQUIDITY','REPAYMENT_CONDUCT')"),
))
def _(t):
    return au.policy_references(t.policy_rule, ["WARNING_LIMIT"])


PARAMS = """SELECT version_no, 'WARNING_LIMIT' AS name, 'INTEGER' AS type, CASE WHEN version_no % 19 = 0 THEN '12.5' ELSE CAST(warning_value AS VARCHAR(20)) END AS value_text, 1 AS minimum, 365 AS maximum, CAST(warning_value AS INT) AS value FROM b_policy_version
UNION ALL SELECT version_no, 'HIGH_LIMIT', CASE WHEN version_no % 23 = 0 THEN 'UNKNOWN' ELSE 'DECIMAL' END, CAST(high_value AS VARCHAR(20)), 5, 390, high_value FROM b_policy_version WHERE version_no % 29 <> 0"""


@query("audit_policy_parameters", f"WITH p AS ({PARAMS}) " + union(
    ("PSV-005", "PARAMETER_TYPE_MISMATCH", "version_no", "name", "p WHERE type = 'UNKNOWN' OR (type = 'INTEGER' AND NOT regexp_full_match(value_text, '[+-]?[0-9]+'))"),
    ("PSV-005", "PARAMETER_BELOW_MINIMUM", "version_no", "name", "p WHERE CAST(value_text AS DECIMAL(20,4)) < minimum"),
    ("PSV-005", "PARAMETER_ABOVE_MAXIMUM", "version_no", "name", "p WHERE CAST(value_text AS DECIMAL(20,4)) > maximum"),
    ("PSV-005", "PARAMETER_VALUE_NOT_ALLOWED", "version_no", "name", "p WHERE name = 'HIGH_LIMIT' AND version_no % 31 = 0 AND value_text NOT IN ('30','60','90')"),
))
def _(t):
    allowed = F.when((F.col("name") == "HIGH_LIMIT") & (F.col("version_no") % 31 == 0), F.array(F.lit("30"), F.lit("60"), F.lit("90"))).otherwise(F.array().cast("array<string>"))
    return au.policy_parameters(t.sql(PARAMS).withColumn("allowed", allowed))


CONSTRAINTS = [("A", "C-1", "WARNING_LIMIT", "LT", "HIGH_LIMIT"), ("B", "C-2", "HIGH_LIMIT", "GTE", "WARNING_LIMIT")]


@query("audit_policy_relations", f"""WITH p AS ({PARAMS}), v AS (SELECT version_no, CASE version_no % 2 WHEN 0 THEN 'A' ELSE 'B' END AS cs FROM b_policy_version),
c AS (SELECT * FROM (VALUES {values_sql(CONSTRAINTS)}) x(cs, cid, l, op, r)),
j AS (SELECT v.version_no, cid, op, pl.value AS lv, pr.value AS rv FROM v JOIN c USING (cs) LEFT JOIN p pl ON pl.version_no = v.version_no AND pl.name = l LEFT JOIN p pr ON pr.version_no = v.version_no AND pr.name = r) """ + union(
    ("PSV-006", "CONSTRAINT_PARAMETER_MISSING", "version_no", "cid", "j WHERE lv IS NULL OR rv IS NULL"),
    ("PSV-006", "PARAMETER_RELATION_VIOLATION", "version_no", "cid", "j WHERE lv IS NOT NULL AND rv IS NOT NULL AND NOT (CASE op WHEN 'LT' THEN lv < rv ELSE lv >= rv END)"),
))
def _(t):
    pol = t.policy_version.withColumn("constraint_set", F.when(F.col("version_no") % 2 == 0, "A").otherwise("B"))
    cons = values(t.spark, ["constraint_set", "constraint_id", "left_parameter", "operator", "right_parameter"], CONSTRAINTS)
    return au.policy_relations(pol, t.sql(PARAMS), cons)


@query("audit_policy_priorities", """SELECT CASE mode WHEN 'PRIORITY' THEN 'PSV-007' ELSE 'PSV-008' END AS rule_id, 'DUPLICATE_PRIORITY' AS code, CAST(version_no AS VARCHAR) AS object_id, CAST(priority AS VARCHAR) AS detail
FROM b_policy_rule WHERE enabled AND mode IN ('PRIORITY','FIRST_MATCH') GROUP BY version_no, mode, priority HAVING count(*) > 1
UNION ALL SELECT 'PSV-019', 'DUPLICATE_RULE_ID', CAST(version_no AS VARCHAR), rule_id FROM b_policy_rule GROUP BY version_no, rule_id HAVING count(*) > 1""")
def _(t):
    return au.policy_priorities(t.policy_rule)


PERIOD = """SELECT version_no, CASE WHEN version_no % 37 = 0 THEN 'not-a-date' ELSE CAST(CAST(effective_from AS DATE) AS VARCHAR(20)) END AS from_text,
CASE WHEN version_no % 41 = 0 THEN 'soon' ELSE CAST(CAST(effective_to AS DATE) AS VARCHAR(20)) END AS to_text FROM b_policy_version"""


@query("audit_policy_period", f"WITH p AS (SELECT *, TRY_CAST(from_text AS TIMESTAMP) AS f, TRY_CAST(to_text AS TIMESTAMP) AS u FROM ({PERIOD})) " + union(
    ("PSV-009", "INVALID_EFFECTIVE_FROM", "version_no", "from_text", "p WHERE f IS NULL"),
    ("PSV-009", "INVALID_EFFECTIVE_TO", "version_no", "to_text", "p WHERE f IS NOT NULL AND to_text IS NOT NULL AND u IS NULL"),
    ("PSV-009", "INVALID_EFFECTIVE_PERIOD", "version_no", "to_text", "p WHERE f IS NOT NULL AND u <= f"),
))
def _(t):
    return au.policy_period(t.sql(PERIOD))


@query("audit_policy_overlap", f"SELECT 'PSV-010' AS rule_id, 'EFFECTIVE_VERSION_OVERLAP' AS code, CAST(version_no AS VARCHAR) AS object_id, CAST(overlaps_version AS VARCHAR) AS detail FROM ({OVERLAP_SQL[OVERLAP_SQL.index('SELECT n.'):]})".replace("SELECT 'PSV-010'", OVERLAP_SQL[:OVERLAP_SQL.index("SELECT n.")] + "SELECT 'PSV-010'", 1))
def _(t):
    return au.policy_overlap(version_overlaps(versions(t), ["policy_key"], "scope", "version_no"))


PV = "b_policy_version WHERE "
NOCHK = "(approved_by IS NULL OR trim(approved_by) = '')"


@query("audit_policy_activation", union(
    ("PSV-011", "MISSING_APPROVAL", "version_no", "''", PV + f"lifecycle = 'ACTIVE' AND {NOCHK}"),
    ("PSV-011", "MISSING_SIMULATION", "version_no", "''", PV + "lifecycle = 'ACTIVE' AND simulation_run_id = ''"),
    ("PSV-011", "MAKER_CHECKER_SAME_ACTOR", "version_no", "approved_by", PV + "lifecycle = 'ACTIVE' AND created_by = approved_by"),
    ("CPV-008", "MAKER_CHECKER_SEPARATION_REQUIRED", "version_no", "''", PV + f"lifecycle IN ('ACTIVE','APPROVED') AND ({NOCHK} OR created_by = approved_by)"),
    ("CPV-009", "SIMULATION_EVIDENCE_REQUIRED", "version_no", "''", PV + "lifecycle IN ('ACTIVE','APPROVED') AND simulation_run_id = ''"),
))
def _(t):
    return au.policy_activation(t.policy_version)


@query("audit_policy_engine_ref", union(
    ("PSV-012", "MISSING_ENGINE_ARTIFACT", "version_no", "engine", PV + "engine IN ('DMN','DROOLS') AND artifact_ref IS NULL"),
    ("PSV-012", "UNDECLARED_NATIVE_ARTIFACT", "version_no", "artifact_ref", PV + "engine = 'NATIVE' AND artifact_ref IS NOT NULL"),
))
def _(t):
    return au.policy_engine(t.policy_version)


@query("audit_policy_boundary", union(
    ("PSV-013", "CLASSIFICATION_BOUNDARY_VIOLATION", "version_no", "semantic_scope", PV + "outcome_type = 'CLASSIFICATION_CANDIDATE' AND (semantic_scope <> 'JURISDICTION_EXTENSION' OR jurisdictions = '')"),
))
def _(t):
    return au.policy_boundary(versions(t))


SCOPE = "b_policy_rule r JOIN b_policy_version v ON r.version_no = v.version_no WHERE "


@query("audit_policy_scope", "SELECT DISTINCT * FROM (" + union(
    ("PSV-014", "PRODUCT_SCOPE_UNSPECIFIED", "r.version_no", "feature_name", SCOPE + "feature_name IN ('current_dpd','utilization_ratio') AND v.version_no % 3 = 0"),
    ("PSV-015", "ENTITY_GRAIN_MISMATCH", "r.version_no", "feature_name", SCOPE + "(feature_name IN ('returned_payment_count_30d','current_dpd') AND policy_grain <> 'COUNTERPARTY') OR (feature_name = 'utilization_ratio' AND policy_grain <> 'FACILITY')"),
) + ")")
def _(t):
    products = F.when(F.col("version_no") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("LOAN")))
    return au.policy_scope(t.policy_rule, versions(t).withColumn("products", products))


EPI = """SELECT o_orderkey AS episode_id, CASE o_orderstatus WHEN 'F' THEN 'UTILIZATION_HIGH' ELSE 'DPD_DERIORATION' END AS signal_type, CASE WHEN o_orderkey % 9 = 0 THEN 'BACKTEST' ELSE 'LIVE' END AS execution_mode,
CASE WHEN o_orderkey % 18 = 0 THEN 'RUN-1' END AS run_id, o_custkey AS entity_id,
concat_ws('|', CASE WHEN o_orderkey % 9 = 0 THEN 'BACKTEST' ELSE 'LIVE' END, 'EP-POL', '1', 'FACILITY', CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_custkey END AS VARCHAR(20)), CASE o_orderstatus WHEN 'F' THEN 'UTILIZATION_HIGH' ELSE 'DPD_DERIORATION' END, '') AS episode_key FROM orders"""
MEM = "SELECT l_orderkey AS episode_id, concat('S-', l_linenumber) AS signal_id, CASE l_returnflag WHEN 'R' THEN 'DPD_DERIORATION' ELSE 'UTILIZATION_HIGH' END AS signal_type FROM lineitem"


@query("audit_episode", f"WITH e AS ({EPI}), m AS ({MEM}) " + union(
    ("ECV-001", "EPISODE_SIGNAL_TYPE_MISMATCH", "m.episode_id", "signal_id", "m JOIN e ON m.episode_id = e.episode_id WHERE m.signal_type <> e.signal_type"),
    ("ECV-002", "DUPLICATE_EPISODE_MEMBER", "episode_id", "signal_id", "m GROUP BY episode_id, signal_id HAVING count(*) > 1"),
    ("ECV-003", "EPISODE_KEY_MISMATCH", "episode_id", "episode_key", "e WHERE episode_id % 17 = 0 AND entity_id <> 0"),
    ("ECV-009", "NON_LIVE_RUN_ID_REQUIRED", "episode_id", "execution_mode", "e WHERE execution_mode <> 'LIVE' AND run_id IS NULL"),
))
def _(t):
    expected = episode_key(F.col("execution_mode"), F.lit("EP-POL"), F.lit("1"), F.lit("FACILITY"), F.col("entity_id"), F.col("signal_type"), F.lit(None).cast("string"))
    return au.episode(t.sql(EPI), t.sql(MEM), expected)


HYP = """SELECT o_orderkey AS hypothesis_id, 'EMERGING_LIQUIDITY_STRESS' AS hypothesis_type, CAST(o_orderkey % 5 AS INT) AS declared_raw, CAST(o_orderkey % 3 AS INT) AS declared_collapsed, CAST(o_orderkey % 3 AS INT) AS declared_independent FROM orders"""
CON = """SELECT l_orderkey AS hypothesis_id, 'SIGNAL' AS contributor_type, concat('C-', l_linenumber) AS contributor_id, CASE WHEN l_tax < 0.02 THEN 'CONTEXTUAL' ELSE 'SUPPORTING' END AS role,
CASE l_returnflag WHEN 'R' THEN 'PAYMENT_RETURN' WHEN 'A' THEN 'DELINQUENCY' ELSE 'UTILIZATION_PRESSURE' END AS family, CASE WHEN l_discount > 0 THEN concat('L-', l_partkey % 5) END AS lineage_group FROM lineitem"""


@query("audit_hypothesis", f"""WITH h AS ({HYP}), c AS ({CON}), s AS (SELECT * FROM c WHERE role = 'SUPPORTING'),
lk AS (SELECT hypothesis_id, count(*) AS n FROM (SELECT DISTINCT a.hypothesis_id, a.family AS fa, b.family AS fb FROM s a JOIN s b ON a.hypothesis_id = b.hypothesis_id AND a.lineage_group = b.lineage_group AND a.family < b.family) GROUP BY 1),
n AS (SELECT hypothesis_id, count(*) AS raw, count(DISTINCT family) AS fam FROM s GROUP BY 1),
d AS (SELECT h.*, coalesce(raw, 0) AS raw, coalesce(fam - least(fam - 1, coalesce(lk.n, 0)), 0) AS ind FROM h LEFT JOIN n USING (hypothesis_id) LEFT JOIN lk USING (hypothesis_id)) """ + union(
    ("ECV-004", "DUPLICATE_CORRELATION_CONTRIBUTOR", "hypothesis_id", "concat('SIGNAL|', contributor_id)", "c GROUP BY hypothesis_id, contributor_id HAVING count(*) > 1"),
    ("ECV-005", "MISSING_SUPPORTING_LINEAGE", "hypothesis_id", "contributor_id", "s WHERE lineage_group IS NULL"),
    ("ECV-006", "RAW_SUPPORTING_COUNT_MISMATCH", "hypothesis_id", "raw", "d WHERE declared_raw <> raw"),
    ("ECV-007", "INDEPENDENCE_COUNT_MISMATCH", "hypothesis_id", "ind", "d WHERE declared_collapsed <> ind OR declared_independent <> ind"),
    ("ECV-008", "INSUFFICIENT_INDEPENDENT_CONTRIBUTORS", "hypothesis_id", "ind", "d WHERE ind < 2"),
))
def _(t):
    return au.hypothesis(t.sql(HYP), t.sql(CON))


CPOL = """SELECT o_orderkey AS policy_id, CASE o_orderkey % 4 WHEN 0 THEN 'REFINANCING_STRESS' ELSE 'EMERGING_LIQUIDITY_STRESS' END AS hypothesis_type, CASE o_orderkey % 5 WHEN 0 THEN 'OTHER' ELSE 'EMERGING_LIQUIDITY_STRESS' END AS policy_key,
CAST(o_orderkey % 5 AS INT) AS minimum_families, 2 AS families_lower, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 3 END AS families_upper,
CASE o_orderkey % 6 WHEN 0 THEN 'P30D' WHEN 1 THEN 'P120D' WHEN 2 THEN 'P1M' WHEN 3 THEN 'PT36H' WHEN 4 THEN 'P10DT12H' ELSE 'P7D' END AS window_duration, 'P7D' AS window_minimum, 'P90D' AS window_maximum FROM orders"""
CCON = """SELECT l_orderkey AS policy_id, CASE l_linenumber WHEN 1 THEN 'REPEATED_PAYMENT_RETURN' WHEN 2 THEN 'DPD_DERIORATION' WHEN 3 THEN 'UTILIZATION_HIGH' WHEN 4 THEN 'UTILIZATION_SPIKE' ELSE 'UNKNOWN_TYPE' END AS analytical_type,
CASE WHEN l_linenumber IN (3, 4) THEN 'UTILIZATION_PRESSURE' WHEN l_linenumber = 1 THEN 'PAYMENT_RETURN' ELSE 'DELINQUENCY' END AS family, 'SUPPORTING' AS role FROM lineitem"""


@query("audit_corr_policy", f"WITH p AS ({CPOL}), c AS ({CCON}), f AS (SELECT policy_id, count(DISTINCT family) AS n FROM c GROUP BY 1) " + union(
    ("CPV-001", "UNKNOWN_HYPOTHESIS_TYPE", "policy_id", "hypothesis_type", "p WHERE hypothesis_type <> 'EMERGING_LIQUIDITY_STRESS'"),
    ("CPV-002", "POLICY_HYPOTHESIS_MISMATCH", "policy_id", "policy_key", "p WHERE policy_key <> hypothesis_type"),
    ("CPV-003", "DUPLICATE_CONTRIBUTOR_TYPE", "policy_id", "analytical_type", "c GROUP BY policy_id, analytical_type HAVING count(*) > 1"),
    ("CPV-004", "UNKNOWN_CONTRIBUTOR_SIGNAL", "policy_id", "analytical_type", "c WHERE analytical_type = 'UNKNOWN_TYPE'"),
    ("CPV-005", "CONTRIBUTOR_THRESHOLD_OUT_OF_BOUNDS", "policy_id", "minimum_families", "p WHERE minimum_families < 2 OR minimum_families > families_upper OR families_upper < 2"),
    ("CPV-006", "UNSATISFIABLE_CONTRIBUTOR_THRESHOLD", "p.policy_id", "minimum_families", "p LEFT JOIN f ON p.policy_id = f.policy_id WHERE minimum_families > coalesce(n, 0)"),
    ("CPV-007", "INVALID_CORRELATION_WINDOW", "policy_id", "window_duration", "p WHERE window_duration = 'P1M'"),
    ("CPV-007", "CORRELATION_WINDOW_OUT_OF_BOUNDS", "policy_id", "window_duration", "p WHERE window_duration IN ('P120D','PT36H')"),
))
def _(t):
    return au.correlation_policy(t.sql(CPOL), t.sql(CCON))


APOL = """SELECT o_orderkey AS policy_id, CAST(0 AS DOUBLE) AS scale_minimum, CASE WHEN o_orderkey % 21 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS scale_maximum, CASE o_orderkey % 2 WHEN 0 THEN 'WEIGHTED_DIMENSIONS' ELSE 'MAX_DIMENSION' END AS method,
0 AS points_info, 20 AS points_low, CAST(o_orderkey % 60 AS INT) AS points_medium, 70 AS points_high, 90 AS points_critical, 0 AS guard_minimum, CASE WHEN o_orderkey % 33 = 0 THEN 80 ELSE 100 END AS guard_maximum FROM orders"""
ABAND = """SELECT o_orderkey AS policy_id, 'LOW' AS band, CAST(o_orderkey % 2 AS DOUBLE) AS minimum FROM orders UNION ALL SELECT o_orderkey, 'MEDIUM', CAST(25 AS DOUBLE) FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'MEDIUM' ELSE 'HIGH' END, o_orderkey % 60 + CASE WHEN o_orderkey % 5 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FROM orders UNION ALL SELECT o_orderkey, 'CRITICAL', CAST(75 + o_orderkey % 30 AS DOUBLE) FROM orders"""
ADIM = "SELECT l_orderkey AS policy_id, CASE l_linenumber WHEN 1 THEN 'LIQUIDITY' WHEN 2 THEN 'REPAYMENT_CONDUCT' WHEN 3 THEN 'CASH_FLOW_DEBT_SERVICE' ELSE 'CREDIT' END AS risk_dimension, CAST(l_quantity * 2.5 AS DOUBLE) AS cap FROM lineitem"
AWGT = "SELECT l_orderkey AS policy_id, CASE l_linenumber WHEN 1 THEN 'LIQUIDITY' WHEN 2 THEN 'REPAYMENT_CONDUCT' WHEN 3 THEN 'CASH_FLOW_DEBT_SERVICE' ELSE 'CREDIT' END AS risk_dimension, CAST(floor(l_quantity) * 2 / 100 AS DECIMAL(8,4)) AS weight FROM lineitem"
ASUB = "SELECT o_orderkey AS policy_id, CASE WHEN o_orderkey % 4 = 0 THEN 'GOVERNANCE_STRESS' ELSE 'EMERGING_LIQUIDITY_STRESS' END AS hypothesis_type, CAST(o_orderkey % 110 AS DOUBLE) AS contribution FROM orders"


@query("audit_agg_policy", f"""WITH p AS ({APOL}), b AS ({ABAND}), d AS ({ADIM}), w AS ({AWGT}), s AS ({ASUB}), ws AS (SELECT policy_id, CAST(sum(weight) AS DOUBLE) AS sm, count(*) AS n FROM w GROUP BY 1),
bl AS (SELECT b.*, scale_minimum, scale_maximum, lag(minimum) OVER (PARTITION BY policy_id ORDER BY minimum, band) AS before, row_number() OVER (PARTITION BY policy_id, band ORDER BY minimum) > 1 AS again FROM b JOIN p USING (policy_id)),
bn AS (SELECT policy_id, min(minimum) FILTER (band = 'LOW') AS m0, min(minimum) FILTER (band = 'MEDIUM') AS m1, min(minimum) FILTER (band = 'HIGH') AS m2, min(minimum) FILTER (band = 'CRITICAL') AS m3, count(*) AS n FROM b GROUP BY 1) """ + union(
    ("RAP-001", "INVALID_SCORE_SCALE", "policy_id", "''", "p WHERE scale_minimum >= scale_maximum"),
    ("RAP-002", "INVALID_SCORE_BAND", "policy_id", "band", "bl WHERE again OR minimum < scale_minimum OR minimum > scale_maximum OR coalesce(minimum <= before, false)"),
    ("RAP-002", "INCOMPLETE_SCORE_BANDS", "policy_id", "''", "bn WHERE NOT coalesce(n = 4 AND m0 < m1 AND m1 < m2 AND m2 < m3 AND abs(m0) <= 0.000001, false)"),
    ("RAP-003", "INVALID_SEVERITY_CONTRIBUTIONS", "policy_id", "''", "p WHERE NOT (20 < points_medium AND points_medium < 70 AND 90 <= guard_maximum)"),
    ("RAP-004", "DUPLICATE_DIMENSION_POLICY", "policy_id", "risk_dimension", "d GROUP BY policy_id, risk_dimension HAVING count(*) > 1"),
    ("RAP-005", "UNKNOWN_RISK_DIMENSION", "d.policy_id", "risk_dimension", "d JOIN p ON d.policy_id = p.policy_id WHERE risk_dimension = 'CREDIT'"),
    ("RAP-006", "DIMENSION_CAP_OUT_OF_SCALE", "d.policy_id", "risk_dimension", "d JOIN p ON d.policy_id = p.policy_id WHERE cap < scale_minimum OR cap > scale_maximum"),
    ("RAP-007", "UNKNOWN_WEIGHT_DIMENSION", "w.policy_id", "risk_dimension", "w JOIN p ON w.policy_id = p.policy_id WHERE method = 'WEIGHTED_DIMENSIONS' AND risk_dimension = 'CREDIT'"),
    ("RAP-008", "DIMENSION_WEIGHTS_NOT_NORMALIZED", "p.policy_id", "''", "p LEFT JOIN ws ON p.policy_id = ws.policy_id WHERE method = 'WEIGHTED_DIMENSIONS' AND (n IS NULL OR abs(sm - 1) > 0.000001)"),
    ("RAP-009", "UNUSED_DIMENSION_WEIGHTS", "p.policy_id", "''", "p JOIN ws ON p.policy_id = ws.policy_id WHERE method <> 'WEIGHTED_DIMENSIONS'"),
    ("RAP-010", "UNKNOWN_CORRELATION_HYPOTHESIS", "policy_id", "hypothesis_type", "s WHERE hypothesis_type <> 'EMERGING_LIQUIDITY_STRESS'"),
    ("RAP-011", "CORRELATION_CONTRIBUTION_OUT_OF_SCALE", "s.policy_id", "hypothesis_type", "s JOIN p ON s.policy_id = p.policy_id WHERE contribution < scale_minimum OR contribution > scale_maximum"),
))
def _(t):
    return au.aggregation_policy(*[t.sql(x) for x in (APOL, ABAND, ADIM, AWGT, ASUB)])


REVISION = """SELECT l_orderkey AS object_id, l_linenumber AS revision, concat_ws('-', l_partkey, l_suppkey) AS change_no, l_shipdate AS changed_at, CASE WHEN l_tax = 0.08 THEN 'POL-B' ELSE 'POL-A' END AS policy_id,
CASE WHEN l_returnflag = 'R' THEN '{a}' WHEN l_returnflag = 'A' THEN '{b}' WHEN l_linestatus = 'O' THEN '{c}' ELSE '{d}' END AS status, CAST(l_partkey % 2 AS INT) AS reopen_count FROM lineitem"""
EREV = REVISION.format(a="OPEN", b="MONITORING", c="RESOLVED", d="SUPERSEDED")
HREV = REVISION.format(a="PROPOSED", b="ACTIVE", c="RESOLVED", d="REJECTED")


def transition_sql(source, allowed, prefix, what, reopen):
    ok = ",".join(f"'{a}>{b}'" for a, b in allowed)
    checks = [
        (f"{prefix}-001", f"{what}_IDENTITY_CHANGED", "object_id", "''", "q WHERE policy_id IS DISTINCT FROM pp"),
        (f"{prefix}-002", f"{what}_REVISION_NOT_SEQUENTIAL", "object_id", "revision", "q WHERE revision <> pr + 1"),
        (f"{prefix}-003", f"INVALID_{what}_TRANSITION", "object_id", "concat(ps, '>', status)", f"q WHERE concat(ps, '>', status) NOT IN ({ok})"),
    ]
    if reopen:
        checks.append((f"{prefix}-004", "INVALID_REOPEN_COUNT", "object_id", "reopen_count", "q WHERE reopen_count <> po + CASE WHEN ps = 'RESOLVED' AND status = 'OPEN' THEN 1 ELSE 0 END"))
    return f"""WITH r AS ({source}), q AS (SELECT * FROM (SELECT *, lag(policy_id) OVER w AS pp, lag(revision) OVER w AS pr, lag(status) OVER w AS ps, lag(reopen_count) OVER w AS po FROM r WINDOW w AS (PARTITION BY object_id ORDER BY changed_at, revision, change_no)) WHERE ps IS NOT NULL) """ + union(*checks)


@query("audit_episode_transitions", transition_sql(EREV, EPISODE_TRANSITIONS, "ETV", "EPISODE", True))
def _(t):
    return au.transitions(t.sql(EREV), "object_id", "changed_at", ["revision", "change_no"], ["policy_id"], EPISODE_TRANSITIONS, "ETV", True)


@query("audit_hypothesis_transitions", transition_sql(HREV, HYPOTHESIS_TRANSITIONS, "CTV", "HYPOTHESIS", False))
def _(t):
    return au.transitions(t.sql(HREV), "object_id", "changed_at", ["revision", "change_no"], ["policy_id"], HYPOTHESIS_TRANSITIONS, "CTV", False)


BANDSQL = "CASE WHEN {x} >= 75 THEN 'CRITICAL' WHEN {x} >= 50 THEN 'HIGH' WHEN {x} >= 25 THEN 'MEDIUM' WHEN {x} >= 0 THEN 'LOW' END"
AOV = """SELECT o_orderkey AS assessment_id, CASE WHEN o_orderkey % 25 = 0 THEN 'OTHER' ELSE 'RISK-AGG' END AS policy_id, '1' AS policy_version, CASE WHEN o_orderkey % 27 = 0 THEN 'bad' ELSE 'abc' END AS policy_hash,
CASE WHEN o_orderkey % 14 = 0 THEN 'BAND_ONLY' ELSE 'MAX_DIMENSION' END AS method, CAST(80 + o_orderkey % 21 AS DOUBLE) AS raw_score, CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS proposed_band, o_orderkey % 8 <> 0 AS requires_human_review, CAST(o_orderkey % 6 AS INT) AS contradictions FROM orders"""
ADM = """SELECT l_orderkey AS assessment_id, l_linenumber * 1000000 + l_partkey AS position, CASE l_linenumber WHEN 1 THEN 'LIQUIDITY' WHEN 2 THEN 'REPAYMENT_CONDUCT' WHEN 3 THEN 'CASH_FLOW_DEBT_SERVICE' WHEN 4 THEN 'REFINANCING_FUNDING' ELSE 'CREDIT' END AS risk_dimension,
CAST(l_quantity * 2.1 AS DOUBLE) AS raw_score, CASE WHEN l_quantity > 30 THEN 'HIGH' WHEN l_quantity > 12 THEN 'MEDIUM' ELSE 'LOW' END AS proposed_band FROM lineitem"""
ACN = """SELECT l_orderkey AS assessment_id, CASE WHEN l_linenumber % 2 = 0 THEN 'LIQUIDITY' ELSE 'REPAYMENT_CONDUCT' END AS risk_dimension, CASE WHEN l_tax > 0.05 THEN 'CORRELATION_HYPOTHESIS' ELSE 'SIGNAL' END AS contributor_type, concat('C-', l_partkey % 3) AS contributor_id,
CASE WHEN l_tax > 0.05 THEN 'EMERGING_LIQUIDITY_STRESS' WHEN l_returnflag = 'R' THEN 'PAYMENT_RETURN' ELSE 'DELINQUENCY' END AS family, CASE WHEN l_discount > 0.08 THEN 'LINEAGE_ONLY' ELSE 'SCORING' END AS role FROM lineitem"""
AUDIT_POLICY = {
    "id": "RISK-AGG", "version": "1", "hash": "abc", "method": "MAX_DIMENSION", "minimum": 0.0, "maximum": 100.0,
    "caps": {"LIQUIDITY": 100, "REPAYMENT_CONDUCT": 90, "CASH_FLOW_DEBT_SERVICE": 100, "REFINANCING_FUNDING": 100},
    "bands": [(75.0, "CRITICAL"), (50.0, "HIGH"), (25.0, "MEDIUM"), (0.0, "LOW")],
    "suppressed": {"LIQUIDITY": ["UTILIZATION_PRESSURE", "PAYMENT_RETURN", "DELINQUENCY"]}, "review_band": "HIGH",
}


@query("audit_assessment", f"""WITH o AS ({AOV}), d AS ({ADM}), c AS ({ACN}), top AS (SELECT assessment_id, max(raw_score) AS mx, arg_max(proposed_band, (raw_score, -position)) AS bd FROM d GROUP BY 1), j AS (SELECT o.*, mx, bd FROM o LEFT JOIN top USING (assessment_id)),
sc AS (SELECT assessment_id FROM c WHERE role = 'SCORING' AND risk_dimension = 'LIQUIDITY' AND contributor_type = 'CORRELATION_HYPOTHESIS' GROUP BY 1) """ + union(
    ("RAV-001", "ASSESSMENT_POLICY_MISMATCH", "assessment_id", "policy_id", "o WHERE policy_id <> 'RISK-AGG'"),
    ("RAV-002", "ASSESSMENT_POLICY_HASH_MISMATCH", "assessment_id", "policy_hash", "o WHERE policy_hash <> 'abc'"),
    ("RAV-003", "DUPLICATE_DIMENSION_ASSESSMENT", "assessment_id", "risk_dimension", "d GROUP BY assessment_id, risk_dimension HAVING count(*) > 1"),
    ("RAV-004", "UNKNOWN_RISK_DIMENSION", "assessment_id", "risk_dimension", "d WHERE risk_dimension = 'CREDIT'"),
    ("RAV-005", "DUPLICATE_DIMENSION_CONTRIBUTOR", "assessment_id", "concat_ws('|', risk_dimension, contributor_type, contributor_id)", "c GROUP BY assessment_id, risk_dimension, contributor_type, contributor_id HAVING count(*) > 1"),
    ("RAV-006", "CORRELATION_DOUBLE_COUNT", "assessment_id", "detail", "(SELECT DISTINCT c.assessment_id, concat('LIQUIDITY|', family) AS detail FROM c JOIN sc ON c.assessment_id = sc.assessment_id WHERE role = 'SCORING' AND risk_dimension = 'LIQUIDITY' AND family IN ('PAYMENT_RETURN','DELINQUENCY'))"),
    ("RAV-007", "AGGREGATION_METHOD_MISMATCH", "assessment_id", "method", "o WHERE method <> 'MAX_DIMENSION'"),
    ("RAV-008", "OVERALL_SCORE_MISMATCH", "assessment_id", "''", "j WHERE method = 'MAX_DIMENSION' AND abs(raw_score - mx) > 0.000001"),
    ("RAV-009", "OVERALL_BAND_MISMATCH", "assessment_id", "proposed_band", "j WHERE method = 'MAX_DIMENSION' AND bd <> proposed_band"),
    ("RAV-010", "DIMENSION_SCORE_OUT_OF_SCALE", "assessment_id", "risk_dimension", "d WHERE raw_score < 0 OR raw_score > 100"),
    ("RAV-011", "DIMENSION_CAP_VIOLATION", "assessment_id", "risk_dimension", "d WHERE raw_score > CASE risk_dimension WHEN 'REPAYMENT_CONDUCT' THEN 90 WHEN 'CREDIT' THEN 1000 ELSE 100 END + 0.000001"),
    ("RAV-012", "DIMENSION_BAND_MISMATCH", "assessment_id", "risk_dimension", f"d WHERE {BANDSQL.format(x='raw_score')} <> proposed_band"),
    ("RAV-013", "OVERALL_POLICY_BAND_MISMATCH", "assessment_id", "proposed_band", f"o WHERE {BANDSQL.format(x='raw_score')} <> proposed_band"),
    ("RAV-014", "HUMAN_REVIEW_REQUIRED", "assessment_id", "''", "o WHERE NOT requires_human_review"),
    ("RAV-015", "CONTRADICTION_REQUIRES_REVIEW", "assessment_id", "''", "o WHERE contradictions > 0 AND NOT requires_human_review"),
))
def _(t):
    return au.assessment(t.sql(AOV), t.sql(ADM), t.sql(ACN), AUDIT_POLICY)
