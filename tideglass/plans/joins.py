"""Joins between facts, policies, registries and entities."""

from pyspark.sql import functions as F

from tideglass.operators import features as feat, joins as jn, signals as sig
from tideglass.plans.dpd import all_signals
from tideglass.plans.sqltext import DPD_SIGNALS, PAYMENT_SIGNALS
from tideglass.registry import query
from tideglass.sources.reference import FEATURE_REGISTRY, RISK_DIMENSIONS, SIGNAL_REGISTRY, values, values_sql


@query(
    "join_signal_by_id",
    f"""WITH {PAYMENT_SIGNALS} SELECT signal_id, pays.entity_id, pays.feature_value_id AS evidence_id, value_numeric AS evidence_value FROM pays JOIN feats USING (feature_value_id)
WHERE signal_id = (SELECT min(signal_id) FROM pays)""",
)
def _(t):
    f = feat.payment_count_features(t.payment_returned)
    s = sig.repeated_payment_return(f)
    wanted = s.join(s.agg(F.min("signal_id").alias("signal_id")), "signal_id", "left_semi")
    d = sig.evidence_drilldown(wanted, f, None)
    return d.select("signal_id", "entity_id", "evidence_id", F.col("evidence_value").cast("double").alias("evidence_value"))


@query(
    "join_full_lineage",
    f"WITH {DPD_SIGNALS} SELECT signal_id, signal_type, d.feature_value_id, f.event_id, e.event_type AS source_event_type, e.props AS source_record FROM dpds d JOIN dpdf f ON d.feature_value_id = f.feature_value_id JOIN events e ON f.event_id = e.event_id",
)
def _(t):
    at = F.col("event_time")
    signals = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    features = t.dpd_changed.select("event_id", feat.feature_id("current_dpd", F.col("event_id"), at, at).alias("feature_value_id"))
    events = t.base("events").select("event_id", F.col("event_type").alias("source_event_type"), F.col("props").alias("source_record"))
    return jn.full_lineage(signals, features, events).select(
        "signal_id", "signal_type", "feature_value_id", "event_id", "source_event_type", "source_record"
    )


# Institution policies: (id, level, jurisdictions, segments, from, to); an empty list admits all.
POLICIES = [
    ("P-CORE", "CORE", "", "", "1990-01-01", None),
    ("P-SEG-AUTO", "SEGMENT", "", "AUTOMOBILE", "1995-01-01", None),
    ("P-SEG-BUILD", "SEGMENT", "", "BUILDING,MACHINERY", "1996-01-01", "2000-01-01"),
    ("P-JUR-1", "JURISDICTION", "NATION_1,NATION_2,FRANCE,GERMANY", "", "1995-06-01", None),
    ("P-JUR-2", "JURISDICTION", "NATION_2,NATION_3,GERMANY,INDIA", "", "1996-06-01", None),
    ("P-INST", "INSTITUTION", "", "FURNITURE", "1997-01-01", None),
    ("P-PROD", "PRODUCT_DEFAULT", "NATION_4,CHINA,JAPAN", "", "1990-01-01", "1999-01-01"),
]
_POL = f"""pol AS (SELECT policy_id, level, CASE WHEN jur = '' THEN [] ELSE string_split(jur, ',') END AS jurisdictions, CASE WHEN seg = '' THEN [] ELSE string_split(seg, ',') END AS segments,
  CAST(f AS TIMESTAMP) AS effective_from, CAST(u AS TIMESTAMP) AS effective_to FROM (VALUES {values_sql(POLICIES)}) v(policy_id, level, jur, seg, f, u)),
facts AS (SELECT o_orderkey AS fact_id, o_orderdate AS asked, c.segment, c.jurisdiction FROM orders JOIN b_counterparty c ON o_custkey = c.counterparty_id),
app AS (SELECT fact_id, policy_id, level FROM facts JOIN pol ON (len(jurisdictions) = 0 OR list_contains(jurisdictions, jurisdiction)) AND (len(segments) = 0 OR list_contains(segments, segment))
  AND effective_from <= asked AND (effective_to IS NULL OR asked < effective_to)),
ranked AS (SELECT *, list_position(['SEGMENT','PRODUCT','INSTITUTION','JURISDICTION','PRODUCT_DEFAULT','CORE'], level) AS r FROM app),
top AS (SELECT fact_id, min(policy_id) AS policy_id, min(level) AS level, count(*) AS candidates FROM (SELECT *, min(r) OVER (PARTITION BY fact_id) AS m FROM ranked) WHERE r = m GROUP BY fact_id)""".replace("AS STRING", "AS VARCHAR")


def applicable(t):
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    pol = values(t.spark, ["policy_id", "level", "jur", "seg", "f", "u"], POLICIES).select(
        "policy_id", "level", split("jur").alias("jurisdictions"), split("seg").alias("segments"),
        F.array().cast("array<string>").alias("entity_types"),
        F.col("f").cast("timestamp_ntz").alias("effective_from"), F.col("u").cast("timestamp_ntz").alias("effective_to"),
    )
    facts = t.base("orders").join(t.counterparty, F.col("o_custkey") == F.col("counterparty_id")).select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("asked"), "segment", "jurisdiction"
    )
    return jn.applicable_policies(facts, pol, "COUNTERPARTY", "asked").select("fact_id", "policy_id", "level")


@query("join_policy_applicability", f"WITH {_POL} SELECT fact_id, policy_id, level FROM app")
def _(t):
    return applicable(t)


@query("pick_policy_precedence", f"WITH {_POL} SELECT fact_id, policy_id, level, candidates > 1 AS conflict FROM top")
def _(t):
    won, tied = jn.pick_by_precedence(applicable(t), ["fact_id"])
    flag = lambda d, c: d.select("fact_id", "policy_id", "level", F.lit(c).alias("conflict"))
    return flag(won, False).unionByName(flag(tied, True))


OVERLAP_SQL = """WITH g AS (SELECT policy_key, version_no, effective_from, effective_to, CASE WHEN jurisdictions = '' THEN [] ELSE string_split(jurisdictions, ',') END AS scope
  FROM b_policy_version WHERE lifecycle IN ('ACTIVE','APPROVED') AND (effective_to IS NULL OR effective_to > effective_from))
SELECT n.policy_key, n.version_no, arg_max(p.version_no, (coalesce(p.effective_to, TIMESTAMP '9999-12-31 00:00:00'), p.version_no)) AS overlaps_version
FROM g n JOIN g p ON n.policy_key = p.policy_key AND (p.effective_from, p.version_no) < (n.effective_from, n.version_no)
  AND (p.effective_to IS NULL OR n.effective_from < p.effective_to) AND (len(n.scope) = 0 OR len(p.scope) = 0 OR list_has_any(n.scope, p.scope))
GROUP BY n.policy_key, n.version_no"""


def versions(t):
    return t.policy_version.withColumn(
        "scope", F.when(F.col("jurisdictions") == "", F.array().cast("array<string>")).otherwise(F.split("jurisdictions", ","))
    )


@query("join_policy_version_overlap", OVERLAP_SQL)
def _(t):
    return jn.version_overlaps(versions(t), ["policy_key"], "scope", "version_no")


@query(
    "anti_join_registry",
    """SELECT 'FEATURE' AS kind, feature_name AS reference, count(*) AS n FROM b_policy_rule WHERE feature_name NOT IN ('returned_payment_count_30d','current_dpd','utilization_ratio') GROUP BY 2
UNION ALL SELECT 'SIGNAL', signal_code, count(*) FROM b_policy_rule WHERE signal_code NOT IN ('REPEATED_PAYMENT_RETURN','DPD_DERIORATION','UTILIZATION_HIGH','UTILIZATION_SPIKE') GROUP BY 2
UNION ALL SELECT 'DIMENSION', risk_dimension, count(*) FROM b_policy_rule WHERE risk_dimension NOT IN ('LIQUIDITY','REPAYMENT_CONDUCT') GROUP BY 2""",
)
def _(t):
    def missing(kind, column, rows, name):
        reg = values(t.spark, [name], [(r[0],) for r in rows])
        return jn.unknown_references(t.policy_rule, column, reg, name).groupBy(F.col(column).alias("reference")).agg(
            F.count(F.lit(1)).alias("n")
        ).withColumn("kind", F.lit(kind))

    return (
        missing("FEATURE", "feature_name", FEATURE_REGISTRY, "feature")
        .unionByName(missing("SIGNAL", "signal_code", SIGNAL_REGISTRY, "signal"))
        .unionByName(missing("DIMENSION", "risk_dimension", [(d,) for d in RISK_DIMENSIONS], "dimension"))
    )


RES = """res AS (SELECT c_custkey AS source_entity_id, concat('CE-', c_custkey - c_custkey % 3) AS canonical_id,
  CASE WHEN c_acctbal < 0 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS resolution_status, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.6 ELSE 0.95 END AS confidence FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


@query(
    "join_entity_resolution",
    f"""WITH {RES} SELECT o_orderkey AS fact_id, coalesce(canonical_id, '') AS canonical_id, CASE WHEN canonical_id IS NULL THEN 'UNRESOLVED' WHEN resolution_status = 'RESOLVED' AND confidence >= 0.8 THEN 'RESOLVED' ELSE 'REVIEW' END AS outcome
FROM orders LEFT JOIN res ON o_custkey = source_entity_id""",
)
def _(t):
    rows = t.base("orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("source_entity_id"))
    out = jn.resolve_entities(rows, t.sql(f"WITH {RES} SELECT * FROM res"), 0.8)
    return out.select("fact_id", F.coalesce("canonical_id", F.lit("")).alias("canonical_id"), "outcome")


IDENT = """SELECT c_custkey AS entity_id, 'NAME' AS scheme, concat(c_mktsegment, '-', c_nationkey, '-', CAST(floor(c_acctbal / 500) AS INT)) AS value, 2 AS priority FROM customer
UNION ALL SELECT c_custkey, 'REGISTER', concat('R', CAST(floor(c_acctbal) AS INT)), 1 FROM customer"""


@query(
    "match_entities_deterministic",
    f"""WITH i AS ({IDENT}), h AS (SELECT scheme, value, min(entity_id) AS candidate_id, count(DISTINCT entity_id) AS sharing FROM i GROUP BY ALL),
l AS (SELECT i.*, candidate_id FROM i JOIN h ON i.scheme = h.scheme AND i.value = h.value WHERE sharing > 1)
SELECT entity_id, arg_min(candidate_id, (priority, candidate_id)) AS matched_id, arg_min(scheme, (priority, candidate_id)) AS matched_by, count(DISTINCT candidate_id) > 1 AS conflicting FROM l GROUP BY entity_id""",
)
def _(t):
    best, _ = jn.match_by_identifiers(t.sql(IDENT))
    return best.select("entity_id", "matched_id", "matched_by", (F.col("candidates") > 1).alias("conflicting"))


REFDATA = """SELECT s_suppkey AS security_id, s_suppkey AS issuer_id, TIMESTAMP '1990-01-01 00:00:00' AS valid_from, TIMESTAMP '1998-06-01 00:00:00' AS valid_to FROM supplier
UNION ALL SELECT s_suppkey, s_nationkey + 1000, TIMESTAMP '1998-06-01 00:00:00', TIMESTAMP '2001-06-01 00:00:00' FROM supplier"""


@query(
    "join_security_to_issuer",
    f"SELECT quote_id, issuer_id, CAST(price AS DOUBLE) AS price FROM b_market_quote q JOIN ({REFDATA}) r ON q.security_id = r.security_id AND valid_from <= quote_time AND quote_time < valid_to",
)
def _(t):
    ref = t.sql(REFDATA.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    out = jn.valid_at(t.market_quote, ref, ["security_id"], "quote_time")
    return out.select("quote_id", "issuer_id", F.col("price").cast("double").alias("price"))


@query(
    "join_related_party_flows",
    """SELECT transfer_id, payer_id, beneficiary_id, CAST(amount AS DOUBLE) AS amount FROM b_transfer f WHERE EXISTS (SELECT 1 FROM b_relationship e
WHERE e.edge_type IN ('CONTROL','GUARANTEE') AND e.owner_id = f.payer_id AND e.owned_id = f.beneficiary_id AND e.valid_from <= f.event_time AND f.event_time < e.valid_to)""",
)
def _(t):
    edges = t.relationship.filter("edge_type IN ('CONTROL','GUARANTEE')")
    out = jn.flows_to_related(t.transfer, edges)
    return out.select("transfer_id", "payer_id", "beneficiary_id", F.col("amount").cast("double").alias("amount"))


@query(
    "reconcile_sources",
    """WITH a AS (SELECT o_orderkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1)
SELECT k, a.v AS value_a, b.v AS value_b, CASE WHEN a.v IS NULL THEN 'MISSING_A' WHEN b.v IS NULL THEN 'MISSING_B' WHEN abs(a.v - b.v) <= 50000 THEN 'AGREE' ELSE 'CONFLICTED' END AS reconciliation FROM a FULL JOIN b USING (k)""",
)
def _(t):
    total = lambda table, key, col: t.base(table).groupBy(F.col(key).alias("k")).agg(
        F.sum(F.col(col).cast("decimal(20,2)")).cast("double").alias("v")
    )
    return jn.reconcile(total("orders", "o_orderkey", "o_totalprice"), total("lineitem", "l_orderkey", "l_extendedprice"), ["k"], "v", 50000)


@query(
    "semi_join_open_conditions",
    f"""WITH {DPD_SIGNALS}, open AS (SELECT entity_id FROM dpds GROUP BY entity_id HAVING max(effective_at) >= TIMESTAMP '2024-01-28 00:00:00')
SELECT CAST(facility_id AS VARCHAR) AS entity_id, count(*) AS features, CAST(facility_id AS VARCHAR) IN (SELECT entity_id FROM open) AS has_open FROM b_dpd_changed GROUP BY facility_id""",
)
def _(t):
    signals = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    open_now = signals.groupBy("entity_id").agg(F.max("effective_at").alias("last_at")).filter("last_at >= TIMESTAMP_NTZ '2024-01-28 00:00:00'")
    counts = t.dpd_changed.groupBy(F.col("facility_id").cast("string").alias("entity_id")).agg(F.count(F.lit(1)).alias("features"))
    return counts.join(open_now, "entity_id", "left_semi").withColumn("has_open", F.lit(True)).unionByName(
        counts.join(open_now, "entity_id", "left_anti").withColumn("has_open", F.lit(False))
    )


@query(
    "list_signals_by_status",
    f"WITH {DPD_SIGNALS} SELECT signal_id, signal_type, entity_id FROM dpds",
)
def _(t):
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    return s.filter("status = 'PROPOSED'").select("signal_id", "signal_type", "entity_id")


@query(
    "list_signals_by_entity_type",
    f"WITH {DPD_SIGNALS} SELECT signal_id, severity FROM dpds WHERE entity_id = '7' AND signal_type = 'DPD_WORSENING'",
)
def _(t):
    return all_signals(t).filter("entity_type = 'FACILITY' AND entity_id = '7' AND signal_type = 'DPD_WORSENING'").select("signal_id", "severity")


@query(
    "intersect_scope",
    """WITH s AS (SELECT jurisdictions, CASE WHEN jurisdictions = '' THEN [] ELSE string_split(jurisdictions, ',') END AS scope FROM b_policy_version)
SELECT jurisdictions, len(scope) = 0 OR list_has_any(scope, ['GB']) AS intersects, count(*) AS n FROM s GROUP BY ALL""",
)
def _(t):
    from tideglass.functions.scalars import scopes_intersect

    hit = scopes_intersect(F.col("scope"), F.array(F.lit("GB")))
    return versions(t).groupBy("jurisdictions", hit.alias("intersects")).agg(F.count(F.lit(1)).alias("n"))
