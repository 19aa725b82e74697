"""Correlation hypotheses and proposed assessments over bound contributors."""

from dataclasses import replace

from pyspark.sql import functions as F

from tideglass.operators import assessment as asm, correlation as corr
from tideglass.registry import query

CAND = """cand AS (SELECT *, CASE analytical_type WHEN 'REPEATED_PAYMENT_RETURN' THEN 'PAYMENT_RETURN' WHEN 'DPD_DERIORATION' THEN 'DELINQUENCY' WHEN 'PAYMENT_CURED' THEN 'PAYMENT_CURED' ELSE 'UTILIZATION_PRESSURE' END AS family,
  CASE analytical_type WHEN 'PAYMENT_CURED' THEN 'CONTRADICTING' ELSE 'SUPPORTING' END AS role,
  make_timestamp(CAST(ceil(epoch_us(effective_at) / 2592000000000.0) AS BIGINT) * 2592000000000) AS as_of
  FROM b_contributor WHERE status NOT IN ('REJECTED','CLOSED','EXPIRED','SUPERSEDED') AND disposition_tag NOT IN ('FALSE_POSITIVE','DUPLICATE','INSUFFICIENT_EVIDENCE') AND quality_state NOT IN ('STALE','INSUFFICIENT')),
sup AS (SELECT * FROM cand WHERE role = 'SUPPORTING'),
links AS (SELECT DISTINCT a.counterparty_id, a.as_of, a.family AS fa, b.family AS fb FROM sup a JOIN sup b ON a.counterparty_id = b.counterparty_id AND a.as_of = b.as_of AND a.lineage_group = b.lineage_group AND a.family < b.family),
nlinks AS (SELECT counterparty_id, as_of, count(*) AS n FROM links GROUP BY ALL),
ind AS (SELECT s.counterparty_id, s.as_of, s.raw_supporting, s.families, s.families - least(s.families - 1, coalesce(n, 0)) AS independent_supporting
  FROM (SELECT counterparty_id, as_of, count(*) AS raw_supporting, count(DISTINCT family) AS families FROM sup GROUP BY ALL) s LEFT JOIN nlinks USING (counterparty_id, as_of)),
st AS (SELECT counterparty_id, as_of, CAST(sum(CASE WHEN role = 'SUPPORTING' THEN confidence END) AS DOUBLE) / count(CASE WHEN role = 'SUPPORTING' THEN 1 END) AS mean, CAST(min(CASE WHEN role = 'SUPPORTING' THEN confidence END) AS DOUBLE) AS low,
  count(CASE WHEN role = 'CONTRADICTING' THEN 1 END) AS contradicting, min(effective_at) AS window_first, max(effective_at) AS window_last FROM cand GROUP BY ALL),
hyp AS (SELECT 'EMERGING_LIQUIDITY_STRESS' AS hypothesis_type, ind.*, contradicting, window_first, window_last, mean, low,
  round(greatest(low, least(mean + (independent_supporting - 2) * 0.05, 0.95)) * CASE WHEN contradicting > 0 THEN 0.8 ELSE 1 END, 6) AS confidence
  FROM ind JOIN st USING (counterparty_id, as_of) WHERE independent_supporting >= 2)"""


def cand(t):
    return corr.candidates(t.contributor, corr.LIQUIDITY)


def hyp(t, policy=corr.LIQUIDITY):
    return corr.hypotheses(t.contributor, policy)


@query("join_hypothesis_candidates", f"WITH {CAND} SELECT contributor_id, counterparty_id, as_of, family, role FROM cand")
def _(t):
    return cand(t).select("contributor_id", "counterparty_id", "as_of", "family", "role")


@query(
    "corr_candidates",
    f"WITH {CAND} SELECT analytical_type, role, count(*) AS n, count(DISTINCT counterparty_id) AS counterparties FROM cand GROUP BY ALL",
)
def _(t):
    return cand(t).groupBy("analytical_type", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("counterparty_id").alias("counterparties"))


@query("corr_lineage_collapse", f"WITH {CAND} SELECT counterparty_id, as_of, raw_supporting, CAST(families AS INT) AS families, CAST(independent_supporting AS INT) AS independent_supporting FROM ind")
def _(t):
    return corr.independent_counts(cand(t).filter("role = 'SUPPORTING'"), ["counterparty_id", "as_of"])


@query(
    "agg_independent_families",
    f"WITH {CAND} SELECT CAST(independent_supporting AS INT) AS independent_supporting, count(*) AS hypotheses FROM ind GROUP BY 1",
)
def _(t):
    return corr.independent_counts(cand(t).filter("role = 'SUPPORTING'"), ["counterparty_id", "as_of"]).groupBy("independent_supporting").agg(
        F.count(F.lit(1)).alias("hypotheses")
    )


@query(
    "corr_hypothesis",
    f"WITH {CAND} SELECT hypothesis_type, counterparty_id, as_of, raw_supporting, CAST(independent_supporting AS INT) AS independent_supporting, contradicting, window_first, window_last, confidence, 'HIGH' AS materiality, 'PROPOSED' AS status FROM hyp",
)
def _(t):
    return hyp(t).select(
        "hypothesis_type", "counterparty_id", "as_of", "raw_supporting", "independent_supporting", "contradicting", "window_first",
        "window_last", "confidence", "materiality", "status",
    )


@query(
    "corr_confidence",
    f"WITH {CAND} SELECT counterparty_id, as_of, round(low * CASE WHEN contradicting > 0 THEN 0.8 ELSE 1 END, 6) AS minimum_confidence, round(mean * CASE WHEN contradicting > 0 THEN 0.8 ELSE 1 END, 6) AS mean_confidence, confidence AS bounded_confidence FROM hyp",
)
def _(t):
    keys = ["counterparty_id", "as_of"]
    by = lambda m, n: hyp(t, replace(corr.LIQUIDITY, confidence_method=m)).select(*keys, F.col("confidence").alias(n))
    return by("MINIMUM_CONTRIBUTOR_CONFIDENCE", "minimum_confidence").join(by("WEIGHTED_CONTRIBUTORS", "mean_confidence"), keys).join(
        by("BOUNDED_RULE", "bounded_confidence"), keys
    )


@query(
    "corr_contradiction",
    f"WITH {CAND} SELECT contradicting > 0 AS contradicted, count(*) AS hypotheses, CAST(sum(CASE WHEN contradicting > 0 THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM hyp GROUP BY 1",
)
def _(t):
    h = hyp(t, replace(corr.LIQUIDITY, contradiction_mode="BLOCK_ACTIVATION"))
    return h.groupBy((F.col("contradicting") > 0).alias("contradicted")).agg(
        F.count(F.lit(1)).alias("hypotheses"), F.sum(F.col("activation_blocked").cast("int")).alias("blocked")
    )


CLIFE = f"""{CAND}, seq AS (SELECT counterparty_id, as_of, lag(as_of) OVER w AS b, lead(as_of) OVER w AS a FROM hyp WINDOW w AS (PARTITION BY counterparty_id ORDER BY as_of)),
clife AS (SELECT counterparty_id, as_of, CASE WHEN as_of = b + INTERVAL 30 DAY THEN 'ACTIVE' ELSE 'PROPOSED' END AS status FROM seq
  UNION ALL SELECT counterparty_id, as_of + INTERVAL 30 DAY, 'RESOLVED' FROM seq WHERE a IS NULL OR a > as_of + INTERVAL 30 DAY)"""


@query("corr_lifecycle", f"WITH {CLIFE} SELECT counterparty_id, as_of, status FROM clife")
def _(t):
    return corr.lifecycle(hyp(t), 30).select("counterparty_id", "as_of", "status")


@query(
    "corr_other_hypotheses",
    """WITH c AS (SELECT *, CASE analytical_type WHEN 'UTILIZATION_HIGH' THEN 'HIGH' WHEN 'UTILIZATION_SPIKE' THEN 'SPIKE' END AS family, make_timestamp(CAST(ceil(epoch_us(effective_at) / 7776000000000.0) AS BIGINT) * 7776000000000) AS as_of FROM b_contributor
  WHERE status NOT IN ('REJECTED','CLOSED','EXPIRED','SUPERSEDED') AND disposition_tag = '' AND quality_state = 'COMPLETE' AND analytical_type IN ('UTILIZATION_HIGH','UTILIZATION_SPIKE')),
l AS (SELECT DISTINCT a.counterparty_id, a.as_of FROM c a JOIN c b ON a.counterparty_id = b.counterparty_id AND a.as_of = b.as_of AND a.lineage_group = b.lineage_group AND a.family < b.family)
SELECT 'REFINANCING_STRESS' AS hypothesis_type, counterparty_id, as_of, count(*) AS raw_supporting FROM c WHERE (counterparty_id, as_of) NOT IN (SELECT (counterparty_id, as_of) FROM l) GROUP BY counterparty_id, as_of HAVING count(DISTINCT family) >= 2""",
)
def _(t):
    """Another policy row on the same operator."""
    policy = replace(
        corr.LIQUIDITY, policy_id="CORR-REFINANCING-001", hypothesis_type="REFINANCING_STRESS", window_days=90,
        families={"UTILIZATION_HIGH": "HIGH", "UTILIZATION_SPIKE": "SPIKE"}, contradicting=(),
    )
    return hyp(t, policy).select("hypothesis_type", "counterparty_id", "as_of", "raw_supporting")


CONTRIB = f"""{CAND}, dims AS (SELECT * FROM (VALUES ('REPEATED_PAYMENT_RETURN','REPAYMENT_CONDUCT'),('REPEATED_PAYMENT_RETURN','LIQUIDITY'),('DPD_DERIORATION','REPAYMENT_CONDUCT'),('DPD_DERIORATION','CASH_FLOW_DEBT_SERVICE'),
  ('UTILIZATION_HIGH','LIQUIDITY'),('UTILIZATION_HIGH','REFINANCING_FUNDING'),('UTILIZATION_SPIKE','LIQUIDITY'),('UTILIZATION_SPIKE','REFINANCING_FUNDING')) v(analytical_type, risk_dimension)),
pts AS (SELECT c.*, risk_dimension, CASE severity WHEN 'CRITICAL' THEN 90.0 WHEN 'HIGH' THEN 70.0 WHEN 'MEDIUM' THEN 40.0 WHEN 'LOW' THEN 20.0 ELSE 0.0 END AS points FROM sup c JOIN dims USING (analytical_type) WHERE confidence >= 0.5),
fam AS (SELECT counterparty_id, as_of, risk_dimension, family, max(points) AS points, count(*) AS contributors FROM pts GROUP BY ALL),
scored AS (SELECT fam.counterparty_id, fam.as_of, risk_dimension, 'SIGNAL' AS source, family, CAST(points AS DOUBLE) AS points, contributors, CASE WHEN risk_dimension = 'LIQUIDITY' AND h.as_of IS NOT NULL THEN 'LINEAGE_ONLY' ELSE 'SCORING' END AS role
    FROM fam LEFT JOIN (SELECT counterparty_id, as_of FROM hyp) h ON fam.counterparty_id = h.counterparty_id AND fam.as_of = h.as_of
  UNION ALL SELECT counterparty_id, as_of, 'LIQUIDITY', 'CORRELATION_HYPOTHESIS', hypothesis_type, CAST(80 AS DOUBLE), 1, 'SCORING' FROM hyp),
dim AS (SELECT counterparty_id, as_of, risk_dimension, least(max(points), 100.0) AS raw_score FROM scored WHERE role = 'SCORING' GROUP BY ALL),
dimb AS (SELECT *, CASE WHEN raw_score >= 75 THEN 'CRITICAL' WHEN raw_score >= 50 THEN 'HIGH' WHEN raw_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS proposed_band FROM dim),
ov AS (SELECT counterparty_id, as_of, max(raw_score) AS raw_score, arg_max(proposed_band, raw_score) AS proposed_band, count(*) AS dimensions FROM dimb GROUP BY ALL)"""


def gated(t):
    return asm.contributions(cand(t).filter("role = 'SUPPORTING'"), asm.CORPORATE)


def scored(t):
    return asm.substitute(gated(t)[0], hyp(t), asm.CORPORATE)


def dims(t):
    return asm.dimension_scores(scored(t), asm.CORPORATE)


@query("assess_contributions", f"WITH {CONTRIB} SELECT contributor_id, risk_dimension, severity, CAST(points AS DOUBLE) AS points FROM pts")
def _(t):
    return gated(t)[0].select("contributor_id", "risk_dimension", "severity", F.col("points").cast("double").alias("points"))


@query("assess_quality_gate", f"WITH {CONTRIB} SELECT contributor_id, CAST(confidence AS DOUBLE) AS confidence FROM sup WHERE confidence < 0.5")
def _(t):
    return gated(t)[1].select("contributor_id", F.col("confidence").cast("double").alias("confidence"))


@query("assess_substitution", f"WITH {CONTRIB} SELECT * FROM scored")
def _(t):
    return scored(t)


@query("assess_dimension", f"WITH {CONTRIB} SELECT counterparty_id, as_of, risk_dimension, CAST(raw_score AS DOUBLE) AS raw_score, proposed_band, false AS cap_applied FROM dimb")
def _(t):
    return dims(t)


@query(
    "agg_dimension_score",
    f"WITH {CONTRIB} SELECT risk_dimension, CAST(least(max(points), 75.0) AS DOUBLE) AS top_score, CAST(count(DISTINCT CASE WHEN points > 75 THEN (counterparty_id, as_of) END) AS BIGINT) AS capped FROM scored WHERE role = 'SCORING' GROUP BY risk_dimension",
)
def _(t):
    low = replace(asm.CORPORATE, caps={k: 75.0 for k in asm.CORPORATE.caps})
    return asm.dimension_scores(scored(t), low).groupBy("risk_dimension").agg(
        F.max("raw_score").alias("top_score"), F.sum(F.col("cap_applied").cast("int")).alias("capped")
    )


@query("band_for_score", "SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p, CASE WHEN l_quantity * 2 >= 75 THEN 'CRITICAL' WHEN l_quantity * 2 >= 50 THEN 'HIGH' WHEN l_quantity * 2 >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM lineitem")
def _(t):
    return t.base("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"),
        asm.band_for_score(F.col("l_quantity") * 2, asm.CORPORATE).alias("band"),
    )


@query(
    "agg_overall_max",
    f"WITH {CONTRIB} SELECT counterparty_id, as_of, CAST(raw_score AS DOUBLE) AS raw_score, proposed_band, CAST(dimensions AS BIGINT) AS dimensions, (SELECT min(risk_dimension) FROM dimb d WHERE d.counterparty_id = ov.counterparty_id AND d.as_of = ov.as_of AND d.raw_score = ov.raw_score) AS leading_dimension FROM ov",
)
def _(t):
    return asm.overall_max(dims(t))


WEIGHTS = {"LIQUIDITY": 0.4, "REPAYMENT_CONDUCT": 0.3, "CASH_FLOW_DEBT_SERVICE": 0.2, "REFINANCING_FUNDING": 0.1}


@query(
    "agg_overall_weighted",
    f"""WITH {CONTRIB}, w AS (SELECT counterparty_id, as_of, round(CAST(sum(raw_score * CASE risk_dimension WHEN 'LIQUIDITY' THEN 4 WHEN 'REPAYMENT_CONDUCT' THEN 3 WHEN 'CASH_FLOW_DEBT_SERVICE' THEN 2 ELSE 1 END) AS DOUBLE) / 10, 6) AS raw_score FROM dimb GROUP BY ALL)
SELECT *, CASE WHEN raw_score >= 75 THEN 'CRITICAL' WHEN raw_score >= 50 THEN 'HIGH' WHEN raw_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS proposed_band FROM w""",
)
def _(t):
    return asm.overall_weighted(dims(t), WEIGHTS, asm.CORPORATE)


@query("agg_overall_band_only", f"WITH {CONTRIB} SELECT counterparty_id, as_of, ['LOW','MEDIUM','HIGH','CRITICAL'][max(list_position(['LOW','MEDIUM','HIGH','CRITICAL'], proposed_band))] AS proposed_band FROM dimb GROUP BY ALL")
def _(t):
    return asm.overall_band_only(dims(t))


REVIEW = f"""{CONTRIB}, rv AS (SELECT ov.*, coalesce(c.n, 0) AS contradictions, proposed_band IN ('HIGH','CRITICAL') OR coalesce(c.n, 0) > 0 AS requires_human_review FROM ov
  LEFT JOIN (SELECT counterparty_id, as_of, count(*) AS n FROM cand WHERE role = 'CONTRADICTING' GROUP BY ALL) c USING (counterparty_id, as_of))"""


def assessed(t):
    return asm.human_review(asm.overall_max(dims(t)), cand(t).filter("role = 'CONTRADICTING'"), asm.CORPORATE)


@query("assess_overall", f"WITH {REVIEW} SELECT counterparty_id, as_of, CAST(raw_score AS DOUBLE) AS raw_score, proposed_band FROM rv")
def _(t):
    return assessed(t).select("counterparty_id", "as_of", "raw_score", "proposed_band")


@query("assess_human_review", f"WITH {REVIEW} SELECT counterparty_id, as_of, proposed_band, contradictions, requires_human_review FROM rv")
def _(t):
    return assessed(t).select("counterparty_id", "as_of", "proposed_band", "contradictions", "requires_human_review")


ARV = f"""{REVIEW}, arv AS (SELECT *, lag(raw_score) OVER w AS ps, lag(proposed_band) OVER w AS pb FROM rv WINDOW w AS (PARTITION BY counterparty_id ORDER BY as_of)),
ch AS (SELECT counterparty_id, as_of, CAST(raw_score AS DOUBLE) AS raw_score, proposed_band, coalesce(CAST(raw_score - ps AS DOUBLE), 0) AS score_change, coalesce(pb, '') AS previous_band FROM arv WHERE pb IS NULL OR raw_score IS DISTINCT FROM ps OR proposed_band IS DISTINCT FROM pb)"""


def revised(t):
    """A new revision only where score or band changed; one row per counterparty and window."""
    from pyspark.sql import Window

    w = Window.partitionBy("counterparty_id").orderBy("as_of")
    rows = assessed(t).withColumn("_p", F.lag(F.struct("raw_score", "proposed_band")).over(w))
    same = F.col("_p").eqNullSafe(F.struct("raw_score", "proposed_band"))
    changed = rows.filter(~same)
    return changed.withColumn("revision", F.row_number().over(w)).select(
        "counterparty_id", "as_of", "raw_score", "proposed_band", F.col("revision").cast("bigint").alias("revision"),
        F.coalesce(F.col("raw_score") - F.col("_p.raw_score"), F.lit(0.0)).alias("score_change"),
        F.coalesce("_p.proposed_band", F.lit("")).alias("previous_band"),
    )


@query("assess_revision", f"WITH {ARV} SELECT counterparty_id, as_of, raw_score, proposed_band, row_number() OVER (PARTITION BY counterparty_id ORDER BY as_of) AS revision FROM ch")
def _(t):
    return revised(t).select("counterparty_id", "as_of", "raw_score", "proposed_band", "revision")


@query("assess_diff", f"WITH {ARV} SELECT counterparty_id, as_of, score_change, previous_band, proposed_band FROM ch WHERE previous_band <> ''")
def _(t):
    return revised(t).filter("previous_band <> ''").select("counterparty_id", "as_of", "score_change", "previous_band", "proposed_band")


@query(
    "assess_raw_vs_approved",
    f"""WITH {REVIEW}, adj AS (SELECT DISTINCT s_suppkey AS counterparty_id, CASE WHEN s_acctbal < 0 THEN 'CRITICAL' END AS approved_band FROM supplier)
SELECT counterparty_id, as_of, CAST(raw_score AS DOUBLE) AS raw_score, proposed_band, coalesce(approved_band, '') AS adjusted_band, coalesce(approved_band, proposed_band) AS approved_band FROM rv LEFT JOIN adj USING (counterparty_id)""",
)
def _(t):
    """The proposal stays as it was; a decision adds columns beside it."""
    decisions = t.base("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("counterparty_id"), F.lit("CRITICAL").alias("decided_band"))
    return assessed(t).join(decisions, "counterparty_id", "left").select(
        "counterparty_id", "as_of", "raw_score", "proposed_band", F.coalesce("decided_band", F.lit("")).alias("adjusted_band"),
        F.coalesce("decided_band", "proposed_band").alias("approved_band"),
    )


@query(
    "top_drivers",
    f"""WITH {CONTRIB} SELECT counterparty_id, as_of, position, risk_dimension, family FROM (SELECT *, row_number() OVER (PARTITION BY counterparty_id, as_of ORDER BY points DESC, risk_dimension, family) AS position FROM scored WHERE role = 'SCORING') WHERE position <= 3""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("counterparty_id", "as_of").orderBy(F.desc("points"), "risk_dimension", "family")
    return (
        scored(t).filter("role = 'SCORING'").withColumn("position", F.row_number().over(w)).filter("position <= 3")
        .select("counterparty_id", "as_of", F.col("position").cast("bigint").alias("position"), "risk_dimension", "family")
    )
