"""Payment returns: scans, rolling features, signals, views."""

from pyspark.sql import functions as F

from tideglass.operators import features as feat, signals as sig
from tideglass.operators.ordered import rolling
from tideglass.plans.sqltext import PAYMENT_FEATURES, PAYMENT_POINTS, PAYMENT_SIGNALS
from tideglass.registry import query


@query("src_payment_returned", "SELECT event_id, account_id, event_time, CAST(amount AS DOUBLE) AS amount, return_reason_category FROM b_payment_returned")
def _(t):
    return t.payment_returned.withColumn("amount", F.col("amount").cast("double"))


@query(
    "filter_countable_returns",
    "SELECT event_id, account_id, event_time FROM b_payment_returned WHERE return_reason_category NOT IN ('TECHNICAL','BENEFICIARY_DETAIL')",
)
def _(t):
    return feat.countable_returns(t.payment_returned).select("event_id", "account_id", "event_time")


ROLL = """SELECT event_id, account_id, event_time, {value} AS {name} FROM b_payment_returned
WHERE return_reason_category NOT IN ('TECHNICAL','BENEFICIARY_DETAIL')
WINDOW w AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)"""


@query("win_returned_payment_count_30d", ROLL.format(value="count(*) OVER w", name="returned_payment_count_30d"))
def _(t):
    out = rolling(
        feat.countable_returns(t.payment_returned), ["account_id"], "event_time", 30,
        {"returned_payment_count_30d": ("count", "event_id")},
    )
    return out.select("event_id", "account_id", "event_time", "returned_payment_count_30d")


@query("win_returned_payment_value_30d", ROLL.format(value="CAST(sum(amount) OVER w AS DOUBLE)", name="returned_payment_value_30d"))
def _(t):
    out = rolling(
        feat.countable_returns(t.payment_returned), ["account_id"], "event_time", 30,
        {"returned_payment_value_30d": ("sum", "amount")},
    )
    return out.select("event_id", "account_id", "event_time", F.col("returned_payment_value_30d").cast("double").alias("returned_payment_value_30d"))


@query(
    "win_returned_payment_rate_30d",
    """SELECT event_id, account_id, event_time,
  round(CAST(count(CASE WHEN return_reason_category NOT IN ('TECHNICAL','BENEFICIARY_DETAIL') THEN 1 END) OVER w AS DOUBLE) / count(*) OVER w, 6)
    AS returned_payment_rate_30d
FROM b_payment_returned
WINDOW w AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    countable = ~F.col("return_reason_category").isin("TECHNICAL", "BENEFICIARY_DETAIL")
    out = rolling(
        t.payment_returned.withColumn("hit", F.when(countable, 1)), ["account_id"], "event_time", 30,
        {"returns": ("count", "hit"), "instructions": ("count", "event_id")},
    )
    return out.select(
        "event_id", "account_id", "event_time",
        F.round(F.when(F.col("instructions") > 0, F.col("returns") / F.col("instructions")), 6).alias("returned_payment_rate_30d"),
    )


@query("feature_returned_payment_count_30d", f"WITH {PAYMENT_FEATURES} SELECT feature_value_id, entity_id, 'VALUE' AS state, value_numeric, window_start, window_end FROM feats")
def _(t):
    return feat.payment_count_features(t.payment_returned).select(
        "feature_value_id", "entity_id", "state", F.col("value_numeric").cast("double").alias("value_numeric"), "window_start", "window_end"
    )


@query(
    "signal_repeated_payment_return",
    f"WITH {PAYMENT_SIGNALS} SELECT signal_id, signal_type, 'GLOBAL_CORE' AS semantic_scope, 'ACCOUNT' AS entity_type, entity_id, 'PROPOSED' AS status, severity, "
    "CAST(0.8 AS DOUBLE) AS confidence_value, materiality_band, effective_at, 'POL-PAYMENT-RETURN-CORP-001' AS policy_id, '2.0' AS policy_version, "
    "'COMPLETE' AS data_quality_state, feature_value_id AS evidence FROM pays",
)
def _(t):
    s = sig.repeated_payment_return(feat.payment_count_features(t.payment_returned))
    return s.withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids", "knowledge_time")


@query(
    "join_evidence_drilldown",
    f"""WITH {PAYMENT_SIGNALS} SELECT signal_id, signal_type, pays.entity_id, pays.feature_value_id AS evidence_id,
  'returned_payment_count_30d' AS feature_name, 'VALUE' AS evidence_state, value_numeric AS evidence_value, window_start, window_end
FROM pays JOIN feats ON pays.feature_value_id = feats.feature_value_id""",
)
def _(t):
    f = feat.payment_count_features(t.payment_returned)
    d = sig.evidence_drilldown(sig.repeated_payment_return(f), f)
    return d.select(
        "signal_id", "signal_type", "entity_id", "evidence_id", "feature_name", "evidence_state",
        F.col("evidence_value").cast("double").alias("evidence_value"), "window_start", "window_end",
    )


@query(
    "signal_high_value_payment_return",
    f"""WITH {PAYMENT_POINTS}, exposure AS (SELECT account_id, sum(amount) AS total FROM b_payment_returned GROUP BY account_id)
SELECT pts.account_id, event_time, round(CAST(return_value AS DOUBLE) / CAST(total AS DOUBLE), 6) AS returned_share,
  CASE WHEN CAST(return_value AS DOUBLE) / CAST(total AS DOUBLE) >= 0.03 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM pts JOIN exposure USING (account_id) WHERE CAST(return_value AS DOUBLE) / CAST(total AS DOUBLE) >= 0.015""",
)
def _(t):
    points = feat.returned_payment_points(t.payment_returned)
    exposure = t.payment_returned.groupBy("account_id").agg(F.sum("amount").alias("total"))
    share = F.col("return_value").cast("double") / F.col("total").cast("double")
    return (
        points.join(exposure, "account_id").filter(share >= 0.015)
        .select("account_id", "event_time", F.round(share, 6).alias("returned_share"),
                F.when(share >= 0.03, "HIGH").otherwise("MEDIUM").alias("severity"))
    )
