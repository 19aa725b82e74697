"""Days past due: point features, rolling maxima, band crossings, signals."""

from pyspark.sql import Window, functions as F

from tideglass.functions.scalars import dpd_band
from tideglass.operators import features as feat, signals as sig
from tideglass.operators.ordered import rolling, running, with_previous
from tideglass.plans.sqltext import DPD_CROSSINGS, DPD_FEATURES, DPD_SIGNALS, PAYMENT_FEATURES, PAYMENT_SIGNALS
from tideglass.registry import query

USABLE = "reconciled AND current_dpd IS NOT NULL AND current_dpd >= 0"


def _double(name):
    return F.col(name).cast("double").alias(name)


@query("src_dpd_changed", "SELECT event_id, event_time, facility_id, counterparty_id, current_dpd, reconciled FROM b_dpd_changed")
def _(t):
    return t.dpd_changed


@query("filter_usable_dpd", "SELECT event_id, facility_id, current_dpd FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0")
def _(t):
    return t.dpd_changed.filter(USABLE).select("event_id", "facility_id", "current_dpd")


@query(
    "project_current_dpd",
    f"""WITH {DPD_FEATURES} SELECT feature_value_id, 'FD-CURRENT-DPD-001' AS definition_id, 'current_dpd' AS feature_name, 'FACILITY' AS entity_type, entity_id, state,
  CASE WHEN usable THEN CAST(current_dpd AS DOUBLE) END AS value_numeric, event_time AS knowledge_time,
  CASE WHEN usable THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS quality_state FROM dpdf""",
)
def _(t):
    return feat.current_dpd_features(t.dpd_changed).select(
        "feature_value_id", "definition_id", "feature_name", "entity_type", "entity_id", "state", _double("value_numeric"),
        "knowledge_time", "quality_state",
    )


@query("derive_value_state", f"WITH {DPD_FEATURES} SELECT state, count(*) AS n FROM dpdf GROUP BY state")
def _(t):
    return feat.current_dpd_features(t.dpd_changed).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "derive_quality_state",
    f"WITH {DPD_FEATURES} SELECT CASE WHEN usable THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS quality_state, count(*) AS n FROM dpdf GROUP BY 1",
)
def _(t):
    return feat.current_dpd_features(t.dpd_changed).groupBy("quality_state").agg(F.count(F.lit(1)).alias("n"))


@query("filter_trackable_dpd", f"WITH {DPD_FEATURES} SELECT feature_value_id, entity_id FROM dpdf WHERE usable")
def _(t):
    return sig.trackable_dpd(feat.current_dpd_features(t.dpd_changed)).select("feature_value_id", "entity_id")


def _max_dpd(t, days):
    out = rolling(t.dpd_changed.filter(USABLE), ["facility_id"], "event_time", days, {"max_dpd": ("max", "current_dpd")})
    return out.select("event_id", "facility_id", "event_time", F.col("max_dpd").alias(f"max_dpd_{days}d"))


MAX_DPD = """SELECT event_id, facility_id, event_time, max(current_dpd) OVER (PARTITION BY facility_id ORDER BY event_time
  RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) AS max_dpd_{days}d
FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0"""


@query("win_max_dpd_30d", MAX_DPD.format(days=30))
def _(t):
    return _max_dpd(t, 30)


@query("win_max_dpd_90d", MAX_DPD.format(days=90))
def _(t):
    return _max_dpd(t, 90)


@query("win_max_dpd_7d", MAX_DPD.format(days=7))
def _(t):
    return _max_dpd(t, 7)


@query("win_prev_dpd", f"WITH {DPD_CROSSINGS} SELECT event_id, CAST(current_dpd AS INT) AS dpd, CAST(previous_dpd AS DOUBLE) AS previous_dpd FROM crossed")
def _(t):
    rows = with_previous(
        _trackable(t), ["facility_id"], "event_time", ["feature_value_id"], {"previous_dpd": "current_dpd"}
    )
    return rows.select("event_id", F.col("current_dpd").alias("dpd"), _double("previous_dpd"))


def _trackable(t):
    good = t.dpd_changed.filter(USABLE)
    at = F.col("event_time")
    return good.withColumn("feature_value_id", feat.feature_id("current_dpd", F.col("event_id"), at, at))


@query("win_dpd_band_crossing", f"WITH {DPD_CROSSINGS} SELECT feature_value_id, entity_id, coalesce(crossing, 'NONE') AS crossing FROM crossed")
def _(t):
    rows = sig.dpd_crossings(feat.current_dpd_features(t.dpd_changed))
    return rows.select("feature_value_id", "entity_id", F.coalesce("crossing", F.lit("NONE")).alias("crossing"))


@query(
    "win_dpd_velocity",
    """SELECT event_id, round((current_dpd - previous_dpd) / (epoch_us(event_time) - epoch_us(previous_time)) * 86400000000.0, 6) AS dpd_per_day
FROM (SELECT *, lag(current_dpd) OVER w AS previous_dpd, lag(event_time) OVER w AS previous_time FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0
  WINDOW w AS (PARTITION BY facility_id ORDER BY event_time, event_id)) WHERE epoch_us(event_time) > epoch_us(previous_time)""",
)
def _(t):
    rows = with_previous(
        t.dpd_changed.filter(USABLE), ["facility_id"], "event_time", ["event_id"],
        {"previous_dpd": "current_dpd", "previous_time": "event_time"},
    )
    us = F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.col("previous_time").cast("timestamp"))
    return rows.filter(us > 0).select(
        "event_id", F.round((F.col("current_dpd") - F.col("previous_dpd")) / us * 86400000000.0, 6).alias("dpd_per_day")
    )


@query(
    "win_dpd_cure_relapse",
    """WITH p AS (SELECT *, lag(current_dpd) OVER (PARTITION BY facility_id ORDER BY event_time, event_id) AS previous_dpd FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0),
e AS (SELECT *, CASE WHEN previous_dpd > 0 AND current_dpd = 0 THEN 1 ELSE 0 END AS cure FROM p),
c AS (SELECT *, coalesce(sum(cure) OVER (PARTITION BY facility_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cures_before FROM e)
SELECT event_id, CASE WHEN cure = 1 THEN 'CURED' WHEN cures_before > 0 AND previous_dpd = 0 AND current_dpd > 0 THEN 'RELAPSED' END AS movement, CAST(cures_before AS BIGINT) AS cures_before
FROM c WHERE cure = 1 OR (cures_before > 0 AND previous_dpd = 0 AND current_dpd > 0)""",
)
def _(t):
    rows = with_previous(t.dpd_changed.filter(USABLE), ["facility_id"], "event_time", ["event_id"], {"previous_dpd": "current_dpd"})
    rows = rows.withColumn("cure", F.when((F.col("previous_dpd") > 0) & (F.col("current_dpd") == 0), 1).otherwise(0))
    rows = running(rows, ["facility_id"], "event_time", ["event_id"], {"cures_before": ("sum", "cure")}, include_current=False)
    before = F.coalesce("cures_before", F.lit(0)).cast("bigint")
    relapse = (before > 0) & (F.col("previous_dpd") == 0) & (F.col("current_dpd") > 0)
    return rows.filter((F.col("cure") == 1) | relapse).select(
        "event_id", F.when(F.col("cure") == 1, "CURED").otherwise("RELAPSED").alias("movement"), before.alias("cures_before")
    )


def _dpd_signal(t, kind):
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed)).filter(F.col("signal_type") == kind)
    return s.select(
        "signal_id", "entity_id", "severity", "confidence_value", "materiality_band", "effective_at", "policy_id",
        F.array_join("evidence_ids", ",").alias("evidence"),
    )


def _dpd_signal_sql(kind, policy):
    return f"""WITH {DPD_SIGNALS} SELECT signal_id, entity_id, severity, CAST(0.9 AS DOUBLE) AS confidence_value, materiality_band, effective_at,
  '{policy}' AS policy_id, feature_value_id AS evidence FROM dpds WHERE signal_type = '{kind}'"""


@query("signal_dpd_emerged", _dpd_signal_sql("DPD_EMERGED", "POL-DPD-EMERGED-CORP-001"))
def _(t):
    return _dpd_signal(t, "DPD_EMERGED")


@query("signal_dpd_worsening", _dpd_signal_sql("DPD_WORSENING", "POL-DPD-WORSENING-CORP-001"))
def _(t):
    return _dpd_signal(t, "DPD_WORSENING")


@query(
    "union_feature_branches",
    f"""WITH {DPD_FEATURES}, p AS (WITH {PAYMENT_FEATURES} SELECT feature_value_id FROM feats),
m AS (SELECT DISTINCT facility_id, event_time, max(current_dpd) OVER (PARTITION BY facility_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS v
  FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0)
SELECT 'current_dpd' AS feature_name, state, count(*) AS n FROM dpdf GROUP BY state
UNION ALL SELECT 'returned_payment_count_30d', 'VALUE', count(*) FROM p
UNION ALL SELECT 'max_dpd_30d', CASE WHEN v = 0 THEN 'ZERO' ELSE 'VALUE' END, count(*) FROM m GROUP BY 2""",
)
def _(t):
    return all_features(t).groupBy("feature_name", "state").agg(F.count(F.lit(1)).alias("n"))


def all_features(t):
    return (
        feat.payment_count_features(t.payment_returned)
        .unionByName(feat.current_dpd_features(t.dpd_changed))
        .unionByName(feat.max_dpd_features(t.dpd_changed))
    )


def all_signals(t):
    return sig.repeated_payment_return(feat.payment_count_features(t.payment_returned)).unionByName(
        sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    )


@query(
    "union_signal_branches",
    f"""WITH {DPD_SIGNALS}, pp AS (WITH {PAYMENT_SIGNALS} SELECT signal_type, severity, signal_id FROM pays)
SELECT signal_type, severity, count(*) AS n FROM (SELECT signal_type, severity, signal_id FROM dpds UNION ALL SELECT * FROM pp) GROUP BY ALL""",
)
def _(t):
    return all_signals(t).groupBy("signal_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "counterparty_max_dpd",
    """SELECT counterparty_id, max(current_dpd) AS max_dpd, count(DISTINCT facility_id) AS facilities FROM b_dpd_changed
WHERE reconciled AND current_dpd >= 0 GROUP BY counterparty_id""",
)
def _(t):
    return t.dpd_changed.filter(USABLE).groupBy("counterparty_id").agg(
        F.max("current_dpd").alias("max_dpd"), F.count_distinct("facility_id").alias("facilities")
    )


@query(
    "severity_materiality_ladders",
    f"""WITH {DPD_FEATURES} SELECT current_dpd, CASE WHEN current_dpd>=90 THEN 'CRITICAL' WHEN current_dpd>=60 THEN 'HIGH' WHEN current_dpd>=30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN current_dpd>=90 THEN 'CRITICAL' WHEN current_dpd>=30 THEN 'HIGH' ELSE 'MEDIUM' END AS materiality,
  CASE WHEN current_dpd>=90 THEN 4 WHEN current_dpd>=60 THEN 3 WHEN current_dpd>=30 THEN 2 WHEN current_dpd>=1 THEN 1 ELSE 0 END AS band, count(*) AS n FROM dpdf WHERE usable GROUP BY ALL""",
)
def _(t):
    from tideglass.functions.scalars import dpd_materiality, dpd_severity

    d = F.col("current_dpd")
    return t.dpd_changed.filter(USABLE).groupBy("current_dpd").agg(F.count(F.lit(1)).alias("n")).select(
        "current_dpd", dpd_severity(d).alias("severity"), dpd_materiality(d).alias("materiality"), dpd_band(d).alias("band"), "n"
    )


@query(
    "agg_current_state",
    """SELECT facility_id, max(event_time) AS as_of, arg_max(current_dpd, (event_time, event_id)) AS current_dpd FROM b_dpd_changed
WHERE reconciled AND current_dpd >= 0 GROUP BY facility_id""",
)
def _(t):
    return feat.template_state(t.dpd_changed.filter(USABLE), ["facility_id"], "event_time", ["event_id"], ["current_dpd"])


@query(
    "agg_daily_buckets",
    """WITH d AS (SELECT facility_id, date_trunc('day', event_time) AS day, count(*) AS n FROM b_dpd_changed GROUP BY ALL)
SELECT facility_id, CAST(day AS TIMESTAMP) AS day, n, CAST(sum(n) OVER (PARTITION BY facility_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n_7_buckets FROM d""",
)
def _(t):
    daily = t.dpd_changed.groupBy("facility_id", F.date_trunc("day", "event_time").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per facility and day: the window is bounded by the calendar.
    w = Window.partitionBy("facility_id").orderBy(F.unix_date(F.col("day").cast("date"))).rangeBetween(-6, 0)
    return daily.withColumn("n_7_buckets", F.sum("n").over(w))
