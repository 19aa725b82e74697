"""Aggregates: portfolio, metrics, quality, materiality."""

from pyspark.sql import functions as F

from tideglass.operators import aggregates as ag, features as feat, signals as sig
from tideglass.plans.sqltext import DPD_CROSSINGS, DPD_FEATURES, DPD_SIGNALS
from tideglass.registry import query

PF = """pf AS (SELECT c.segment, c.market, o.o_orderstatus AS product, CAST(o.o_totalprice AS DECIMAL(20,2)) AS exposure, c.counterparty_id FROM orders o JOIN b_counterparty c ON o.o_custkey = c.counterparty_id)"""


def portfolio(t):
    return t.base("orders").join(t.counterparty, F.col("o_custkey") == F.col("counterparty_id")).select(
        "segment", "market", F.col("o_orderstatus").alias("product"), F.col("o_totalprice").cast("decimal(20,2)").alias("exposure"), "counterparty_id"
    )


def _measures():
    return [
        F.count(F.lit(1)).alias("facilities"), F.count_distinct("counterparty_id").alias("entities"),
        F.sum("exposure").cast("double").alias("exposure"),
    ]


_PSQL = "SELECT coalesce(segment, 'ALL') AS segment, coalesce(market, 'ALL') AS market, coalesce(product, 'ALL') AS product, grouping(segment, market, product) AS level, count(*) AS facilities, count(DISTINCT counterparty_id) AS entities, CAST(sum(exposure) AS DOUBLE) AS exposure FROM pf GROUP BY"


def _named(df):
    return df.select(*[F.coalesce(c, F.lit("ALL")).alias(c) for c in ("segment", "market", "product")], F.col("level").cast("bigint").alias("level"), "facilities", "entities", "exposure")


@query("agg_portfolio_rollup", f"WITH {PF} {_PSQL} ROLLUP (segment, market, product)")
def _(t):
    return _named(ag.portfolio_cube(portfolio(t), ["segment", "market", "product"], _measures(), "rollup"))


@query("agg_portfolio_cube", f"WITH {PF} {_PSQL} CUBE (segment, market, product)")
def _(t):
    return _named(ag.portfolio_cube(portfolio(t), ["segment", "market", "product"], _measures()))


DECIDED = f"""{DPD_SIGNALS}, numbered AS (SELECT dpds.*, e.event_id AS signal_no FROM dpds JOIN dpdf e ON dpds.feature_value_id = e.feature_value_id),
decided AS (SELECT n.*, d.decision FROM numbered n LEFT JOIN b_disposition d ON n.signal_no = d.signal_no)"""


def numbered_signals(t):
    """DPD signals with the number of their source event, to which decisions refer."""
    at = F.col("event_time")
    source = t.dpd_changed.select(
        feat.feature_id("current_dpd", F.col("event_id"), at, at).alias("feature_value_id"), F.col("event_id").alias("signal_no")
    )
    signals = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    return signals.withColumn("feature_value_id", F.col("evidence_ids")[0]).join(source, "feature_value_id")


@query(
    "agg_signal_metrics",
    f"""WITH {DECIDED} SELECT signal_type, severity, count(*) AS alerts, CAST(count(decision) AS BIGINT) AS decided, CAST(count(CASE WHEN decision = 'ACCEPT' THEN 1 END) AS BIGINT) AS accepted,
  CAST(count(CASE WHEN decision = 'MARK_FALSE_POSITIVE' THEN 1 END) AS BIGINT) AS false_positives,
  round(CASE WHEN count(decision) > 0 THEN CAST(count(CASE WHEN decision = 'ACCEPT' THEN 1 END) AS DOUBLE) / count(decision) END, 6) AS precision,
  round(CASE WHEN count(decision) > 0 THEN CAST(count(CASE WHEN decision = 'MARK_FALSE_POSITIVE' THEN 1 END) AS DOUBLE) / count(decision) END, 6) AS false_positive_rate
FROM decided GROUP BY ALL""",
)
def _(t):
    rows = numbered_signals(t).join(t.disposition, "signal_no", "left")
    return ag.signal_metrics(rows, ["signal_type", "severity"])


@query(
    "agg_disposition_time_median",
    """WITH d AS (SELECT user_id % 10 AS queue, CAST(floor(value * 10) AS BIGINT) AS minutes FROM events) SELECT queue, CAST(quantile_cont(minutes, 0.5) AS DOUBLE) AS median_value FROM d GROUP BY queue""",
)
def _(t):
    rows = t.base("events").select((F.col("user_id") % 10).alias("queue"), F.floor(F.col("value") * 10).alias("minutes"))
    return ag.median_by(rows, ["queue"], "minutes")


@query(
    "agg_policy_metrics",
    f"""WITH {DPD_CROSSINGS} SELECT state, count(*) AS evaluations, count(crossing) AS matched, round(CAST(count(crossing) AS DOUBLE) / count(*), 6) AS matched_rate,
  count(CASE WHEN crossing = 'DPD_EMERGED' THEN 1 END) AS emerged, count(CASE WHEN crossing = 'DPD_WORSENING' THEN 1 END) AS worsening FROM crossed GROUP BY state""",
)
def _(t):
    rows = sig.dpd_crossings(feat.current_dpd_features(t.dpd_changed))
    c = F.col("crossing")
    return rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("evaluations"), F.count(c).alias("matched"), F.round(F.count(c) / F.count(F.lit(1)), 6).alias("matched_rate"),
        F.count(F.when(c == "DPD_EMERGED", 1)).alias("emerged"), F.count(F.when(c == "DPD_WORSENING", 1)).alias("worsening"),
    )


@query(
    "agg_freshness_slo",
    """SELECT CAST(facility_id % 10 AS BIGINT) AS source, CAST(quantile_cont(h, 0.5) AS DOUBLE) AS p50_hours, CAST(quantile_cont(h, 0.99) AS DOUBLE) AS p99_hours, count(*) AS n
FROM (SELECT facility_id, CAST(floor((epoch_us(knowledge_time) - epoch_us(effective_at)) / 3600000000.0) AS BIGINT) AS h FROM b_feature_history) GROUP BY 1""",
)
def _(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = F.floor((us("knowledge_time") - us("effective_at")) / 3_600_000_000)
    # Whole hours: few distinct values, so the counter map of the exact percentile stays small.
    return t.feature_history.withColumn("h", hours).groupBy((F.col("facility_id") % 10).alias("source")).agg(
        F.percentile("h", F.lit(0.5)).alias("p50_hours"), F.percentile("h", F.lit(0.99)).alias("p99_hours"), F.count(F.lit(1)).alias("n")
    )


@query(
    "agg_quality_summary",
    f"""WITH {DPD_FEATURES}, q AS (SELECT counterparty_id, entity_id, CASE WHEN usable THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS quality_state FROM dpdf)
SELECT counterparty_id, CASE max(CASE WHEN quality_state = 'INSUFFICIENT' THEN 1 ELSE 0 END) WHEN 1 THEN 'INSUFFICIENT' ELSE 'COMPLETE' END AS worst_quality, count(*) AS contributors,
  CAST(sum(CASE WHEN quality_state = 'INSUFFICIENT' THEN 1 ELSE 0 END) AS BIGINT) AS excluded, count(DISTINCT CASE WHEN quality_state = 'INSUFFICIENT' THEN entity_id END) AS excluded_distinct FROM q GROUP BY counterparty_id""",
)
def _(t):
    from tideglass.functions.scalars import quality_state, usable_dpd

    rows = t.dpd_changed.select(
        "counterparty_id", "facility_id", quality_state(usable_dpd(F.col("current_dpd"), F.col("reconciled"))).alias("quality_state")
    )
    return ag.worst_quality(rows, ["counterparty_id"], "quality_state", "facility_id")


@query(
    "agg_duplicates",
    "SELECT l_orderkey AS version_no, concat('R-', l_linenumber) AS rule_id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return ag.duplicates(t.policy_rule, ["version_no", "rule_id"])


@query(
    "agg_confidence",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p, CASE WHEN l_tax > 0 THEN 1 - l_tax END AS a, CASE WHEN l_discount > 0 THEN 1 - l_discount END AS b, l_quantity / 50 AS d FROM lineitem)
SELECT k, line, p, least(a, b, d) AS confidence_min, round((coalesce(a, 0) + coalesce(b, 0) + d) / (1 + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END), 6) AS confidence_mean FROM c""",
)
def _(t):
    parts = [
        F.when(F.col("l_tax") > 0, 1 - F.col("l_tax")), F.when(F.col("l_discount") > 0, 1 - F.col("l_discount")), F.col("l_quantity") / 50,
    ]
    return t.base("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"),
        ag.confidence(parts, "MINIMUM").alias("confidence_min"), F.round(ag.confidence(parts, "MEAN"), 6).alias("confidence_mean"),
    )


@query(
    "agg_materiality",
    """WITH d AS (SELECT payer_id, sum(amount) AS total FROM b_transfer GROUP BY payer_id)
SELECT transfer_id, round(CAST(amount AS DOUBLE) / CAST(total AS DOUBLE), 8) AS share, CASE WHEN CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) >= 0.1 THEN 'CRITICAL' WHEN CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) >= 0.05 THEN 'HIGH'
  WHEN CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS materiality_band FROM b_transfer JOIN d USING (payer_id)""",
)
def _(t):
    total = t.transfer.groupBy("payer_id").agg(F.sum("amount").alias("total"))
    share, band = ag.materiality(F.col("amount"), F.col("total"), [(0.1, "CRITICAL"), (0.05, "HIGH"), (0.02, "MEDIUM")])
    return t.transfer.join(total, "payer_id").select("transfer_id", F.round(share, 8).alias("share"), band.alias("materiality_band"))


@query(
    "signal_disposition_apply",
    f"""WITH {DECIDED}, s AS (SELECT signal_id, CASE decision WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'MARK_FALSE_POSITIVE' THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM decided)
SELECT signal_id, status FROM s""",
)
def _(t):
    rows = numbered_signals(t)
    decisions = rows.join(t.disposition, "signal_no").select(
        "signal_id", "decision", F.col("effective_at").alias("decided_at"), F.col("signal_no").alias("decision_no")
    )
    applied, _ = sig.apply_dispositions(rows, decisions)
    return applied.select("signal_id", "status")


# Every order line that cites an order is one decision on it; the first by ship date wins.
DECQ = """dec AS (SELECT l_orderkey AS signal_id, CASE l_returnflag WHEN 'R' THEN 'REJECT' WHEN 'A' THEN 'ACCEPT' ELSE 'DEFER' END AS decision, l_shipdate AS decided_at,
  concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS decision_no FROM lineitem)"""


@query(
    "signal_disposition_conflicts",
    f"""WITH {DECQ}, sg AS (SELECT o_orderkey AS signal_id, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' ELSE 'PROPOSED' END AS status FROM orders),
f AS (SELECT signal_id, arg_min(decision_no, (decided_at, decision_no)) AS won FROM dec GROUP BY signal_id)
SELECT CASE WHEN status IS NULL THEN 'UNKNOWN_SIGNAL' WHEN status <> 'PROPOSED' THEN 'NOT_PROPOSED' ELSE 'ALREADY_DECIDED' END AS conflict, decision, count(*) AS n
FROM dec JOIN f USING (signal_id) LEFT JOIN sg USING (signal_id) WHERE status IS NULL OR status <> 'PROPOSED' OR decision_no <> won GROUP BY ALL""",
)
def _(t):
    decisions = t.sql(f"WITH {DECQ} SELECT * FROM dec")
    signals = t.base("orders").select(
        F.col("o_orderkey").alias("signal_id"), F.when(F.col("o_orderstatus") == "F", "ACCEPTED").otherwise("PROPOSED").alias("status")
    )
    _, conflicts = sig.apply_dispositions(signals, decisions)
    return conflicts.groupBy("conflict", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("sink_disposition_append", "SELECT signal_no, decision, count(*) AS n FROM b_disposition GROUP BY ALL")
def _(t):
    """Decisions are only ever appended; read back from the written table."""
    from tideglass.session import new_path

    path = new_path(t.spark, "dispositions")
    t.disposition.write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("signal_no", "decision").agg(F.count(F.lit(1)).alias("n"))


LIFE = """life AS (SELECT l_orderkey AS signal_id, l_shipdate AS changed_at, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS change_no,
  CASE l_linenumber WHEN 1 THEN 'DETECTED' WHEN 2 THEN 'PROPOSED' WHEN 3 THEN 'ACCEPTED' WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'ACTIVE' WHEN 6 THEN 'CLOSED' ELSE 'EXPIRED' END AS status FROM lineitem)"""


@query(
    "signal_lifecycle_audit",
    f"""WITH {LIFE}, p AS (SELECT *, lag(status) OVER (PARTITION BY signal_id ORDER BY changed_at, change_no) AS previous_status FROM life)
SELECT previous_status, status, count(*) AS n FROM p WHERE previous_status IS NOT NULL AND concat(previous_status, '>', status) NOT IN
('DETECTED>PROPOSED','PROPOSED>ACCEPTED','PROPOSED>REJECTED','ACCEPTED>ACTIVE','ACTIVE>MITIGATED','ACTIVE>CLOSED','ACTIVE>EXPIRED','ACTIVE>SUPERSEDED') GROUP BY ALL""",
)
def _(t):
    bad = sig.lifecycle_violations(t.sql(f"WITH {LIFE} SELECT * FROM life"), ["signal_id"], "changed_at", ["change_no"], sig.SIGNAL_TRANSITIONS)
    return bad.groupBy("previous_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "signal_cooldown",
    f"""WITH {DPD_SIGNALS}, g AS (SELECT *, lag(effective_at) OVER (PARTITION BY entity_id, signal_type ORDER BY effective_at) AS prev FROM dpds)
SELECT signal_id, prev IS NULL OR epoch_us(effective_at) - epoch_us(prev) > 43200000000 AS kept FROM g""",
)
def _(t):
    """Twelve hours without a detection reset the cool-down; repeats inside it are suppressed."""
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    return sig.suppress_repeats(s, ["entity_id", "signal_type"], "effective_at", 0.5).select("signal_id", "kept")


@query(
    "signal_decay",
    f"""WITH {DPD_SIGNALS} SELECT signal_id, round((CASE severity WHEN 'CRITICAL' THEN 90 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 40 ELSE 20 END) * pow(0.5, date_diff('day', CAST(effective_at AS DATE), DATE '2024-02-01') / 14.0), 6) AS points FROM dpds""",
)
def _(t):
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    points = F.when(F.col("severity") == "CRITICAL", 90).when(F.col("severity") == "HIGH", 70).when(F.col("severity") == "MEDIUM", 40).otherwise(20)
    age = F.datediff(F.lit("2024-02-01").cast("date"), "effective_at")
    return s.select("signal_id", F.round(sig.decay(points, age, 14), 6).alias("points"))


@query(
    "top_worklist",
    f"""WITH {DPD_SIGNALS} SELECT segment, position, signal_id FROM (SELECT counterparty_id % 5 AS segment, signal_id,
  row_number() OVER (PARTITION BY counterparty_id % 5 ORDER BY list_position(['LOW','MEDIUM','HIGH','CRITICAL'], severity) DESC, list_position(['LOW','MEDIUM','HIGH','CRITICAL'], materiality_band) DESC, effective_at, signal_id) AS position FROM dpds) WHERE position <= 20""",
)
def _(t):
    """Top 20 open signals per analyst queue; the rank filter is pushed below the shuffle."""
    from pyspark.sql import Window

    from tideglass.functions.scalars import BANDS, rank_in

    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed)).withColumn("segment", F.col("entity_id").cast("bigint") % 50 % 5)
    w = Window.partitionBy("segment").orderBy(
        rank_in(F.col("severity"), BANDS).desc(), rank_in(F.col("materiality_band"), BANDS).desc(), "effective_at", "signal_id"
    )
    return s.withColumn("position", F.row_number().over(w)).filter("position <= 20").select("segment", F.col("position").cast("bigint").alias("position"), "signal_id")


@query(
    "ml_drift",
    """WITH b AS (SELECT least(CAST(floor(value / 20) AS BIGINT), 10) AS bucket, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'A' ELSE 'B' END AS period FROM events),
c AS (SELECT bucket, CAST(count(CASE WHEN period = 'A' THEN 1 END) AS BIGINT) AS n_a, CAST(count(CASE WHEN period = 'B' THEN 1 END) AS BIGINT) AS n_b FROM b GROUP BY bucket), t AS (SELECT sum(n_a) AS t_a, sum(n_b) AS t_b FROM c),
s AS (SELECT bucket, n_a, n_b, (CASE WHEN n_a > 0 THEN n_a ELSE 0.5 END) / CAST(t_a AS DOUBLE) AS a, (CASE WHEN n_b > 0 THEN n_b ELSE 0.5 END) / CAST(t_b AS DOUBLE) AS bb FROM c, t)
SELECT bucket, n_a, n_b, round((a - bb) * ln(a / bb), 8) AS stability FROM s""",
)
def _(t):
    rows = t.base("events").select(
        F.least(F.floor(F.col("value") / 20), F.lit(10).cast("bigint")).alias("bucket"),
        F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "A").otherwise("B").alias("period"),
    )
    return ag.population_stability(rows, "bucket", "period", "A", "B").withColumn("stability", F.round("stability", 8))
