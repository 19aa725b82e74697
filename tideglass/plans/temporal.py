"""Point-in-time views, revisions, sequence, lateness, corrections."""

from pyspark.sql import functions as F

from tideglass.operators import features as feat, temporal as tm
from tideglass.operators.ordered import rolling, with_previous
from tideglass.registry import query


@query(
    "join_point_in_time",
    """SELECT d.event_id, d.event_time AS asked_at, CAST(arg_max(h.value_numeric, (h.effective_at, h.revision, h.event_id)) AS DOUBLE) AS value_known,
  CAST(arg_max(h.event_id, (h.effective_at, h.revision, h.event_id)) AS DOUBLE) AS fact_id
FROM b_dpd_changed d LEFT JOIN b_feature_history h ON d.facility_id = h.facility_id AND h.knowledge_time <= d.event_time GROUP BY d.event_id, d.event_time""",
)
def _(t):
    asks = t.dpd_changed.select(F.col("event_id").alias("ask_id"), "facility_id", F.col("event_time").alias("asked_at"))
    out = tm.point_in_time(
        asks, t.feature_history, ["facility_id"], "asked_at", "knowledge_time", ["effective_at", "revision", "event_id"],
        ["value_numeric", "event_id"],
    )
    return out.select(
        F.col("ask_id").alias("event_id"), "asked_at", F.col("value_numeric").cast("double").alias("value_known"),
        F.col("event_id").cast("double").alias("fact_id"),
    )


@query(
    "join_as_corrected",
    """SELECT event_id, facility_id, effective_at, revision, value_numeric FROM b_feature_history
QUALIFY row_number() OVER (PARTITION BY event_id, facility_id, effective_at ORDER BY revision DESC) = 1""",
)
def _(t):
    return tm.as_corrected(t.feature_history, ["event_id", "facility_id", "effective_at"], "revision", ["value_numeric"])


@query(
    "diff_as_known_vs_corrected",
    """SELECT event_id, CAST(arg_max(value_numeric, revision) FILTER (knowledge_time <= TIMESTAMP '2024-01-20 00:00:00') AS DOUBLE) AS known_value,
  CAST(arg_max(value_numeric, revision) AS DOUBLE) AS corrected_value FROM b_feature_history GROUP BY event_id
HAVING arg_max(value_numeric, revision) FILTER (knowledge_time <= TIMESTAMP '2024-01-20 00:00:00') IS DISTINCT FROM arg_max(value_numeric, revision)""",
)
def _(t):
    out = tm.known_versus_corrected(
        t.feature_history, ["event_id"], "revision", "knowledge_time", "value_numeric", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    )
    return out.select("event_id", F.col("known_value").cast("double").alias("known_value"), F.col("corrected_value").cast("double").alias("corrected_value"))


@query(
    "win_revision_number",
    "SELECT event_id, knowledge_time, row_number() OVER (PARTITION BY event_id ORDER BY knowledge_time, revision) AS revision_no FROM b_feature_history",
)
def _(t):
    out = tm.number_revisions(t.feature_history, ["event_id"], "knowledge_time", ["revision"])
    return out.select("event_id", "knowledge_time", "revision_no")


@query(
    "win_previous_revision",
    """SELECT event_id, revision, CAST(lag(value_numeric) OVER w AS DOUBLE) AS previous_value, lag(knowledge_time) OVER w AS previous_known_at
FROM b_feature_history WINDOW w AS (PARTITION BY event_id ORDER BY knowledge_time, revision)""",
)
def _(t):
    out = with_previous(
        t.feature_history, ["event_id"], "knowledge_time", ["revision"],
        {"previous_value": "value_numeric", "previous_known_at": "knowledge_time"}, days=365,
    )
    return out.select("event_id", "revision", F.col("previous_value").cast("double").alias("previous_value"), "previous_known_at")


@query(
    "win_transition_pairs",
    """SELECT facility_id, event_id, lag(event_id) OVER w IS NOT NULL AS has_previous, coalesce(lag(event_id) OVER w, -1) AS previous_event_id,
  CASE WHEN lag(current_dpd) OVER w IS NULL THEN 'FIRST' WHEN lag(current_dpd) OVER w < current_dpd THEN 'UP' WHEN lag(current_dpd) OVER w > current_dpd THEN 'DOWN' ELSE 'SAME' END AS movement
FROM b_dpd_changed WINDOW w AS (PARTITION BY facility_id ORDER BY event_time, event_id)""",
)
def _(t):
    out = with_previous(t.dpd_changed, ["facility_id"], "event_time", ["event_id"], {"p_id": "event_id", "p_dpd": "current_dpd"})
    p, c = F.col("p_dpd"), F.col("current_dpd")
    return out.select(
        "facility_id", "event_id", F.col("p_id").isNotNull().alias("has_previous"),
        F.coalesce("p_id", F.lit(-1).cast("bigint")).alias("previous_event_id"),
        F.when(p.isNull(), "FIRST").when(p < c, "UP").when(p > c, "DOWN").otherwise("SAME").alias("movement"),
    )


@query(
    "win_emit_on_change",
    """SELECT event_id, facility_id, current_dpd FROM (SELECT *, lag(current_dpd) OVER w AS b, row_number() OVER w AS rn FROM b_dpd_changed WHERE reconciled
  WINDOW w AS (PARTITION BY facility_id ORDER BY event_time, event_id)) WHERE rn = 1 OR b IS DISTINCT FROM current_dpd""",
)
def _(t):
    out = tm.emit_on_change(t.dpd_changed.filter("reconciled"), ["facility_id"], "event_time", ["event_id"], "current_dpd")
    return out.select("event_id", "facility_id", "current_dpd")


SEQ = "SELECT event_id, user_id AS facility_id, ts AS event_time, CAST(floor(value) AS INT) % 20 AS aggregate_sequence FROM events"


@query(
    "win_sequence_check",
    f"""SELECT event_id, CASE WHEN top IS NULL OR aggregate_sequence = top + 1 THEN 'OK' WHEN aggregate_sequence < top THEN 'STALE' WHEN aggregate_sequence = top THEN 'DUPLICATE' ELSE 'GAP' END AS sequence_state
FROM (SELECT *, max(aggregate_sequence) OVER (PARTITION BY facility_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({SEQ}))""",
)
def _(t):
    out = tm.sequence_check(t.sql(SEQ), ["facility_id"], "event_time", ["event_id"], "aggregate_sequence")
    return out.select("event_id", "sequence_state")


LATE_SQL = """late AS (SELECT *, (epoch_us(knowledge_time) - epoch_us(effective_at)) / 3600000000.0 AS hours,
  CASE WHEN epoch_us(knowledge_time) - epoch_us(effective_at) <= 3600000000 THEN 'L1' WHEN epoch_us(knowledge_time) - epoch_us(effective_at) <= 48*3600000000 THEN 'L2'
       WHEN epoch_us(knowledge_time) - epoch_us(effective_at) <= 168*3600000000 THEN 'L3' ELSE 'L4' END AS late_class FROM b_feature_history)"""


def classified(t):
    return t.feature_history.withColumn("late_class", tm.late_class(F.col("effective_at"), F.col("knowledge_time"), 1, 48, 168))


@query("late_arrival_class", f"WITH {LATE_SQL} SELECT event_id, revision, late_class FROM late")
def _(t):
    return classified(t).select("event_id", "revision", "late_class")


@query(
    "agg_late_arrival",
    f"""WITH {LATE_SQL}, h AS (SELECT *, CAST(floor(hours) AS BIGINT) AS whole FROM late)
SELECT late_class, count(*) AS n, CAST(sum(CASE WHEN revision > 1 THEN 1 ELSE 0 END) AS BIGINT) AS corrections, CAST(quantile_cont(whole, 0.5) AS DOUBLE) AS p50_hours, CAST(quantile_cont(whole, 0.95) AS DOUBLE) AS p95_hours, max(whole) AS max_hours
FROM h GROUP BY late_class""",
)
def _(t):
    hours = F.floor((F.unix_micros(F.col("knowledge_time").cast("timestamp")) - F.unix_micros(F.col("effective_at").cast("timestamp"))) / 3_600_000_000)
    # Whole hours are few distinct values, so the exact percentile keeps a small counter map.
    return classified(t).withColumn("whole", hours).groupBy("late_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("revision") > 1).cast("int")).alias("corrections"),
        F.percentile("whole", F.lit(0.5)).alias("p50_hours"), F.percentile("whole", F.lit(0.95)).alias("p95_hours"), F.max("whole").alias("max_hours"),
    )


REV = """rev AS (SELECT event_id, account_id, event_time, CASE WHEN l_linestatus = 'O' THEN event_time + INTERVAL 10 DAY END AS reversed_at FROM
  (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS event_id, l_suppkey AS account_id, l_shipdate AS event_time, l_linestatus FROM lineitem WHERE l_returnflag = 'R'))"""


@query(
    "correction_reversal",
    f"""WITH {REV}, w AS (SELECT account_id, event_time, count(*) OVER x AS as_known, count(CASE WHEN reversed_at IS NULL THEN 1 END) OVER x AS corrected FROM rev
  WINDOW x AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT DISTINCT account_id, event_time, as_known AS count_as_known, corrected AS count_corrected, CASE WHEN as_known <> corrected THEN 2 ELSE 1 END AS revision FROM w""",
)
def _(t):
    facts = feat.countable_returns(t.payment_returned)
    reversals = t.sql(
        "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS reversal_of, "
        "l_shipdate + INTERVAL 10 DAY AS knowledge_time FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'"
    )
    rows = tm.apply_reversals(facts, reversals, "event_id").withColumn("standing", F.when(F.col("reversed_at").isNull(), 1))
    out = rolling(
        rows, ["account_id"], "event_time", 30,
        {"count_as_known": ("count", "event_id"), "count_corrected": ("count", "standing")}, per_event=False,
    )
    return out.withColumn("revision", F.when(F.col("count_as_known") != F.col("count_corrected"), 2).otherwise(1))


@query(
    "diff_runs",
    """WITH live AS (SELECT event_id, facility_id, value_numeric FROM b_feature_history WHERE revision = 1),
replay AS (SELECT event_id, facility_id, value_numeric FROM b_feature_history QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY revision DESC) = 1)
SELECT 'ONLY_LIVE' AS side, event_id, facility_id, value_numeric FROM (SELECT * FROM live EXCEPT ALL SELECT * FROM replay)
UNION ALL SELECT 'ONLY_REPLAY', * FROM (SELECT * FROM replay EXCEPT ALL SELECT * FROM live)""",
)
def _(t):
    live = t.feature_history.filter("revision = 1").select("event_id", "facility_id", "value_numeric")
    replay = tm.as_corrected(t.feature_history, ["event_id", "facility_id"], "revision", ["value_numeric"]).drop("revision")
    only = lambda a, b, side: a.exceptAll(b).select(F.lit(side).alias("side"), "*")
    return only(live, replay, "ONLY_LIVE").unionByName(only(replay, live, "ONLY_REPLAY"))


@query(
    "top_feature_history",
    "SELECT facility_id, event_id, revision, knowledge_time, value_numeric FROM b_feature_history WHERE facility_id = 7",
)
def _(t):
    """History of one entity, newest knowledge first."""
    return (
        t.feature_history.filter("facility_id = 7")
        .select("facility_id", "event_id", "revision", "knowledge_time", "value_numeric")
        .orderBy(F.desc("knowledge_time"), F.desc("revision"))
    )


@query(
    "top_latest_feature",
    """SELECT facility_id, event_id, value_numeric, effective_at FROM b_feature_history WHERE value_numeric IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY effective_at DESC, revision DESC, event_id DESC) = 1""",
)
def _(t):
    return feat.template_state(
        t.feature_history.filter("value_numeric IS NOT NULL").withColumn("at", F.col("effective_at")),
        ["facility_id"], "effective_at", ["revision", "event_id"], ["event_id", "value_numeric", "at"],
    ).select("facility_id", "event_id", "value_numeric", F.col("at").alias("effective_at"))


@query(
    "feature_freshness",
    """WITH s AS (SELECT facility_id, max(effective_at) AS last_at FROM b_feature_history GROUP BY facility_id)
SELECT facility_id, CASE WHEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_at) > 72*3600000000 THEN 'STALE' ELSE 'VALUE' END AS state FROM s""",
)
def _(t):
    """A value older than the time to live of its definition (72 hours here) is STALE."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    last = t.feature_history.groupBy("facility_id").agg(F.max("effective_at").alias("last_at"))
    return last.select("facility_id", F.when(F.col("last_at") < now - F.expr("INTERVAL 72 HOURS"), "STALE").otherwise("VALUE").alias("state"))
