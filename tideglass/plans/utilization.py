"""Limits and outstanding: utilisation, headroom, excess."""

from pyspark.sql import functions as F

from tideglass.operators import features as feat
from tideglass.plans.sqltext import DAILY_EXCESS, UTILIZATION
from tideglass.registry import query


def util(t):
    return feat.utilization(t.outstanding_changed, t.limit_changed)


def _d(name):
    return F.col(name).cast("double").alias(name)


@query(
    "join_utilization_state",
    f"WITH {UTILIZATION} SELECT event_id, facility_id, effective_at, CAST(outstanding AS DOUBLE) AS outstanding, CAST(limit_amount AS DOUBLE) AS limit_amount, state FROM util",
)
def _(t):
    return util(t).select("event_id", "facility_id", "effective_at", _d("outstanding"), _d("limit_amount"), "state")


@query("utilization_ratio", f"WITH {UTILIZATION} SELECT event_id, utilization_ratio, state FROM util")
def _(t):
    return util(t).select("event_id", "utilization_ratio", "state")


@query("wc_available_headroom", f"WITH {UTILIZATION} SELECT event_id, CAST(headroom AS DOUBLE) AS headroom, headroom < 0 AS in_excess FROM util WHERE headroom IS NOT NULL")
def _(t):
    return util(t).filter("headroom IS NOT NULL").select("event_id", _d("headroom"), (F.col("headroom") < 0).alias("in_excess"))


DELTA = f"""{UTILIZATION}, delta AS (SELECT event_id, facility_id, effective_at, utilization_ratio,
  CAST(sum(CAST(utilization_ratio AS DECIMAL(28,12))) OVER w AS DOUBLE) / nullif(count(utilization_ratio) OVER w, 0) AS baseline
  FROM util WHERE utilization_ratio IS NOT NULL
  WINDOW w AS (PARTITION BY facility_id ORDER BY effective_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""


def util_delta(t):
    def delta(rows, hot):
        rows = rows.filter("utilization_ratio IS NOT NULL").select("event_id", "facility_id", "effective_at", "utilization_ratio")
        return feat.template_delta(rows, ["facility_id"], "effective_at", ["event_id"], "utilization_ratio", 30, hot)

    return feat.utilization(t.outstanding_changed, t.limit_changed, delta)


@query("win_utilization_delta_30d", f"WITH {DELTA} SELECT event_id, round(baseline, 10) AS baseline, round(utilization_ratio - baseline, 10) AS delta FROM delta")
def _(t):
    return util_delta(t).select("event_id", F.round("baseline", 10).alias("baseline"), F.round("delta", 10).alias("delta"))


EXCESS = f"""{DAILY_EXCESS}, roll AS (SELECT facility_id, day, CAST(sum(in_excess) OVER w AS BIGINT) AS excess_days, max(excess_ratio) OVER w AS max_excess_ratio FROM daily
  WINDOW w AS (PARTITION BY facility_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))"""


def excess(t):
    return feat.excess_windows(feat.daily_excess(util(t)))


@query("win_limit_excess_days_30d", f"WITH {EXCESS} SELECT facility_id, CAST(day AS TIMESTAMP) AS day, excess_days FROM roll")
def _(t):
    return excess(t).select("facility_id", "day", "excess_days")


@query("win_max_limit_excess_ratio_30d", f"WITH {EXCESS} SELECT facility_id, CAST(day AS TIMESTAMP) AS day, round(max_excess_ratio, 6) AS max_excess_ratio FROM roll")
def _(t):
    return excess(t).select("facility_id", "day", F.round("max_excess_ratio", 6).alias("max_excess_ratio"))


RUNS = f"""{DAILY_EXCESS}, isl AS (SELECT facility_id, day, date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) - row_number() OVER (PARTITION BY facility_id ORDER BY day) AS grp
  FROM daily WHERE in_excess = 1)"""


@query(
    "win_consecutive_limit_excess_days",
    f"WITH {RUNS} SELECT facility_id, CAST(day AS TIMESTAMP) AS day, row_number() OVER (PARTITION BY facility_id, grp ORDER BY day) AS consecutive_days FROM isl",
)
def _(t):
    return feat.excess_runs(feat.daily_excess(util(t))).select("facility_id", "day", F.col("consecutive_days").cast("bigint").alias("consecutive_days"))


@query(
    "win_credit_inflow_change_30d_90d",
    """WITH i AS (SELECT beneficiary_id AS account_id, event_time, amount FROM b_transfer WHERE NOT related_party),
p AS (SELECT account_id, event_time, sum(amount) AS amount FROM i GROUP BY ALL),
r AS (SELECT account_id, event_time, sum(amount) OVER (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS recent,
  sum(amount) OVER (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW) AS whole FROM p)
SELECT account_id, event_time, CAST(recent AS DOUBLE) AS recent_inflow, round(CAST(recent AS DOUBLE) / (CAST(whole - recent AS DOUBLE) / 3) - 1, 6) AS inflow_change
FROM r WHERE whole > recent""",
)
def _(t):
    from tideglass.operators.ordered import rolling

    inflow = t.transfer.filter(~F.col("related_party")).select(F.col("beneficiary_id").alias("account_id"), "event_time", "amount")
    daily = inflow.groupBy("account_id", "event_time").agg(F.sum("amount").alias("amount"))
    recent = rolling(daily, ["account_id"], "event_time", 30, {"recent": ("sum", "amount")}, per_event=False)
    whole = rolling(daily, ["account_id"], "event_time", 120, {"whole": ("sum", "amount")}, per_event=False)
    both = recent.join(whole, ["account_id", "event_time"]).filter("whole > recent")
    change = F.col("recent").cast("double") / ((F.col("whole") - F.col("recent")).cast("double") / 3) - 1
    return both.select("account_id", "event_time", _d("recent").alias("recent_inflow"), F.round(change, 6).alias("inflow_change"))




@query(
    "signal_utilization_high",
    f"""WITH {UTILIZATION} SELECT event_id, facility_id, CASE WHEN utilization_ratio >= 0.95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM util
WHERE utilization_ratio >= 0.85""",
)
def _(t):
    return util(t).filter("utilization_ratio >= 0.85").select(
        "event_id", "facility_id", F.when(F.col("utilization_ratio") >= 0.95, "HIGH").otherwise("MEDIUM").alias("severity")
    )


@query(
    "signal_utilization_high_persistent",
    f"""WITH {UTILIZATION}, d AS (SELECT facility_id, date_trunc('day', effective_at) AS day, min(utilization_ratio) AS low FROM util WHERE utilization_ratio IS NOT NULL GROUP BY ALL),
i AS (SELECT facility_id, day, date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) - row_number() OVER (PARTITION BY facility_id ORDER BY day) AS grp FROM d WHERE low >= 0.85)
SELECT facility_id, CAST(day AS TIMESTAMP) AS day, n AS days_high FROM (SELECT facility_id, day, row_number() OVER (PARTITION BY facility_id, grp ORDER BY day) AS n FROM i) WHERE n >= 2""",
)
def _(t):
    daily = (
        util(t).filter("utilization_ratio IS NOT NULL")
        .groupBy("facility_id", F.date_trunc("day", "effective_at").cast("timestamp_ntz").alias("day"))
        .agg((F.min("utilization_ratio") >= 0.85).cast("int").alias("in_excess"))
    )
    runs = feat.excess_runs(daily)
    return runs.filter("consecutive_days >= 2").select("facility_id", "day", F.col("consecutive_days").cast("bigint").alias("days_high"))


@query(
    "signal_utilization_spike",
    f"WITH {DELTA} SELECT event_id, facility_id, round(utilization_ratio - baseline, 10) AS delta FROM delta WHERE utilization_ratio - baseline >= 0.5 AND utilization_ratio >= 1.5 * baseline",
)
def _(t):
    hit = (F.col("delta") >= 0.5) & (F.col("utilization_ratio") >= 1.5 * F.col("baseline"))
    return util_delta(t).filter(hit).select("event_id", "facility_id", F.round("delta", 10).alias("delta"))


@query("signal_limit_excess_recurring", f"WITH {EXCESS} SELECT facility_id, CAST(day AS TIMESTAMP) AS day, excess_days FROM roll WHERE excess_days >= 2")
def _(t):
    return excess(t).filter("excess_days >= 2").select("facility_id", "day", "excess_days")
