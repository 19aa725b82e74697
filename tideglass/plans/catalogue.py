"""Feature catalogue over statements, ratings, corporate events, market quotes, collateral, debt."""

from pyspark.sql import functions as F

from tideglass.operators import catalogue as cat, features as feat
from tideglass.operators.ordered import rolling, with_previous
from tideglass.registry import query
from tideglass.sources.reference import values_sql


def ratio_sql(name, num, den, scale):
    ok = f"({den}) > 0"
    return (
        f"SELECT counterparty_id AS entity_id, CAST(period_start AS TIMESTAMP) AS observed_at, '{name}' AS feature_name, CASE WHEN {ok} THEN round(CAST({num} AS DOUBLE) * {scale} / CAST({den} AS DOUBLE), 8) END AS value, "
        f"CASE WHEN NOT ({ok}) THEN 'INVALID' WHEN ({num}) = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM b_statement"
    )


RATIO_SQL = "ratios AS (" + " UNION ALL ".join(ratio_sql(*r) for r in cat.RATIOS) + ")"


@query("feature_ratio", f"WITH {RATIO_SQL} SELECT * FROM ratios")
def ratios(t, only=None):
    return cat.statement_ratios(t.statement, only).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


def _days(n, d):
    return f"CASE WHEN {d} > 0 THEN round(CAST({n} AS DOUBLE) * 90 / CAST({d} AS DOUBLE), 8) END"


CCC = f"({_days('receivables', 'revenue')} + {_days('inventory', 'cost_of_goods')} - {_days('payables', 'cost_of_goods')})"


@query(
    "feature_statement_levels",
    f"""WITH v AS (SELECT counterparty_id AS entity_id, CAST(period_start AS TIMESTAMP) AS observed_at, CAST(operating_cash_flow AS DOUBLE) AS ocf, CAST(operating_cash_flow - capital_expenditure AS DOUBLE) AS fcf, {CCC} AS ccc FROM b_statement),
l AS (SELECT entity_id, observed_at, 'operating_cash_flow' AS feature_name, ocf AS value FROM v UNION ALL SELECT entity_id, observed_at, 'free_cash_flow', fcf FROM v UNION ALL SELECT entity_id, observed_at, 'cash_conversion_cycle', round(ccc, 6) FROM v)
SELECT *, CASE WHEN value IS NULL THEN 'INVALID' WHEN value = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM l""",
)
def _(t):
    return cat.statement_levels(t.statement).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


YOY = """j AS (SELECT s.counterparty_id AS entity_id, CAST(s.period_start AS TIMESTAMP) AS observed_at, CAST(s.revenue AS DOUBLE) AS r, CAST(y.revenue AS DOUBLE) AS yr, CAST(s.ebitda AS DOUBLE) AS e, CAST(y.ebitda AS DOUBLE) AS ye, s.revenue - y.revenue AS dr,
  s.current_assets - q.current_assets AS dc, q.current_assets AS qc, s.operating_cash_flow - y.operating_cash_flow AS dox, y.operating_cash_flow AS yo
  FROM b_statement s LEFT JOIN b_statement y ON s.counterparty_id = y.counterparty_id AND s.period_start = y.period_start + INTERVAL 12 MONTH LEFT JOIN b_statement q ON s.counterparty_id = q.counterparty_id AND s.period_start = q.period_start + INTERVAL 3 MONTH)"""


@query(
    "feature_statement_changes",
    f"""WITH {YOY} SELECT entity_id, observed_at, 'revenue_yoy_change' AS feature_name, CASE WHEN yr > 0 THEN round(CAST(dr AS DOUBLE) / yr, 8) END AS value, CASE WHEN yr IS NULL THEN 'NOT_AVAILABLE' WHEN NOT (yr > 0) THEN 'INVALID' WHEN dr = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM j
UNION ALL SELECT entity_id, observed_at, 'ebitda_margin_change_yoy', round(e / r - ye / yr, 8), CASE WHEN yr IS NULL THEN 'NOT_AVAILABLE' WHEN round(e / r - ye / yr, 8) = 0 THEN 'ZERO' ELSE 'VALUE' END FROM j
UNION ALL SELECT entity_id, observed_at, 'cash_balance_change', CASE WHEN qc > 0 THEN round(CAST(dc AS DOUBLE) / CAST(qc AS DOUBLE), 8) END, CASE WHEN qc IS NULL THEN 'NOT_AVAILABLE' WHEN NOT (qc > 0) THEN 'INVALID' WHEN dc = 0 THEN 'ZERO' ELSE 'VALUE' END FROM j
UNION ALL SELECT entity_id, observed_at, 'operating_profit_projection_variance', CASE WHEN yo > 0 THEN round(CAST(dox AS DOUBLE) / CAST(yo AS DOUBLE), 8) END, CASE WHEN yo IS NULL THEN 'NOT_AVAILABLE' WHEN NOT (yo > 0) THEN 'INVALID' WHEN dox = 0 THEN 'ZERO' ELSE 'VALUE' END FROM j""",
)
def _(t):
    return cat.statement_changes(t.statement).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


COUNT_DEFS = [(n, d, k) for n, d, ks in cat.COUNTS for k in ks]
COUNT_SQL = f"""hits AS (SELECT e.counterparty_id AS entity_id, d.feature_name, d.days, e.event_time AS observed_at FROM b_corporate_event e JOIN (VALUES {values_sql(COUNT_DEFS)}) d(feature_name, days, kind_no) ON e.kind_no = d.kind_no),
counts AS (""" + " UNION ALL ".join(
    f"SELECT DISTINCT entity_id, observed_at, feature_name, CAST(count(*) OVER (PARTITION BY entity_id, feature_name ORDER BY observed_at RANGE BETWEEN INTERVAL {d} DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS value, 'VALUE' AS state FROM hits WHERE days = {d}"
    for d in (90, 180, 365, 730)
) + ")"


@query("feature_roll", f"WITH {COUNT_SQL} SELECT * FROM counts")
def counts(t):
    return cat.event_counts(t.corporate_event)


#: name, kinds of events, days, whether the change against one look-back earlier is asked
PARTY = [("secured_creditor_count_change_90d", (9, 10), 90, True), ("lender_count_change_12m", (6, 8), 365, True), ("active_secured_party_count", (9,), 180, False)]
PARTY_AS_OF = "1999-01-01 00:00:00"


def party_sql(name, kinds, days, change):
    span = f"INTERVAL {days} DAY"
    older = f" - count(DISTINCT h.party_no) FILTER (h.event_time <= a.at - {span})" if change else ""
    return f"""SELECT a.counterparty_id AS entity_id, CAST(a.at AS TIMESTAMP) AS observed_at, '{name}' AS feature_name, CAST(count(DISTINCT h.party_no) FILTER (h.event_time >= a.at - {span}){older} AS DOUBLE) AS value
FROM (SELECT DISTINCT counterparty_id, unnest([event_time, event_time + {span} + INTERVAL 1 MICROSECOND]) AS at FROM b_corporate_event WHERE kind_no IN ({','.join(map(str, kinds))})) a
LEFT JOIN b_corporate_event h ON h.counterparty_id = a.counterparty_id AND h.kind_no IN ({','.join(map(str, kinds))}) AND h.event_time BETWEEN a.at - {span}{f" - {span}" if change else ""} AND a.at
WHERE a.at <= TIMESTAMP '{PARTY_AS_OF}' GROUP BY a.counterparty_id, a.at"""


@query("feature_distinct_parties", "SELECT *, CASE WHEN value = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM (" + " UNION ALL ".join(party_sql(*p) for p in PARTY) + ")")
def _(t):
    as_of = F.lit(PARTY_AS_OF).cast("timestamp_ntz")
    parts = [cat.distinct_parties(t.corporate_event, n, list(k), d, change, as_of) for n, k, d, change in PARTY]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SCALE = f"(VALUES {values_sql(cat.RATING_SCALE)}) s(rating, notch, pd)"
NOTCH = f"""r AS (SELECT a.*, notch FROM b_rating_action a JOIN {SCALE} ON a.rating = s.rating),
st AS (SELECT *, notch - lag(notch) OVER (PARTITION BY issuer_id, agency ORDER BY action_time, action_id) AS step FROM r),
rl AS (SELECT issuer_id, agency, action_time, arg_max(notch, action_id) AS notch FROM r GROUP BY ALL),
f1 AS (SELECT st.*, a.notch AS n90 FROM st ASOF LEFT JOIN rl a ON st.issuer_id = a.issuer_id AND st.agency = a.agency AND st.action_time - INTERVAL 90 DAY >= a.action_time),
f2 AS (SELECT f1.*, a.notch AS n12, coalesce(sum(abs(step)) OVER (PARTITION BY f1.issuer_id, f1.agency ORDER BY f1.action_time RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW), 0) AS velocity FROM f1 ASOF LEFT JOIN rl a ON f1.issuer_id = a.issuer_id AND f1.agency = a.agency AND f1.action_time - INTERVAL 365 DAY >= a.action_time),
lng AS (SELECT concat_ws('|', issuer_id, agency, action_id) AS entity_id, action_time AS observed_at, unnest(['external_rating_notch_change','external_rating_notch_change_90d','external_rating_notch_change_12m','rating_migration_velocity']) AS feature_name,
  unnest([CAST(step AS DOUBLE), CAST(notch - n90 AS DOUBLE), CAST(notch - n12 AS DOUBLE), CAST(velocity AS DOUBLE)]) AS value FROM f2)"""


@query("feature_rating_notches", f"WITH {NOTCH} SELECT *, CASE WHEN value IS NULL THEN 'NOT_AVAILABLE' WHEN value = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM lng")
def _(t):
    return cat.rating_features(t.rating_action)


@query(
    "feature_rating_states",
    "SELECT issuer_id, agency, arg_max(outlook, (action_time, action_id)) AS rating_outlook_state, arg_max(on_watch, (action_time, action_id)) AS rating_watch_state, CAST(date_diff('day', CAST(max(action_time) AS DATE), DATE '2002-01-01') AS INT) AS days_since_rating_action FROM b_rating_action GROUP BY ALL",
)
def _(t):
    return cat.rating_states(t.rating_action, F.lit("2002-01-01").cast("date"))


@query(
    "origination_relative",
    f"""WITH r AS (SELECT a.*, notch, CAST(pd AS DOUBLE) AS pd FROM b_rating_action a JOIN {SCALE} ON a.rating = s.rating),
e AS (SELECT issuer_id, arg_min(pd, (action_time, action_id)) AS o, arg_max(pd, (action_time, action_id)) AS c, arg_min(notch, (action_time, action_id)) AS og, arg_max(notch, (action_time, action_id)) AS cg FROM r GROUP BY 1)
SELECT issuer_id, o AS origination_pd, c AS current_pd, round(c - o, 8) AS absolute_pd_change, round(c / o - 1, 8) AS relative_pd_change, og AS origination_internal_grade, cg AS current_internal_grade, cg - og AS grade_notches_deteriorated FROM e""",
)
def _(t):
    return cat.origination_relative(t.rating_action)


DAILY = """dly AS (SELECT security_id, date_trunc('day', quote_time) AS day, max(price) AS high, arg_max(price, (quote_time, quote_id)) AS close, max(yield_pct) AS y, sum(volume) AS volume FROM b_market_quote GROUP BY ALL),
sp AS (SELECT d.*, y - min(y) OVER (PARTITION BY day) AS spread FROM dly d)"""


def _mk(days):
    frame = f"(PARTITION BY security_id ORDER BY day RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW)"
    old = f"(PARTITION BY security_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAY PRECEDING)"
    return f"round(1 - CAST(close AS DOUBLE) / CAST(max(high) OVER {frame} AS DOUBLE), 8), round(CAST((y - last_value(y) OVER {old}) * 100 AS DOUBLE), 6), round(CAST((spread - last_value(spread) OVER {old}) * 100 AS DOUBLE), 6)"


@query(
    "feature_market_changes",
    f"""WITH {DAILY}, l AS (SELECT security_id AS entity_id, CAST(day AS TIMESTAMP) AS observed_at, unnest(['bond_price_drawdown_5d','bond_yield_change_bps_5d','credit_spread_change_bps_5d','bond_price_drawdown_30d','bond_yield_change_bps_30d','credit_spread_change_bps_30d']) AS feature_name, unnest([{_mk(5)}, {_mk(30)}]) AS value FROM sp)
SELECT *, CASE WHEN value IS NULL THEN 'NOT_AVAILABLE' WHEN value = 0 THEN 'ZERO' ELSE 'VALUE' END AS state FROM l""",
)
def market(t, only=None):
    return cat.market_features(cat.market_daily(t.market_quote), only)


@query("win_drawdown", f"WITH {DAILY} SELECT security_id, CAST(day AS TIMESTAMP) AS day, round(1 - CAST(close AS DOUBLE) / CAST(max(high) OVER (PARTITION BY security_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS DOUBLE), 8) AS drawdown FROM sp")
def _(t):
    return market(t).filter("feature_name = 'bond_price_drawdown_30d'").select(F.col("entity_id").alias("security_id"), F.col("observed_at").alias("day"), F.col("value").alias("drawdown"))


@query("win_change_bps", f"WITH {DAILY} SELECT * FROM (SELECT security_id, CAST(day AS TIMESTAMP) AS day, round(CAST((y - last_value(y) OVER (PARTITION BY security_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 5 DAY PRECEDING)) * 100 AS DOUBLE), 6) AS change_bps FROM sp) WHERE change_bps IS NOT NULL")
def _(t):
    return market(t).filter("feature_name = 'bond_yield_change_bps_5d' AND value IS NOT NULL").select(F.col("entity_id").alias("security_id"), F.col("observed_at").alias("day"), F.col("value").alias("change_bps"))


ZS = f"""{DAILY}, zs AS (SELECT security_id, day, volume, count(*) OVER w AS n, sum(volume) OVER w AS s, sum(volume * volume) OVER w AS ss FROM sp WINDOW w AS (PARTITION BY security_id ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
zv AS (SELECT *, (CAST(ss AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / (n - 1) AS var FROM zs WHERE n >= 5)"""


def volume_z(t):
    return cat.own_history_zscore(cat.market_daily(t.market_quote), "volume", 90, 5)


@query("feature_abnormal_volume", f"WITH {ZS} SELECT security_id, CAST(day AS TIMESTAMP) AS day, round((CAST(volume AS DOUBLE) - CAST(s AS DOUBLE) / n) / sqrt(var), 6) AS z FROM zv WHERE var > 0")
def _(t):
    return volume_z(t).filter("z_state = 'VALUE'").select("security_id", "day", F.round("z", 6).alias("z"))


PEER = f"""{RATIO_SQL}, pr AS (SELECT r.entity_id, r.observed_at, value, segment, year(r.observed_at) AS yr FROM ratios r JOIN b_counterparty c ON r.entity_id = c.counterparty_id WHERE feature_name = '{{name}}' AND state IN ('VALUE','ZERO')),
pk AS (SELECT *, count(*) OVER c AS n, percent_rank() OVER (PARTITION BY segment, yr ORDER BY value) AS pct, avg(value) OVER c AS mean, stddev_samp(value) OVER c AS sd, median(value) OVER c AS med FROM pr WINDOW c AS (PARTITION BY segment, yr))"""


def peers(t, name, minimum=30):
    rows = ratios(t).filter((F.col("feature_name") == name) & F.col("state").isin("VALUE", "ZERO"))
    rows = rows.join(t.counterparty.select(F.col("counterparty_id").alias("entity_id"), "segment"), "entity_id").withColumn("yr", F.year("observed_at"))
    return feat.template_peer(rows.select("entity_id", "observed_at", "value", "segment", "yr"), ["segment", "yr"], "value", minimum)


@query("win_peer_percentile", f"WITH {PEER.format(name='current_ratio')} SELECT entity_id, observed_at, CASE WHEN n >= 30 THEN round(pct, 8) END AS peer_percentile, CASE WHEN n >= 30 THEN 'VALUE' ELSE 'NOT_AVAILABLE' END AS peer_state FROM pk")
def _(t):
    return peers(t, "current_ratio").select("entity_id", "observed_at", F.round("peer_percentile", 8).alias("peer_percentile"), "peer_state")


@query("win_peer_zscore", f"WITH {PEER.format(name='receivable_days')} SELECT entity_id, observed_at, CASE WHEN n >= 30 AND sd > 0 THEN round((value - mean) / sd, 6) END AS peer_zscore, CASE WHEN n >= 30 THEN 'VALUE' ELSE 'NOT_AVAILABLE' END AS peer_state FROM pk")
def _(t):
    return peers(t, "receivable_days").select("entity_id", "observed_at", F.round("peer_zscore", 6).alias("peer_zscore"), "peer_state")


@query("win_peer_delta", f"WITH {PEER.format(name='ebitda_margin')} SELECT entity_id, observed_at, CASE WHEN n >= 30 THEN round(value - med, 8) END AS peer_delta, n AS cohort_size FROM pk")
def _(t):
    return peers(t, "ebitda_margin").select("entity_id", "observed_at", F.round("peer_delta", 8).alias("peer_delta"), "cohort_size")


PEER_FEATURES = (("debt_ebitda", "debt_ebitda_peer_percentile"), ("tol_atnw", "leverage_peer_percentile"))


@query("feature_peer", " UNION ALL ".join(
    f"SELECT * FROM (WITH {PEER.format(name=n)} SELECT '{f}' AS feature_name, entity_id, observed_at, CASE WHEN n >= 30 THEN round(pct, 8) END AS value, CASE WHEN n >= 30 THEN 'VALUE' ELSE 'NOT_AVAILABLE' END AS state FROM pk)"
    for n, f in PEER_FEATURES
))
def _(t):
    """One row per entity and period; a small cohort is NOT_AVAILABLE, not left out."""
    part = lambda n, f: peers(t, n).select(F.lit(f).alias("feature_name"), "entity_id", "observed_at", F.round("peer_percentile", 8).alias("value"), F.col("peer_state").alias("state"))
    (a, x), (b, y) = PEER_FEATURES
    return part(a, x).unionByName(part(b, y))


@query("feature_delta", """WITH p AS (SELECT *, lag(limit_amount) OVER (PARTITION BY facility_id ORDER BY effective_at, event_id) AS before FROM b_limit_changed)
SELECT event_id, facility_id, CASE WHEN before > 0 THEN round(CAST(limit_amount - before AS DOUBLE) / CAST(before AS DOUBLE), 8) END AS committed_facility_change_pct,
  CASE WHEN before IS NULL THEN 'NOT_AVAILABLE' WHEN before <= 0 THEN 'INVALID' WHEN limit_amount = before THEN 'ZERO' ELSE 'VALUE' END AS state FROM p""")
def _(t):
    """Every change has a row: without a limit before it is NOT_AVAILABLE, after a limit of nothing INVALID."""
    rows = with_previous(t.limit_changed, ["facility_id"], "effective_at", ["event_id"], {"before": "limit_amount"}, days=365)
    before, now = F.col("before"), F.col("limit_amount")
    state = F.when(before.isNull(), "NOT_AVAILABLE").when(before <= 0, "INVALID").when(now == before, "ZERO").otherwise("VALUE")
    return rows.select(
        "event_id", "facility_id", F.when(before > 0, F.round((now - before).cast("double") / before.cast("double"), 8)).alias("committed_facility_change_pct"), state.alias("state")
    )


AGE_SQL = """SELECT s_suppkey AS entity_id, '{n}' AS feature_name, CAST(date_diff('day', CAST(last_at AS DATE), DATE '2002-01-01') AS DOUBLE) AS value, CASE WHEN last_at IS NULL THEN 'NOT_AVAILABLE' WHEN CAST(last_at AS DATE) = DATE '2002-01-01' THEN 'ZERO' ELSE 'VALUE' END AS state
FROM supplier LEFT JOIN (SELECT counterparty_id, max(event_time) AS last_at FROM b_corporate_event WHERE kind_no = {k} GROUP BY 1) ON s_suppkey = counterparty_id"""
AGES = [("collateral_valuation_age_days", 9), ("days_since_insolvency_start", 14), ("accounts_filing_delay_days", 19), ("drawing_power_age_days", 6), ("monitoring_document_delay_days", 7), ("financial_statement_age_days", 18)]


@query("feature_age", " UNION ALL ".join(AGE_SQL.format(n=n, k=k) for n, k in AGES))
def _(t):
    """Days since the last event of a kind; an entity that never had one is NOT_AVAILABLE, not 0."""
    kinds = [k for _, k in AGES]
    last = t.corporate_event.filter(F.col("kind_no").isin(kinds)).groupBy("counterparty_id").agg(
        *[F.max(F.when(F.col("kind_no") == k, F.col("event_time"))).alias(f"l{k}") for k in kinds]
    )
    rows = t.base("supplier").select("s_suppkey").join(last, F.col("s_suppkey") == F.col("counterparty_id"), "left")
    now = F.lit("2002-01-01").cast("date")
    cells = []
    for name, k in AGES:
        rows = feat.template_age(rows, name, F.col(f"l{k}"), now)
        cells.append(F.struct(F.lit(name).alias("n"), F.col(name).cast("double").alias("v"), F.col(f"{name}_state").alias("s")))
    return rows.select(F.col("s_suppkey").alias("entity_id"), F.explode(F.array(*cells)).alias("c")).select("entity_id", F.col("c.n").alias("feature_name"), F.col("c.v").alias("value"), F.col("c.s").alias("state"))


@query("feature_state", """SELECT counterparty_id, max(event_time) AS as_of, arg_max(CASE kind_no WHEN 14 THEN 'ADMINISTRATION' ELSE 'NONE' END, (event_time, event_id)) AS insolvency_procedure_type FROM b_corporate_event WHERE kind_no IN (14, 15) GROUP BY 1""")
def _(t):
    rows = t.corporate_event.filter("kind_no IN (14, 15)").withColumn("insolvency_procedure_type", F.when(F.col("kind_no") == 14, "ADMINISTRATION").otherwise("NONE"))
    return feat.template_state(rows, ["counterparty_id"], "event_time", ["event_id"], ["insolvency_procedure_type"])


@query("feature_flag", """SELECT counterparty_id, arg_max(kind_no, (event_time, event_id)) FILTER (kind_no IN (14, 15)) IS NOT DISTINCT FROM 14 AS active_insolvency_proceeding_flag, count(CASE WHEN kind_no = 16 AND event_time >= TIMESTAMP '2000-01-01 00:00:00' THEN 1 END) > 0 AS financial_non_reliance_flag,
  count(CASE WHEN kind_no = 19 AND event_time >= TIMESTAMP '2001-01-01 00:00:00' THEN 1 END) = 0 AS accounts_overdue_flag FROM b_corporate_event GROUP BY 1""")
def _(t):
    k, observed_at = F.col("kind_no"), F.col("event_time")
    since = lambda d: observed_at >= F.lit(d).cast("timestamp_ntz")
    last = F.max_by("kind_no", F.when(k.isin(14, 15), F.struct("event_time", "event_id")))
    return t.corporate_event.groupBy("counterparty_id").agg(
        last.eqNullSafe(F.lit(14)).alias("active_insolvency_proceeding_flag"),
        (F.count(F.when((k == 16) & since("2000-01-01"), 1)) > 0).alias("financial_non_reliance_flag"),
        (F.count(F.when((k == 19) & since("2001-01-01"), 1)) == 0).alias("accounts_overdue_flag"),
    )


@query("collateral_cover_ratio", """WITH c AS (SELECT l_suppkey AS e, sum(CAST(l_extendedprice AS DECIMAL(20,2)) * (100 - CAST(floor(l_discount * 100 + 0.5) AS INT)) / 100) AS eligible FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), x AS (SELECT l_suppkey AS e, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS exposure FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT e AS entity_id, round(CAST(eligible AS DOUBLE) / CAST(exposure AS DOUBLE), 6) AS collateral_cover_ratio, CASE WHEN eligible >= exposure THEN 'PERFECTED' ELSE 'PENDING' END AS security_perfection_status FROM c JOIN x USING (e) WHERE exposure > 0""")
def _(t):
    """Haircut-adjusted value over secured exposure, both kept as components of one aggregation."""
    price = F.col("l_extendedprice").cast("decimal(20,2)")
    keep = price * (100 - F.floor(F.col("l_discount") * 100 + 0.5).cast("int")) / 100
    rows = t.base("lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", keep)).alias("eligible"), F.sum(F.when(F.col("l_linestatus") == "O", price)).alias("exposure")
    )
    return rows.filter("exposure > 0 AND eligible IS NOT NULL").select(
        "entity_id", F.round(F.col("eligible").cast("double") / F.col("exposure").cast("double"), 6).alias("collateral_cover_ratio"),
        F.when(F.col("eligible") >= F.col("exposure"), "PERFECTED").otherwise("PENDING").alias("security_perfection_status"),
    )


@query("covenant_headroom", """SELECT l_orderkey AS k, l_linenumber AS line, p_partkey AS part, round(CASE WHEN p_size % 2 = 0 THEN (l_extendedprice - p_retailprice * 50) / (p_retailprice * 50) ELSE (p_retailprice * 50 - l_extendedprice) / (p_retailprice * 50) END, 8) AS covenant_headroom,
  CASE WHEN p_size % 2 = 0 THEN l_extendedprice < p_retailprice * 50 ELSE l_extendedprice > p_retailprice * 50 END AS breached FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    """Signed distance to the threshold; a floor covenant counts from below, a cap from above."""
    a, th = F.col("l_extendedprice"), F.col("p_retailprice") * 50
    floor = F.col("p_size") % 2 == 0
    room = F.when(floor, (a - th) / th).otherwise((th - a) / th)
    return t.base("lineitem").join(t.base("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("p_partkey").alias("part"), F.round(room, 8).alias("covenant_headroom"), F.when(floor, a < th).otherwise(a > th).alias("breached")
    )


@query("signal_covenant_breach", """SELECT 'COVENANT_BREACH' AS signal_type, l_orderkey AS k, l_linenumber AS line, l_suppkey AS entity_id, CASE WHEN p_size % 2 = 0 THEN 'FLOOR' ELSE 'CAP' END AS covenant, 'HIGH' AS severity
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CASE WHEN p_size % 2 = 0 THEN l_extendedprice < p_retailprice * 50 ELSE l_extendedprice > p_retailprice * 50 END""")
def _(t):
    """COVENANT_BREACH: a floor missed or a cap passed; meeting the threshold is no breach."""
    a, th, floor = F.col("l_extendedprice"), F.col("p_retailprice") * 50, F.col("p_size") % 2 == 0
    rows = t.base("lineitem").join(t.base("part"), F.col("l_partkey") == F.col("p_partkey")).filter(F.when(floor, a < th).otherwise(a > th))
    return rows.select(
        F.lit("COVENANT_BREACH").alias("signal_type"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("entity_id"),
        F.when(floor, "FLOOR").otherwise("CAP").alias("covenant"), F.lit("HIGH").alias("severity"),
    )


RELATED = """tr AS (SELECT payer_id, event_time, sum(amount) AS amount, sum(CASE WHEN related_party THEN amount ELSE 0 END) AS related FROM b_transfer GROUP BY ALL),
rr AS (SELECT payer_id, event_time, sum(related) OVER a AS r30, sum(amount) OVER a AS a30, sum(related) OVER b AS r90 FROM tr WINDOW a AS (PARTITION BY payer_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY payer_id ORDER BY event_time RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW))"""


def related(t):
    rows = t.transfer.withColumn("related", F.when(F.col("related_party"), F.col("amount")).otherwise(F.lit(0).cast("decimal(20,2)")))
    a = rolling(rows, ["payer_id"], "event_time", 30, {"r30": ("sum", "related"), "a30": ("sum", "amount")}, per_event=False)
    b = rolling(rows, ["payer_id"], "event_time", 90, {"r90": ("sum", "related")}, per_event=False)
    return a.join(b, ["payer_id", "event_time"])


@query("related_party_transfer_ratio_30d", f"WITH {RELATED} SELECT payer_id, event_time, round(CAST(r30 AS DOUBLE) / CAST(a30 AS DOUBLE), 8) AS ratio_30d, CAST(3 * r30 - r90 AS DOUBLE) / 2 AS delta_90d FROM rr")
def _(t):
    return related(t).select(
        "payer_id", "event_time", F.round(F.col("r30").cast("double") / F.col("a30").cast("double"), 8).alias("ratio_30d"),
        ((F.col("r30") * 3 - F.col("r90")).cast("double") / 2).alias("delta_90d"),
    )


@query("distressed_group_exposure_ratio", """SELECT payer_id AS entity_id, round(CAST(sum(CASE WHEN s_acctbal < 0 THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 8) AS distressed_group_exposure_ratio FROM b_transfer JOIN supplier ON beneficiary_id = s_suppkey GROUP BY 1""")
def _(t):
    """Exposure is first summed per payer and beneficiary, then joined to the distressed set."""
    per = t.transfer.groupBy("payer_id", "beneficiary_id").agg(F.sum("amount").alias("amount"))
    bad = t.base("supplier").select(F.col("s_suppkey").alias("beneficiary_id"), (F.col("s_acctbal") < 0).alias("distressed"))
    rows = per.join(bad, "beneficiary_id").groupBy(F.col("payer_id").alias("entity_id")).agg(F.sum(F.when(F.col("distressed"), F.col("amount")).otherwise(0)).alias("d"), F.sum("amount").alias("a"))
    return rows.select("entity_id", F.round(F.col("d").cast("double") / F.col("a").cast("double"), 8).alias("distressed_group_exposure_ratio"))


DEBT = "SELECT o_custkey AS entity_id, CAST(o_totalprice AS DECIMAL(20,2)) AS amount, o_orderdate + INTERVAL 1 DAY * CAST(200 + o_orderkey % 900 AS INT) AS maturity FROM orders"


@query("feature_debt_maturity", f"""WITH d AS (SELECT *, date_diff('day', DATE '1998-01-01', CAST(maturity AS DATE)) AS days FROM ({DEBT})) SELECT entity_id, CAST(min(CASE WHEN days >= 0 AND amount >= 100000 THEN days END) AS DOUBLE) AS nearest_material_debt_maturity_days,
  round(CAST(sum(CASE WHEN days BETWEEN 0 AND 365 THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN days >= 0 THEN amount END) AS DOUBLE), 8) AS debt_maturing_12m_ratio FROM d GROUP BY 1""")
def _(t):
    days = F.datediff("maturity", F.lit("1998-01-01").cast("date"))
    rows = t.sql(DEBT).withColumn("days", days).groupBy("entity_id").agg(
        F.min(F.when((F.col("days") >= 0) & (F.col("amount") >= 100000), F.col("days"))).alias("n"),
        F.sum(F.when(F.col("days").between(0, 365), F.col("amount")).otherwise(0)).alias("soon"), F.sum(F.when(F.col("days") >= 0, F.col("amount"))).alias("total"),
    )
    return rows.select(
        "entity_id", F.col("n").cast("double").alias("nearest_material_debt_maturity_days"), F.round(F.col("soon").cast("double") / F.col("total").cast("double"), 8).alias("debt_maturing_12m_ratio")
    )


@query("feature_affected_debt", """SELECT counterparty_id AS entity_id, round(CAST(sum(CASE WHEN kind_no IN (11, 12) THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 8) AS affected_defaulted_debt_ratio, round(CAST(count(CASE WHEN kind_no = 9 THEN 1 END) AS DOUBLE) / count(DISTINCT CAST(event_time AS DATE)), 8) AS security_interest_creation_velocity FROM b_corporate_event GROUP BY 1""")
def _(t):
    k = F.col("kind_no")
    rows = t.corporate_event.groupBy(F.col("counterparty_id").alias("entity_id")).agg(
        F.sum(F.when(k.isin(11, 12), F.col("amount")).otherwise(0)).alias("d"), F.sum("amount").alias("a"), F.count(F.when(k == 9, 1)).alias("c"), F.count_distinct(F.col("event_time").cast("date")).alias("n")
    )
    return rows.select(
        "entity_id", F.round(F.col("d").cast("double") / F.col("a").cast("double"), 8).alias("affected_defaulted_debt_ratio"), F.round(F.col("c") / F.col("n"), 8).alias("security_interest_creation_velocity")
    )


@query("feature_quality_measures", """SELECT source_system, round(CAST(count(quality) AS DOUBLE) / count(*), 8) AS relationship_resolution_coverage, round(CAST(sum(quality) AS DOUBLE) / count(quality), 8) AS financial_extraction_confidence, CASE WHEN count(CASE WHEN toxic = 1 AND quality = 1 THEN 1 END) > 0 THEN 'CONFLICTED' ELSE 'AGREE' END AS source_reconciliation_status
FROM b_evidence LEFT JOIN labels ON evidence_id = doc_id GROUP BY 1""")
def _(t):
    lab = t.base("labels").select(F.col("doc_id").alias("evidence_id"), "quality", "toxic")
    rows = t.evidence.select("evidence_id", "source_system").join(lab, "evidence_id", "left").groupBy("source_system").agg(
        F.count("quality").alias("q"), F.sum("quality").alias("s"), F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 1)).alias("c")
    )
    return rows.select(
        "source_system", F.round(F.col("q") / F.col("n"), 8).alias("relationship_resolution_coverage"), F.round(F.col("s") / F.col("q"), 8).alias("financial_extraction_confidence"),
        F.when(F.col("c") > 0, "CONFLICTED").otherwise("AGREE").alias("source_reconciliation_status"),
    )


@query("classify_namespace_state", """SELECT o_custkey AS entity_id, CASE o_orderstatus WHEN 'F' THEN 'IN_SMA_NPA' WHEN 'O' THEN 'UK_IFRS9_STAGE' ELSE 'US_ACCRUAL_STATUS' END AS namespace, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS current_state, max(o_orderdate) AS since, count(*) AS rows_kept FROM orders GROUP BY ALL""")
def _(t):
    """Classification rows are appended; the current one per entity and namespace is a view."""
    ns = F.when(F.col("o_orderstatus") == "F", "IN_SMA_NPA").when(F.col("o_orderstatus") == "O", "UK_IFRS9_STAGE").otherwise("US_ACCRUAL_STATUS")
    return t.base("orders").groupBy(F.col("o_custkey").alias("entity_id"), ns.alias("namespace")).agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("current_state"), F.max("o_orderdate").alias("since"), F.count(F.lit(1)).alias("rows_kept")
    )
