"""Signal catalogue, graph, text and model jobs."""

from pyspark.sql import functions as F

from tideglass.operators import catalogue as cat, graph as gr, ml, signal_catalogue as sc, text as tx
from tideglass.operators.ordered import rolling_sums
from tideglass.plans.catalogue import CCC, COUNT_SQL, DAILY, NOTCH, PEER, RATIO_SQL, YOY, ZS, _mk, counts, market, peers, ratios, volume_z
from tideglass.registry import query
from tideglass.sources.reference import values_sql

NUM = [(s, f, o, float(x), v) for s, f, o, x, v in sc.THRESHOLD]
MARKET_SQL = f"""{DAILY}, mkt AS (SELECT security_id AS entity_id, CAST(day AS TIMESTAMP) AS observed_at, unnest(['bond_price_drawdown_5d','bond_yield_change_bps_5d','credit_spread_change_bps_5d','bond_price_drawdown_30d','bond_yield_change_bps_30d','credit_spread_change_bps_30d']) AS feature_name, unnest([{_mk(5)}, {_mk(30)}]) AS value FROM sp)"""
LEVEL_SQL = f"""lv AS (SELECT counterparty_id AS entity_id, CAST(period_start AS TIMESTAMP) AS observed_at, 'operating_cash_flow' AS feature_name, CAST(operating_cash_flow AS DOUBLE) AS value FROM b_statement UNION ALL SELECT counterparty_id, CAST(period_start AS TIMESTAMP), 'cash_conversion_cycle', round({CCC}, 6) FROM b_statement)"""
CHANGE_SQL = f"""{YOY}, cg AS (SELECT entity_id, observed_at, 'revenue_yoy_change' AS feature_name, CASE WHEN yr > 0 THEN round(CAST(dr AS DOUBLE) / yr, 8) END AS value FROM j UNION ALL SELECT entity_id, observed_at, 'cash_balance_change', CASE WHEN qc > 0 THEN round(CAST(dc AS DOUBLE) / CAST(qc AS DOUBLE), 8) END FROM j)"""
SIDES = "SELECT entity_id, observed_at, feature_name, value FROM ratios UNION ALL SELECT * FROM lv UNION ALL SELECT * FROM cg"


def statement_long(t, only=None):
    ntz = lambda d: d.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    return ratios(t, only).unionByName(ntz(cat.statement_levels(t.statement, only))).unionByName(ntz(cat.statement_changes(t.statement, only)))


def all_long(t, only=None):
    return statement_long(t, only).unionByName(market(t, only))


@query(
    "signal_threshold",
    f"""WITH {RATIO_SQL}, {LEVEL_SQL}, {CHANGE_SQL}, {MARKET_SQL}, f AS ({SIDES} UNION ALL SELECT * FROM mkt)
SELECT signal_type, entity_id, observed_at, value, severity FROM f JOIN (VALUES {values_sql(NUM)}) p(signal_type, feature_name, op, threshold, severity) ON f.feature_name = p.feature_name WHERE CASE op WHEN 'LT' THEN value < threshold ELSE value >= threshold END""",
)
def _(t):
    return sc.threshold(all_long(t))


TR = [(s, f, d, float(x), v) for s, f, d, x, v in sc.TREND]


@query(
    "signal_trend",
    f"""WITH {RATIO_SQL}, {LEVEL_SQL}, {CHANGE_SQL}, {MARKET_SQL}, {NOTCH}, f AS (SELECT CAST(entity_id AS VARCHAR) AS entity_id, observed_at, feature_name, value FROM ({SIDES} UNION ALL SELECT * FROM mkt) UNION ALL SELECT entity_id, observed_at, feature_name, value FROM lng),
m AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, feature_name ORDER BY observed_at) AS previous FROM f WHERE value IS NOT NULL)
SELECT signal_type, entity_id, observed_at, value, severity FROM m JOIN (VALUES {values_sql(TR)}) p(signal_type, feature_name, direction, change, severity) ON m.feature_name = p.feature_name
WHERE CASE direction WHEN 'UP' THEN value - previous >= change WHEN 'DOWN' THEN previous - value >= change ELSE value >= change END""",
)
def _(t):
    text = lambda d: d.withColumn("entity_id", F.col("entity_id").cast("string"))
    named = {feature for _, feature, *_ in sc.TREND}
    # Adverse changes are of statement features, one row a quarter: the calendar bounds what an entity has of a feature.
    return sc.trend(text(all_long(t, named)).unionByName(text(cat.rating_features(t.rating_action, named))), hot=None)


SPIKE = """tr AS (SELECT payer_id, event_time, sum(amount) AS amount FROM b_transfer WHERE related_party GROUP BY ALL),
w AS (SELECT *, count(*) OVER x AS n, sum(amount) OVER x AS s FROM tr WINDOW x AS (PARTITION BY payer_id ORDER BY event_time RANGE BETWEEN INTERVAL 360 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""


@query("signal_spike", f"WITH {SPIKE} SELECT 'RELATED_ENTITY_TRANSFER_SPIKE' AS signal_type, payer_id, event_time, CAST(amount AS DOUBLE) AS amount FROM w WHERE n >= 1 AND CAST(amount AS DOUBLE) >= 2.0 * (CAST(s AS DOUBLE) / n)")
def _(t):
    daily = t.transfer.filter("related_party").groupBy("payer_id", "event_time").agg(F.sum("amount").alias("amount"))
    return sc.spike(daily, ["payer_id"], "event_time", "amount", 360, 2.0, 1).select(
        F.lit("RELATED_ENTITY_TRANSFER_SPIKE").alias("signal_type"), "payer_id", "event_time", F.col("amount").cast("double").alias("amount")
    )


@query("signal_recurrence", f"WITH {COUNT_SQL} SELECT signal_type, entity_id, observed_at, value, severity FROM counts c JOIN (VALUES {values_sql(sc.RECURRENCE)}) p(signal_type, feature_name, minimum, severity) ON c.feature_name = p.feature_name WHERE value >= minimum")
def _(t):
    return sc.recurrence(counts(t))


@query("signal_state", f"SELECT signal_type, counterparty_id AS entity_id, event_time AS observed_at, event_id, severity FROM b_corporate_event e JOIN (VALUES {values_sql(sc.STATE)}) p(signal_type, kind_no, severity) ON e.kind_no = p.kind_no")
def _(t):
    return sc.state(t.corporate_event)


@query(
    "signal_zscore",
    f"""WITH {PEER.format(name='receivable_days')}, {ZS}
SELECT 'PEER_PERFORMANCE_DIVERGENCE' AS signal_type, CAST(entity_id AS VARCHAR) AS entity_id, observed_at FROM pk WHERE n >= 30 AND sd > 0 AND abs((value - mean) / sd) >= 2
UNION ALL SELECT 'MARKET_LIQUIDITY_DETERIORATION', CAST(security_id AS VARCHAR), CAST(day AS TIMESTAMP) FROM zv WHERE var > 0 AND abs((CAST(volume AS DOUBLE) - CAST(s AS DOUBLE) / n) / sqrt(var)) >= 2""",
)
def _(t):
    a = sc.zscore(peers(t, "receivable_days"), "peer_zscore", 2, "PEER_PERFORMANCE_DIVERGENCE").select("signal_type", F.col("entity_id").cast("string").alias("entity_id"), "observed_at")
    b = sc.zscore(volume_z(t), "z", 2, "MARKET_LIQUIDITY_DETERIORATION").select("signal_type", F.col("security_id").cast("string").alias("entity_id"), F.col("day").alias("observed_at"))
    return a.unionByName(b)


@query(
    "signal_credit_spread_divergence",
    f"""WITH {DAILY}, c AS (SELECT sp.*, s_nationkey % 5 AS sector, CAST(volume AS DOUBLE) >= 20 AS liquid FROM sp JOIN supplier ON security_id = s_suppkey), k AS (SELECT *, date_trunc('month', day) AS m FROM c),
z AS (SELECT *, count(*) OVER g AS n, avg(CAST(spread AS DOUBLE)) OVER g AS mean, stddev_samp(CAST(spread AS DOUBLE)) OVER g AS sd FROM k WINDOW g AS (PARTITION BY sector, m))
SELECT security_id, CAST(day AS TIMESTAMP) AS day FROM z WHERE n >= 20 AND sd > 0 AND abs((CAST(spread AS DOUBLE) - mean) / sd) >= 2 AND liquid""",
)
def _(t):
    """Spread against the sector in the same month; thin trading fails the gate."""
    daily = cat.market_daily(t.market_quote)
    bench = daily.groupBy("day").agg(F.min("yield_pct").alias("_bench"))
    sector = t.base("supplier").select(F.col("s_suppkey").alias("security_id"), (F.col("s_nationkey") % 5).alias("sector"))
    rows = daily.join(bench, "day").join(sector, "security_id").withColumn("spread", (F.col("yield_pct") - F.col("_bench")).cast("double")).withColumn("m", F.date_trunc("month", "day"))
    stats = rows.groupBy("sector", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("sd"))
    z = rows.join(stats, ["sector", "m"]).filter("n >= 20 AND sd > 0").withColumn("z", (F.col("spread") - F.col("mean")) / F.col("sd"))
    return sc.zscore(z, "z", 2, "CREDIT_SPREAD_DIVERGENCE", F.col("volume") >= 20).select("security_id", "day")


@query(
    "signal_sector_stress",
    f"""WITH {RATIO_SQL}, q AS (SELECT segment, observed_at, count(*) AS n, sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS weak FROM ratios JOIN b_counterparty ON entity_id = counterparty_id WHERE feature_name = 'dscr' AND state IN ('VALUE','ZERO') GROUP BY ALL),
l AS (SELECT *, lag(weak) OVER w AS pw, lag(n) OVER w AS pn FROM q WINDOW w AS (PARTITION BY segment ORDER BY observed_at))
SELECT segment, observed_at, round(CAST(weak AS DOUBLE) / n - CAST(pw AS DOUBLE) / pn, 8) AS rise FROM l WHERE CAST(weak AS DOUBLE) / n - CAST(pw AS DOUBLE) / pn >= 0.02""",
)
def _(t):
    """SECTOR_STRESS_RISING: share of weak debt service in a sector against the quarter before."""
    from pyspark.sql import Window

    rows = ratios(t).filter("feature_name = 'dscr' AND state IN ('VALUE','ZERO')").join(t.counterparty.select(F.col("counterparty_id").alias("entity_id"), "segment"), "entity_id")
    q = rows.groupBy("segment", "observed_at").agg((F.sum((F.col("value") < 1).cast("int")) / F.count(F.lit(1))).alias("share"))
    # One row per sector and quarter.
    w = Window.partitionBy("segment").orderBy("observed_at")
    rise = F.col("share") - F.lag("share").over(w)
    return q.withColumn("rise", rise).filter("rise >= 0.02").select("segment", "observed_at", F.round("rise", 8).alias("rise"))


CONC = """pp AS (SELECT payer_id, beneficiary_id, CAST(sum(amount) AS DOUBLE) AS a FROM b_transfer GROUP BY ALL)"""


@query("graph_concentration", f"WITH {CONC} SELECT payer_id, count(*) AS parties, round(max(a) / sum(a), 8) AS top_share, round(sum(a * a) / (sum(a) * sum(a)), 8) AS herfindahl FROM pp GROUP BY 1")
def _(t):
    out = gr.concentration(t.transfer, "payer_id", "beneficiary_id", "amount")
    return out.select("payer_id", "parties", F.round("top_share", 8).alias("top_share"), F.round("herfindahl", 8).alias("herfindahl"))


@query("signal_cash_flow_concentration", """WITH pb AS (SELECT beneficiary_id, payer_id, CAST(sum(amount) AS DOUBLE) AS a FROM b_transfer GROUP BY ALL) SELECT beneficiary_id, round(max(a) / sum(a), 8) AS top_share FROM pb GROUP BY 1 HAVING max(a) / sum(a) >= 0.01""")
def _(t):
    out = gr.concentration(t.transfer, "beneficiary_id", "payer_id", "amount").filter("top_share >= 0.01")
    return out.select("beneficiary_id", F.round("top_share", 8).alias("top_share"))


EDGES = """e AS (SELECT concat('C', owner_id) AS src, concat('S', owned_id) AS dst, edge_type, valid_from, valid_to, confidence FROM b_relationship UNION ALL SELECT concat('S', owned_id), concat('C', owner_id), edge_type, valid_from, valid_to, confidence FROM b_relationship)"""
NODES = "SELECT concat('C', c_custkey) AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal < 0"


AS_OF = "1998-06-01 00:00:00"
VALID = f"valid_from <= TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' < valid_to"


@query(
    "graph_group_components",
    f"""WITH RECURSIVE x AS (SELECT DISTINCT concat('C', owner_id) AS a, concat('S', owned_id) AS b FROM b_relationship WHERE edge_type = 'CONTROL' AND {VALID}),
both_ways AS (SELECT a, b FROM x UNION SELECT b, a FROM x), r AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM r JOIN both_ways w ON r.other = w.a)
SELECT node, min(other) AS component FROM r GROUP BY node""",
)
def _(t):
    """Groups under common control at a moment, over all control relations valid then."""
    control = t.relationship.filter(f"edge_type = 'CONTROL' AND {VALID}")
    return gr.components(control.select(F.concat(F.lit("C"), "owner_id").alias("src"), F.concat(F.lit("S"), "owned_id").alias("dst")))


@query(
    "graph_bounded_contagion",
    f"""WITH {EDGES}, v AS (SELECT src, dst, CAST(max(confidence) AS DOUBLE) AS c FROM e WHERE edge_type IN ('CONTROL','GUARANTEE') AND valid_from <= TIMESTAMP '1998-06-01 00:00:00' AND TIMESTAMP '1998-06-01 00:00:00' < valid_to GROUP BY ALL), n AS ({NODES}),
h1 AS (SELECT dst AS node, max(1.0 * c) AS strength, 1 AS hops FROM n JOIN v ON n.node = v.src WHERE dst NOT IN (SELECT node FROM n) GROUP BY dst), h2 AS (SELECT dst AS node, max(strength * c) AS strength, 2 AS hops FROM h1 JOIN v ON h1.node = v.src WHERE dst NOT IN (SELECT node FROM n) GROUP BY dst),
a AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT node, round(max(strength), 8) AS strength, arg_min(hops, (-strength, hops)) AS hops FROM a GROUP BY node""",
)
def contagion(t):
    edges = gr.valid_edges(t.sql(f"WITH {EDGES} SELECT * FROM e"), F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), ["CONTROL", "GUARANTEE"])
    return gr.contagion(t.sql(NODES), edges, 2).withColumn("strength", F.round("strength", 8))


@query(
    "signal_round_tripping",
    """WITH ed AS (SELECT * FROM b_related_flow)
SELECT 'TWO' AS kind, a.src AS a, a.dst AS b, '' AS c FROM ed a JOIN ed z ON a.src = z.dst AND a.dst = z.src WHERE a.src < a.dst
UNION ALL SELECT 'THREE', x.src, x.dst, y.dst FROM ed x JOIN ed y ON x.dst = y.src JOIN ed z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst""",
)
def _(t):
    """Money that comes back over two or three related parties; customers and suppliers keep their own ids."""
    edges = t.related_flow
    two = gr.two_cycles(edges).select(F.lit("TWO").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("").alias("c"))
    three = gr.three_cycles(edges)
    back = F.col("direction") == "ACB"
    return two.unionByName(three.select(
        F.lit("THREE").alias("kind"), "a", F.when(back, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(back, F.col("b")).otherwise(F.col("c")).alias("c")
    ))


@query(
    "signal_graph",
    f"""WITH {EDGES}, v AS (SELECT DISTINCT src, dst FROM e WHERE edge_type IN ('CONTROL','GUARANTEE') AND {VALID}), n AS ({NODES})
SELECT CASE WHEN substr(dst, 1, 1) = 'C' THEN 'GUARANTOR_DISTRESS' ELSE 'MAJOR_CUSTOMER_DISTRESS' END AS signal_type, dst AS entity_id, count(*) AS distressed_links FROM v JOIN n ON v.src = n.node GROUP BY dst""",
)
def _(t):
    """A related entity in distress, by relations valid at the moment; links are counted per entity, reduced before the shuffle."""
    edges = t.sql(f"WITH {EDGES} SELECT * FROM e").filter(f"edge_type IN ('CONTROL','GUARANTEE') AND {VALID}").select("src", "dst").distinct()
    hits = edges.join(t.sql(NODES).withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("entity_id")).agg(F.count(F.lit(1)).alias("distressed_links"))
    return hits.withColumn("signal_type", F.when(F.col("entity_id").startswith("C"), "GUARANTOR_DISTRESS").otherwise("MAJOR_CUSTOMER_DISTRESS"))


@query("feature_graph", """SELECT payer_id, count(*) AS transfers, count(CASE WHEN hit THEN 1 END) AS linked FROM (SELECT f.payer_id, EXISTS (SELECT 1 FROM b_relationship e WHERE e.edge_type = 'GUARANTEE' AND e.owner_id = f.payer_id AND e.owned_id = f.beneficiary_id AND e.valid_from <= f.event_time AND f.event_time < e.valid_to) AS hit FROM b_transfer f) GROUP BY 1""")
def _(t):
    from tideglass.operators.joins import flows_to_related

    linked = flows_to_related(t.transfer, t.relationship.filter("edge_type = 'GUARANTEE'")).groupBy("payer_id").agg(F.count(F.lit(1)).alias("linked"))
    return t.transfer.groupBy("payer_id").agg(F.count(F.lit(1)).alias("transfers")).join(linked, "payer_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))


@query("text_evidence_hash", "SELECT evidence_id, source_system, sha256(text) AS content_hash FROM b_evidence")
def _(t):
    return tx.evidence_hashes(t.evidence)


@query("text_exact_copies", "SELECT sha256(text) AS content_hash, min(evidence_id) AS first_id, count(*) AS copies FROM b_evidence GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return tx.exact_copies(tx.evidence_hashes(t.evidence))


SPANS = f"""ph AS (SELECT * FROM (VALUES {values_sql([(p, c, x) for p, c, x in tx.PHRASES])}) p(phrase, category, confidence)),
d AS (SELECT evidence_id, phrase, category, CAST(confidence AS DOUBLE) AS confidence, string_split(lower(text), phrase) AS parts FROM b_evidence JOIN ph ON contains(lower(text), phrase)),
o AS (SELECT evidence_id, phrase, category, confidence, parts, unnest(range(1, len(parts))) AS i FROM d),
spans AS (SELECT evidence_id, phrase, category, confidence, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS INT) AS span_start, length(phrase) AS len FROM o)"""


@query("text_candidate_spans", f"WITH {SPANS} SELECT evidence_id, phrase, category, confidence, span_start, CAST(span_start + len AS INT) AS span_end FROM spans")
def _(t):
    return tx.candidate_spans(t.evidence)


@query("signal_text", f"WITH {SPANS} SELECT category AS signal_type, evidence_id, count(*) AS spans, max(confidence) AS confidence FROM spans WHERE confidence >= 0.5 GROUP BY ALL")
def _(t):
    """Phrase evidence above the confidence floor; always for review."""
    return tx.candidate_spans(t.evidence).filter("confidence >= 0.5").groupBy(F.col("category").alias("signal_type"), "evidence_id").agg(
        F.count(F.lit(1)).alias("spans"), F.max("confidence").alias("confidence")
    )


def extract(t):
    asks = t.dpd_changed.select(F.col("event_id").alias("ask_id"), "facility_id", F.col("event_time").alias("asked_at"), F.col("current_dpd").alias("dpd_now"))
    return ml.training_extract(asks, t.feature_history, t.dpd_changed, 3, 90)


@query(
    "ml_training_extract",
    """WITH k AS (SELECT d.event_id, arg_max(h.value_numeric, (h.effective_at, h.revision, h.event_id)) AS known FROM b_dpd_changed d LEFT JOIN b_feature_history h ON d.facility_id = h.facility_id AND h.knowledge_time <= d.event_time GROUP BY d.event_id),
w AS (SELECT event_id, facility_id, event_time, count(*) OVER p AS n7, max(current_dpd) OVER p AS m7, max(current_dpd) OVER f AS ahead FROM b_dpd_changed WINDOW p AS (PARTITION BY facility_id ORDER BY event_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW), f AS (PARTITION BY facility_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 3 DAY FOLLOWING))
SELECT w.event_id AS ask_id, facility_id, event_time AS asked_at, CAST(known AS DOUBLE) AS dpd_known, n7 AS events_7d, m7 AS max_dpd_7d, CASE WHEN coalesce(ahead, 0) >= 90 THEN 1 ELSE 0 END AS label FROM w JOIN k ON w.event_id = k.event_id""",
)
def _(t):
    return extract(t).select("ask_id", "facility_id", "asked_at", F.col("dpd_known").cast("double").alias("dpd_known"), "events_7d", "max_dpd_7d", "label")


@query("ml_score")
def _(t):
    return ml.score(extract(t), ["dpd_known", "events_7d", "max_dpd_7d"], "DPD_90_PLUS", 3, "lr-1")


@query(
    "signal_inflow_decline",
    """WITH i AS (SELECT beneficiary_id AS account_id, event_time, sum(amount) AS amount, count(*) AS n FROM b_transfer GROUP BY ALL),
r AS (SELECT account_id, event_time, sum(amount) OVER a AS s30, sum(amount) OVER b AS s120, sum(n) OVER a AS n30, sum(n) OVER b AS n120 FROM i WINDOW a AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW))
SELECT 'CREDIT_INFLOW_DECLINE' AS signal_type, account_id, event_time FROM r WHERE 6 * s30 <= s120 - s30 UNION ALL SELECT 'TRANSACTION_VOLUME_COLLAPSE', account_id, event_time FROM r WHERE 9 * n30 <= n120 - n30""",
)
def _(t):
    daily = t.transfer.groupBy(F.col("beneficiary_id").alias("account_id"), "event_time").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    both = rolling_sums(daily, ["account_id"], "event_time", [30, 120], ["amount", "n"])
    hits = F.array(
        F.when(F.expr("6 * amount_30 <= amount_120 - amount_30"), "CREDIT_INFLOW_DECLINE"), F.when(F.expr("9 * n_30 <= n_120 - n_30"), "TRANSACTION_VOLUME_COLLAPSE")
    )
    return both.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("signal_type"), "account_id", "event_time")


SERIES = """SELECT 'revenue_by_market' AS series, c.market AS member, s.period_start AS period, CAST(sum(s.revenue) AS DECIMAL(28,4)) AS total FROM b_statement s JOIN b_counterparty c ON s.counterparty_id = c.counterparty_id GROUP BY c.market, s.period_start
UNION ALL SELECT 'price_by_type', p.p_type, date_trunc('year', l.l_shipdate), CAST(sum(CAST(l.l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(28,4)) FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_type, date_trunc('year', l.l_shipdate)
UNION ALL SELECT 'yield', 'ALL', date_trunc('month', quote_time), CAST(sum(yield_pct) AS DECIMAL(28,4)) FROM b_market_quote GROUP BY date_trunc('month', quote_time)
UNION ALL SELECT 'flow_by_nation', CAST(c.c_nationkey AS VARCHAR(10)), date_trunc('quarter', f.event_time), CAST(sum(f.amount) AS DECIMAL(28,4)) FROM b_transfer f JOIN customer c ON f.payer_id = c.c_custkey GROUP BY c.c_nationkey, date_trunc('quarter', f.event_time)"""


@query(
    "signal_macro_series",
    f"""WITH s AS ({SERIES}), l AS (SELECT *, lag(total) OVER (PARTITION BY series, member ORDER BY period) AS before FROM s), c AS (SELECT *, (CAST(total AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(before AS DOUBLE) AS change FROM l WHERE before > 0)
SELECT signal_type, member, CAST(period AS TIMESTAMP) AS period, round(change, 8) AS change, severity FROM c JOIN (VALUES {values_sql([(a, b, d, float(x), v) for a, b, d, x, v in sc.SERIES])}) p(signal_type, series, direction, level, severity) ON c.series = p.series WHERE CASE direction WHEN 'UP' THEN change ELSE -change END >= level""",
)
def _(t):
    """Sector and macro series: region revenue, input prices, yields, flows by nation."""
    out = sc.series_stress(t.sql(SERIES))
    return out.select("signal_type", "member", F.col("period").cast("timestamp_ntz").alias("period"), F.round("change", 8).alias("change"), "severity")


@query(
    "signal_document_integrity",
    """WITH a AS (SELECT o_orderkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
j AS (SELECT k, a.v AS va, b.v AS vb FROM a FULL JOIN b USING (k))
SELECT * FROM (SELECT k, CASE WHEN vb IS NULL THEN 'INVOICE_FABRICATION_SUSPECTED' WHEN va IS NULL THEN 'INVENTORY_OR_BORROWING_BASE_INCONSISTENCY' WHEN abs(va - vb) > 50000 THEN CASE WHEN va >= vb * 1.5 THEN 'TURNOVER_OVERSTATEMENT_SUSPECTED' WHEN vb >= va * 1.5 THEN 'RECEIVABLE_OR_DEBTOR_DATA_ANOMALY' ELSE 'FINANCIAL_DOCUMENT_INCONSISTENCY' END END AS signal_type, true AS requires_review FROM j) WHERE signal_type IS NOT NULL""",
)
def _(t):
    from tideglass.operators.joins import reconcile

    total = lambda table, key, col: t.base(table).groupBy(F.col(key).alias("k")).agg(F.sum(F.col(col).cast("decimal(20,2)")).cast("double").alias("v"))
    both = reconcile(total("orders", "o_orderkey", "o_totalprice"), total("lineitem", "l_orderkey", "l_extendedprice"), ["k"], "v", 50000)
    return sc.document_integrity(both, 1.5).select("k", "signal_type", "requires_review")


FLOWS = """SELECT f.payer_id, f.amount, f.related_party, s.s_acctbal < 0 AS distressed, np.n_regionkey <> nb.n_regionkey AS outside FROM b_transfer f JOIN supplier s ON f.beneficiary_id = s.s_suppkey JOIN customer c ON f.payer_id = c.c_custkey
JOIN nation np ON c.c_nationkey = np.n_nationkey JOIN nation nb ON s.s_nationkey = nb.n_nationkey"""


@query(
    "signal_flow_patterns",
    f"""WITH f AS ({FLOWS}), p AS (SELECT payer_id, CAST(sum(CASE WHEN related_party THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS related_share, CAST(sum(CASE WHEN distressed THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS distressed_share,
  CAST(sum(CASE WHEN outside THEN amount ELSE 0 END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS outside_share FROM f GROUP BY 1) """
    + " UNION ALL ".join(f"SELECT payer_id, '{s}' AS signal_type FROM p WHERE {c} >= {x}" for s, c, x in sc.FLOW),
)
def _(t):
    """Integrity patterns on outflows; always reviewed by a person."""
    return sc.flow_patterns(t.sql(FLOWS))
