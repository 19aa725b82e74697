"""Wire parsing, routing, gates, sinks."""

from pyspark.sql import functions as F

from tideglass.functions import scalars as sc
from tideglass.operators import features as feat, signals as sig
from tideglass.plans.sqltext import DPD_FEATURES, DPD_SIGNALS, uuid_sql
from tideglass.registry import query
from tideglass.session import new_path
from tideglass.sources import events as ev, sinks
from tideglass.sources.reference import CORPORATE_EVENT_KINDS, PROHIBITED_SIGNAL_TYPES, RETENTION, values, values_sql


def wire(t):
    """Envelope JSON of the event table; purchases over 100 arrive cut off, views under 1 without a usable time."""
    e = t.base("events")
    envelope = F.struct(
        F.col("event_id").cast("string").alias("eventId"), F.lit(ev.DPD_EVENT).alias("eventType"),
        F.when((F.col("event_type") == "view") & (F.col("value") < 1), "unknown").otherwise(feat.iso_instant(F.col("ts"))).alias("eventTime"),
        F.lit("FACILITY").alias("entityType"), F.when((F.col("event_type") == "click") & (F.col("value") < 1), "").otherwise(F.col("user_id").cast("string")).alias("entityId"),
        F.struct((F.floor("value").cast("int") % 121).alias("currentDpd"), (F.col("event_type") != "error").alias("reconciled")).alias("data"),
    )
    text = F.to_json(envelope)
    cut = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return e.select(F.when(cut, F.substring(text, 1, 60)).otherwise(text).alias("value"))


Q = """q AS (SELECT *, CASE WHEN event_type = 'purchase' AND value > 100 THEN 'SCHEMA_INVALID' WHEN event_type = 'view' AND value < 1 THEN 'BUSINESS_VALIDATION_FAILED' WHEN event_type = 'click' AND value < 1 THEN 'ENTITY_RESOLUTION_FAILED' END AS quarantine_class FROM events)"""


@query(
    "src_canonical_events",
    f"WITH {Q} SELECT CAST(event_id AS VARCHAR) AS event_id, 'obligation.dpd.changed' AS event_type, ts AS event_time, CAST(user_id AS VARCHAR) AS facility_id, CAST(floor(value) AS INT) % 121 AS current_dpd, event_type <> 'error' AS reconciled FROM q WHERE quarantine_class IS NULL",
)
def _(t):
    good, _ = ev.parse_envelopes(wire(t))
    return ev.dpd_changes(good).select(
        "event_id", F.lit(ev.DPD_EVENT).alias("event_type"), F.col("event_time").cast("timestamp_ntz").alias("event_time"), "facility_id", "current_dpd", "reconciled"
    )


@query("check_quarantine_class", f"WITH {Q} SELECT quarantine_class, count(*) AS n FROM q WHERE quarantine_class IS NOT NULL GROUP BY 1")
def _(t):
    _, bad = ev.parse_envelopes(wire(t))
    return bad.groupBy("quarantine_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coerce_long",
    """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) WHEN event_id % 4 = 1 THEN CAST(floor(value) AS BIGINT) WHEN event_id % 4 = 2 THEN NULL ELSE trunc(value) END AS DOUBLE) AS coerced FROM events""",
)
def _(t):
    """A number, whole-number text, other text and a fraction in turn."""
    whole = F.floor("value").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"x":'), whole, F.lit("}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"x":"'), whole, F.lit('"}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"x":"'), F.col("value").cast("string"), F.lit('d"}')))
        .otherwise(F.concat(F.lit('{"x":'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("}")))
    )
    return t.base("events").select("event_id", sc.coerce_long(F.try_parse_json(text), "$.x").cast("double").alias("coerced"))


@query(
    "coerce_decimal_time",
    """SELECT doc_id, n_chars % 3 = 0 AS is_blank, CASE WHEN n_chars % 3 <> 0 THEN CAST(n_chars AS DOUBLE) / 4 END AS amount, CASE WHEN n_chars % 3 <> 0 AND n_chars % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(n_chars % 1000 AS INT) END AS at FROM documents""",
)
def _(t):
    d = t.base("documents").select("doc_id", "n_chars")
    empty = F.col("n_chars") % 3 == 0
    amount = F.when(empty, "  ").otherwise((F.col("n_chars") / 4).cast("decimal(20,2)").cast("string"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("n_chars") % 1000).cast("int"))
    text = F.when(empty, "").when(F.col("n_chars") % 5 == 0, "tomorrow").otherwise(feat.iso_instant(at))
    return d.select(
        "doc_id", empty.alias("is_blank"), sc.coerce_decimal(amount).cast("double").alias("amount"), sc.coerce_instant(text).cast("timestamp_ntz").alias("at")
    )


@query("name_uuid", f"SELECT event_id, {uuid_sql('CAST(event_id AS VARCHAR)')} AS id FROM b_dpd_changed")
def _(t):
    return t.dpd_changed.select("event_id", sc.name_uuid(F.col("event_id").cast("string")).alias("id"))


@query(
    "src_feature_values",
    f"WITH {DPD_FEATURES} SELECT feature_value_id, entity_id, state, CASE WHEN usable THEN CAST(current_dpd AS DOUBLE) END AS value_numeric, event_time AS knowledge_time FROM dpdf WHERE event_id % 50 <> 0",
)
def _(t):
    """Feature JSON; every fiftieth record is broken and dropped."""
    f = feat.current_dpd_features(t.dpd_changed)
    src = t.dpd_changed
    at = F.col("event_time")
    ids = src.select(feat.feature_id("current_dpd", F.col("event_id"), at, at).alias("feature_value_id"), (F.col("event_id") % 50 == 0).alias("broken"))
    rows = f.join(ids, "feature_value_id")
    record = F.to_json(F.struct(
        F.col("feature_value_id").alias("featureValueId"), F.col("feature_name").alias("featureName"), F.col("entity_type").alias("entityType"),
        F.col("entity_id").alias("entityId"), F.col("state"), F.col("value_type").alias("valueType"), F.col("value_numeric").cast("bigint").cast("string").alias("valueNumeric"),
        feat.iso_instant(F.col("knowledge_time")).alias("knowledgeTime"), feat.iso_instant(F.col("window_end")).alias("windowEnd"), F.col("quality_state").alias("qualityState"),
    ))
    out = ev.feature_values(rows.select(F.when(F.col("broken"), F.lit("{broken")).otherwise(record).alias("value")))
    return out.select(
        "feature_value_id", "entity_id", "state", F.col("value_numeric").cast("double").alias("value_numeric"), F.col("knowledge_time").cast("timestamp_ntz").alias("knowledge_time")
    )


ROUTES = [("view", "account"), ("click", "repayment"), ("purchase", "account"), ("signup", "market")]


@query("route_events_by_type", """SELECT CASE event_type WHEN 'view' THEN 'account' WHEN 'click' THEN 'repayment' WHEN 'purchase' THEN 'account' WHEN 'signup' THEN 'market' ELSE 'UNROUTED' END AS family, event_type, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    good, lost = ev.route(t.base("events").select("event_id", "event_type"), values(t.spark, ["event_type", "family"], ROUTES))
    return good.unionByName(lost.withColumn("family", F.lit("UNROUTED"))).groupBy("family", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "land_event_envelope",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'FACILITY' AS entity_type, CAST(user_id AS VARCHAR) AS entity_id, ts AS event_time, ts + INTERVAL 2 HOUR AS knowledge_time, 'core' AS source_system, concat('T', event_id % 4 + 1) AS authority_tier, 'LIVE' AS execution_mode, props AS payload FROM events""",
)
def _(t):
    e = t.base("events")
    ts = F.col("ts").cast("timestamp")
    nested = e.select(
        F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("eventType"), F.lit("1").alias("schemaVersion"),
        F.struct(F.lit("FACILITY").alias("type"), F.col("user_id").cast("string").alias("id"), F.lit(1.0).alias("resolutionConfidence")).alias("entity"),
        F.struct(ts.alias("eventTime"), ts.alias("effectiveTime"), (ts + F.expr("INTERVAL 2 HOURS")).alias("knowledgeTime"), ts.alias("ingestedAt")).alias("times"),
        F.struct(F.lit("core").alias("system"), F.col("event_id").cast("string").alias("recordId"), F.concat(F.lit("T"), F.col("event_id") % 4 + 1).alias("authorityTier"), F.array(F.lit("MODEL")).alias("rights")).alias("source"),
        F.struct(F.lit("LIVE").alias("mode"), F.lit(None).cast("string").alias("runId")).alias("execution"), F.col("props").alias("payload"),
    )
    flat = ev.land(nested)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return flat.select("event_id", "event_type", "entity_type", "entity_id", ntz("event_time"), ntz("knowledge_time"), "source_system", "authority_tier", "execution_mode", "payload")


KINDS = f"(VALUES {values_sql(CORPORATE_EVENT_KINDS)}) k(kind_no, kind, family)"


@query(
    "src_external_observations",
    f"""WITH o AS (SELECT e.*, kind, family FROM b_corporate_event e JOIN {KINDS} ON e.kind_no = k.kind_no) SELECT family, kind, count(*) AS observations, count(DISTINCT counterparty_id) AS entities, count(CASE WHEN amount > 50000 THEN 1 END) AS material FROM o GROUP BY ALL
UNION ALL SELECT 'rating', 'RATING_ACTION', count(*), count(DISTINCT issuer_id), 0 FROM b_rating_action UNION ALL SELECT 'market', 'QUOTE', count(*), count(DISTINCT security_id), count(CASE WHEN price > 50000 THEN 1 END) FROM b_market_quote""",
)
def _(t):
    """Observations of every family in one shape: common metadata plus family data."""
    obs = observations(t)
    return obs.groupBy("family", "kind").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("entity_id").alias("entities"), F.count(F.when(F.col("amount") > 50000, 1)).alias("material")
    )


def observations(t):
    kinds = values(t.spark, ["kind_no", "kind", "family"], CORPORATE_EVENT_KINDS)
    corporate = t.corporate_event.join(kinds, "kind_no").select(
        F.col("event_id").alias("observation_id"), "family", "kind", F.col("counterparty_id").alias("entity_id"), F.col("event_time").alias("effective_at"), "amount"
    )
    rating = t.rating_action.select(
        F.col("action_id").cast("string").alias("observation_id"), F.lit("rating").alias("family"), F.lit("RATING_ACTION").alias("kind"), F.col("issuer_id").alias("entity_id"),
        F.col("action_time").alias("effective_at"), F.struct("agency", "rating", "outlook").alias("rating_data"),
    )
    market = t.market_quote.select(
        F.col("quote_id").alias("observation_id"), F.lit("market").alias("family"), F.lit("QUOTE").alias("kind"), F.col("security_id").alias("entity_id"),
        F.col("quote_time").alias("effective_at"), F.col("price").alias("amount"),
    )
    return corporate.unionByName(rating, allowMissingColumns=True).unionByName(market, allowMissingColumns=True)


@query(
    "union_security_interest_sources",
    """SELECT CASE WHEN party_no < 3 THEN 'US_UCC_FILING' WHEN party_no < 6 THEN 'GB_COMPANY_CHARGE' ELSE 'OTHER_REGISTRY' END AS legal_subtype, count(*) AS n FROM b_corporate_event WHERE kind_no = 9 GROUP BY 1""",
)
def _(t):
    charges = t.corporate_event.filter("kind_no = 9")
    part = lambda cond, name: charges.filter(cond).select("event_id", "counterparty_id", "event_time", F.lit(name).alias("legal_subtype"))
    ucc = part("party_no < 3", "US_UCC_FILING").withColumn("secured_party", F.lit("filed"))
    out = ucc.unionByName(part("party_no >= 3 AND party_no < 6", "GB_COMPANY_CHARGE"), allowMissingColumns=True).unionByName(part("party_no >= 6", "OTHER_REGISTRY"), allowMissingColumns=True)
    return out.groupBy("legal_subtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_feature_upsert",
    """WITH r AS (SELECT event_id, revision, value_numeric FROM b_feature_history) SELECT event_id, arg_max(value_numeric, revision) AS value_numeric, max(revision) AS revision FROM r GROUP BY event_id""",
)
def _(t):
    """First revisions, then corrections, written as batches; the correction batch is delivered twice."""
    path = new_path(t.spark, "features")
    h = t.feature_history.select("event_id", "revision", "value_numeric")
    sinks.write_batch(h.filter("revision = 1"), path, 1)
    for _again in range(2):
        sinks.write_batch(h.filter("revision = 2"), path, 2)
    return sinks.latest_per_key(sinks.read_batches(t.spark, path).drop("batch_id"), ["event_id"], ["revision"])


@query(
    "sink_signal_insert_if_absent",
    f"""WITH {DPD_SIGNALS} SELECT signal_id, CASE WHEN signal_type = 'DPD_EMERGED' THEN 'ACCEPTED' ELSE 'PROPOSED' END AS status FROM dpds""",
)
def _(t):
    """Emerged signals were accepted before; all signals are delivered again, twice. Accepted ones stay."""
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed)).select("signal_id", "signal_type", "status", "effective_at")
    path = new_path(t.spark, "signals")
    sinks.write_batch(s.filter("signal_type = 'DPD_EMERGED'").withColumn("status", F.lit("ACCEPTED")), path, 1)
    existing = sinks.read_batches(t.spark, path).drop("batch_id")
    fresh = sinks.insert_if_absent(existing, s.unionByName(s), "signal_id", ["effective_at"])
    return existing.unionByName(fresh).select("signal_id", "status")


OUTBOX = """SELECT event_id, event_type, ts AS created_at, CASE WHEN value < 60 THEN 'PUBLISHED' WHEN value < 120 THEN 'NEW' ELSE 'FAILED' END AS status, CAST(floor(value) AS INT) % 5 AS attempts FROM events"""


@query("outbox_backlog_metrics", f"SELECT status, event_type, count(*) AS rows_waiting, min(created_at) AS oldest, max(attempts) AS max_attempts FROM ({OUTBOX}) WHERE status <> 'PUBLISHED' GROUP BY ALL")
def _(t):
    return t.sql(OUTBOX).filter("status <> 'PUBLISHED'").groupBy("status", "event_type").agg(
        F.count(F.lit(1)).alias("rows_waiting"), F.min("created_at").alias("oldest"), F.max("attempts").alias("max_attempts")
    )


@query("top_oldest_pending", f"SELECT event_id, created_at FROM ({OUTBOX}) WHERE status = 'NEW' ORDER BY created_at, event_id LIMIT 50")
def _(t):
    return t.sql(OUTBOX).filter("status = 'NEW'").orderBy("created_at", "event_id").limit(50).select("event_id", "created_at")


RIGHTS = [(f"src{i}", "MODEL,DISPLAY" if i % 3 == 0 else ("DISPLAY" if i % 3 == 1 else "MODEL")) for i in range(20)]


@query("source_rights_gate", f"SELECT source_system, contains(coalesce(r.rights, ''), 'MODEL') AS permitted, count(*) AS n FROM b_evidence LEFT JOIN (VALUES {values_sql(RIGHTS)}) r(s, rights) ON source_system = s GROUP BY ALL")
def _(t):
    reg = values(t.spark, ["source_system", "allowed"], RIGHTS).select("source_system", F.split("allowed", ",").alias("rights"))
    return ev.rights_gate(t.evidence.select("evidence_id", "source_system"), reg, "MODEL").groupBy("source_system", "permitted").agg(F.count(F.lit(1)).alias("n"))


@query("retention_expiry", """WITH e AS (SELECT event_type, CASE event_type WHEN 'view' THEN 'R1' WHEN 'click' THEN 'R1' WHEN 'purchase' THEN 'R2' ELSE 'R3' END AS retention_class, ts FROM events)
SELECT retention_class, event_type, count(*) AS n FROM e WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') > CASE retention_class WHEN 'R1' THEN 7 WHEN 'R2' THEN 14 ELSE 30 END GROUP BY ALL""")
def _(t):
    cls = F.when(F.col("event_type").isin("view", "click"), "R1").when(F.col("event_type") == "purchase", "R2").otherwise("R3")
    rows = t.base("events").select("event_type", cls.alias("retention_class"), "ts")
    old = ev.expired(rows, values(t.spark, ["retention_class", "days_kept"], RETENTION), "ts", F.lit("2024-02-01").cast("date"))
    return old.groupBy("retention_class", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("source_checkpoint_lag", "SELECT event_type AS source, max(ts) AS last_seen, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 1000000) AS BIGINT) AS lag_seconds FROM events GROUP BY 1")
def _(t):
    last = t.base("events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_seen"))
    now = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return last.withColumn("lag_seconds", F.floor((now - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1000000))


@query("project_signal", f"WITH {DPD_SIGNALS} SELECT signal_id, signal_type, entity_id, severity, feature_value_id AS evidence, 'PROPOSED' AS status FROM dpds")
def _(t):
    s = sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))
    return s.select("signal_id", "signal_type", "entity_id", "severity", F.array_join("evidence_ids", ",").alias("evidence"), "status")


@query("check_evidence_present", "SELECT count(CASE WHEN value >= 5 THEN 1 END) AS accepted, count(CASE WHEN value < 5 THEN 1 END) AS rejected FROM events")
def _(t):
    rows = t.base("events").select("event_id", F.when(F.col("value") >= 5, F.array(F.col("event_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    ok, bad = sig.with_evidence(rows)
    flag = lambda d, c: d.select(F.lit(c).alias("c"))
    return flag(ok, 1).unionByName(flag(bad, 0)).agg(F.count(F.when(F.col("c") == 1, 1)).alias("accepted"), F.count(F.when(F.col("c") == 0, 1)).alias("rejected"))


@query("quality_gate", f"WITH {DPD_FEATURES} SELECT CASE WHEN NOT usable THEN 'FAIL' WHEN current_dpd > 90 THEN 'DEGRADED' ELSE 'PASS' END AS gate, count(*) AS n FROM dpdf GROUP BY 1")
def _(t):
    usable = sc.usable_dpd(F.col("current_dpd"), F.col("reconciled"))
    state = F.when(~usable, "INSUFFICIENT").when(F.col("current_dpd") > 90, "PARTIAL").otherwise("COMPLETE")
    return ev.quality_gate(t.dpd_changed.withColumn("quality_state", state), ["INSUFFICIENT", "STALE"], ["PARTIAL", "UNVERIFIED"]).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


NAMES = "CASE l_partkey % 6 WHEN 0 THEN 'BG_INVOCATION' WHEN 1 THEN 'PROMOTER_PLEDGE_INCREASE' WHEN 2 THEN 'PROMOTER_NEW_CONDITION' WHEN 3 THEN 'UK_SICR' WHEN 4 THEN 'BANKRUPTCY_FILED' ELSE 'UTILIZATION_HIGH' END AS signal_type"


@query("normalize_aliases", f"""WITH s AS (SELECT {NAMES} FROM lineitem) SELECT signal_type AS original_signal_type, CASE signal_type WHEN 'BG_INVOCATION' THEN 'GUARANTEE_INVOCATION' WHEN 'PROMOTER_PLEDGE_INCREASE' THEN 'CONTROLLING_OWNER_PLEDGE_INCREASE' WHEN 'BANKRUPTCY_FILED' THEN 'FORMAL_INSOLVENCY_PROCEEDING' ELSE signal_type END AS signal_type,
CASE signal_type WHEN 'BG_INVOCATION' THEN 'rename' WHEN 'PROMOTER_PLEDGE_INCREASE' THEN 'map' WHEN 'BANKRUPTCY_FILED' THEN 'normalize' ELSE '' END AS treatment, signal_type = 'PROMOTER_NEW_CONDITION' AS deprecated_prefix, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    rows = t.sql(f"SELECT {NAMES} FROM lineitem")
    return ev.canonical_names(rows, "signal_type", "signal").groupBy("original_signal_type", "signal_type", "treatment", "deprecated_prefix").agg(F.count(F.lit(1)).alias("n"))


@query("audit_prohibited_signal_types", f"WITH s AS (SELECT l_orderkey AS k, {NAMES} FROM lineitem) SELECT k, signal_type, count(*) AS n FROM s WHERE signal_type = 'UK_SICR' GROUP BY ALL")
def _(t):
    rows = t.sql(f"SELECT l_orderkey AS k, {NAMES} FROM lineitem")
    return rows.filter(F.col("signal_type").isin(PROHIBITED_SIGNAL_TYPES)).groupBy("k", "signal_type").agg(F.count(F.lit(1)).alias("n"))


MODES = "SELECT event_id, CASE event_type WHEN 'view' THEN 'BACKFILL' WHEN 'click' THEN 'COUNTERFACTUAL' ELSE 'LIVE' END AS execution_mode, CASE WHEN event_type = 'view' AND value > 10 THEN 'RUN-7' ELSE '' END AS run_id FROM events"


@query("isolate_execution_mode", f"SELECT execution_mode, run_id, execution_mode <> 'LIVE' AND run_id = '' AS rejected, count(*) AS n FROM ({MODES}) GROUP BY ALL")
def _(t):
    ok, bad = ev.execution_isolation(t.sql(MODES))
    rows = ok.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return rows.groupBy("execution_mode", "run_id", "rejected").agg(F.count(F.lit(1)).alias("n"))


TYPED = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'INVALID' ELSE 'VALUE' END AS state, CASE WHEN event_id % 2 = 0 THEN 'INTEGER' ELSE 'DECIMAL' END AS value_type, CASE WHEN event_id % 3 = 0 THEN CAST(value AS DECIMAL(12,2)) END AS value_decimal,
CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS INT) END AS value_integer, CAST(NULL AS BOOLEAN) AS value_boolean, CAST(NULL AS VARCHAR(10)) AS value_string, CAST(NULL AS DATE) AS value_date, CAST(NULL AS TIMESTAMP) AS value_timestamp FROM events"""


@query("check_typed_value", f"""WITH v AS (SELECT state, value_type, (CASE WHEN value_decimal IS NULL THEN 0 ELSE 1 END) + (CASE WHEN value_integer IS NULL THEN 0 ELSE 1 END) AS n, CASE value_type WHEN 'INTEGER' THEN value_integer IS NOT NULL ELSE value_decimal IS NOT NULL END AS named FROM ({TYPED})),
c AS (SELECT CASE WHEN state = 'VALUE' AND n <> 1 THEN 'VALUE_COUNT' WHEN state = 'VALUE' AND NOT named THEN 'WRONG_COLUMN' WHEN state <> 'VALUE' AND n > 0 THEN 'VALUE_WITHOUT_STATE' END AS violation FROM v)
SELECT violation, count(*) AS n FROM c WHERE violation IS NOT NULL GROUP BY 1""")
def _(t):
    rows = t.sql(TYPED)
    return rows.withColumn("violation", ev.typed_value_violations(rows)).filter("violation IS NOT NULL").groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
