"""Wire records to typed rows, with what cannot be read kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import blank, coerce_decimal, coerce_instant, coerce_long
from tideglass.schemas import ENVELOPE, FEATURE_VALUE, PAYMENT_RETURNED
from tideglass.sources.reference import ALIASES, DEPRECATED_PREFIXES, values

PAYMENT_EVENT = "payment.instruction.returned"
DPD_EVENT = "obligation.dpd.changed"


def parse_envelopes(wire: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(readable events, quarantined records with a reason)."""
    parsed = wire.withColumn(
        "_e", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    time = F.try_to_timestamp(F.col("_e.eventTime"))
    reason = (
        F.when(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull(), "SCHEMA_INVALID")
        .when(blank(F.col("_e.eventId")) | blank(F.col("_e.eventType")), "SCHEMA_INVALID")
        .when(time.isNull(), "BUSINESS_VALIDATION_FAILED")
        .when(blank(F.col("_e.entityId")), "ENTITY_RESOLUTION_FAILED")
    )
    parsed = parsed.withColumn("quarantine_class", reason)
    good = parsed.filter("quarantine_class IS NULL").select(
        F.col("_e.eventId").alias("event_id"), F.col("_e.eventType").alias("event_type"), time.alias("event_time"),
        F.col("_e.entityType").alias("entity_type"), F.col("_e.entityId").alias("entity_id"), F.col("_e.data").alias("data"),
    )
    return good, parsed.filter("quarantine_class IS NOT NULL").select(F.col(column).alias("raw"), "quarantine_class")


def payment_returns(events: DataFrame) -> DataFrame:
    d = F.from_json("data", PAYMENT_RETURNED)
    return events.filter(F.col("event_type") == PAYMENT_EVENT).withColumn("_d", d).select(
        "event_id", F.col("entity_id").alias("account_id"), "event_time", F.col("_d.amount").alias("amount"),
        F.col("_d.returnReasonCategory").alias("return_reason_category"), F.col("_d.reversalOfEventId").alias("reversal_of"),
    )


def dpd_changes(events: DataFrame) -> DataFrame:
    """DPD events; day counts may come as numbers or as text."""
    doc = F.try_parse_json("data")
    return events.filter(F.col("event_type") == DPD_EVENT).withColumn("_d", doc).select(
        "event_id", F.col("entity_id").alias("facility_id"), "event_time",
        coerce_long(F.col("_d"), "$.currentDpd").cast("int").alias("current_dpd"),
        coerce_long(F.col("_d"), "$.previousDpd").cast("int").alias("previous_dpd"),
        F.coalesce(F.try_variant_get("_d", "$.reconciled", "boolean"), F.lit(False)).alias("reconciled"),
    )


def feature_values(wire: DataFrame, column: str = "value") -> DataFrame:
    """Feature records; those that cannot be read are dropped."""
    f = F.from_json(column, FEATURE_VALUE)
    return wire.withColumn("_f", f).filter("_f.featureValueId IS NOT NULL").select(
        F.col("_f.featureValueId").alias("feature_value_id"), F.col("_f.featureName").alias("feature_name"),
        F.col("_f.entityType").alias("entity_type"), F.col("_f.entityId").alias("entity_id"), F.col("_f.state").alias("state"),
        F.col("_f.valueType").alias("value_type"), coerce_decimal(F.col("_f.valueNumeric")).alias("value_numeric"),
        coerce_decimal(F.col("_f.priorValueNumeric")).alias("prior_value_numeric"),
        coerce_instant(F.col("_f.knowledgeTime")).alias("knowledge_time"), coerce_instant(F.col("_f.windowEnd")).alias("window_end"),
        F.col("_f.qualityState").alias("quality_state"),
    )


def land(canonical: DataFrame) -> DataFrame:
    """Nested envelope -> flat landing layout."""
    return canonical.select(
        F.col("eventId").alias("event_id"), F.col("eventType").alias("event_type"), F.col("schemaVersion").alias("schema_version"),
        F.col("entity.type").alias("entity_type"), F.col("entity.id").alias("entity_id"),
        F.col("entity.resolutionConfidence").alias("resolution_confidence"),
        F.col("times.eventTime").alias("event_time"), F.col("times.effectiveTime").alias("effective_time"),
        F.col("times.knowledgeTime").alias("knowledge_time"), F.col("times.ingestedAt").alias("ingested_at"),
        F.col("source.system").alias("source_system"), F.col("source.recordId").alias("source_record_id"),
        F.col("source.authorityTier").alias("authority_tier"), F.array_join("source.rights", ",").alias("rights"),
        F.col("execution.mode").alias("execution_mode"), F.col("execution.runId").alias("run_id"), "payload",
    )


def route(events: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their family, events of types without a route)."""
    joined = events.join(routes, "event_type", "left")
    return joined.filter("family IS NOT NULL"), joined.filter("family IS NULL")


def canonical_names(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """Replace deprecated names, keeping the old one; flag deprecated prefixes without a mapping."""
    old = values(rows.sparkSession, [column, "canonical_name", "treatment"], [(d, c, t) for d, c, k, t in ALIASES if k == kind])
    out = rows.join(old, column, "left")
    prefixed = F.lit(False)
    for prefix in DEPRECATED_PREFIXES:
        prefixed = prefixed | F.col(column).startswith(prefix)
    return out.select(
        *[c for c in rows.columns if c != column], F.col(column).alias(f"original_{column}"),
        F.coalesce("canonical_name", column).alias(column), F.coalesce("treatment", F.lit("")).alias("treatment"),
        (F.col("canonical_name").isNull() & prefixed).alias("deprecated_prefix"),
    )


def typed_value_violations(rows: DataFrame) -> Column:
    """Exactly the column named by value_type is set, and only where the state has a value."""
    kinds = ["decimal", "integer", "boolean", "string", "date", "timestamp"]
    filled = sum([F.col(f"value_{k}").isNotNull().cast("int") for k in kinds[1:]], F.col("value_decimal").isNotNull().cast("int"))
    named = F.lit(None).cast("boolean")
    for k in kinds:
        named = F.when(F.lower("value_type") == k, F.col(f"value_{k}").isNotNull()).otherwise(named)
    valued = F.col("state").isin("VALUE", "ZERO")
    return (
        F.when(valued & (filled != 1), "VALUE_COUNT").when(valued & ~F.coalesce(named, F.lit(False)), "WRONG_COLUMN")
        .when(~valued & (filled > 0), "VALUE_WITHOUT_STATE")
    )


def execution_isolation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of LIVE or of a named run, non-LIVE rows without a run)."""
    bad = (F.col("execution_mode") != "LIVE") & blank(F.col("run_id"))
    return rows.filter(~bad), rows.filter(bad)


def quality_gate(rows: DataFrame, fail: list[str], degrade: list[str], state: str = "quality_state") -> DataFrame:
    return rows.withColumn(
        "gate", F.when(F.col(state).isin(*fail), "FAIL").when(F.col(state).isin(*degrade), "DEGRADED").otherwise("PASS")
    )


def rights_gate(rows: DataFrame, registry: DataFrame, use: str) -> DataFrame:
    """Adds whether the source permits the use; unknown sources permit nothing."""
    return rows.join(registry, "source_system", "left").withColumn("permitted", F.coalesce(F.array_contains("rights", use), F.lit(False)))


def expired(rows: DataFrame, retention: DataFrame, ts: str, now: Column) -> DataFrame:
    """Rows older than the retention of their class."""
    return rows.join(retention, "retention_class").filter(F.datediff(now, ts) > F.col("days_kept"))
