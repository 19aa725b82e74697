"""Set-level joins of the risk domain. Broadcasts happen only where Catalyst knows the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideglass.functions.scalars import scope_contains
from tideglass.operators.ordered import running


ANY = "*"


def applicable_policies(facts: DataFrame, policies: DataFrame, entity_type: str, at: str) -> DataFrame:
    """facts x policies whose scope admits the fact and whose period covers it.

    ``facts`` has jurisdiction and segment; ``policies`` has arrays jurisdictions, segments,
    entity_types (empty = any) and effective_from / effective_to. A policy is listed under each pair of its
    scope values, with a wildcard for an empty list, and a fact looks under its own values and the wildcard; so
    the join is by equality, and a policy is met once, as it has either values or the wildcard.
    """
    listed = lambda c: F.explode(F.when(F.size(c) == 0, F.array(F.lit(ANY))).otherwise(F.transform(F.array_distinct(c), lambda v: F.concat(F.lit("="), v))))
    scoped = policies.filter(scope_contains(F.col("entity_types"), F.lit(entity_type))).select(
        "policy_id", "level", "effective_from", "effective_to", "segments", listed("jurisdictions").alias("_j")
    ).select("policy_id", "level", "effective_from", "effective_to", "_j", listed("segments").alias("_s"))
    under = lambda c: F.explode(F.array_compact(F.array(F.lit(ANY), F.concat(F.lit("="), F.col(c)))))
    asked = facts.withColumn("_j", under("jurisdiction")).withColumn("_s", under("segment"))
    p, f = scoped.alias("p"), asked.alias("f")
    covers = (
        (F.col("p._j") == F.col("f._j")) & (F.col("p._s") == F.col("f._s")) & (F.col("p.effective_from") <= F.col(f"f.{at}"))
        & (F.col("p.effective_to").isNull() | (F.col(f"f.{at}") < F.col("p.effective_to")))
    )
    return f.join(p, covers).select(*[F.col(f"f.{c}") for c in facts.columns], "p.policy_id", "p.level")


# Precedence of policy levels, most specific first.
PRECEDENCE = ["SEGMENT", "PRODUCT", "INSTITUTION", "JURISDICTION", "PRODUCT_DEFAULT", "CORE"]


def pick_by_precedence(applicable: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the policy of the most specific level per key, keys where that level holds several)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in PRECEDENCE]), F.col("level"))
    best = applicable.withColumn("_r", rank).groupBy(*keys, "_r").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("policy_id").alias("policy_id"), F.first("level").alias("level")
    )
    top = best.groupBy(*keys).agg(F.min_by(F.struct("candidates", "policy_id", "level"), F.col("_r")).alias("_t")).select(*keys, "_t.*")
    return top.filter("candidates = 1").drop("candidates"), top.filter("candidates > 1")


def version_overlaps(versions: DataFrame, keys: list[str], scope: str, version: str) -> DataFrame:
    """Governed versions that start inside the period of an earlier version with a common scope.

    ``scope`` is an array, empty = every value. Each version is spread over its scope values (an empty
    scope over all values its key knows, plus a wildcard) and the furthest end seen before it is
    carried along the start order, so no pairs are built. Each finding names the earlier version
    that ends last.
    """
    rows = versions.filter(F.col("lifecycle").isin("ACTIVE", "APPROVED"))
    known = rows.select(*keys, F.explode(scope).alias("_v")).distinct().groupBy(*keys).agg(F.collect_set("_v").alias("_known"))
    everything = F.array_union(F.coalesce("_known", F.array().cast("array<string>")), F.array(F.lit("*")))
    spread = rows.join(known, keys, "left").withColumn(
        "_token", F.explode(F.when(F.size(scope) == 0, everything).otherwise(F.col(scope)))
    )
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    # A period that ends before it starts covers nothing.
    real = F.col("effective_to").isNull() | (F.col("effective_to") > F.col("effective_from"))
    end = F.when(real, F.struct(F.coalesce("effective_to", far).alias("end"), F.col(version).alias("by")))
    seen = running(
        spread.withColumn("_end", end), [*keys, "_token"], "effective_from", [version], {"_furthest": ("max", "_end")},
        days=365, include_current=False,
    )
    hit = seen.filter(
        (F.col("_furthest.end") > F.col("effective_from"))
        & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("effective_from")))
    )
    return hit.groupBy(*keys, version).agg(F.max("_furthest").alias("_f")).select(*keys, version, F.col("_f.by").alias("overlaps_version"))


def unknown_references(rows: DataFrame, column: str, registry: DataFrame, name: str) -> DataFrame:
    """Rows whose reference the registry lacks."""
    return rows.join(registry.select(F.col(name).alias(column)), column, "left_anti")


def resolve_entities(rows: DataFrame, decisions: DataFrame, minimum: float) -> DataFrame:
    """Canonical entity for each row: RESOLVED, REVIEW (weak or ambiguous) or UNRESOLVED. One row for each row.

    Decisions are reduced to one per source entity first, the most confident; several canonical ids make it ambiguous.
    """
    others = [c for c in decisions.columns if c != "source_entity_id"]
    order = F.struct("confidence", F.col("resolution_status") == "RESOLVED", "canonical_id")
    one = decisions.groupBy("source_entity_id").agg(F.max_by(F.struct(*others), order).alias("_d"), F.count_distinct("canonical_id").alias("_ids"))
    joined = rows.join(one.select("source_entity_id", "_d.*", "_ids"), "source_entity_id", "left")
    outcome = (
        F.when(F.col("canonical_id").isNull(), "UNRESOLVED")
        .when((F.col("resolution_status") == "RESOLVED") & (F.col("confidence") >= minimum) & (F.col("_ids") == 1), "RESOLVED")
        .otherwise("REVIEW")
    )
    return joined.withColumn("outcome", outcome).drop("_ids")


def match_by_identifiers(identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link every entity to the smallest entity that shares one of its identifiers.

    ``identifiers`` has entity_id, scheme, value, priority. The star shape keeps one link per entity and
    identifier however many entities share it. Returns (links, entities whose schemes disagree).
    """
    hub = identifiers.groupBy("scheme", "value").agg(F.min("entity_id").alias("candidate_id"), F.count_distinct("entity_id").alias("sharing"))
    links = identifiers.join(hub.filter("sharing > 1"), ["scheme", "value"])
    best = links.groupBy("entity_id").agg(
        F.min_by("candidate_id", F.struct("priority", "candidate_id")).alias("matched_id"),
        F.min_by("scheme", F.struct("priority", "candidate_id")).alias("matched_by"),
        F.count_distinct("candidate_id").alias("candidates"),
    )
    return best, best.filter("candidates > 1")


def valid_at(facts: DataFrame, reference: DataFrame, on: list[str], at: str) -> DataFrame:
    """Join with reference rows whose half-open validity covers the fact."""
    f, r = facts.alias("f"), reference.alias("r")
    cond = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in on]
    cond += [F.col("r.valid_from") <= F.col(f"f.{at}"), F.col("r.valid_to").isNull() | (F.col(f"f.{at}") < F.col("r.valid_to"))]
    extra = [f"r.{c}" for c in reference.columns if c not in on]
    return f.join(r, cond).select("f.*", *extra)


def flows_to_related(transfers: DataFrame, edges: DataFrame) -> DataFrame:
    """Transfers whose beneficiary is linked to the payer at that time; as-of, nothing multiplied.

    A transfer is covered if, of the pair's edges that have started by then, the one that lasts longest has not ended. So
    edges and transfers of a pair are stacked and the furthest end seen is carried along; a hot pair is cut like any hot key.
    """
    keys = ["payer_id", "beneficiary_id"]
    stacked = edges.select(
        F.col("owner_id").alias("payer_id"), F.col("owned_id").alias("beneficiary_id"), F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), F.col("valid_to").alias("_until")
    ).unionByName(
        transfers.select(*keys, F.col("event_time").alias("_at"), F.lit(1).alias("_side"), F.struct(*transfers.columns).alias("_flow")), allowMissingColumns=True
    )
    seen = running(stacked, keys, "_at", ["_side"], {"_last": ("max", "_until")})
    return seen.filter((F.col("_side") == 1) & (F.col("_last") > F.col("_at")) & F.col("payer_id").isNotNull() & F.col("beneficiary_id").isNotNull()).select("_flow.*")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Two sources of one figure, both kept, with AGREE, CONFLICTED or the missing side."""
    both = a.select(*keys, F.col(value).alias("value_a")).join(b.select(*keys, F.col(value).alias("value_b")), keys, "full")
    va, vb = F.col("value_a"), F.col("value_b")
    status = (
        F.when(va.isNull(), "MISSING_A").when(vb.isNull(), "MISSING_B")
        .when(F.abs(va - vb) <= tolerance, "AGREE").otherwise("CONFLICTED")
    )
    return both.withColumn("reconciliation", status)


def full_lineage(signals: DataFrame, features: DataFrame, events: DataFrame) -> DataFrame:
    """signal -> feature value -> source event, one row per link."""
    cited = signals.select("signal_id", "signal_type", F.explode("evidence_ids").alias("feature_value_id"))
    return cited.join(features, "feature_value_id").join(events, "event_id")


