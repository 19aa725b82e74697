"""Governance rules as set-based audits. Every audit returns rule_id, code, object_id, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import BANDS, blank, duration_seconds
from tideglass.operators.correlation import independent_counts
from tideglass.operators.ordered import running, with_previous
from tideglass.sources.reference import FEATURE_REGISTRY, HYPOTHESIS_REGISTRY, RISK_DIMENSIONS, SIGNAL_REGISTRY, values

FINDING = ["rule_id", "code", "object_id", "detail"]
Check = tuple[str, str, Column, Column]
TOLERANCE = 0.000001


def findings(df: DataFrame, object_id: str, checks: list[Check]) -> DataFrame:
    """All checks of a table in one pass: one output row per (row, violated check)."""
    hits = F.array(
        *[
            F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(code).alias("code"), detail.cast("string").alias("detail")))
            for rule, code, cond, detail in checks
        ]
    )
    rows = df.select(F.col(object_id).cast("string").alias("object_id"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("h.rule_id", "h.code", "object_id", F.coalesce("h.detail", F.lit("")).alias("detail"))


def repeated(df: DataFrame, object_id: str, keys: list[str], rule: str, code: str) -> DataFrame:
    """One finding per key that occurs more than once inside an object."""
    detail = F.concat_ws("|", *keys)
    return df.groupBy(object_id, *keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.lit(rule).alias("rule_id"), F.lit(code).alias("code"), F.col(object_id).cast("string").alias("object_id"), detail.alias("detail")
    )


def _members(column: str, names: list[str]) -> Column:
    return F.col(column).isin(names)


def policy_references(rules: DataFrame, parameters: list[str]) -> DataFrame:
    """PSV-001 parameter, 002 feature, 003 signal, 004 dimension, 020 signal not active."""
    known = [s for s, _ in SIGNAL_REGISTRY]
    active = [s for s, status in SIGNAL_REGISTRY if status == "ACTIVE"]
    return findings(rules, "version_no", [
        ("PSV-001", "UNKNOWN_PARAMETER", ~_members("parameter_name", parameters), F.col("parameter_name")),
        ("PSV-002", "UNKNOWN_FEATURE", ~_members("feature_name", [f for f, _, _ in FEATURE_REGISTRY]), F.col("feature_name")),
        ("PSV-003", "UNKNOWN_SIGNAL", ~_members("signal_code", known), F.col("signal_code")),
        ("PSV-004", "UNKNOWN_RISK_DIMENSION", ~_members("risk_dimension", RISK_DIMENSIONS), F.col("risk_dimension")),
        ("PSV-020", "NON_ACTIVE_SIGNAL", _members("signal_code", known) & ~_members("signal_code", active), F.col("signal_code")),
    ])


def policy_parameters(params: DataFrame) -> DataFrame:
    """PSV-005 type, minimum, maximum, allowed values. Rows have value_text, type, minimum, maximum, allowed (array)."""
    v = F.col("value_text")
    number = v.try_cast("decimal(38,12)")
    whole = v.rlike(r"^[+-]?\d+$")
    wrong_type = (
        F.when(F.col("type") == "INTEGER", ~whole).when(F.col("type") == "DECIMAL", number.isNull())
        .when(F.col("type") == "BOOLEAN", ~v.isin("true", "false")).when(F.col("type").isin("STRING", "DATE", "DURATION"), F.lit(False)).otherwise(True)
    )
    return findings(params, "version_no", [
        ("PSV-005", "PARAMETER_TYPE_MISMATCH", wrong_type, F.col("name")),
        ("PSV-005", "PARAMETER_BELOW_MINIMUM", number < F.col("minimum"), F.col("name")),
        ("PSV-005", "PARAMETER_ABOVE_MAXIMUM", number > F.col("maximum"), F.col("name")),
        ("PSV-005", "PARAMETER_VALUE_NOT_ALLOWED", (F.size("allowed") > 0) & ~F.array_contains("allowed", v), F.col("name")),
    ])


def policy_relations(policies: DataFrame, parameters: DataFrame, constraints: DataFrame) -> DataFrame:
    """PSV-006: left op right between parameters of one version, or a parameter it names is missing."""
    one = parameters.groupBy("version_no", "name").agg(F.min("value").alias("value"))
    left = one.withColumnsRenamed({"name": "left_parameter", "value": "_l"})
    right = one.withColumnsRenamed({"name": "right_parameter", "value": "_r"})
    rows = (
        policies.select("version_no", "constraint_set").join(constraints, "constraint_set")
        .join(left, ["version_no", "left_parameter"], "left").join(right, ["version_no", "right_parameter"], "left")
    )
    left_v, right_v, op = F.col("_l"), F.col("_r"), F.col("operator")
    holds = (
        F.when(op == "LT", left_v < right_v).when(op == "LTE", left_v <= right_v).when(op == "GT", left_v > right_v)
        .when(op == "GTE", left_v >= right_v).when(op == "EQ", left_v == right_v).when(op == "NE", left_v != right_v).otherwise(False)
    )
    absent = left_v.isNull() | right_v.isNull()
    return findings(rows, "version_no", [
        ("PSV-006", "CONSTRAINT_PARAMETER_MISSING", absent, F.col("constraint_id")),
        ("PSV-006", "PARAMETER_RELATION_VIOLATION", ~absent & ~holds, F.col("constraint_id")),
    ])


def policy_priorities(rules: DataFrame) -> DataFrame:
    """PSV-007 / 008 tie among enabled rules, PSV-019 duplicate rule id."""
    tied = rules.filter("enabled AND mode IN ('PRIORITY', 'FIRST_MATCH')").groupBy("version_no", "mode", "priority").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ties = tied.select(
        F.when(F.col("mode") == "PRIORITY", "PSV-007").otherwise("PSV-008").alias("rule_id"), F.lit("DUPLICATE_PRIORITY").alias("code"),
        F.col("version_no").cast("string").alias("object_id"), F.col("priority").cast("string").alias("detail"),
    )
    return ties.unionByName(repeated(rules, "version_no", ["rule_id"], "PSV-019", "DUPLICATE_RULE_ID"))


def policy_period(versions: DataFrame) -> DataFrame:
    """PSV-009: texts that are not instants, or an end not after the start."""
    start, end = F.try_to_timestamp("from_text"), F.try_to_timestamp("to_text")
    given = F.col("to_text").isNotNull()
    return findings(versions, "version_no", [
        ("PSV-009", "INVALID_EFFECTIVE_FROM", start.isNull(), F.col("from_text")),
        ("PSV-009", "INVALID_EFFECTIVE_TO", start.isNotNull() & given & end.isNull(), F.col("to_text")),
        ("PSV-009", "INVALID_EFFECTIVE_PERIOD", start.isNotNull() & given & (end <= start), F.col("to_text")),
    ])


def policy_overlap(overlaps: DataFrame, rule: str = "PSV-010") -> DataFrame:
    return overlaps.select(
        F.lit(rule).alias("rule_id"), F.lit("EFFECTIVE_VERSION_OVERLAP").alias("code"), F.col("version_no").cast("string").alias("object_id"),
        F.col("overlaps_version").cast("string").alias("detail"),
    )


def policy_activation(versions: DataFrame) -> DataFrame:
    """PSV-011 for ACTIVE; CPV/RAP style separation and simulation evidence for APPROVED and ACTIVE."""
    active = F.col("lifecycle") == "ACTIVE"
    governed = F.col("lifecycle").isin("APPROVED", "ACTIVE")
    maker, checker = F.col("created_by"), F.col("approved_by")
    same = ~blank(maker) & ~blank(checker) & (maker == checker)
    no_sim = blank(F.col("simulation_run_id"))
    return findings(versions, "version_no", [
        ("PSV-011", "MISSING_APPROVAL", active & blank(checker), F.lit("")),
        ("PSV-011", "MISSING_SIMULATION", active & no_sim, F.lit("")),
        ("PSV-011", "MAKER_CHECKER_SAME_ACTOR", active & same, checker),
        ("CPV-008", "MAKER_CHECKER_SEPARATION_REQUIRED", governed & (blank(maker) | blank(checker) | same), F.lit("")),
        ("CPV-009", "SIMULATION_EVIDENCE_REQUIRED", governed & no_sim, F.lit("")),
    ])


def policy_engine(versions: DataFrame) -> DataFrame:
    """PSV-012: external engines need an artefact, the native one must not have any."""
    external = F.col("engine").isin("DMN", "DROOLS")
    return findings(versions, "version_no", [
        ("PSV-012", "MISSING_ENGINE_ARTIFACT", external & blank(F.col("artifact_ref")), F.col("engine")),
        ("PSV-012", "UNDECLARED_NATIVE_ARTIFACT", (F.col("engine") == "NATIVE") & ~blank(F.col("artifact_ref")), F.col("artifact_ref")),
    ])


def policy_boundary(versions: DataFrame) -> DataFrame:
    """PSV-013: a classification outcome needs a jurisdiction extension with jurisdictions."""
    crossing = (F.col("outcome_type") == "CLASSIFICATION_CANDIDATE") & (
        (F.col("semantic_scope") != "JURISDICTION_EXTENSION") | (F.size("scope") == 0)
    )
    return findings(versions, "version_no", [("PSV-013", "CLASSIFICATION_BOUNDARY_VIOLATION", crossing, F.col("semantic_scope"))])


def policy_scope(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """PSV-014 scope the feature asks for, PSV-015 grain the policy does not target."""
    reg = values(rules.sparkSession, ["feature_name", "feature_scope", "grain"], FEATURE_REGISTRY)
    rows = rules.join(reg, "feature_name").join(versions.select("version_no", "scope", "products"), "version_no")
    return findings(rows, "version_no", [
        ("PSV-014", "JURISDICTION_SCOPE_REQUIRED", (F.col("feature_scope") == "JURISDICTION_EXTENSION") & (F.size("scope") == 0), F.col("feature_name")),
        ("PSV-014", "PRODUCT_SCOPE_UNSPECIFIED", (F.col("feature_scope") == "GLOBAL_PRODUCT_SPECIFIC") & (F.size("products") == 0), F.col("feature_name")),
        ("PSV-015", "ENTITY_GRAIN_MISMATCH", F.col("policy_grain") != F.col("grain"), F.col("feature_name")),
    ]).distinct()


def episode(episodes: DataFrame, members: DataFrame, expected_key: Column) -> DataFrame:
    """ECV-001 foreign member type, 002 duplicate member, 003 key, 009 run id."""
    typed = members.join(episodes.select("episode_id", F.col("signal_type").alias("_type")), "episode_id")
    return (
        findings(typed, "episode_id", [("ECV-001", "EPISODE_SIGNAL_TYPE_MISMATCH", F.col("signal_type") != F.col("_type"), F.col("signal_id"))])
        .unionByName(repeated(members, "episode_id", ["signal_id"], "ECV-002", "DUPLICATE_EPISODE_MEMBER"))
        .unionByName(findings(episodes, "episode_id", [
            ("ECV-003", "EPISODE_KEY_MISMATCH", F.col("episode_key") != expected_key, F.col("episode_key")),
            ("ECV-009", "NON_LIVE_RUN_ID_REQUIRED", (F.col("execution_mode") != "LIVE") & blank(F.col("run_id")), F.col("execution_mode")),
        ]))
    )


def hypothesis(declared: DataFrame, contributors: DataFrame) -> DataFrame:
    """ECV-004 duplicate, 005 missing lineage, 006 raw count, 007 independence count, 008 minimum of two."""
    support = contributors.filter("role = 'SUPPORTING'")
    counts = independent_counts(support, ["hypothesis_id"])
    both = declared.join(counts, "hypothesis_id", "left").fillna(0, ["raw_supporting", "independent_supporting"])
    raw, ind = F.col("raw_supporting"), F.col("independent_supporting")
    return (
        repeated(contributors, "hypothesis_id", ["contributor_type", "contributor_id"], "ECV-004", "DUPLICATE_CORRELATION_CONTRIBUTOR")
        .unionByName(findings(support, "hypothesis_id", [("ECV-005", "MISSING_SUPPORTING_LINEAGE", F.col("lineage_group").isNull(), F.col("contributor_id"))]))
        .unionByName(findings(both, "hypothesis_id", [
            ("ECV-006", "RAW_SUPPORTING_COUNT_MISMATCH", F.col("declared_raw") != raw, raw),
            ("ECV-007", "INDEPENDENCE_COUNT_MISMATCH", (F.col("declared_collapsed") != ind) | (F.col("declared_independent") != ind), ind),
            ("ECV-008", "INSUFFICIENT_INDEPENDENT_CONTRIBUTORS", (F.col("hypothesis_type") == "EMERGING_LIQUIDITY_STRESS") & (ind < 2), ind),
        ]))
    )


def correlation_policy(policies: DataFrame, contributors: DataFrame) -> DataFrame:
    """CPV-001 hypothesis, 002 key, 003 duplicate, 004 signal, 005 bounds, 006 unsatisfiable, 007 window."""
    known = [h for h, _ in HYPOTHESIS_REGISTRY]
    active = [h for h, s in HYPOTHESIS_REGISTRY if s == "ACTIVE"]
    signals = [s for s, _ in SIGNAL_REGISTRY]
    families = contributors.filter("role = 'SUPPORTING'").groupBy("policy_id").agg(F.count_distinct("family").alias("_families"))
    rows = policies.join(families, "policy_id", "left").fillna(0, ["_families"])
    span, low, high = (duration_seconds(F.col(c)) for c in ("window_duration", "window_minimum", "window_maximum"))
    bad = span.isNull() | low.isNull() | high.isNull()
    n, lo, hi = F.col("minimum_families"), F.col("families_lower"), F.col("families_upper")
    return (
        findings(rows, "policy_id", [
            ("CPV-001", "UNKNOWN_HYPOTHESIS_TYPE", ~_members("hypothesis_type", known), F.col("hypothesis_type")),
            ("CPV-001", "INACTIVE_HYPOTHESIS_TYPE", _members("hypothesis_type", known) & ~_members("hypothesis_type", active), F.col("hypothesis_type")),
            ("CPV-002", "POLICY_HYPOTHESIS_MISMATCH", F.col("policy_key") != F.col("hypothesis_type"), F.col("policy_key")),
            ("CPV-005", "CONTRIBUTOR_THRESHOLD_OUT_OF_BOUNDS", (n < lo) | (n > hi) | (lo > hi), n),
            ("CPV-006", "UNSATISFIABLE_CONTRIBUTOR_THRESHOLD", n > F.col("_families"), n),
            ("CPV-007", "INVALID_CORRELATION_WINDOW", bad, F.col("window_duration")),
            ("CPV-007", "CORRELATION_WINDOW_OUT_OF_BOUNDS", ~bad & ((low > high) | (span < low) | (span > high)), F.col("window_duration")),
        ])
        .unionByName(repeated(contributors, "policy_id", ["analytical_type"], "CPV-003", "DUPLICATE_CONTRIBUTOR_TYPE"))
        .unionByName(findings(contributors, "policy_id", [("CPV-004", "UNKNOWN_CONTRIBUTOR_SIGNAL", ~_members("analytical_type", signals), F.col("analytical_type"))]))
    )


def aggregation_policy(policies: DataFrame, bands: DataFrame, dimensions: DataFrame, weights: DataFrame, substitutions: DataFrame) -> DataFrame:
    """RAP-001 scale, 002 bands, 003 severity order, 004/005/006 dimensions, 007-009 weights, 010/011 substitution."""
    scale = policies.select("policy_id", "scale_minimum", "scale_maximum")
    lo, hi = F.col("scale_minimum"), F.col("scale_maximum")
    stepped = with_previous(bands, ["policy_id"], "minimum", ["band"], {"_before": "minimum"})
    named = running(stepped, ["policy_id", "band"], "minimum", [], {"_times": ("count", F.lit(1))})
    ranked = named.join(scale, "policy_id").withColumn("_again", F.col("_times") > 1)
    names = bands.groupBy("policy_id").agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.when(F.col("band") == b, F.col("minimum"))).alias(f"_m{i}") for i, b in enumerate(BANDS)])
    shaped = names.join(scale, "policy_id")
    complete = (
        (F.col("_n") == 4) & (F.col("_m0") < F.col("_m1")) & (F.col("_m1") < F.col("_m2")) & (F.col("_m2") < F.col("_m3"))
        & (F.abs(F.col("_m0") - lo) <= TOLERANCE)
    )
    p = {s: F.col(f"points_{s.lower()}") for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")}
    ordered = (
        (F.col("guard_minimum") <= p["INFO"]) & (p["INFO"] <= p["LOW"]) & (p["LOW"] < p["MEDIUM"]) & (p["MEDIUM"] < p["HIGH"])
        & (p["HIGH"] < p["CRITICAL"]) & (p["CRITICAL"] <= F.col("guard_maximum"))
    )
    sums = weights.groupBy("policy_id").agg(F.sum("weight").cast("double").alias("_sum"), F.count(F.lit(1)).alias("_w"))
    weighted = policies.join(sums, "policy_id", "left").fillna(0, ["_sum", "_w"])
    uses = F.col("method") == "WEIGHTED_DIMENSIONS"
    active = [h for h, s in HYPOTHESIS_REGISTRY if s == "ACTIVE"]
    parts = [
        findings(weighted, "policy_id", [
            ("RAP-001", "INVALID_SCORE_SCALE", lo >= hi, F.lit("")),
            ("RAP-003", "INVALID_SEVERITY_CONTRIBUTIONS", ~ordered, F.lit("")),
            ("RAP-008", "DIMENSION_WEIGHTS_NOT_NORMALIZED", uses & ((F.col("_w") == 0) | (F.abs(F.col("_sum") - 1.0) > TOLERANCE)), F.lit("")),
            ("RAP-009", "UNUSED_DIMENSION_WEIGHTS", ~uses & (F.col("_w") > 0), F.lit("")),
        ]),
        findings(ranked, "policy_id", [
            ("RAP-002", "INVALID_SCORE_BAND", F.col("_again") | (F.col("minimum") < lo) | (F.col("minimum") > hi) | F.coalesce(F.col("minimum") <= F.col("_before"), F.lit(False)), F.col("band")),
        ]),
        findings(shaped, "policy_id", [("RAP-002", "INCOMPLETE_SCORE_BANDS", ~F.coalesce(complete, F.lit(False)), F.lit(""))]),
        repeated(dimensions, "policy_id", ["risk_dimension"], "RAP-004", "DUPLICATE_DIMENSION_POLICY"),
        findings(dimensions.join(scale, "policy_id"), "policy_id", [
            ("RAP-005", "UNKNOWN_RISK_DIMENSION", ~_members("risk_dimension", RISK_DIMENSIONS), F.col("risk_dimension")),
            ("RAP-006", "DIMENSION_CAP_OUT_OF_SCALE", (F.col("cap") < lo) | (F.col("cap") > hi), F.col("risk_dimension")),
        ]),
        findings(weights.join(policies.select("policy_id", "method"), "policy_id"), "policy_id", [
            ("RAP-007", "UNKNOWN_WEIGHT_DIMENSION", uses & ~_members("risk_dimension", RISK_DIMENSIONS), F.col("risk_dimension")),
        ]),
        findings(substitutions.join(scale, "policy_id"), "policy_id", [
            ("RAP-010", "UNKNOWN_CORRELATION_HYPOTHESIS", ~_members("hypothesis_type", active), F.col("hypothesis_type")),
            ("RAP-011", "CORRELATION_CONTRIBUTION_OUT_OF_SCALE", (F.col("contribution") < lo) | (F.col("contribution") > hi), F.col("hypothesis_type")),
        ]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def transitions(revisions: DataFrame, object_id: str, ts: str, ties: list[str], identity: list[str], allowed: list[tuple[str, str]], prefix: str, reopen: bool) -> DataFrame:
    """Identity kept, revision + 1, permitted status change and, for episodes, the reopen count."""
    carried = {f"_p_{c}": c for c in dict.fromkeys([*identity, "revision", "status", *(["reopen_count"] if reopen else [])])}
    rows = with_previous(revisions, [object_id], ts, ties, carried, days=365).filter(F.col("_p_status").isNotNull())
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    change = F.concat_ws(">", "_p_status", "status")
    moved = F.lit(False)
    for c in identity:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    what = "EPISODE" if reopen else "HYPOTHESIS"
    checks = [
        (f"{prefix}-001", f"{what}_IDENTITY_CHANGED", moved, F.lit("")),
        (f"{prefix}-002", f"{what}_REVISION_NOT_SEQUENTIAL", F.col("revision") != F.col("_p_revision") + 1, F.col("revision")),
        (f"{prefix}-003", f"INVALID_{what}_TRANSITION", ~F.array_contains(pairs, change), change),
    ]
    if reopen:
        expected = F.col("_p_reopen_count") + F.when(change == "RESOLVED>OPEN", 1).otherwise(0)
        checks.append((f"{prefix}-004", "INVALID_REOPEN_COUNT", F.col("reopen_count") != expected, F.col("reopen_count")))
    return findings(rows, object_id, checks)


def assessment(overall: DataFrame, dims: DataFrame, contributors: DataFrame, policy: dict) -> DataFrame:
    """RAV-001 to RAV-015: recompute scores and bands from the parts and compare with what is declared.

    ``policy`` has id, version, hash, method, minimum, maximum, caps, bands (high to low), suppressed
    (dimension -> families), review_band.
    """
    caps = F.create_map(*[F.lit(x) for k, v in policy["caps"].items() for x in (k, float(v))])

    def band(score: Column) -> Column:
        out = F.when(score >= policy["bands"][0][0], policy["bands"][0][1])
        for low, name in policy["bands"][1:]:
            out = out.when(score >= low, name)
        return out

    score, method = F.col("raw_score"), F.col("method")
    per_dim = findings(dims, "assessment_id", [
        ("RAV-004", "UNKNOWN_RISK_DIMENSION", ~_members("risk_dimension", RISK_DIMENSIONS), F.col("risk_dimension")),
        ("RAV-010", "DIMENSION_SCORE_OUT_OF_SCALE", (score < policy["minimum"]) | (score > policy["maximum"]), F.col("risk_dimension")),
        ("RAV-011", "DIMENSION_CAP_VIOLATION", score > F.try_element_at(caps, F.col("risk_dimension")) + TOLERANCE, F.col("risk_dimension")),
        ("RAV-012", "DIMENSION_BAND_MISMATCH", band(score) != F.col("proposed_band"), F.col("risk_dimension")),
    ])
    # Among equal scores the first listed dimension gives the band.
    top = dims.filter("raw_score IS NOT NULL").groupBy("assessment_id").agg(
        F.max("raw_score").alias("_max"), F.max_by("proposed_band", F.struct("raw_score", -F.col("position"))).alias("_band")
    )
    rank = lambda c: F.array_position(F.array(*[F.lit(b) for b in BANDS]), c)
    o = overall.join(top, "assessment_id", "left")
    by_max = method == "MAX_DIMENSION"
    review = F.col("requires_human_review")
    whole = findings(o, "assessment_id", [
        ("RAV-001", "ASSESSMENT_POLICY_MISMATCH", (F.col("policy_id") != policy["id"]) | (F.col("policy_version") != policy["version"]), F.col("policy_id")),
        ("RAV-002", "ASSESSMENT_POLICY_HASH_MISMATCH", F.col("policy_hash") != policy["hash"], F.col("policy_hash")),
        ("RAV-007", "AGGREGATION_METHOD_MISMATCH", method != policy["method"], method),
        ("RAV-008", "OVERALL_SCORE_MISMATCH", by_max & (F.abs(score - F.col("_max")) > TOLERANCE), F.lit("")),
        ("RAV-009", "OVERALL_BAND_MISMATCH", by_max & (F.col("_band") != F.col("proposed_band")), F.col("proposed_band")),
        ("RAV-013", "OVERALL_POLICY_BAND_MISMATCH", band(score) != F.col("proposed_band"), F.col("proposed_band")),
        ("RAV-014", "HUMAN_REVIEW_REQUIRED", (rank(F.col("proposed_band")) >= rank(F.lit(policy["review_band"]))) & ~review, F.lit("")),
        ("RAV-015", "CONTRADICTION_REQUIRES_REVIEW", (F.col("contradictions") > 0) & ~review, F.lit("")),
    ])
    double = contributors.filter("role = 'SCORING'").groupBy("assessment_id", "risk_dimension").agg(
        F.max((F.col("contributor_type") == "CORRELATION_HYPOTHESIS").cast("int")).alias("_corr"),
        F.collect_set(F.when(F.col("family").isin(sorted({f for fs in policy["suppressed"].values() for f in fs})), F.col("family"))).alias("_families"),
    )
    out = per_dim.unionByName(whole).unionByName(repeated(dims, "assessment_id", ["risk_dimension"], "RAV-003", "DUPLICATE_DIMENSION_ASSESSMENT"))
    out = out.unionByName(repeated(contributors, "assessment_id", ["risk_dimension", "contributor_type", "contributor_id"], "RAV-005", "DUPLICATE_DIMENSION_CONTRIBUTOR"))
    for dim, families in policy["suppressed"].items():
        hit = double.filter((F.col("_corr") == 1) & (F.col("risk_dimension") == dim)).withColumn("family", F.explode("_families")).filter(F.col("family").isin(*families))
        out = out.unionByName(findings(hit, "assessment_id", [("RAV-006", "CORRELATION_DOUBLE_COUNT", F.lit(True), F.concat_ws("|", "risk_dimension", "family"))]))
    return out
