"""Known sequences and decision tables with their expected results."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.functions import scalars as sc
from tideglass.operators import assessment as asm, audits as au, correlation as corr, episodes as ep, features as feat, policy as pol, signals as sig
from tideglass.sources import events as ev, sinks

T0 = datetime(2026, 9, 1)


def at(**kw):
    return T0 + timedelta(**kw)


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_returns_count_three_of_five(spark):
    cats = ["FINANCIAL", "FINANCIAL", "TECHNICAL", "BENEFICIARY_DETAIL", "FINANCIAL"]
    rows = [(str(i), "acct-1", at(seconds=s), 1.0, c) for i, (s, c) in enumerate(zip((0, 60, 120, 150, 180), cats))]
    df = spark.createDataFrame(rows, "event_id string, account_id string, event_time timestamp_ntz, amount double, return_reason_category string")
    f = feat.payment_count_features(df.withColumn("amount", F.col("amount").cast("decimal(20,2)")))
    assert f.agg(F.max("value_numeric")).first()[0] == 3
    assert [r.feature_name for r in f.select("feature_name").distinct().collect()] == ["returned_payment_count_30d"]
    signals = sig.repeated_payment_return(f).collect()
    assert len(signals) == 1 and signals[0].status == "PROPOSED" and len(signals[0].evidence_ids) == 1


def dpd(spark, rows):
    return spark.createDataFrame(
        [(str(i), "fac-1", at(days=d), cur, prev, ok) for i, (d, prev, cur, ok) in enumerate(rows)],
        "event_id string, facility_id string, event_time timestamp_ntz, current_dpd int, previous_dpd int, reconciled boolean",
    )


def test_dpd_features_keep_invalid_apart(spark):
    df = dpd(spark, [(0, 0, 10, True), (10, 10, 40, True), (11, 40, 999, False)])
    got = feat.current_dpd_features(df).orderBy("window_end").select("state", F.col("value_numeric").cast("int"), F.col("prior_value_numeric").cast("int"), "quality_state").collect()
    assert [tuple(r) for r in got] == [("VALUE", 10, 0, "COMPLETE"), ("VALUE", 40, 10, "COMPLETE"), ("INVALID", None, 40, "INSUFFICIENT")]
    assert {int(r.value_numeric) for r in feat.max_dpd_features(df).collect()} == {10, 40}
    zero = feat.current_dpd_features(dpd(spark, [(0, None, 0, True)])).first()
    assert (zero.state, int(zero.value_numeric), zero.prior_value_numeric) == ("ZERO", 0, None)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(i, None, v, True) for i, v in enumerate([0, 12, 20, 45, 45, 0, 8])], [("DPD_EMERGED", "LOW"), ("DPD_WORSENING", "MEDIUM"), ("DPD_EMERGED", "LOW")]),
        ([(0, 40, 45, True)], []),
        ([(0, None, 10, True), (1, 10, 500, False), (2, 500, 15, True)], [("DPD_EMERGED", "LOW")]),
    ],
)
def test_dpd_signals(spark, rows, expected):
    got = sig.dpd_signals(feat.current_dpd_features(dpd(spark, rows))).orderBy("effective_at")
    assert one(got, "signal_type", "severity") == expected


def test_classify_boundaries(spark):
    cases = [(0, 12, "DPD_EMERGED"), (12, 20, None), (20, 20, None), (20, 45, "DPD_WORSENING"), (45, 0, None), (0, 8, "DPD_EMERGED"), (40, 45, None), (89, 90, "DPD_WORSENING")]
    df = spark.createDataFrame(cases, "p int, c int, want string").withColumn("got", sc.classify_dpd(F.col("p"), F.col("c")))
    assert df.filter("NOT (want <=> got)").count() == 0


def test_fourteen_policy_cases(spark):
    def run(policy, feature, value, state, parameters):
        df = spark.createDataFrame([(value, state)], f"{feature} double, {feature}_state string")
        r = pol.evaluate(df, replace(policy, parameters={**policy.parameters, **parameters})).first().result
        return r.severity if r.status == "MATCHED" else r.status

    count, cur, ratio = "returned_payment_count_30d", "current_dpd", "utilization_ratio"
    ppr, dp, ut = pol.REPEATED_PAYMENT_RETURN, pol.DPD_DETERIORATION, pol.HIGH_UTILIZATION
    cases = [
        (ppr, count, 2.0, "VALUE", {}, "NOT_MATCHED"), (ppr, count, 3.0, "VALUE", {}, "HIGH"),
        (ppr, count, 3.0, "VALUE", {"PAYMENT_RETURN_COUNT_THRESHOLD": 5}, "NOT_MATCHED"), (ppr, count, None, "NULL_UNKNOWN", {}, "INSUFFICIENT_EVIDENCE"),
        (dp, cur, 0.0, "ZERO", {}, "NOT_MATCHED"), (dp, cur, 15.0, "VALUE", {}, "MEDIUM"), (dp, cur, 30.0, "VALUE", {}, "HIGH"),
        (dp, cur, None, "STALE", {}, "INSUFFICIENT_EVIDENCE"), (dp, cur, 10.0, "VALUE", {"DPD_WARNING_THRESHOLD": 7}, "MEDIUM"),
        (ut, ratio, 0.84, "VALUE", {}, "NOT_MATCHED"), (ut, ratio, 0.85, "VALUE", {}, "MEDIUM"), (ut, ratio, 0.97, "VALUE", {}, "HIGH"),
        (ut, ratio, 0.87, "VALUE", {"UTILIZATION_HIGH_THRESHOLD": 0.90, "CRITICAL_UTILIZATION_THRESHOLD": 0.98}, "NOT_MATCHED"),
        (ut, ratio, None, "NOT_AVAILABLE", {}, "INSUFFICIENT_EVIDENCE"),
    ]
    assert [run(*c[:5]) for c in cases] == [c[5] for c in cases]
    assert run(ut, ratio, None, "NOT_APPLICABLE", {}) == "NOT_MATCHED"


def test_independence_after_collapse(spark):
    rows = [
        ("distinct", "PAYMENT_RETURN", "L1"), ("distinct", "UTILIZATION_PRESSURE", "L2"),
        ("shared", "PAYMENT_RETURN", "L1"), ("shared", "UTILIZATION_PRESSURE", "L1"),
        ("family", "UTILIZATION_PRESSURE", "L1"), ("family", "UTILIZATION_PRESSURE", "L2"),
        ("chain", "A", "L1"), ("chain", "B", "L1"), ("chain", "B", "L2"), ("chain", "C", "L2"), ("chain", "D", "L9"),
        ("none", "A", None), ("none", "B", None),
    ]
    df = spark.createDataFrame(rows, "h string, family string, lineage_group string")
    got = {r.h: r.independent_supporting for r in corr.independent_counts(df, ["h"]).collect()}
    assert got == {"distinct": 2, "shared": 1, "family": 1, "chain": 2, "none": 2}


def test_assessment_substitutes_instead_of_adding(spark):
    when = at()
    cand = spark.createDataFrame(
        [
            (1, when, "UTILIZATION_HIGH", "UTILIZATION_PRESSURE", "HIGH", 0.9, "c1"), (1, when, "REPEATED_PAYMENT_RETURN", "PAYMENT_RETURN", "HIGH", 0.9, "c2"),
            (1, when, "DPD_DERIORATION", "DELINQUENCY", "CRITICAL", 0.4, "c3"),
        ],
        "counterparty_id long, as_of timestamp_ntz, analytical_type string, family string, severity string, confidence double, contributor_id string",
    )
    found = spark.createDataFrame([("EMERGING_LIQUIDITY_STRESS", 1, when)], "hypothesis_type string, counterparty_id long, as_of timestamp_ntz")
    points, excluded = asm.contributions(cand, asm.CORPORATE)
    assert [r.contributor_id for r in excluded.collect()] == ["c3"]
    scored = asm.substitute(points, found, asm.CORPORATE)
    roles = {(r.risk_dimension, r.family): r.role for r in scored.collect()}
    assert roles[("LIQUIDITY", "UTILIZATION_PRESSURE")] == "LINEAGE_ONLY" and roles[("REFINANCING_FUNDING", "UTILIZATION_PRESSURE")] == "SCORING"
    dims = asm.dimension_scores(scored, asm.CORPORATE)
    got = {r.risk_dimension: (r.raw_score, r.proposed_band) for r in dims.collect()}
    assert got == {"LIQUIDITY": (80.0, "CRITICAL"), "REPAYMENT_CONDUCT": (70.0, "HIGH"), "REFINANCING_FUNDING": (70.0, "HIGH")}
    overall = asm.human_review(asm.overall_max(dims), cand.limit(0), asm.CORPORATE).first()
    assert (overall.raw_score, overall.proposed_band, overall.requires_human_review) == (80.0, "CRITICAL", True)
    with pytest.raises(ValueError):
        asm.overall_weighted(dims, {"LIQUIDITY": 0.7, "REPAYMENT_CONDUCT": 0.4}, asm.CORPORATE)


def test_episode_key_and_members(spark):
    key = ep.episode_key(*[F.lit(x) for x in ("LIVE", "EP-POL-HIGH-UTILIZATION", "1", "FACILITY", "FAC-1001", "UTILIZATION_HIGH", "FAC-1001")])
    assert spark.range(1).select(key).first()[0] == "LIVE|EP-POL-HIGH-UTILIZATION|1|FACILITY|FAC-1001|UTILIZATION_HIGH|FAC-1001"
    rows = [(f"s{i}", "UTILIZATION_HIGH", "FACILITY", "F1", "MEDIUM", at(days=d), "P", [f"e{i}"]) for i, d in enumerate((0, 2, 7, 30))]
    df = spark.createDataFrame(rows, "signal_id string, signal_type string, entity_type string, entity_id string, severity string, effective_at timestamp_ntz, policy_id string, evidence_ids array<string>")
    episodes, members = ep.build(df, 7)
    assert sorted(r.occurrences for r in episodes.collect()) == [1, 3]
    assert sorted(one(members, "signal_id", "role")) == [("s0", "PRIMARY"), ("s1", "SUPPORTING"), ("s2", "SUPPORTING"), ("s3", "PRIMARY")]


def test_episode_transitions(spark):
    rows = [("a", 1, "OPEN", 0), ("a", 2, "RESOLVED", 0), ("a", 3, "OPEN", 1), ("b", 1, "RESOLVED", 0), ("b", 2, "MONITORING", 0), ("c", 1, "OPEN", 0), ("c", 3, "OPEN", 1)]
    df = spark.createDataFrame(rows, "object_id string, revision int, status string, reopen_count int").withColumn("at", F.lit(T0) + F.make_dt_interval(F.col("revision"))).withColumn("policy_id", F.lit("P"))
    got = au.transitions(df, "object_id", "at", ["revision"], ["policy_id"], ep.EPISODE_TRANSITIONS, "ETV", True)
    assert sorted(one(got, "rule_id", "object_id")) == [("ETV-002", "c"), ("ETV-003", "b"), ("ETV-004", "c")]


def test_durations(spark):
    assert sc.parse_duration("P30D") == timedelta(days=30) and sc.parse_duration("PT36H") == timedelta(hours=36)
    for bad in ("P1M", "P1Y", "P", "30D", "PT"):
        with pytest.raises(ValueError):
            sc.parse_duration(bad)
    df = spark.createDataFrame([("P30D", 2592000.0), ("PT36H", 129600.0), ("P1M", None), ("P1DT2H3M4S", 93784.0), ("x", None)], "t string, want double")
    assert df.filter(~F.col("want").eqNullSafe(sc.duration_seconds(F.col("t")))).count() == 0


def test_name_uuid_is_version_three(spark):
    import hashlib
    import uuid

    def want(text):
        return str(uuid.UUID(bytes=hashlib.md5(text.encode()).digest(), version=3))

    texts = ["a", "current_dpd|e1|x|y", "", "DPD_EMERGED:1"]
    df = spark.createDataFrame([(x, want(x)) for x in texts], "t string, want string")
    assert df.filter(F.col("want") != sc.name_uuid(F.col("t"))).count() == 0


def test_accepted_signal_survives_redelivery(spark):
    old = spark.createDataFrame([("s1", "ACCEPTED", 1)], "signal_id string, status string, n int")
    new = spark.createDataFrame([("s1", "PROPOSED", 2), ("s2", "PROPOSED", 1), ("s2", "PROPOSED", 2)], "signal_id string, status string, n int")
    fresh = sinks.insert_if_absent(old, new, "signal_id", ["n"])
    assert sorted(one(old.unionByName(fresh), "signal_id", "status", "n")) == [("s1", "ACCEPTED", 1), ("s2", "PROPOSED", 1)]


def test_second_disposition_is_a_conflict(spark):
    signals = spark.createDataFrame([("s1", "PROPOSED"), ("s2", "ACCEPTED")], "signal_id string, status string")
    decisions = spark.createDataFrame([("s1", "ACCEPT", at(), 1), ("s1", "REJECT", at(days=1), 2), ("s2", "REJECT", at(), 3)], "signal_id string, decision string, decided_at timestamp_ntz, decision_no int")
    applied, conflicts = sig.apply_dispositions(signals, decisions)
    assert sorted(one(applied, "signal_id", "status")) == [("s1", "ACCEPTED"), ("s2", "ACCEPTED")]
    assert sorted(one(conflicts, "decision_no", "conflict")) == [(2, "ALREADY_DECIDED"), (3, "NOT_PROPOSED")]


def test_wire_records(spark):
    wire = spark.createDataFrame(
        [
            ('{"eventId":"1","eventType":"obligation.dpd.changed","eventTime":"2026-01-01T00:00:00Z","entityType":"FACILITY","entityId":"f","data":{"currentDpd":"12","previousDpd":3,"reconciled":true}}',),
            ('{"eventId":"2","eventType":"obligation.dpd.changed","eventTime":"2026-01-01T00:00:00Z","entityType":"FACILITY","entityId":"f","data":{"currentDpd":"x"}}',),
            ('{"eventId":"3","eventType":"financial.statement.received","eventTime":"2026-01-01T00:00:00Z","entityId":"f","data":{}}',), ("{oops",),
        ],
        "value string",
    )
    good, bad = ev.parse_envelopes(wire)
    assert sorted(one(ev.dpd_changes(good), "event_id", "current_dpd", "previous_dpd", "reconciled")) == [("1", 12, 3, True), ("2", None, None, False)]
    assert [r.quarantine_class for r in bad.collect()] == ["SCHEMA_INVALID"]


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = [(i, None, (i * 37) % 121, i % 5 != 0) for i in range(200)]
    df = dpd(spark, rows)
    base = sorted(one(sig.dpd_signals(feat.current_dpd_features(df)), "signal_id", "severity"))
    again = sorted(one(sig.dpd_signals(feat.current_dpd_features(df.orderBy(F.desc("event_id")).repartition(7))), "signal_id", "severity"))
    assert base == again and base


def test_whole_numbers_beyond_doubles_are_kept(spark):
    from tideglass.functions.scalars import coerce_long

    rows = [("9007199254740993", 9007199254740993), ("9007199254740993.0", 9007199254740993), ("-1.7", -1), ("1e3", 1000), ("true", None), ("1e30", None), ('"9007199254740993"', 9007199254740993), ('"x"', None)]
    df = spark.createDataFrame(rows, "j string, want long")
    got = df.select("want", coerce_long(F.try_parse_json(F.concat(F.lit('{"x":'), "j", F.lit("}"))), "$.x").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_span_offsets_are_those_of_the_text(spark):
    from tideglass.operators.text import candidate_spans

    texts = [(1, "İİ going concern"), (2, "Going Concern, GOING CONCERN"), (3, "a (b+ [c a (B+ [c"), (3, "a (b+ [c"), (4, None), (5, "")]
    got = candidate_spans(spark.createDataFrame(texts, "evidence_id int, text string"), [("going concern", "G", 0.9), ("a (b+ [c", "P", 0.5)]).collect()
    assert sorted((r.evidence_id, r.span_start, r.span_end) for r in got) == [(1, 3, 16), (2, 0, 13), (2, 15, 28), (3, 0, 8), (3, 0, 8), (3, 9, 17)]


def test_policies_apply_by_scope_and_period(spark):
    from tideglass.operators.joins import applicable_policies

    day = lambda s: f"TIMESTAMP_NTZ '{s} 00:00:00'"
    policies = spark.sql(
        f"""SELECT * FROM VALUES ('any', 'CORE', array(), array(), array(), {day('2020-01-01')}, NULL), ('in', 'JURISDICTION', array('IN', 'IN', 'US'), array(), array('LOAN'), {day('2020-01-01')}, {day('2021-01-01')}),
        ('seg', 'SEGMENT', array('IN'), array('SME', '*'), array(), {day('2020-01-01')}, NULL), ('other', 'CORE', array(), array(), array('CARD'), {day('2020-01-01')}, NULL)
        AS t(policy_id, level, jurisdictions, segments, entity_types, effective_from, effective_to)"""
    )
    facts = spark.sql(f"SELECT * FROM VALUES (1, 'IN', 'SME', {day('2020-06-01')}), (2, 'IN', '*', {day('2021-01-01')}), (3, 'US', NULL, {day('2020-06-01')}), (4, NULL, 'SME', {day('2019-06-01')}) AS t(id, jurisdiction, segment, at)")
    found = applicable_policies(facts, policies, "LOAN", "at")
    assert sorted((r.id, r.policy_id) for r in found.collect()) == [(1, "any"), (1, "in"), (1, "seg"), (2, "any"), (2, "seg"), (3, "any"), (3, "in")]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
