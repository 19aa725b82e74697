"""Look-backs inside rule conditions against a plain loop over the rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.operators import policy as pol, policy_windows as pw

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)
ROWS = [  # key, time, value, state, since
    ("a", T0, 1.0, "VALUE", T0 - 3 * DAY), ("a", T0 + 10 * DAY, 2.0, "VALUE", None), ("a", T0 + 10 * DAY, 3.0, "VALUE", T0),
    ("a", T0 + 20 * DAY, 9.0, "INVALID", T0), ("a", T0 + 20 * DAY + timedelta(microseconds=1), 4.0, "VALUE", T0),
    ("a", T0 + 40 * DAY, 0.0, "ZERO", T0), ("a", T0 + 50 * DAY, 5.0, "VALUE", T0), ("a", T0 + 50 * DAY, 5.0, "VALUE", T0),
    ("b", T0 + 5 * DAY, None, "NOT_AVAILABLE", T0), ("b", None, 7.0, "VALUE", T0), (None, T0, 1.0, "VALUE", T0), (None, T0 + 10 * DAY, 6.0, "VALUE", T0),
]
NOTES = [("a", T0, "x"), ("a", T0, "x"), ("a", T0 + 12 * DAY, "y"), ("a", T0 + 50 * DAY, None), ("b", None, "x"), ("c", T0, "x"), (None, T0 + 1 * DAY, "x")]
HIGH = {"left": {"feature": "v"}, "operator": "GTE", "right": {"parameter": "LEVEL"}}
X = {"left": {"feature": "kind"}, "operator": "EQ", "right": {"literal": "x"}}


def policy(name, condition, level=2):
    return pol.Policy(name, name, "PRIORITY", {"LEVEL": level}, (pol.Rule(f"R-{name}", 1, condition, name, "HIGH"),), missing="RULE_NOT_MATCHED")


POLICIES = [
    policy("ONE", {"all": [
        {"left": {"count": "v", "days": 10, "where": HIGH}, "operator": "GTE", "right": {"literal": 1}}, {"exists": "note", "days": 20, "where": X},
        {"left": {"changed_by": "v", "days": 10}, "operator": "GT", "right": {"literal": 0}},
    ]}),
    policy("TWO", {"any": [
        {"left": {"count": "note", "days": 20}, "operator": "GTE", "right": {"literal": 2}}, {"not": {"exists": "note", "days": 20, "where": X}},
        {"left": {"percentage_change": "v", "days": 20}, "operator": "GTE", "right": {"literal": 0.5}},
        {"left": {"count": "v", "days": 10, "where": HIGH}, "operator": "GTE", "right": {"literal": 2}}, {"left": {"age_days": "since"}, "operator": "GT", "right": {"literal": 45}},
    ]}),
]


def tables(spark, rows=ROWS, notes=NOTES):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, at timestamp_ntz, v double, v_state string, since timestamp_ntz")
    return df, {"note": pw.Source(spark.createDataFrame(notes, "who string, seen timestamp_ntz, kind string"), ("who",), "seen")}


def expected(row):
    _, at, v, state, since = row
    known = [(r[1], r[2]) for r in ROWS if r[0] == row[0] and r[1] is not None and r[3] in ("VALUE", "ZERO")]
    seen = [(n[1], n[2]) for n in NOTES if n[0] == row[0] and n[1] is not None]
    within = lambda t, d: at is not None and at - d * DAY <= t <= at
    usable = v if state in ("VALUE", "ZERO") else None

    def change(days, share):
        old = max([(t, x) for t, x in known if at is not None and t <= at - days * DAY], default=(None, None))[1]
        if old is None or usable is None or (share and old == 0):
            return None
        return (usable - old) / abs(old) if share else usable - old

    return {
        ("count", "v", 10): sum(within(t, 10) and x >= 2 for t, x in known), ("count", "note", 20, True): sum(within(t, 20) and k == "x" for t, k in seen),
        ("count", "note", 20, False): sum(within(t, 20) for t, _ in seen), ("changed_by", "v", 10): change(10, False), ("percentage_change", "v", 20): change(20, True),
        ("age_days", "since", 0): None if at is None or since is None else (at - since).days,
    }


@pytest.mark.parametrize("hot", [None, "2"])
def test_look_backs_equal_a_loop(spark, hot):
    if hot:
        spark.conf.set("spark.tideglass.hotRows", hot)
    try:
        df, sources = tables(spark)
        rows, _, backs = pw.compile_policies(df, ["k"], "at", POLICIES, sources)
        got = {r["id"]: r for r in rows.collect()}
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    assert sorted(got) == list(range(len(ROWS)))
    assert len(backs) == 6  # the count and the exists that both policies name are one each
    for i, row in enumerate(ROWS):
        want = expected(row)
        for b, name in backs.items():
            key = (b.kind, b.of, b.days, bool(b.where)) if b.of == "note" else (b.kind, b.of, b.days)
            assert got[i][name] == want[key], (i, b)
            assert got[i][f"{name}_state"] == ("NOT_AVAILABLE" if want[key] is None else "ZERO" if want[key] == 0 else "VALUE")


def test_policies_over_look_backs(spark):
    df, sources = tables(spark)
    rows, (one, two), _ = pw.compile_policies(df, ["k"], "at", POLICIES, sources)
    verdicts = {r["id"]: (r["a"], r["b"]) for r in pol.evaluate(pol.evaluate(rows, one, into="x"), two, into="y").selectExpr("id", "x.status = 'MATCHED' AS a", "y.status = 'MATCHED' AS b").collect()}
    for i, row in enumerate(ROWS):
        w = expected(row)
        first = w["count", "v", 10] >= 1 and w["count", "note", 20, True] >= 1 and (w["changed_by", "v", 10] or 0) > 0
        second = (
            w["count", "note", 20, False] >= 2 or w["count", "note", 20, True] == 0 or (w["percentage_change", "v", 20] or 0) >= 0.5
            or w["count", "v", 10] >= 2 or (w["age_days", "since", 0] or 0) > 45
        )
        assert verdicts[i] == (first, second), i
    assert any(a for a, _ in verdicts.values()) and not all(b for _, b in verdicts.values())


def test_parameters_of_a_condition_are_part_of_the_look_back():
    count = {"left": {"count": "v", "days": 10, "where": HIGH}, "operator": "GTE", "right": {"literal": 1}}
    assert len(pw.lift([policy("A", count, 2), policy("B", count, 2)])[1]) == 1
    assert len(pw.lift([policy("A", count, 2), policy("B", count, 3)])[1]) == 2


def test_rows_are_shuffled_once(spark):
    df, sources = tables(spark)
    spark.conf.set("spark.tideglass.hotRows", str(10**18))  # rows given in Python have no known size
    try:
        rows, _, _ = pw.compile_policies(df, ["k"], "at", POLICIES, sources)
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_are_moved_before_they_are_spread(spark):
    """A row takes part in several steps of the pass; usual keys move it once, not once a step."""
    df, sources = tables(spark)
    spark.conf.set("spark.tideglass.hotRows", str(10**18))
    try:
        plan = pw.compile_policies(df, ["k"], "at", POLICIES, sources)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_given_hot_keys_change_no_figure(spark):
    df, sources = tables(spark)
    plain, _, _ = pw.compile_policies(df, ["k"], "at", POLICIES, sources)
    hot = spark.createDataFrame([("a",), (None,)], "k string").withColumn("_hot", F.lit(True))
    cut, _, _ = pw.compile_policies(df, ["k"], "at", POLICIES, sources, hot)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))


def test_empty_tables(spark):
    df, sources = tables(spark, rows=[], notes=[])
    assert pw.compile_policies(df, ["k"], "at", POLICIES, sources)[0].count() == 0
    df, sources = tables(spark, notes=[])
    rows, _, backs = pw.compile_policies(df, ["k"], "at", POLICIES, sources)
    noted = next(n for b, n in backs.items() if b.of == "note")
    assert [r[noted] for r in rows.collect()] == [0] * len(ROWS)


@pytest.mark.parametrize("operand", [
    {"count": "v", "days": 0}, {"count": "v", "days": 40000}, {"count": "v"}, {"changed_by": "v", "days": 5, "where": X}, {"count": "v", "days": 5, "where": {"exists": "note", "days": 5}},
])
def test_unbounded_or_nested_windows_are_refused(operand):
    with pytest.raises(ValueError):
        pw.lift([policy("A", {"left": operand, "operator": "GTE", "right": {"literal": 1}})])


def test_unknown_source_is_refused(spark):
    df, sources = tables(spark)
    with pytest.raises(ValueError):
        pw.compile_policies(df, ["k"], "at", [policy("A", {"exists": "absent", "days": 5})], sources)
