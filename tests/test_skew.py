"""A key with a third of all rows: every ordered operator equals a plain window on the same rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from tideglass.operators.ordered import asof, by_heat, exact_median, hot_keys, ranked_values, rolling, rolling_sums, running, sessions, with_previous


@pytest.fixture(scope="module", params=["1000000", "50"], ids=["usual", "hot"])
def facts(request, spark):
    spark.conf.set("spark.tideglass.hotRows", request.param)
    rng = random.Random(7)
    rows = [
        (0 if i % 3 == 0 else rng.randrange(1, 60), i, rng.randrange(0, 200 * 86400) * 1_000_000 + rng.randrange(3), rng.choice([None, 1, 2, 3, 50, 90]))
        for i in range(3000)
    ]
    # Ties on one time.
    rows += [(0, 5000 + i, 90 * 86_400_000_000, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, id int, us long, v int").withColumn("ts", F.timestamp_micros("us")).drop("us")
    yield df.cache(), request.param
    spark.conf.unset("spark.tideglass.hotRows")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert Counter(map(tuple, a.select(cols).collect())) == Counter(map(tuple, b.select(cols).collect()))


def test_hot_key_is_found(facts):
    df, floor = facts
    hot = hot_keys(df, ["k"])
    found = [] if hot is None else [r.k for r in hot.collect()]
    assert (0 in found) == (floor == "50")


def test_small_tables_keep_plain_windows(facts, tmp_path):
    df, floor = facts
    df.write.parquet(str(tmp_path / "facts"))
    read = df.sparkSession.read.parquet(str(tmp_path / "facts"))
    assert (hot_keys(read, ["k"]) is None) == (floor == "1000000")
    read.createOrReplaceTempView("small_facts")
    assert (hot_keys(df.sparkSession.sql("WITH c AS (SELECT * FROM small_facts) SELECT * FROM c"), ["k"]) is None) == (floor == "1000000")


@pytest.mark.parametrize("days", [1, 30])
def test_rolling(facts, days):
    df, _ = facts
    got = rolling(df, ["k"], "ts", days, {"n": ("count", "v"), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")})
    w = Window.partitionBy("k").orderBy("us").rangeBetween(-int(days * 86_400_000_000), 0)
    want = df.withColumn("us", F.unix_micros("ts"))
    want = want.select("k", "id", "v", "ts", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
    same(got, want)


def test_rolling_before_current(facts):
    df, _ = facts
    got = rolling(df, ["k"], "ts", 10, {"n": ("count", "id")}, include_current=False)
    w = Window.partitionBy("k").orderBy("us").rangeBetween(-10 * 86_400_000_000, -1)
    same(got, df.withColumn("us", F.unix_micros("ts")).select("k", "id", "v", "ts", F.count("id").over(w).alias("n")))


def test_previous(facts):
    df, _ = facts
    w = Window.partitionBy("k").orderBy("ts", "id")
    same(with_previous(df, ["k"], "ts", ["id"], {"p": "v", "q": "id"}), df.select("*", F.lag("v").over(w).alias("p"), F.lag("id").over(w).alias("q")))


@pytest.mark.parametrize("current", [True, False])
def test_running(facts, current):
    df, _ = facts
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    got = running(df, ["k"], "ts", ["id"], {"n": ("count", "v"), "s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, include_current=current)
    same(got, df.select("*", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.last("v", True).over(w).alias("l")))


def test_asof(facts):
    df, _ = facts
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1").select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"), F.col("v").alias("rv"))
    got = asof(left, right, ["k"], "ts", "rts", ["rid", "rv"], ["rid"])
    best = left.alias("l").join(right.alias("r"), F.expr("l.k = r.k AND r.rts <= l.ts"), "left").groupBy("l.k", "l.id", "l.v", "l.ts").agg(F.max_by(F.struct("rid", "rv"), F.struct("rts", "rid")).alias("b"))
    same(got, best.select("k", "id", "v", "ts", "b.rid", "b.rv"))


def test_sessions(facts):
    df, _ = facts
    tagged, grouped = sessions(df, ["k"], "ts", 1.5, [F.count(F.lit(1)).alias("n")])
    w = Window.partitionBy("k").orderBy("ts", "id")
    new = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > int(1.5 * 86_400_000_000), F.lit(True))
    want = df.withColumn("new", new).withColumn("session_start", F.last(F.when(F.col("new"), F.col("ts")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    same(tagged, want)
    assert sum(r.n for r in grouped.collect()) == df.count()


def test_ranks_and_median(facts):
    df, _ = facts
    rows = df.withColumn("x", F.col("id") % 997)
    got = ranked_values(rows, ["k"], "x")
    w = Window.partitionBy("k").orderBy("x")
    want = rows.select("k", "x", (F.rank().over(w) - 1).cast("bigint").alias("below")).distinct()
    same(got.select("k", "x", "below"), want)
    med = {r.k: r.median_value for r in exact_median(got, ["k"], "x").collect()}
    assert med == {r.k: r.m for r in rows.groupBy("k").agg(F.median("x").alias("m")).collect()}


def test_null_and_many_hot_keys(spark):
    """Null keys are keys, and more than a thousand keys may be hot."""
    spark.conf.set("spark.tideglass.hotRows", "2")
    try:
        rows = [(None if i % 7 == 0 else i % 1500, i, 1_000_000 * (i // 3), i % 5) for i in range(6000)]
        df = spark.createDataFrame(rows, "k int, id int, us long, v int").withColumn("ts", F.timestamp_micros("us")).drop("us")
        w = Window.partitionBy("k").orderBy("ts", "id")
        same(with_previous(df, ["k"], "ts", ["id"], {"p": "v"}), df.select("*", F.lag("v").over(w).alias("p")))
        run = running(df, ["k"], "ts", ["id"], {"n": ("count", "id")})
        same(run, df.select("*", F.count("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
        look = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000, 0)
        same(rolling(df, ["k"], "ts", 1, {"s": ("sum", "v")}), df.select("*", F.sum("v").over(look).alias("s")))
        ranked = ranked_values(df, ["k"], "v")
        same(ranked.select("k", "v", "n"), df.groupBy("k", "v").agg(F.count("id").alias("n")))
    finally:
        spark.conf.unset("spark.tideglass.hotRows")


def test_distinct_parties_over_two_look_backs(spark):
    """Against sets, at every event and every time one leaves; a hot entity, repeated events, a fall to zero."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from tideglass.operators.catalogue import distinct_parties

    rng = random.Random(2)
    base, day, tick = dt.datetime(2020, 1, 1), dt.timedelta(days=1), dt.timedelta(microseconds=1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(5), base + day * rng.randrange(400), rng.choice([9, 10, 11])) for _ in range(200)]
    rows += rows[:20] + [(4, 1, base, 9), (5, 1, base, 9), (5, 1, base + 30 * day, 9), (5, 1, base + 60 * day + tick, 9)]
    as_of, span = base + 380 * day, 30 * day
    df = spark.createDataFrame(rows, "counterparty_id int, party_no int, event_time timestamp_ntz, kind_no int")
    for floor in (None, "30"):
        if floor:
            spark.conf.set("spark.tideglass.hotRows", floor)
        try:
            for change in (True, False):
                got = {(r.entity_id, r.observed_at): r.value for r in distinct_parties(df, "x", [9, 10], 30, change, F.lit(str(as_of)).cast("timestamp_ntz")).collect()}
                hits = {r[:3] for r in rows if r[3] in (9, 10)}
                want = {}
                for who, _, t in hits:
                    for at in (t, t + span + tick):
                        now = {p for k, p, x in hits if k == who and at - span <= x <= at}
                        then = {p for k, p, x in hits if k == who and at - 2 * span <= x <= at - span}
                        if at <= as_of:
                            want[who, at] = float(len(now) - (len(then) if change else 0))
                assert got == want
                assert change or got[4, base + span + tick] == 0.0  # the fall to zero has its row
        finally:
            spark.conf.unset("spark.tideglass.hotRows")


def test_passes_over_the_same_keys(facts):
    """As-of, look-back and previous value one after another: as plain windows, and one shuffle for the keys that are not hot."""
    df, floor = facts
    right = df.filter("id % 2 = 1").select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"), F.col("v").alias("rv"))
    left = df.filter("id % 2 = 0")

    def then(rows, hot):
        looked = rolling(rows, ["k"], "ts", 10, {"s": ("sum", "rv")}, hot=hot)
        return with_previous(looked, ["k"], "ts", ["id"], {"p": "s"}, hot=hot)

    known = asof(left, right, ["k"], "ts", "rts", ["rv"], ["rid"]).localCheckpoint()
    look = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-10 * 86_400_000_000, 0)
    want = known.withColumn("s", F.sum("rv").over(look)).withColumn("p", F.lag("s").over(Window.partitionBy("k").orderBy("ts", "id")))
    same(asof(left, right, ["k"], "ts", "rts", ["rv"], ["rid"], then=then), want)
    parts = []
    by_heat(df, ["k"], lambda rows, hot: parts.append((rows, hot)) or rows)
    assert parts[0][1] is None and all(hot is not None for _, hot in parts[1:])
    usual = then(with_previous(parts[0][0], ["k"], "ts", ["id"], {"rv": "v"}, hot=None), None)
    assert usual._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(k") <= 2  # one of them counts rows by key


@pytest.mark.parametrize("floor", [str(10**18), "40"])
def test_change_of_utilization_against_its_mean_before(spark, floor):
    """As-of of the limit and look-back of the ratio by facility: one shuffle, and the figures of a loop, the null facility's too."""
    import datetime as dt

    from tideglass.operators.features import template_delta, utilization

    rng, base = random.Random(4), dt.datetime(2020, 1, 1)
    when = lambda: base + dt.timedelta(days=rng.randrange(120))
    facility = lambda: rng.choice([1, 1, 1, 2, 3, None])
    out = [(facility(), f"e{i}", when(), rng.choice([None, 5, 10, 40])) for i in range(120)]
    lim = [(facility(), i, when(), rng.choice([None, 0, 20, 50])) for i in range(40)]
    spark.conf.set("spark.tideglass.hotRows", floor)
    try:
        found = utilization(
            spark.createDataFrame(out, "facility_id int, event_id string, effective_at timestamp_ntz, outstanding int"),
            spark.createDataFrame(lim, "facility_id int, event_id int, effective_at timestamp_ntz, limit_amount int"),
            lambda rows, hot: template_delta(rows.filter("utilization_ratio IS NOT NULL"), ["facility_id"], "effective_at", ["event_id"], "utilization_ratio", 30, hot),
        )
        got = {r["event_id"]: r["baseline"] and round(r["baseline"], 9) for r in found.collect()}
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    if floor != "40":
        assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    known = {}
    for f, e, at, amount in out:
        newest = max(((t, i, x) for k, i, t, x in lim if k == f and t <= at), key=lambda r: r[:2], default=(None, None, None))[2]
        if newest and amount is not None:
            known[e] = (f, at, round(amount / newest, 6))
    want = {}
    for e, (f, at, _) in known.items():
        earlier = [r for k, t, r in known.values() if k == f and at - dt.timedelta(days=30) <= t < at]
        want[e] = round(sum(earlier) / len(earlier), 9) if earlier else None
    assert got == want and any(want.values())


def test_sums_over_several_look_backs(facts):
    """In one pass as in two: values that are null, look-backs with none, rows on both ends, null keys and times left out."""
    df, floor = facts
    more = df.sparkSession.createDataFrame([(0, 5000, 0), (0, 5001, 30 * 86_400_000_000), (None, 1, 5), (3, 7, None)], "k int, id int, us long").select("k", "id", F.lit(None).cast("int").alias("v"), F.timestamp_micros("us").alias("ts"))
    points = df.unionByName(more).groupBy("k", "ts").agg(F.sum(F.col("v").cast("decimal(20,2)")).alias("v"), F.count(F.lit(1)).alias("n"))
    got = rolling_sums(points, ["k"], "ts", [1, 30], ["v", "n"])
    look = lambda c, days: F.sum(c).over(Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-int(days * 86_400_000_000), 0)).alias(f"{c}_{days}")
    same(got, points.filter("k IS NOT NULL AND ts IS NOT NULL").select("k", "ts", *[look(c, d) for d in (1, 30) for c in ("v", "n")]))
    plan = rolling_sums(points, ["k"], "ts", [1, 30], ["n"], hot=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(k")  # moved once, then spread
