"""Named features as definition rows over a few templates.

Every function returns long rows: entity_id, observed_at, feature_name, value (double), state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.functions.scalars import days_us, floor_div, micros
from tideglass.operators.ordered import running, asof, rolling, with_previous
from tideglass.sources.reference import values

LONG = ["entity_id", "observed_at", "feature_name", "value", "state"]

# Numerator and denominator of the ratio features over statement columns. The third
# entry scales to days where the feature is expressed in days of a quarter.
RATIOS = [
    ("current_ratio", "current_assets", "current_liabilities", 1),
    ("quick_ratio", "quick_assets", "current_liabilities", 1),
    ("debt_ebitda", "total_debt", "ebitda", 1),
    ("tol_atnw", "total_debt + current_liabilities", "current_assets - current_liabilities", 1),
    ("dscr", "operating_cash_flow", "debt_service", 1),
    ("interest_coverage_ratio", "ebitda", "interest_expense", 1),
    ("ebitda_margin", "ebitda", "revenue", 1),
    ("ocf_to_ebitda", "operating_cash_flow", "ebitda", 1),
    ("receivable_days", "receivables", "revenue", 90),
    ("inventory_days", "inventory", "cost_of_goods", 90),
    ("payable_days", "payables", "cost_of_goods", 90),
]

# Event counts over a look-back: name, days, kinds counted.
COUNTS = [
    ("key_management_change_count_180d", 180, (0, 1)), ("key_management_departure_count_180d", 180, (1,)),
    ("cfo_turnover_24m", 730, (2,)), ("director_turnover_12m", 365, (3,)), ("clustered_key_departures_90d", 90, (1, 2, 3)),
    ("auditor_change_count_24m", 730, (4,)), ("ownership_control_change_count_12m", 365, (5,)),
    ("psc_change_count_12m", 365, (5,)), ("credit_facility_amendment_count_12m", 365, (6,)),
    ("covenant_waiver_count_12m", 365, (7,)), ("covenant_event_count", 365, (7, 12)),
    ("maturity_extension_count_24m", 730, (8,)), ("new_security_interest_count_90d", 90, (9,)),
    ("ucc_amendments_12m", 365, (6, 9)), ("ucc_terminations_12m", 365, (10,)),
    ("debt_default_disclosure_count_12m", 365, (11,)), ("debt_acceleration_count_12m", 365, (12,)),
    ("adverse_legal_notice_count_90d", 90, (13,)), ("notice_type_count", 365, (13, 14)),
    ("material_control_weakness_count", 365, (17,)), ("financial_restatement_count_24m", 730, (18,)),
    ("profit_warning_count_12m", 365, (20,)), ("guidance_revision_count", 365, (21,)),
    ("registered_office_change_count_12m", 365, (22,)), ("status_change_count_12m", 365, (23,)),
    ("late_payment_count_90d", 90, (39, 41)), ("temporary_limit_count_90d", 90, (42,)), ("adverse_news_count_90d", 90, (47,)),
    ("lender_exit_count_12m", 365, (44,)),
]

# Normalised rating scale, best first, with a probability of default in percent.
RATING_SCALE = [("A", 1, 0.1), ("BBB", 2, 0.4), ("BB", 3, 1.5), ("B", 4, 5.0), ("CCC", 5, 20.0)]


def _unpivot(df: DataFrame, entity: str, observed_at: str, entries: list[tuple[str, Column, Column]], only: set[str] | None = None) -> DataFrame:
    """One row a feature; ``only`` these where given, so that what the others read is not computed."""
    cells = [F.struct(F.lit(n).alias("n"), v.cast("double").alias("v"), s.alias("s")) for n, v, s in entries if only is None or n in only]
    cells = F.array(*cells) if cells else F.array().cast("array<struct<n:string,v:double,s:string>>")
    rows = df.select(F.col(entity).alias("entity_id"), F.col(observed_at).alias("observed_at"), F.explode(cells).alias("c"))
    return rows.select("entity_id", "observed_at", F.col("c.n").alias("feature_name"), F.col("c.v").alias("value"), F.col("c.s").alias("state"))


def _ratio(num: Column, den: Column, scale: int = 1) -> tuple[Column, Column]:
    """A denominator that is absent, zero or negative gives INVALID, never a misleading number."""
    ok = F.coalesce(den > 0, F.lit(False)) & num.isNotNull()
    value = F.when(ok, F.round(num.cast("double") * scale / den.cast("double"), 8))
    return value, F.when(~ok, "INVALID").when(num == 0, "ZERO").otherwise("VALUE")


def statement_ratios(statements: DataFrame, only: set[str] | None = None) -> DataFrame:
    entries = []
    for name, num, den, scale in RATIOS:
        value, state = _ratio(F.expr(num), F.expr(den), scale)
        entries.append((name, value, state))
    return _unpivot(statements, "counterparty_id", "period_start", entries, only)


def statement_levels(statements: DataFrame, only: set[str] | None = None) -> DataFrame:
    parts = [_ratio(F.expr(n), F.expr(d), s) for name, n, d, s in RATIOS if name in ("receivable_days", "inventory_days", "payable_days")]
    ccc = parts[0][0] + parts[1][0] - parts[2][0]
    ocf, fcf = F.col("operating_cash_flow"), F.expr("operating_cash_flow - capital_expenditure")
    state = lambda v: F.when(v.isNull(), "INVALID").when(v == 0, "ZERO").otherwise("VALUE")
    return _unpivot(statements, "counterparty_id", "period_start", [
        ("operating_cash_flow", ocf, state(ocf)), ("free_cash_flow", fcf, state(fcf)),
        ("cash_conversion_cycle", F.round(ccc, 6), state(ccc)),
    ], only)


def statement_changes(statements: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Against the same quarter a year before, and against the quarter before."""
    base = statements.select("counterparty_id", "period_start", "revenue", "ebitda", "current_assets", "operating_cash_flow")

    def earlier(months: int, prefix: str) -> DataFrame:
        shifted = (F.col("period_start") + F.make_ym_interval(F.lit(0), F.lit(months))).alias("period_start")
        return base.select("counterparty_id", shifted, *[F.col(c).alias(f"{prefix}{c}") for c in ("revenue", "ebitda", "current_assets", "operating_cash_flow")])

    keys = ["counterparty_id", "period_start"]
    rows = base.join(earlier(12, "y_"), keys, "left").join(earlier(3, "q_"), keys, "left")
    growth, growth_state = _ratio(F.expr("revenue - y_revenue"), F.col("y_revenue"))
    margin = F.round(
        F.col("ebitda").cast("double") / F.col("revenue").cast("double") - F.col("y_ebitda").cast("double") / F.col("y_revenue").cast("double"), 8
    )
    cash, cash_state = _ratio(F.expr("current_assets - q_current_assets"), F.col("q_current_assets"))
    variance, variance_state = _ratio(F.expr("operating_cash_flow - y_operating_cash_flow"), F.col("y_operating_cash_flow"))
    absent = lambda col, s: F.when(F.col(col).isNull(), "NOT_AVAILABLE").otherwise(s)
    return _unpivot(rows, "counterparty_id", "period_start", [
        ("revenue_yoy_change", growth, absent("y_revenue", growth_state)),
        ("ebitda_margin_change_yoy", margin, absent("y_revenue", F.when(margin == 0, "ZERO").otherwise("VALUE"))),
        ("cash_balance_change", cash, absent("q_current_assets", cash_state)),
        ("operating_profit_projection_variance", variance, absent("y_operating_cash_flow", variance_state)),
    ], only)


def event_counts(events: DataFrame) -> DataFrame:
    """All look-back counts: events are joined to the literal definition rows, one rolling per length."""
    out = None
    for days in sorted({d for _, d, _ in COUNTS}):
        rows = [(name, kind) for name, d, kinds in COUNTS if d == days for kind in kinds]
        defs = values(events.sparkSession, ["feature_name", "kind_no"], rows)
        hits = events.join(defs, "kind_no").select("counterparty_id", "feature_name", "event_time", "event_id")
        # Blocks of at most 30 days whatever the length of the look-back.
        counted = rolling(
            hits, ["counterparty_id", "feature_name"], "event_time", days, {"n": ("count", "event_id")}, max(1, days // 30), per_event=False
        )
        part = counted.select(F.col("counterparty_id").alias("entity_id"), F.col("event_time").alias("observed_at"), "feature_name", F.col("n").cast("double").alias("value"), F.lit("VALUE").alias("state"))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_parties(events: DataFrame, name: str, kinds: list[int], days: int, change: bool, as_of: Column) -> DataFrame:
    """Distinct parties in the look-back [t - days, t], or their change against the look-back that ends days earlier.

    A party is present from an event until ``days`` after it. An event adds +1 where its party was not present, and -1 a microsecond
    after its own look-back ends; where it prolongs a presence, it takes back the end that the event before has set. So the count is a running
    sum, exact for any number of parties, and the change is the same sum with each step taken back ``days`` later. Reported at
    every event and at every time one leaves the look-back, so a fall, to zero too, has its row; nothing later than ``as_of``.
    """
    length, who = F.lit(days_us(days)).cast("bigint"), "counterparty_id"
    hits = events.filter(F.col("kind_no").isin(kinds)).select(who, "party_no", "event_time").distinct()
    seen = with_previous(hits, [who, "party_no"], "event_time", [], {"_before": "event_time"}, days=days)
    at = micros("event_time")
    ends, set_before = at + length + 1, micros("_before") + length + 1
    fresh = set_before.isNull() | (at >= set_before)

    def step(when: Column, d: Column, asked: bool) -> Column:
        return F.struct(when.alias("_at"), d.cast("bigint").alias("_d"), F.lit(asked).alias("_asked"))

    kept_on = F.when(~fresh, set_before)
    steps = [step(at, fresh.cast("int"), True), step(ends, F.lit(-1), True), step(kept_on, F.lit(1), False)]
    if change:
        steps += [step(at + length, -fresh.cast("int"), False), step(ends + length, F.lit(1), False), step(kept_on + length, F.lit(-1), False)]
    rows = seen.select(who, F.inline(F.array(*steps))).filter(F.col("_at") <= micros(as_of))
    rows = rows.groupBy(who, "_at").agg(F.sum("_d").alias("_d"), F.bool_or("_asked").alias("_asked"))
    rows = rows.withColumn("observed_at", F.timestamp_micros("_at").cast("timestamp_ntz"))
    counted = running(rows, [who], "observed_at", [], {"_n": ("sum", "_d")}, days=days).filter("_asked")
    return counted.select(
        F.col(who).alias("entity_id"), "observed_at", F.lit(name).alias("feature_name"), F.col("_n").cast("double").alias("value"),
        F.when(F.col("_n") == 0, "ZERO").otherwise("VALUE").alias("state"),
    )


def scale(spark) -> DataFrame:
    return values(spark, ["rating", "notch", "pd"], RATING_SCALE)


def rating_features(actions: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Notch movements per issuer and agency; scales of different agencies are never mixed."""
    keys = ["issuer_id", "agency"]
    rows = actions.join(scale(actions.sparkSession), "rating")
    stepped = with_previous(rows, keys, "action_time", ["action_id"], {"_before": "notch"}, days=365)
    stepped = stepped.withColumn("step", F.col("notch") - F.col("_before"))
    out = stepped.withColumns({"n_90d": F.lit(None).cast("int"), "n_12m": F.lit(None).cast("int"), "velocity": F.lit(None).cast("bigint")})
    for name, days in (("90d", 90), ("12m", 365)):
        if only is not None and f"external_rating_notch_change_{name}" not in only:
            continue
        then = rows.select(*keys, "action_time", F.col("notch").alias(f"n_{name}"), F.col("action_id").alias("_tie"))
        asked = out.drop(f"n_{name}").withColumn("_then", F.col("action_time") - F.expr(f"INTERVAL {days} DAYS"))
        out = asof(asked, then, keys, "_then", "action_time", [f"n_{name}"], ["_tie"], days=365)
    if only is None or "rating_migration_velocity" in only:
        moved = rolling(stepped.withColumn("_abs", F.abs("step")), keys, "action_time", 365, {"velocity": ("sum", "_abs")}, 12, per_event=False)
        out = out.drop("velocity").join(moved, [*keys, "action_time"], "left")
    out = out.withColumn("issuer_key", F.concat_ws("|", *keys, "action_id"))
    have = lambda c: F.when(c.isNull(), "NOT_AVAILABLE").when(c == 0, "ZERO").otherwise("VALUE")
    d90, d12 = F.expr("notch - n_90d"), F.expr("notch - n_12m")
    velocity = F.coalesce("velocity", F.lit(0))
    return _unpivot(out, "issuer_key", "action_time", [
        ("external_rating_notch_change", F.col("step"), have(F.col("step"))),
        ("external_rating_notch_change_90d", d90, have(d90)), ("external_rating_notch_change_12m", d12, have(d12)),
        ("rating_migration_velocity", velocity, have(velocity)),
    ], only)


def rating_states(actions: DataFrame, now: Column) -> DataFrame:
    last = actions.groupBy("issuer_id", "agency").agg(
        F.max_by(F.struct("outlook", "on_watch", "action_time"), F.struct("action_time", "action_id")).alias("_s")
    )
    return last.select(
        "issuer_id", "agency", F.col("_s.outlook").alias("rating_outlook_state"), F.col("_s.on_watch").alias("rating_watch_state"),
        F.datediff(now, F.col("_s.action_time")).alias("days_since_rating_action"),
    )


def origination_relative(actions: DataFrame) -> DataFrame:
    """First against latest grade and default probability of each issuer."""
    rows = actions.join(scale(actions.sparkSession), "rating")
    observed_at = F.struct("action_time", "action_id")
    ends = rows.groupBy("issuer_id").agg(F.min_by(F.struct("notch", "pd"), observed_at).alias("o"), F.max_by(F.struct("notch", "pd"), observed_at).alias("c"))
    return ends.select(
        "issuer_id", F.col("o.pd").cast("double").alias("origination_pd"), F.col("c.pd").cast("double").alias("current_pd"),
        F.round(F.expr("CAST(c.pd AS DOUBLE) - CAST(o.pd AS DOUBLE)"), 8).alias("absolute_pd_change"), F.round(F.expr("CAST(c.pd AS DOUBLE) / CAST(o.pd AS DOUBLE) - 1"), 8).alias("relative_pd_change"),
        F.col("o.notch").alias("origination_internal_grade"), F.col("c.notch").alias("current_internal_grade"),
        F.expr("c.notch - o.notch").alias("grade_notches_deteriorated"),
    )


def market_daily(quotes: DataFrame) -> DataFrame:
    """One row per security and day."""
    day = F.date_trunc("day", "quote_time").cast("timestamp_ntz")
    return quotes.groupBy("security_id", day.alias("day")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("quote_time", "quote_id")).alias("close"),
        F.max("yield_pct").alias("yield_pct"), F.sum("volume").alias("volume"),
    )


def market_features(daily: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Drawdown from the rolling high and yield, spread changes over 5 and 30 days.

    There is one row per security and day, so windows over a security are bounded by the calendar.
    The benchmark of a day is the lowest yield of that day.
    """
    number = F.unix_date(F.col("day").cast("date"))
    bench = daily.groupBy("day").agg(F.min("yield_pct").alias("_bench"))
    rows = daily.join(bench, "day").withColumn("spread", F.col("yield_pct") - F.col("_bench"))
    w = Window.partitionBy("security_id").orderBy(number)
    entries = []
    have = lambda c: F.when(c.isNull(), "NOT_AVAILABLE").when(c == 0, "ZERO").otherwise("VALUE")
    for days in (5, 30):
        top = F.max("high").over(w.rangeBetween(-days, 0))
        old = w.rangeBetween(Window.unboundedPreceding, -days)
        rows = (
            rows.withColumn(f"_dd{days}", F.round(1 - F.col("close").cast("double") / top.cast("double"), 8))
            .withColumn(f"_y{days}", F.round(((F.col("yield_pct") - F.last("yield_pct").over(old)) * 100).cast("double"), 6))
            .withColumn(f"_s{days}", F.round(((F.col("spread") - F.last("spread").over(old)) * 100).cast("double"), 6))
        )
        for name, col in (("bond_price_drawdown", f"_dd{days}"), ("bond_yield_change_bps", f"_y{days}"), ("credit_spread_change_bps", f"_s{days}")):
            entries.append((f"{name}_{days}d", F.col(col), have(F.col(col))))
    return _unpivot(rows, "security_id", "day", entries, only)


def own_history_zscore(daily: DataFrame, value: str, days: int, minimum: int) -> DataFrame:
    """Distance of today's value from its own mean over the days before, in standard deviations."""
    number = F.unix_date(F.col("day").cast("date"))
    w = Window.partitionBy("security_id").orderBy(number).rangeBetween(-days, -1)
    v = F.col(value).cast("decimal(18,4)")
    n, s, ss = F.count(v).over(w), F.sum(v).over(w), F.sum(v * v).over(w)
    rows = daily.withColumn("_n", n).withColumn("_mean", s.cast("double") / n).withColumn(
        "_var", (ss.cast("double") - s.cast("double") * s.cast("double") / n) / (n - 1)
    )
    ok = (F.col("_n") >= minimum) & (F.col("_var") > 0)
    return rows.withColumn("z", F.when(ok, (F.col(value).cast("double") - F.col("_mean")) / F.sqrt("_var"))).withColumn(
        "z_state", F.when(ok, "VALUE").otherwise("NOT_AVAILABLE")
    ).drop("_n", "_mean", "_var")
