"""Feature value rows and the templates that compute them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.functions.scalars import NON_COUNTABLE_RETURNS, age_days, name_uuid, quality_state, safe_ratio, usable_dpd, value_state
from tideglass.operators.ordered import FIND, asof, exact_median, ranked_values, rolling

FEATURE_COLUMNS = [
    "feature_value_id", "definition_id", "feature_name", "definition_version", "entity_type", "entity_id", "state",
    "value_type", "value_numeric", "prior_value_numeric", "knowledge_time", "window_start", "window_end",
    "quality_state",
]


@dataclass(frozen=True)
class Definition:
    name: str
    definition_id: str
    entity_type: str
    value_type: str
    days: int | None = None


# Definition ids, grains and look-backs.
DEFINITIONS = {
    d.name: d
    for d in [
        Definition("returned_payment_count_30d", "FD-RETURNED-PAYMENT-COUNT-30D-001", "ACCOUNT", "INTEGER", 30),
        Definition("returned_payment_value_30d", "FD-RETURNED-PAYMENT-VALUE-30D-001", "ACCOUNT", "DECIMAL", 30),
        Definition("returned_payment_rate_30d", "FD-RETURNED-PAYMENT-RATE-30D-001", "ACCOUNT", "DECIMAL", 30),
        Definition("current_dpd", "FD-CURRENT-DPD-001", "FACILITY", "INTEGER"),
        Definition("max_dpd_30d", "FD-MAX-DPD-30D-001", "FACILITY", "INTEGER", 30),
        Definition("max_dpd_90d", "FD-MAX-DPD-90D-001", "FACILITY", "INTEGER", 90),
        Definition("utilization_ratio", "FD-UTILIZATION-RATIO-001", "FACILITY", "DECIMAL"),
    ]
}


def iso_instant(ts: Column) -> Column:
    """ISO-8601 instant with 0, 3 or 6 fraction digits, whichever is shortest."""
    us = F.unix_micros(ts.cast("timestamp"))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(us % 1_000_000 == 0, F.lit(""))
        .when(us % 1_000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(whole, fraction, F.lit("Z"))


def feature_id(name: str, identity: Column, start: Column, end: Column) -> Column:
    return name_uuid(F.concat_ws("|", F.lit(name), identity.cast("string"), iso_instant(start), iso_instant(end)))


def feature_rows(
    df: DataFrame, definition: Definition, entity: str, at: str, value: Column, usable: Column | None = None,
    prior: Column | None = None, identity: str | None = None,
) -> DataFrame:
    """Project computed values into feature value rows."""
    usable = value.isNotNull() if usable is None else usable
    end = F.col(at)
    start = end - F.expr(f"INTERVAL {definition.days} DAYS") if definition.days else end
    return df.select(
        feature_id(definition.name, F.col(identity or entity), start, end).alias("feature_value_id"),
        F.lit(definition.definition_id).alias("definition_id"),
        F.lit(definition.name).alias("feature_name"),
        F.lit("1.0").alias("definition_version"),
        F.lit(definition.entity_type).alias("entity_type"),
        F.col(entity).cast("string").alias("entity_id"),
        value_state(value, usable).alias("state"),
        F.lit(definition.value_type).alias("value_type"),
        F.when(usable, value).cast("decimal(38,12)").alias("value_numeric"),
        (prior if prior is not None else F.lit(None)).cast("decimal(38,12)").alias("prior_value_numeric"),
        end.alias("knowledge_time"),
        start.alias("window_start"),
        end.alias("window_end"),
        quality_state(usable).alias("quality_state"),
    )


def countable_returns(returns: DataFrame) -> DataFrame:
    category = F.col("return_reason_category")
    return returns.filter(category.isNotNull() & ~category.isin(NON_COUNTABLE_RETURNS))


def returned_payment_points(returns: DataFrame, days: int = 30) -> DataFrame:
    """Count and value of countable returns in the look-back, one row per account and time."""
    return rolling(
        countable_returns(returns), ["account_id"], "event_time", days,
        {"return_count": ("count", "event_id"), "return_value": ("sum", "amount")}, per_event=False,
    )


def payment_count_features(returns: DataFrame) -> DataFrame:
    return feature_rows(
        returned_payment_points(returns), DEFINITIONS["returned_payment_count_30d"], "account_id", "event_time",
        F.col("return_count"),
    )


def current_dpd_features(dpd: DataFrame) -> DataFrame:
    usable = usable_dpd(F.col("current_dpd"), F.col("reconciled"))
    prior = F.col("previous_dpd") if "previous_dpd" in dpd.columns else None
    return feature_rows(
        dpd, DEFINITIONS["current_dpd"], "facility_id", "event_time", F.col("current_dpd"), usable, prior, "event_id"
    )


def max_dpd_points(dpd: DataFrame, days: int = 30) -> DataFrame:
    good = dpd.filter(usable_dpd(F.col("current_dpd"), F.col("reconciled")))
    return rolling(good, ["facility_id"], "event_time", days, {"max_dpd": ("max", "current_dpd")}, per_event=False)


def max_dpd_features(dpd: DataFrame, days: int = 30) -> DataFrame:
    return feature_rows(
        max_dpd_points(dpd, days), DEFINITIONS[f"max_dpd_{days}d"], "facility_id", "event_time", F.col("max_dpd")
    )


# --- templates -------------------------------------------------------------------------------


def template_ratio(df: DataFrame, name: str, num: Column, den: Column) -> DataFrame:
    """num / den; an absent, zero or negative denominator gives INVALID and no number."""
    ok = den.isNotNull() & (den > 0) & num.isNotNull()
    return (
        df.withColumn(name, F.when(ok, safe_ratio(num, den)))
        .withColumn(f"{name}_state", F.when(~F.coalesce(ok, F.lit(False)), "INVALID").when(num == 0, "ZERO").otherwise("VALUE"))
    )


def template_roll(df: DataFrame, keys: list[str], ts: str, days: int, aggs: dict) -> DataFrame:
    return rolling(df, keys, ts, days, aggs, per_event=False)


def template_delta(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, days: int, hot: DataFrame | str | None = FIND) -> DataFrame:
    """Value minus the mean of the look-back that ends just before it."""
    d = df.withColumn("_v", F.col(value).cast("decimal(28,12)"))
    out = rolling(
        d, keys, ts, days, {"_n": ("count", "_v"), "_sum": ("sum", "_v")}, include_current=False, hot=hot
    )
    baseline = F.when(F.col("_n") > 0, F.col("_sum").cast("double") / F.col("_n"))
    return out.withColumn("baseline", baseline).withColumn("delta", F.col(value).cast("double") - F.col("baseline")).drop(
        "_v", "_n", "_sum"
    )


def template_age(df: DataFrame, name: str, since: Column, now: Column) -> DataFrame:
    return df.withColumn(name, age_days(since, now)).withColumn(
        f"{name}_state", F.when(since.isNull(), "NOT_AVAILABLE").when(F.col(name) == 0, "ZERO").otherwise("VALUE")
    )


def template_state(df: DataFrame, keys: list[str], ts: str, ties: list[str], cols: list[str]) -> DataFrame:
    """Newest values of a state per key, by a mergeable aggregate rather than a sort."""
    value = F.struct(*cols)
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, *ties)).alias("_s"), F.max(ts).alias("as_of")).select(
        *keys, "as_of", "_s.*"
    )


def template_peer(df: DataFrame, cohort: list[str], value: str, minimum: int) -> DataFrame:
    """Percentile rank, z-score and distance to the median inside a cohort.

    A cohort smaller than ``minimum`` gives NOT_AVAILABLE and nulls.
    """
    ranked = ranked_values(df, cohort, value)
    v = F.col(value).cast("double")
    stats = df.groupBy(*cohort).agg(
        F.count(v).alias("cohort_size"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd")
    )
    middle = exact_median(ranked, cohort, value)
    enough = F.col("cohort_size") >= minimum
    out = (
        df.filter(F.col(value).isNotNull())
        .join(ranked.select(*cohort, value, "below"), [*cohort, value])
        .join(stats, cohort)
        .join(middle, cohort)
    )
    return out.select(
        *df.columns, "cohort_size",
        F.when(enough & (F.col("cohort_size") > 1), F.col("below") / (F.col("cohort_size") - 1)).alias("peer_percentile"),
        F.when(enough & (F.col("_sd") > 0), (v - F.col("_mean")) / F.col("_sd")).alias("peer_zscore"),
        F.when(enough, v - F.col("median_value")).alias("peer_delta"),
        F.when(enough, "VALUE").otherwise("NOT_AVAILABLE").alias("peer_state"),
    )


# --- utilisation -----------------------------------------------------------------------------


def utilization(outstanding: DataFrame, limits: DataFrame, then: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, hot: DataFrame | str | None = FIND) -> DataFrame:
    """Outstanding against the limit known at that moment; without a limit NOT_AVAILABLE, never 0.

    ``then(rows, hot)`` goes on by facility without another shuffle of usual facilities, see ``ordered.by_heat``.
    """
    lim = F.col("limit_amount")
    ratio = safe_ratio(F.col("outstanding"), lim)

    def states(joined: DataFrame, hot: DataFrame | None) -> DataFrame:
        rows = joined.select(
            "*",
            F.round(ratio, 6).alias("utilization_ratio"),
            (lim - F.col("outstanding")).alias("headroom"),
            F.when(lim.isNull(), "NOT_AVAILABLE").when(lim <= 0, "INVALID").when(F.col("outstanding") == 0, "ZERO")
            .otherwise("VALUE").alias("state"),
        )
        return rows if then is None else then(rows, hot)

    # Ties on one day: the limit of the highest event id is the last of that day.
    return asof(outstanding, limits, ["facility_id"], "effective_at", "effective_at", ["limit_amount"], ["event_id"], then=states, hot=hot)


def daily_excess(util: DataFrame) -> DataFrame:
    """One row per facility and day: whether, and how far, outstanding exceeded the limit."""
    return (
        util.filter("state IN ('VALUE', 'ZERO')")
        .groupBy("facility_id", F.date_trunc("day", "effective_at").cast("timestamp_ntz").alias("day"))
        .agg(
            F.max((F.col("headroom") < 0).cast("int")).alias("in_excess"),
            F.max(F.greatest(F.col("utilization_ratio") - 1, F.lit(0.0))).alias("excess_ratio"),
        )
    )


def excess_windows(daily: DataFrame, days: int = 30) -> DataFrame:
    """Days in excess and worst ratio over the look-back; at most one row per calendar day and key."""
    w = Window.partitionBy("facility_id").orderBy(F.unix_date(F.col("day").cast("date"))).rangeBetween(-days, 0)
    return daily.withColumn("excess_days", F.sum("in_excess").over(w)).withColumn("max_excess_ratio", F.max("excess_ratio").over(w))


def excess_runs(daily: DataFrame) -> DataFrame:
    """Length so far of the unbroken run of calendar days in excess ending on each day in excess.

    A facility has at most one row per calendar day here, so the window over it is bounded by the
    calendar whatever the number of underlying rows.
    """
    day_no = F.unix_date(F.col("day").cast("date"))
    w = Window.partitionBy("facility_id").orderBy("day")
    return (
        daily.filter("in_excess = 1")
        .withColumn("_island", day_no - F.row_number().over(w))
        .withColumn(
            "consecutive_days",
            F.row_number().over(Window.partitionBy("facility_id", "_island").orderBy("day")),
        )
        .drop("_island")
    )
