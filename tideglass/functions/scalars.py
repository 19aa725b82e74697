"""Column functions: ids, coercion, states, bands, durations."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, functions as F

# Fixed values.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
BANDS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
AUTHORITY_TIERS = ["T1", "T2", "T3", "T4"]
QUALITY_STATES = ["COMPLETE", "PARTIAL", "UNVERIFIED", "CONFLICTED", "STALE", "INSUFFICIENT"]
VALUED_STATES = ["VALUE", "ZERO"]
NON_COUNTABLE_RETURNS = ["TECHNICAL", "BENEFICIARY_DETAIL"]
DPD_BAND_STARTS = [1, 30, 60, 90]


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp column."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def floor_div(x: Column, n) -> Column:
    """Exact integer division rounding down, also for negative numbers."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", x - F.pmod(x, n), n)


def days_us(days: float) -> int:
    return int(days * 86_400_000_000)


def name_uuid(text: Column) -> Column:
    """Version 3 (name-based, MD5) UUID of a text, without a namespace prefix.

    The digest is bound once through a one-element array: written inline, nested ids would repeat
    their whole input expression for every part of the id.
    """

    def layout(digest: Column) -> Column:
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(
            F.substring(digest, 1, 8), F.lit("-"),
            F.substring(digest, 9, 4), F.lit("-3"),
            F.substring(digest, 14, 3), F.lit("-"),
            variant, F.substring(digest, 18, 3), F.lit("-"),
            F.substring(digest, 21, 12),
        )

    return F.element_at(F.transform(F.array(F.md5(text.cast("binary"))), layout), 1)


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def coerce_long(document: Column, path: str) -> Column:
    """Whole number at a path of a variant, given as a number (cut to whole) or as whole-number text.

    Numbers are read as bigint from the variant itself, so none passes through a double.
    """
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    text = F.try_variant_get(document, path, "string")
    number = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(document, path, "bigint"))
    return F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))).otherwise(number)


def coerce_decimal(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit("")).try_cast("decimal(38,12)")


def coerce_instant(raw: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(raw), F.lit("")))


def usable_dpd(dpd: Column, reconciled: Column) -> Column:
    return F.coalesce(reconciled & (dpd >= 0), F.lit(False))


def value_state(value: Column, usable: Column) -> Column:
    return F.when(~usable | value.isNull(), "INVALID").when(value == 0, "ZERO").otherwise("VALUE")


def quality_state(usable: Column) -> Column:
    return F.when(usable, "COMPLETE").otherwise("INSUFFICIENT")


def ladder(value: Column, steps: list[tuple[float, object]], default) -> Column:
    """First result whose lower bound the value reaches; steps go from high to low."""
    (bound, result), *rest = steps
    out = F.when(value >= bound, F.lit(result))
    for bound, result in rest:
        out = out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(default))


def dpd_band(dpd: Column) -> Column:
    """Delinquency band: 0 none, 1 from day 1, 2 from 30, 3 from 60, 4 from 90."""
    reached = [(dpd >= start).cast("int") for start in DPD_BAND_STARTS]
    return sum(reached[1:], reached[0])


def classify_dpd(previous: Column, current: Column) -> Column:
    """DPD_EMERGED when delinquency starts, DPD_WORSENING when a delinquent account climbs a band."""
    before = F.coalesce(previous, F.lit(0))
    return F.when((before <= 0) & (current >= 1), "DPD_EMERGED").when(
        (before >= 1) & (dpd_band(current) > dpd_band(before)), "DPD_WORSENING"
    )


def dpd_severity(dpd: Column) -> Column:
    return ladder(dpd, [(90, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM")], "LOW")


def dpd_materiality(dpd: Column) -> Column:
    return ladder(dpd, [(90, "CRITICAL"), (30, "HIGH")], "MEDIUM")


def rank_in(value: Column, order: list[str]) -> Column:
    """Position of a value in an ordered list, 0 for the lowest, null when unknown."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(pos > 0, (pos - 1).cast("int"))


def from_rank(rank: Column, order: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in order]), (rank + 1).cast("int"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, null where the denominator is absent, zero or negative."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def scope_contains(scope: Column, value: Column) -> Column:
    """An empty scope list admits every value."""
    return (F.size(scope) == 0) | F.array_contains(scope, value)


def scopes_intersect(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def periods_overlap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Half-open periods; a null end is open."""
    return (to_a.isNull() | (from_b < to_a)) & (to_b.isNull() | (from_a < to_b))


_DURATION = r"^([-+]?)P(?:([-+]?\d+)D)?(?:T(?:([-+]?\d+)H)?(?:([-+]?\d+)M)?(?:([-+]?\d+(?:\.\d+)?)S)?)?$"


def parse_duration(text: str) -> timedelta:
    """ISO-8601 day/time duration; years, months and weeks are not accepted."""
    match = re.match(_DURATION, text.upper())
    if not match or text.upper().rstrip("T") in ("P", "-P", "+P"):
        raise ValueError(f"not a day/time duration: {text}")
    sign, days, hours, minutes, seconds = match.groups()
    value = timedelta(days=int(days or 0), hours=int(hours or 0), minutes=int(minutes or 0), seconds=float(seconds or 0))
    return -value if sign == "-" else value


def duration_seconds(text: Column) -> Column:
    """The same parse on a column, in seconds; null where the text is not such a duration."""
    upper = F.upper(text)

    def part(group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(upper, _DURATION, group), F.lit("")).cast("double"), F.lit(0.0))

    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    signed = F.when(F.regexp_extract(upper, _DURATION, 1) == "-", -total).otherwise(total)
    return F.when(upper.rlike(_DURATION) & ~upper.rlike(r"^[-+]?PT?$") & ~upper.endswith("T"), signed)


def age_days(since: Column, now: Column) -> Column:
    return F.datediff(now, since)


def percentage_change(previous: Column, current: Column) -> Column:
    return F.when(previous != 0, (current - previous) / F.abs(previous))
