"""Robust baselines of a key's own history from mergeable sketches.

A block of ``block_days`` of a key is a sketch: how often each leading-digit class of a whole number occurs in it. Sketches
merge by adding counts, so the baseline of a block, over the ``blocks`` blocks before it, is a sum of sketches, however many rows they stand
for. From it come the lower median and the median absolute deviation.

Stated error: a class stands for its middle, so with ``digits`` leading digits a value is off by at most 0.5 * 10**(1 - digits) of its size
(0.5 % for three), and exact below 10**digits. The median has the same relative error. The deviation is off by at most twice that share of the larger of the
median and of the value it belongs to. A sketch has at most 1.8 * 10**digits classes per power of ten.

Null values and rows without a time are in no sketch; null keys are a key of their own. Repeated rows count each time. A block with no
earlier rows has n = 0 and no median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.functions.scalars import days_us, floor_div, micros
from tideglass.operators.ordered import join_null_safe, with_previous

#: 3.5 robust standard deviations (of 1.4826 median absolute deviations each), in hundredths of a deviation.
FAR = 519


def leading(value: Column, digits: int = 3) -> Column:
    """The middle of a whole number's class: numbers of the same sign, length and first ``digits`` digits."""
    size = F.abs(value)
    unit = F.pow(F.lit(10.0), F.greatest(F.length(size.cast("string")) - digits, F.lit(0))).cast("bigint")
    return F.signum(value).cast("bigint") * (floor_div(size, unit) * unit + floor_div(unit, 2))


def block_of(ts: str | Column, block_days: int) -> Column:
    return floor_div(micros(ts), F.lit(days_us(block_days)).cast("bigint"))


def robust_baseline(points: DataFrame, keys: list[str], ts: str, value: str, block_days: int = 30, blocks: int = 12, digits: int = 3) -> DataFrame:
    """One row per key and block that has rows: ``block``, ``n``, ``median`` and ``deviation`` of the ``blocks`` blocks before it."""
    placed = points.select(*keys, block_of(ts, block_days).alias("block"), leading(F.col(value).cast("bigint"), digits).alias("_v")).filter("block IS NOT NULL")
    sketch = placed.groupBy(*keys, "block", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # A block's sketch goes to itself, which only marks that the block is asked for, and to the blocks that look back at it.
    reach = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks)), lambda i: F.struct(i.alias("ahead"), (F.col("block") + i).alias("block"))))
    spread = sketch.select(*keys, "_v", "_n", reach.alias("_to"))
    merged = spread.groupBy(*keys, F.col("_to.block").alias("block"), "_v").agg(
        F.sum(F.when((F.col("_to.ahead") > 0) & F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).alias("_n"), F.max((F.col("_to.ahead") == 0).cast("int")).alias("_asked")
    )
    whole = Window.partitionBy(*keys, "block")
    half = lambda order: 2 * F.sum("_n").over(whole.orderBy(order)) >= F.col("n")
    ranked = merged.withColumn("n", F.sum("_n").over(whole)).withColumn("_asked", F.max("_asked").over(whole)).filter("_asked = 1")
    ranked = ranked.withColumn("_low", half(F.col("_v").asc_nulls_first())).withColumn("median", F.min(F.when(F.col("_low") & (F.col("_n") > 0), F.col("_v"))).over(whole))
    ranked = ranked.withColumn("_off", F.when(F.col("_n") > 0, F.abs(F.col("_v") - F.col("median"))))
    ranked = ranked.withColumn("_near", half(F.col("_off").asc_nulls_first()))
    return ranked.groupBy(*keys, "block").agg(
        F.max("n").alias("n"), F.max("median").alias("median"), F.min(F.when(F.col("_near") & (F.col("_n") > 0), F.col("_off"))).alias("deviation")
    )


def against_baseline(points: DataFrame, keys: list[str], ts: str, value: str, block_days: int = 30, blocks: int = 12, digits: int = 3) -> DataFrame:
    """Rows with ``n``, ``median`` and ``deviation`` of their block; the join's small side has one row per key and block."""
    base = robust_baseline(points, keys, ts, value, block_days, blocks, digits)
    return join_null_safe(points.withColumn("block", block_of(ts, block_days)), base, [*keys, "block"], "left").drop("block")


def against_sparse_baseline(points: DataFrame, keys: list[str], ts: str, value: str, block_days: int = 30, blocks: int = 12, digits: int = 3) -> DataFrame:
    """``against_baseline`` for keys with at most a few rows a day, so that the calendar bounds a block: no class is sent to the blocks ahead.

    The rows of a block become one row, which reads the values of the blocks before it in one pass over the key: rows that lie
    together by key are not moved again, and a key has one row a block.
    """
    small = leading(F.col(value).cast("bigint"), digits)
    held = points.withColumn("block", block_of(ts, block_days)).groupBy(*keys, "block").agg(
        F.collect_list(F.struct(*[F.col(c) for c in points.columns if c not in keys])).alias("_rows"), F.collect_list(small).alias("_vs")
    )
    before = Window.partitionBy(*keys).orderBy("block").rangeBetween(-blocks, -1)
    past = held.withColumn("_past", F.when(F.col("block").isNotNull(), F.sort_array(F.flatten(F.collect_list("_vs").over(before)))))
    middle = lambda values: F.when(F.size(values) > 0, F.element_at(values, F.greatest((F.size(values) + 1).cast("int") / 2, F.lit(1)).cast("int")))
    past = past.withColumn("median", middle(F.col("_past")))
    past = past.withColumn("deviation", middle(F.sort_array(F.transform("_past", lambda v: F.abs(v - F.col("median"))))))
    n = F.when(F.col("block").isNotNull(), F.size("_past")).cast("bigint").alias("n")
    rows = past.select(*keys, n, "median", "deviation", F.explode("_rows").alias("_row"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in points.columns], "n", "median", "deviation")


def _width(least: Column) -> Column:
    """A deviation that is never zero: at least a hundredth of the median, and at least ``least``."""
    return F.greatest("deviation", floor_div(F.abs("median"), 100), least)


def unusual_transfers(transfers: DataFrame, minimum: int = 5, far: int = FAR, new_far: int = 200) -> DataFrame:
    """Transfers far above the payer's own past amounts; less far is enough for a beneficiary the payer never paid before.

    ``transfers``: transfer_id, payer_id, beneficiary_id, event_time, cents. Levels are hundredths of a deviation above the median.
    """
    first = with_previous(transfers, ["payer_id", "beneficiary_id"], "event_time", ["transfer_id"], {"_before": "transfer_id"}, days=365)
    rows = against_baseline(first.withColumn("new_beneficiary", F.col("_before").isNull()).drop("_before"), ["payer_id"], "event_time", "cents")
    above = 100 * (F.col("cents") - F.col("median"))
    width = _width(F.lit(1).cast("bigint"))
    hit = (F.col("n") >= minimum) & ((above >= far * width) | (F.col("new_beneficiary") & (above >= new_far * width)))
    return rows.filter(hit).withColumn("signal_type", F.lit("LARGE_UNUSUAL_TRANSFER"))


def pattern_anomalies(movements: DataFrame, block_days: int = 30, minimum: int = 4, far: int = FAR, least: int = 50) -> DataFrame:
    """Blocks whose share of debits, in thousandths of the turnover, lies far from the account's own past shares, either way.

    ``movements``: account_id, event_time, cents (debits negative). ``least`` is the smallest deviation counted, in thousandths.
    """
    length = days_us(block_days)
    total = movements.groupBy("account_id", block_of("event_time", block_days).alias("_blk")).agg(
        F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("_debit"), F.sum(F.abs("cents")).alias("_all")
    ).filter("_all > 0 AND _blk IS NOT NULL")
    shares = total.select(
        "account_id", F.timestamp_micros(F.col("_blk") * length).cast("timestamp_ntz").alias("block_start"),
        floor_div(F.col("_debit") * 1000, F.col("_all")).alias("debit_share"),
    )
    rows = against_sparse_baseline(shares, ["account_id"], "block_start", "debit_share", block_days)
    off = 100 * F.abs(F.col("debit_share") - F.col("median"))
    return rows.filter((F.col("n") >= minimum) & (off >= far * _width(F.lit(least).cast("bigint")))).withColumn("signal_type", F.lit("DEBIT_CREDIT_PATTERN_ANOMALY"))


def balance_drains(movements: DataFrame, minimum: int = 5, left_percent: int = 20) -> DataFrame:
    """Days on which an account's closing balance falls to ``left_percent`` or less of its usual one, the median of past closing balances.

    ``movements``: account_id, event_time, cents. The balance starts at nothing; only accounts usually in credit can drain, and
    only the day of the fall counts: the closing balance before it was still above the level.
    """
    day = F.date_trunc("day", "event_time").cast("timestamp_ntz")
    daily = movements.filter("event_time IS NOT NULL").groupBy("account_id", day.alias("day")).agg(F.sum("cents").alias("_moved"))
    # An account has at most one row a day, so windows over it are bounded by the calendar.
    w = Window.partitionBy("account_id").orderBy("day")
    closing = daily.withColumn("balance", F.sum("_moved").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_moved")
    stepped = closing.withColumn("balance_before", F.lag("balance").over(w))
    rows = against_sparse_baseline(stepped, ["account_id"], "day", "balance")
    level = left_percent * F.col("median")
    hit = (F.col("n") >= minimum) & (F.col("median") > 0) & (100 * F.col("balance") <= level) & (100 * F.col("balance_before") > level)
    return rows.filter(hit).withColumn("signal_type", F.lit("ACCOUNT_BALANCE_DRAIN"))
