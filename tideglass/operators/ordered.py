"""Ordered per-key computations that do not put a hot key into one task.

A window partitioned by a key alone sends every row of that key to one task, and a sliding RANGE
frame re-aggregates its rows for each row. Here most keys are one group, and a hot key is cut into
blocks of the ordering column. Work inside a group is a running frame, one pass over sorted rows. What
a block needs from earlier blocks comes as one extra row at its start, built with map-side
aggregation; so there is one shuffle and one sort of the rows, and no join on the hot key.

Hot keys are those with at least ``spark.tideglass.hotRows`` rows (default one million), all of them, null keys
like any other. They are found inside the query itself: building it starts no job. Their number is at most rows / hotRows,
so they are broadcast, and rows that are cut move no more often than others; where none turn up, adaptive execution drops what
only hot keys need. A plan none of whose tables can hold so many rows keeps plain windows. Which keys are cut changes the work, never the result.

Several passes over the same keys go through ``by_heat``: usual keys then take one shuffle by key for all passes, and only hot keys are
cut anew for each. An operator's ``hot`` is what the job is given; without one, the operator finds its hot keys itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.functions.scalars import days_us, floor_div, micros

_BLK, _POS, _HOT, _ROW = "_blk", "_pos", "_hot", "_row"
_MERGE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; columns of the left, then those of the right that are no keys."""
    one, two = left.alias("_one"), right.alias("_two")
    on = [F.col(f"_one.{k}").eqNullSafe(F.col(f"_two.{k}")) for k in keys]
    return one.join(two, on, how).select(*[F.col(f"_one.{c}") for c in left.columns], *[F.col(f"_two.{c}") for c in right.columns if c not in keys])


#: No table keeps a row in less than this many bytes, compressed; columns of one value apart.
LEAST_ROW_BYTES = 16


def largest_table(df: DataFrame) -> int:
    """Bytes of the largest table that the rows come from, by the sizes of its files; no job is started."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    tables = [leaves.apply(i) for i in range(leaves.size())]
    # A reference to a common table expression has no size of its own; the tables of its definition are leaves too.
    return max((int(str(t.stats().sizeInBytes())) for t in tables if t.nodeName() != "CTERelationRef"), default=0)


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys that hold too many rows for one task, as a part of the query; None where no table is large enough to have any."""
    floor = int(df.sparkSession.conf.get("spark.tideglass.hotRows", "1000000"))
    if largest_table(df) < floor * LEAST_ROW_BYTES:
        return None
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= floor)
    return F.broadcast(large.select(*keys, F.lit(True).alias(_HOT)))


#: An operator given this finds the hot keys of its own rows.
FIND = "find"


def _hot_of(hot, df: DataFrame, keys: list[str]) -> DataFrame | None:
    return hot_keys(df, keys) if isinstance(hot, str) else hot


def _some_keys(df: DataFrame, chosen: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows whose key, null too, is (left_semi) or is not (left_anti) among the chosen ones."""
    one, two = df.alias("_one"), chosen.alias("_two")
    return one.join(two, [F.col(f"_one.{k}").eqNullSafe(F.col(f"_two.{k}")) for k in keys], how)


def by_heat(df: DataFrame, keys: list[str], job: Callable[[DataFrame, DataFrame | None], DataFrame], hot: DataFrame | str | None = FIND) -> DataFrame:
    """``job(rows, hot)`` over the rows of usual keys, with no hot keys, and over those of hot keys, with these.

    Of usual keys every pass of the job is a plain window by key, so they share one shuffle. Hot keys are counted once for all passes.
    """
    hot = _hot_of(hot, df, keys)
    if hot is None:
        return job(df, None)
    return job(_some_keys(df, hot, keys, "left_anti"), None).unionByName(job(_some_keys(df, hot, keys, "left_semi"), hot))


def _mark(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    return df.withColumn(_HOT, F.lit(None).cast("boolean")) if hot is None else join_null_safe(df, hot, keys, "left")


def _blocked(df: DataFrame, keys: list[str], hot: DataFrame | None, block: Column) -> DataFrame:
    """Add the block of each row: 0 for usual keys, ``block`` for hot ones."""
    if hot is None:
        return df.withColumn(_BLK, F.lit(0).cast("bigint"))
    return _mark(df, keys, hot).withColumn(_BLK, F.when(F.col(_HOT), block).otherwise(F.lit(0).cast("bigint")))


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn in ("count", "sum"):
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if fn == "max" else F.least(a, b)


def _value_of(fn: str, col: str | Column) -> Column:
    """What one row adds: itself, or 1 to a count if it is not null."""
    value = F.col(col) if isinstance(col, str) else col
    return F.when(value.isNotNull(), 1) if fn == "count" else value


def rolling(
    df: DataFrame,
    keys: list[str],
    ts: str,
    days: float,
    aggs: dict[str, tuple[str, str | Column]],
    blocks_per_window: int | None = None,
    per_event: bool = True,
    include_current: bool = True,
    hot: DataFrame | str | None = FIND,
) -> DataFrame:
    """Aggregates over the look-back [t - days, t] of every row, both ends included.

    ``aggs`` maps an output name to (count|sum|max|min, column). Time is cut into blocks, one look-back
    long for usual keys and a fraction of it for hot ones. The look-back ending at t is the tail of the
    block it starts in, the full blocks between, and the head of its own block: each is a running
    aggregate, so the cost per row does not depend on how many rows a look-back holds. With
    ``include_current=False`` the frame ends one microsecond before t. With ``per_event`` every row carries its
    columns through the one shuffle; otherwise rows are first reduced to one per (key, time), which is what returns.
    """
    cuts = blocks_per_window or max(1, int(days * 4))
    length = days_us(days)
    names = list(aggs)
    parts = []
    for name, (fn, col) in aggs.items():
        value = F.col(col) if isinstance(col, str) else col
        parts.append((F.count(value) if fn == "count" else _MERGE[fn](value)).alias(name))
    points = df.withColumn(_POS, micros(ts)).groupBy(*keys, _POS).agg(*parts)
    carried = []
    if per_event:
        types = {n: points.schema[n].dataType for n in names}
        each = [_value_of(fn, c).cast(types[n]).alias(n) for n, (fn, c) in aggs.items()]
        carried = ["_carried"]
        points = df.select(*keys, micros(ts).alias(_POS), *each, F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias("_carried"))
    hot = _hot_of(hot, df, keys)
    points = _mark(points, keys, hot)
    step = F.when(F.col(_HOT), F.lit(cuts)).otherwise(F.lit(1))
    # Hot blocks are numbered in units of length / cuts; the same integer arithmetic places the copies.
    points = points.withColumn("_step", step).withColumn(_BLK, floor_div(F.col(_POS) * F.col("_step"), F.lit(length).cast("bigint")))

    # Both of a row come from it in place, so rows that lie together by key already are not moved again.
    native = F.struct(F.col(_BLK), F.col(_POS), F.lit(0).alias(_ROW), *[F.col(c) for c in carried])
    leaving = F.struct((F.col(_BLK) + F.col("_step")).alias(_BLK), (F.col(_POS) + length).alias(_POS), F.lit(1).alias(_ROW), *[F.when(F.lit(False), F.col(c)).alias(c) for c in carried])
    rows = points.select(*keys, *names, F.inline(F.array(native, leaving)))
    if hot is not None and cuts > 1:
        per_block = points.filter(F.col(_HOT)).groupBy(*keys, _BLK).agg(*[_MERGE[aggs[n][0]](n).alias(n) for n in names])
        between = Window.partitionBy(*keys).orderBy(_BLK).rangeBetween(-(cuts - 1), -1)
        middle = per_block.select(
            *keys, _BLK, F.lit(-(2**62)).alias(_POS), *[_MERGE[aggs[n][0]](n).over(between).alias(n) for n in names], F.lit(2).alias(_ROW)
        )
        rows = rows.unionByName(middle, allowMissingColumns=True)

    group = Window.partitionBy(*keys, _BLK)
    head = group.orderBy(F.col(_POS).asc()).rangeBetween(Window.unboundedPreceding, 0 if include_current else -1)
    tail = group.orderBy(F.col(_POS).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for name in names:
        fn = aggs[name][0]
        own = _MERGE[fn](F.when(F.col(_ROW) != 1, F.col(name))).over(head)
        old = _MERGE[fn](F.when(F.col(_ROW) == 1, F.col(name))).over(tail)
        rows = rows.withColumn(f"_own_{name}", own).withColumn(f"_old_{name}", old)
        both = _combine(fn, F.col(f"_own_{name}"), F.col(f"_old_{name}"))
        out.append((F.coalesce(both, F.lit(0)) if fn == "count" else both).alias(name))
    rows = rows.filter(F.col(_ROW) == 0)
    if per_event:
        return rows.select(*[F.col(c) if c in keys else F.col(f"_carried.{c}").alias(c) for c in df.columns], *out)
    return rows.select(*keys, _POS, *out).withColumn(ts, F.timestamp_micros(_POS).cast(df.schema[ts].dataType)).drop(_POS)


def rolling_sums(df: DataFrame, keys: list[str], ts: str, days: list[int], cols: list[str], hot: DataFrame | str | None = FIND) -> DataFrame:
    """Sums of ``cols`` over the look-backs [t - d, t] of several lengths, in one pass: (keys, ts) are unique, and the columns exact numbers.

    A row adds its values at its time and takes them back from length d a microsecond after t + d. A sum is named ``<col>_<d>``; it is null
    where the look-back holds no value. Rows without a time or with a null key are left out.
    """
    rows = df.filter(F.col(ts).isNotNull() & F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()).select(*keys, micros(ts).alias("_us"), *cols)

    def job(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
        steps = F.array(
            F.struct(F.col("_us").alias("_at"), F.lit(0).alias("_of")), *[F.struct((F.col("_us") + days_us(d) + 1).alias("_at"), F.lit(i).alias("_of")) for i, d in enumerate(days, 1)]
        )
        # Rows of usual keys are moved before they are spread. At one time rows leave before the new one is read.
        spread = (rows.repartition(*keys) if hot is None else rows).select(*keys, *cols, F.inline(steps))
        spread = spread.withColumn(_POS, F.timestamp_micros("_at")).withColumn("_last", (F.col("_of") == 0).cast("int"))
        aggs = {}
        for i, d in enumerate(days, 1):
            part = lambda value: F.when(F.col("_of") == 0, value).when(F.col("_of") == i, -value)  # noqa: B023, E731
            for c in cols:
                aggs[f"{c}_{d}"] = ("sum", part(F.col(c)))
                aggs[f"_n_{c}_{d}"] = ("sum", part(F.when(F.col(c).isNotNull(), F.lit(1).cast("bigint"))))
        found = running(spread, keys, _POS, ["_last", "_of"], aggs, days=max(days), hot=hot).filter("_of = 0")
        sums = [F.when(F.col(f"_n_{c}_{d}") > 0, F.col(f"{c}_{d}")).alias(f"{c}_{d}") for d in days for c in cols]
        return found.select(*keys, F.col(_POS).cast(df.schema[ts].dataType).alias(ts), *sums)

    return by_heat(rows, keys, job, hot)


def _last_of_block_before(rows: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """One row per block of a hot key, carrying the last value of the block before it."""
    ends = rows.filter(F.col(_HOT)).groupBy(*keys, _BLK).agg(last.alias("_value"))
    before = F.lag("_value").over(Window.partitionBy(*keys).orderBy(_BLK))
    return ends.select(*keys, _BLK, before.alias("_value"), F.lit(-1).alias(_ROW)).filter(F.col("_value").isNotNull())


def with_previous(
    df: DataFrame, keys: list[str], ts: str, ties: list[str], cols: dict[str, str], days: float = 7, hot: DataFrame | str | None = FIND
) -> DataFrame:
    """Values of ``cols`` (output name -> column) on the row before this one in (ts, ties) order.

    ``days`` is the block width of hot keys.
    """
    value = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    hot = _hot_of(hot, df, keys)
    block = floor_div(micros(ts), F.lit(days_us(days)).cast("bigint"))
    rows = _blocked(df, keys, hot, block).withColumn("_value", value).withColumn(_ROW, F.lit(0))
    if hot is not None:
        rows = rows.unionByName(_last_of_block_before(rows, keys, F.max_by("_value", F.struct(ts, *ties))), allowMissingColumns=True)
    group = Window.partitionBy(*keys).orderBy(ts, *ties) if hot is None else Window.partitionBy(*keys, _BLK).orderBy(_ROW, ts, *ties)
    out = rows.withColumn("_prev", F.lag("_value").over(group))
    return out.filter(F.col(_ROW) == 0).select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in cols])


def running(
    df: DataFrame,
    keys: list[str],
    ts: str,
    ties: list[str],
    aggs: dict[str, tuple[str, str | Column]],
    days: float = 7,
    include_current: bool = True,
    hot: DataFrame | str | None = FIND,
) -> DataFrame:
    """Aggregates of all rows of the key up to this one in (ts, ties) order.

    ``aggs`` maps an output name to (count|sum|max|min|last, column); ``last`` is the newest non-null
    value. Struct columns work with max, min and last. ``days`` is the block width of hot keys.
    """
    hot = _hot_of(hot, df, keys)
    rows = _blocked(df, keys, hot, floor_div(micros(ts), F.lit(days_us(days)).cast("bigint"))).withColumn(_ROW, F.lit(0))
    order = F.struct(ts, *ties)
    for name, (fn, col) in aggs.items():
        value = F.col(col) if isinstance(col, str) else col
        rows = rows.withColumn(f"_v_{name}", F.when(value.isNotNull(), F.lit(1).cast("bigint")) if fn == "count" else value)

    def whole(name: str, fn: str) -> Column:
        v = F.col(f"_v_{name}")
        return F.max_by(v, F.when(v.isNotNull(), order)) if fn == "last" else _MERGE[fn](v)

    def over(name: str, fn: str, frame) -> Column:
        v = F.col(f"_v_{name}")
        return (F.last(v, ignorenulls=True) if fn == "last" else _MERGE[fn](v)).over(frame)

    out = rows
    if hot is not None:
        blocks = rows.filter(F.col(_HOT)).groupBy(*keys, _BLK).agg(*[whole(n, fn).alias(f"_v_{n}") for n, (fn, _) in aggs.items()])
        earlier = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        starts = blocks.select(
            *keys, _BLK, F.lit(-1).alias(_ROW), *[over(n, fn, earlier).alias(f"_v_{n}") for n, (fn, _) in aggs.items()]
        )
        out = rows.unionByName(starts, allowMissingColumns=True)
    order_of = Window.partitionBy(*keys).orderBy(ts, *ties) if hot is None else Window.partitionBy(*keys, _BLK).orderBy(_ROW, ts, *ties)
    within = order_of.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    for name, (fn, _) in aggs.items():
        out = out.withColumn(f"_o_{name}", over(name, fn, within))
    final = [
        (F.coalesce(F.col(f"_o_{n}"), F.lit(0)) if fn == "count" else F.col(f"_o_{n}")).alias(n) for n, (fn, _) in aggs.items()
    ]
    return out.filter(F.col(_ROW) == 0).select(*df.columns, *final)


def stack(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, cols: list[str], right_ties: list[str]) -> DataFrame:
    """Both sides of an as-of join as rows of one table, for ``carry``."""
    payload_l = F.struct(*[F.col(c) for c in left.columns if c not in keys]) if set(left.columns) - set(keys) else F.struct(F.lit(1))
    payload_r = F.struct(*[F.col(c) for c in cols])
    tie = F.struct(*[F.col(c) for c in right_ties])
    return left.select(*keys, F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), payload_l.alias("_l")).unionByName(
        right.select(
            *keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), tie.alias("_tie"), payload_r.alias("_r")
        ),
        allowMissingColumns=True,
    )


def carry(stacked: DataFrame, keys: list[str], columns: list[str], cols: list[str], days: float = 7, hot: DataFrame | str | None = FIND) -> DataFrame:
    """Left rows of a stack, with their ``columns`` and the last right-hand ``cols``."""
    filled = running(stacked, keys, "_at", ["_side", "_tie"], {"_hit": ("last", "_r")}, days=days, hot=hot)
    own = [F.col(c) if c in keys else F.col(f"_l.{c}").alias(c) for c in columns]
    return filled.filter("_side = 1").select(*own, *[F.col(f"_hit.{c}").alias(c) for c in cols])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    cols: list[str],
    right_ties: list[str],
    days: float = 7,
    then: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    hot: DataFrame | str | None = FIND,
) -> DataFrame:
    """Newest right-hand values at or before each left row, null where there is none yet.

    Both sides are stacked and the last right-hand row is carried forward; nothing is multiplied. ``then(rows, hot)`` goes on
    with the rows of usual and of hot keys apart, see ``by_heat``.
    """
    stacked = stack(left, right, keys, left_ts, right_ts, cols, right_ties)

    def job(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
        found = carry(rows, keys, left.columns, cols, days, hot)
        return found if then is None else then(found, hot)

    return by_heat(stacked, keys, job, hot)


def sessions(
    df: DataFrame, keys: list[str], ts: str, gap_days: float, aggs: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Group rows of a key whose neighbours are at most ``gap_days`` apart.

    Returns (rows with session_start, one row per session with ``aggs``). Blocks are no wider than the
    gap, so a block always lies inside one session, and sessions are found from one row per block:
    a key has as many of them as the calendar allows, however many rows it has.
    """
    gap = days_us(gap_days)
    rows = df.withColumn(_BLK, floor_div(micros(ts), F.lit(gap).cast("bigint")))
    extents = rows.groupBy(*keys, _BLK).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    by_block = Window.partitionBy(*keys).orderBy(_BLK)
    starts = extents.withColumn(
        "_new", F.coalesce(micros("_first") - F.lag(micros("_last")).over(by_block) > gap, F.lit(True)),
    ).select(
        *keys, _BLK,
        F.last(F.when(F.col("_new"), F.col("_first")), ignorenulls=True)
        .over(by_block.rowsBetween(Window.unboundedPreceding, 0)).alias("session_start"),
    )
    tagged = join_null_safe(rows, starts, [*keys, _BLK], "left").drop(_BLK)
    return tagged, tagged.groupBy(*keys, "session_start").agg(*aggs)


def ranked_values(df: DataFrame, keys: list[str], value: str, pieces: int = 256) -> DataFrame:
    """Distinct values of each key with n (rows), below (rows with a smaller value) and total.

    Keys with many distinct values are cut at approximate quantiles; these only choose the block
    borders, the counts are exact.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    number = F.col(value).cast("double")
    hot = hot_keys(counts, keys)
    within = Window.partitionBy(*keys, _BLK).orderBy(_ROW, value).rowsBetween(Window.unboundedPreceding, -1)
    if hot is None:
        placed = counts.withColumn(_BLK, F.lit(0)).withColumn(_ROW, F.lit(0))
    else:
        marked = _mark(counts, keys, hot)
        borders = marked.filter(F.col(_HOT)).groupBy(*keys).agg(
            F.percentile_approx(number, [i / pieces for i in range(1, pieces)], 10000).alias("_cut")
        )
        rows = join_null_safe(marked, borders, keys, "left").withColumn(
            _BLK, F.when(F.col("_cut").isNull(), 0).otherwise(F.size(F.filter("_cut", lambda c: c < number)))
        ).drop("_cut").withColumn(_ROW, F.lit(0))
        blocks = rows.filter(F.col(_HOT)).groupBy(*keys, _BLK).agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        starts = blocks.select(*keys, _BLK, F.lit(-1).alias(_ROW), F.sum("n").over(earlier).alias("n"))
        placed = rows.unionByName(starts, allowMissingColumns=True)
    placed = placed.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return join_null_safe(placed.filter(F.col(_ROW) == 0), totals, keys).select(*keys, value, "n", "below", "total")


def exact_median(ranked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median per key from ``ranked_values``: the mean of the two middle rows."""
    lo, hi = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("n"))
    v = F.col(value).cast("double")
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lo), v)) + F.max(F.when(holds(hi), v))) / 2).alias("median_value")
    )
