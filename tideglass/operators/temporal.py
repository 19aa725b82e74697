"""Bitemporal tables: revisions, as-known, as-corrected, sequence and lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideglass.functions.scalars import micros
from tideglass.operators.ordered import running, with_previous


def point_in_time(
    asks: DataFrame, history: DataFrame, keys: list[str], ask_ts: str, knowledge: str, newest: list[str],
    cols: list[str], days: float = 30,
) -> DataFrame:
    """For each (key, T) the newest fact among those known at or before T, null when none was.

    ``newest`` orders facts, e.g. (effective_at, revision). Asks and facts are stacked and a running
    maximum is carried along knowledge time: one pass, no range join.
    """
    fact = F.struct(*[F.col(c) for c in dict.fromkeys([*newest, *cols])])
    ask = F.struct(*[F.col(c) for c in asks.columns])
    stacked = asks.select(*keys, F.col(ask_ts).alias("_at"), F.lit(1).alias("_side"), ask.alias("_ask")).unionByName(
        history.select(*keys, F.col(knowledge).alias("_at"), F.lit(0).alias("_side"), fact.alias("_fact")),
        allowMissingColumns=True,
    )
    known = running(stacked, keys, "_at", ["_side"], {"_known": ("max", "_fact")}, days=days)
    return known.filter("_side = 1").select("_ask.*", *[F.col(f"_known.{c}").alias(c) for c in cols])


def as_corrected(history: DataFrame, fact_keys: list[str], revision: str, cols: list[str]) -> DataFrame:
    """The last revision of every fact, whenever it became known."""
    newest = F.max_by(F.struct(revision, *cols), F.col(revision))
    return history.groupBy(*fact_keys).agg(newest.alias("_n")).select(*fact_keys, "_n.*")


def known_versus_corrected(history: DataFrame, fact_keys: list[str], revision: str, knowledge: str, value: str, at: Column) -> DataFrame:
    """Facts whose value as known at a moment differs from the corrected one; one aggregation, no join."""
    known = F.when(F.col(knowledge) <= at, F.col(revision))
    both = history.groupBy(*fact_keys).agg(
        F.max_by(value, known).alias("known_value"), F.max_by(value, F.col(revision)).alias("corrected_value")
    )
    return both.filter(~F.col("known_value").eqNullSafe(F.col("corrected_value")))


def number_revisions(history: DataFrame, fact_keys: list[str], knowledge: str, ties: list[str]) -> DataFrame:
    """Revision number in order of knowledge."""
    return running(history, fact_keys, knowledge, ties, {"revision_no": ("count", F.lit(1))}, days=365)


def emit_on_change(values: DataFrame, keys: list[str], ts: str, ties: list[str], value: str) -> DataFrame:
    moved = with_previous(values, keys, ts, ties, {"_before": value, "_seen": ts})
    return moved.filter(F.col("_seen").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_seen")


def sequence_check(events: DataFrame, keys: list[str], ts: str, ties: list[str], sequence: str) -> DataFrame:
    """STALE, DUPLICATE, OK or GAP against the highest sequence accepted before."""
    rows = running(events, keys, ts, ties, {"_top": ("max", sequence)}, include_current=False)
    s, top = F.col(sequence), F.col("_top")
    verdict = (
        F.when(top.isNull() | (s == top + 1), "OK").when(s < top, "STALE").when(s == top, "DUPLICATE").otherwise("GAP")
    )
    return rows.withColumn("sequence_state", verdict).drop("_top")


def late_class(event_time: Column, known: Column, grace_hours: float, actionable_hours: float, history_hours: float) -> Column:
    """L1 in grace, L2 late but actionable, L3 history only, L4 to reconcile."""
    hours = (micros(known) - micros(event_time)) / 3_600_000_000
    return (
        F.when(event_time.isNull() | known.isNull() | (hours < 0), "L4")
        .when(hours <= grace_hours, "L1").when(hours <= actionable_hours, "L2")
        .when(hours <= history_hours, "L3").otherwise("L4")
    )


def apply_reversals(facts: DataFrame, reversals: DataFrame, fact_id: str) -> DataFrame:
    """Facts with the time their reversal became known; the fact itself is kept."""
    known = reversals.groupBy("reversal_of").agg(F.min("knowledge_time").alias("reversed_at"))
    return facts.join(known.withColumnRenamed("reversal_of", fact_id), fact_id, "left")
