"""Idempotent writes to Parquet tables.

A Parquet folder has no keyed update, so a table is a set of immutable batches and its current
content is a view over them. Replaying a batch rewrites the same batch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch under its own id; a repeat replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_per_key(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Last write wins: a mergeable aggregate, so a key with many writes is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("_r")).select(*keys, "_r.*")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key; existing rows are never touched."""
    others = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return first.join(existing.select(key), key, "left_anti").select(*incoming.columns)
