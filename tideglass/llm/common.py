"""Helpers shared by the document operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tideglass.session import new_path, shared_dir

#: Bytes of text that one vectorised step holds, but for a single longer document.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the cluster's shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each with at most ``most`` bytes unless one text alone is longer."""
    ends = np.cumsum(text_lengths(column))
    at = 0
    while at < len(column):
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield at, to
        at = to


def text_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array and the offsets that part them (null: empty)."""
    filled = pc.fill_null(column, "")
    _, ends, data = filled.buffers()
    if ends is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    offsets = np.frombuffer(ends, kind)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieced(df: DataFrame, column: str, pieces: int, name: str = "_piece") -> DataFrame:
    """Adds the piece of each row: its place among sampled quantiles of a number column, null as the smallest."""
    cuts = np.array(sorted(set(df.stat.approxQuantile(column, [i / pieces for i in range(1, pieces)], 1 / (4 * pieces)))))

    @F.pandas_udf("int")
    def piece(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(), "right").astype(np.int32))

    # Beyond 2^53 neighbours may round to one number, so they share a piece; the order within it is exact.
    return df.withColumn(name, piece(F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", weight: str | None = None, pieces: int | None = None) -> DataFrame:
    """Exact 0-based place of each row within its ``keys``, by ``order``, as column ``name``.

    The rows are cut at sampled quantiles of the first order column (the cuts move work, not results), counted per
    (keys, piece), and numbered within their piece from the sum of the pieces before. So a key that holds most rows is
    spread over all pieces; one value of the order column stays together. ``weight`` names a column to add up too: the
    sum before the row comes as ``<name>_weight``.
    """
    rows = pieced(df, order[0], pieces or 4 * partitions(df))
    counts = rows.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), *([F.sum(weight).alias("_w")] if weight else []))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_wstart")] if weight else []))
    within = Window.partitionBy(*keys, "_piece").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumn("_row", F.row_number().over(within) - 1)
    if weight:
        rows = rows.withColumn("_wrow", F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col("l._piece") == F.col("r._piece")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = rows.alias("l").join(starts.alias("r"), on)
    out = [F.col(f"l.{c}").alias(c) for c in df.columns] + [(F.col("r._start") + F.col("l._row")).cast("bigint").alias(name)]
    if weight:
        out.append((F.col("r._wstart") + F.col("l._wrow")).cast("bigint").alias(f"{name}_weight"))
    return joined.select(*out)


def letters_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
