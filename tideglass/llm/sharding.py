"""Range shards of near-equal bytes from sampled splitters.

Rows are ordered by key, the first 60 bits of the text's MD5, then by id, so equal texts lie side by side. Splitters are
quantiles of a sample of (key, id), drawn with a chance in proportion to a row's size; ranges that turn out overfull
get splitters of their own, drawn from their rows, until no range is overfull or its rows are all alike. Bytes and
rows are then counted per range, exactly, and within a range by a running sum; shard ``s`` takes the rows whose bytes
before them lie in the ``s``-th part of all bytes. So shards differ by less than two rows' sizes for every sample drawn:
the sample moves work, never results. Equal texts part only where a shard is full.

Only (id, size, checksum, key) are shuffled, never the texts. The sample and the ranges are bounded by
``ranges`` (at least 256 and four times the shuffle partitions) and 32 draws a range. A null text is empty; null ids come
first; repeated rows may take each other's places; an empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.llm.common import partitions, written

DRAWS = 32


def key_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key_of(F.col(text_col)).alias("key"),
    )


def _draw(rows: DataFrame, share: float, seed: int) -> list[tuple[int, int]]:
    """(key, id) of rows taken with chance size * share; a null id counts as the smallest."""
    u = (F.xxhash64("key", "id", F.lit(seed)).bitwiseAND(2**53 - 1)) / float(2**53)
    got = rows.filter(u < F.col("size") * share).select("key", F.coalesce("id", F.lit(-(2**63))).alias("id")).collect()
    return sorted((r.key, r.id) for r in got)


def _quantiles(sample: list[tuple[int, int]], pieces: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * i // pieces] for i in range(1, pieces)}) if sample else []


def in_ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: the number of splitters at or before the row."""
    keys, ids = np.array([k for k, _ in splitters], np.int64), np.array([i for _, i in splitters], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            number = pc.fill_null(batch.column(batch.schema.get_field_index("id")), -(2**63)).to_numpy(zero_copy_only=False)
            low, at = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for a, b in {*zip(low[at > low].tolist(), at[at > low].tolist(), strict=True)}:
                same = (low == a) & (at == b)
                at[same] = a + np.searchsorted(ids[a:b], number[same], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{kinds}, range int")


def find_splitters(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    splitters = _quantiles(_draw(rows, DRAWS * ranges / total, 0), ranges)
    fair, seed = total / ranges, 0
    while True:
        seed += 1
        placed = in_ranges(rows, splitters)
        over = placed.groupBy("range").agg(F.sum("size").alias("size")).filter(F.col("size") > 3 * fair).collect()
        fresh: set[tuple[int, int]] = set()
        for r in over:
            pieces = int(-(-r.size // fair))
            fresh |= set(_quantiles(_draw(placed.filter(F.col("range") == r["range"]), DRAWS * pieces / r.size, seed), pieces))
        if fresh <= set(splitters):
            return splitters
        splitters = sorted({*splitters, *fresh})


def range_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, key, shard (from 0), slot (from 0, without gaps)."""
    ranges = ranges or max(256, 4 * partitions(docs))
    rows = written(_rows(docs, id_col, text_col), "shard-rows")
    placed = in_ranges(rows, find_splitters(rows, ranges))
    counted = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    by_key = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_first())
    ranked = placed.withColumn("_row", F.row_number().over(by_key) - 1).withColumn("_bytes", F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # One row for each range: bounded by the number of ranges.
    at = ranked.join(F.broadcast(starts), "range").select(
        "id", "size", "text_crc32", "key", (F.col("row0") + F.col("_row")).alias("_at"),
        F.expr(f"CAST(((byte0 + _bytes) * {shards}) DIV total AS INT)").alias("shard"),
    )
    at = written(at, "shard-places")
    firsts = at.groupBy("shard").agg(F.min("_at").alias("_first"))
    return at.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "key", "shard", (F.col("_at") - F.col("_first")).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 1) -> None:
    """Writes the documents with all their columns below ``path``, a folder for each shard.

    A row's shard follows from the first (key, id) of each shard, so the texts are shuffled once and joined with nothing.
    """
    made = range_shards(docs, shards, id_col, text_col)
    firsts = [(r.shard, r.k.key, r.k.id) for r in made.groupBy("shard").agg(F.min(F.struct("key", F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"))).alias("k")).collect()]
    key, number = key_of(F.col(text_col)), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    # A name that no column of the input has, in either case.
    shard = "shard"
    while shard in {c.lower() for c in docs.columns}:
        shard = f"_{shard}"
    place = F.coalesce(*[F.when((key > k) | ((key == k) & (number >= i)), F.lit(s)) for s, k, i in sorted(firsts, reverse=True)], F.lit(0))
    docs.withColumn(shard, place).repartition(shards * files_per_shard, shard, F.pmod(F.xxhash64(F.col(id_col)), F.lit(files_per_shard))).write.partitionBy(shard).parquet(path)
