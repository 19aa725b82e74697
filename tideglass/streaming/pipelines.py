"""Streaming reads, windows, routing, sinks and replay. All operators take a DataFrame as source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideglass.operators.ordered import asof, rolling
from tideglass.session import new_path
from tideglass.sources import sinks


def file_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 16) -> DataFrame:
    """Stream of a Parquet table below a folder, typed like the table and bounded per trigger."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    )


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", partitions: list[str] | None = None) -> str:
    """Drain the stream into a new Parquet folder with its own checkpoint; returns the folder."""
    path = new_path(df.sparkSession, name)
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return path


def run_batches(df: DataFrame, name: str, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    where = checkpoint or f"{new_path(df.sparkSession, name)}-checkpoint"
    df.writeStream.foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def graced(df: DataFrame, ts: str, grace: str = "1 hour") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, grace)


def deduplicated(df: DataFrame, ids: list[str]) -> DataFrame:
    """First arrival per identity inside the watermark; never by payload."""
    return df.dropDuplicatesWithinWatermark(ids)


def tumbling_counts(df: DataFrame, keys: list[str], ts: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def session_counts(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("opened_at"), F.max(ts).alias("last_activity_at")
    ).drop("w")


def rolling_batches(
    stream: DataFrame, keys: list[str], ts: str, event_id: str, days: float, aggs: dict[str, tuple[str, str]], name: str
) -> DataFrame:
    """Exact per-event look-backs on a stream, with the batch operator in every trigger.

    A trigger appends its rows to the retained history (split by date) and recomputes the rows it
    can change: those of its keys from its earliest row until one look-back after its latest. A late row thus
    emits new revisions of later rows; the revision of a row is the trigger that wrote it. Hot keys
    are cut into blocks by the operator instead of living in one state store partition.
    """
    spark = stream.sparkSession
    history, results = new_path(spark, f"{name}-history"), new_path(spark, f"{name}-results")
    span = F.expr(f"INTERVAL {int(days * 86400)} SECONDS")

    def each(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("event_date", F.to_date(ts))
        dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{history}/batch_id={batch_id}")
        mine = spark.read.parquet(f"{history}/batch_id={batch_id}").drop("event_date")
        # One row: the time span of the trigger.
        low, high = mine.agg(F.min(ts), F.max(ts)).first()
        if low is None:
            return
        low, high = F.lit(low), F.lit(high)
        kept = spark.read.parquet(history).filter(F.col("batch_id") <= batch_id)
        kept = kept.filter((F.col("event_date") >= F.to_date(low - span)) & (F.col("event_date") <= F.to_date(high + span)))
        kept = kept.join(mine.select(*keys).distinct(), keys, "left_semi").drop("batch_id", "event_date")
        out = rolling(kept, keys, ts, days, aggs).filter((F.col(ts) >= low) & (F.col(ts) <= high + span))
        out.select(*keys, event_id, ts, *aggs).withColumn("revision", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{results}/batch_id={batch_id}"
        )

    run_batches(stream, name, each)
    revisions = spark.read.parquet(results).drop("batch_id")
    return sinks.latest_per_key(revisions, [event_id], ["revision"])


def upsert_stream(stream: DataFrame, name: str, keys: list[str], newest: list[str], deliveries: int = 1) -> DataFrame:
    """Last write wins; batches are stored under their id, so a repeated delivery changes nothing."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    for _ in range(deliveries):
        run_batches(stream, name, lambda batch, batch_id: sinks.write_batch(batch, path, batch_id))
    return sinks.latest_per_key(spark.read.parquet(path).drop("batch_id"), keys, newest)


def append_revisions(stream: DataFrame, name: str) -> str:
    """Corrections are further rows; nothing written before is changed."""
    path = new_path(stream.sparkSession, name)
    run_batches(stream, name, lambda batch, batch_id: sinks.write_batch(batch, path, batch_id))
    return path


def route_late(stream: DataFrame, late_class: Column, name: str) -> dict[str, str]:
    """Split by lateness before any watermark can drop rows; returns the folder of each route."""
    spark = stream.sparkSession
    live, late = new_path(spark, f"{name}-live"), new_path(spark, f"{name}-late")

    def each(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("late_class", late_class)
        sinks.write_batch(marked.filter("late_class = 'L1'"), live, batch_id)
        sinks.write_batch(marked.filter("late_class <> 'L1'"), late, batch_id)

    run_batches(stream, name, each)
    return {"live": live, "late": late}


class Runs:
    """Runs of one job over a history, each with a checkpoint and results of its own.

    ``LIVE`` is the official lineage. ``RECOVERY`` goes on with its checkpoint and its results after a failure: a batch that was written
    but not committed is written again under its number. All other modes (``REBUILD``, ``BACKFILL``, ``COUNTERFACTUAL``, ``AS_CORRECTED``)
    need a run id that was not used before, start from nothing and write below their own (mode, run), so no run can touch the official results.
    """

    OWN = ("REBUILD", "BACKFILL", "COUNTERFACTUAL", "AS_CORRECTED")

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.used = spark, new_path(spark, name), set()

    def run(self, stream: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, run_id: str, fail_at: int | None = None) -> None:
        """Drains the stream through the job. ``fail_at`` breaks off in that batch, after its results are written and before they are committed."""
        if mode in ("LIVE", "RECOVERY"):
            lineage = "LIVE"
            if mode == "RECOVERY" and "LIVE" not in {m for m, _ in self.used}:
                raise ValueError("there is no live run to recover")
            run_id = "LIVE"
        elif mode not in self.OWN:
            raise ValueError(f"unknown mode {mode}")
        elif not run_id.strip() or (mode, run_id) in self.used:
            raise ValueError("processing outside LIVE needs a run id of its own")
        else:
            lineage = mode
        self.used.add((lineage, run_id))
        path = f"{self.root}/execution_mode={lineage}/run_id={run_id}"

        def each(batch: DataFrame, batch_id: int) -> None:
            sinks.write_batch(job(batch), path, batch_id)
            if batch_id == fail_at:
                raise RuntimeError(f"broken off in batch {batch_id}")

        run_batches(stream, "run", each, f"{self.root}-checkpoints/{lineage}/{run_id}")

    def results(self, mode: str, run_id: str) -> DataFrame:
        lineage, run_id = ("LIVE", "LIVE") if mode in ("LIVE", "RECOVERY") else (mode, run_id)
        rows = self.spark.read.parquet(f"{self.root}/execution_mode={lineage}/run_id={run_id}").drop("batch_id")
        return rows.withColumn("execution_mode", F.lit(mode)).withColumn("run_id", F.lit(run_id))

    def compared(self, run: tuple[str, str], keys: list[str], values: list[str]) -> DataFrame:
        """Rows whose values differ between the official results and a run, missing ones included."""
        live = self.results("LIVE", "").select(*keys, F.struct(*values).alias("live"))
        other = self.results(*run).select(*keys, F.struct(*values).alias("other"))
        joined = live.join(other, keys, "full").filter(~F.col("live").eqNullSafe(F.col("other")))
        side = F.when(F.col("other").isNull(), "ONLY_LIVE").when(F.col("live").isNull(), "ONLY_RUN").otherwise("CHANGED")
        return joined.select(*keys, side.alias("difference"), *[F.col(f"live.{v}").alias(f"live_{v}") for v in values], *[F.col(f"other.{v}").alias(f"run_{v}") for v in values])


def replay(rows: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, run_id: str, name: str) -> str:
    """Run a job over a whole table at once into its own (mode, run) partition; a run without an id is refused."""
    if mode != "LIVE" and not run_id.strip():
        raise ValueError("processing outside LIVE needs a run id")
    path = new_path(rows.sparkSession, name)
    out = job(rows).withColumn("execution_mode", F.lit(mode)).withColumn("run_id", F.lit(run_id))
    out.write.mode("append").partitionBy("execution_mode", "run_id").parquet(path)
    return path


#: Rows of a delivered slice that one file takes.
FILE_ROWS = 1_000_000


def deliveries(df: DataFrame, arrived: Column, name: str, slices: int = 4) -> tuple[str, int]:
    """Writes a table as files in the order its rows arrive, slice after slice; returns the folder and the files of a slice.

    A slice is a stretch of arrival time, so slices overlap in event time by the delays. A stream that takes one slice's files a
    trigger sees the rows as they would have come.
    """
    path, rows = new_path(df.sparkSession, name), df.withColumn("_arrived", F.unix_micros(arrived.cast("timestamp")))
    low, high, n = rows.agg(F.min("_arrived"), F.max("_arrived"), F.count(F.lit(1))).first()
    files = max(1, -(-n // (slices * FILE_ROWS)))
    place = F.least(F.lit(slices - 1), F.floor((F.col("_arrived") - F.lit(low)) * slices / (F.lit((high or 0) - (low or 0)) + 1)))
    rows = rows.withColumn("_slice", F.coalesce(place, F.lit(0)))
    for i in range(slices):
        rows.filter(F.col("_slice") == i).drop("_arrived", "_slice").repartition(files).write.mode("append").parquet(path)
    return path, files


def delivered(spark: SparkSession, delivery: tuple[str, int], schema, slices: int = 1) -> DataFrame:
    """Stream of a delivery, ``slices`` of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", delivery[1] * slices).parquet(delivery[0])


def window_revisions(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Window counts in update mode: every trigger writes the windows it changed as a revision under its number.

    Returns each window's last revision, open ones too; ``final`` once the watermark has passed its end.
    """
    spark = counts.sparkSession
    path, columns = new_path(spark, name), [*keys, "window_start", "window_end"]
    spark.createDataFrame([], counts.schema).write.parquet(f"{path}/batch_id=-1")
    query = counts.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: sinks.write_batch(batch, path, batch_id))
    query = query.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    watermark = max((p["eventTime"].get("watermark", "") for p in query.recentProgress), default="") or "1970-01-01T00:00:00.000Z"
    last = F.max_by("n", "batch_id").alias("n"), F.count(F.lit(1)).alias("revisions")
    return spark.read.parquet(path).groupBy(*columns).agg(*last).withColumn("final", F.col("window_end") <= F.lit(watermark).cast("timestamp"))


def versioned(stream: DataFrame, versions: str, keys: list[str], ts: str, since: str, values: list[str], order: list[str], job: Callable[[DataFrame], DataFrame], name: str, before: Callable[[int], None] | None = None) -> str:
    """Rows with the version of a table that is valid at their event time, the table read anew in every trigger.

    Versions published between triggers hold from the next one on; what was evaluated before keeps the version it names.
    ``before`` runs ahead of each trigger's read. Returns the folder of the job's results.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        if before:
            before(batch_id)
        known = spark.read.parquet(versions)
        sinks.write_batch(job(asof(batch, known, keys, ts, since, values, order)), path, batch_id)

    run_batches(stream, name, each)
    return path
