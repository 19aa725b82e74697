"""Streams over several triggers, with late rows and repeated deliveries, against their batch twins."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from tideglass.streaming import pipelines as pl

SCHEMA = "event_id long, facility_id long, event_time timestamp, dpd int, previous_dpd int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four files; rows of a facility are in order between files but for a few late ones."""
    root = tmp_path_factory.mktemp("stream")
    rng = random.Random(3)
    rows = [(i, i % 7, 1_700_000_000 + i * 7200 + rng.randrange(60), rng.randrange(0, 121)) for i in range(400)]
    late = {50, 120, 260}
    for part in range(4):
        mine = [r for r in rows if (r[0] // 100 == part and r[0] not in late) or (r[0] in late and part == 3)]
        df = spark.createDataFrame(mine, "event_id long, facility_id long, s long, dpd int").select(
            "event_id", "facility_id", F.timestamp_seconds("s").alias("event_time"), "dpd", F.lit(None).cast("int").alias("previous_dpd")
        )
        df.coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert Counter(map(tuple, a.select(cols).collect())) == Counter(map(tuple, b.select(cols).collect()))


def test_rolling_with_late_rows(spark, folder):
    got = pl.rolling_batches(stream(spark, folder), ["facility_id"], "event_time", "event_id", 5, {"n": ("count", "event_id"), "hi": ("max", "dpd")}, "t")
    rows = spark.read.parquet(folder).withColumn("us", F.unix_micros("event_time"))
    w = Window.partitionBy("facility_id").orderBy("us").rangeBetween(-5 * 86_400_000_000, 0)
    same(got.select("event_id", "n", "hi"), rows.select("event_id", F.count("event_id").over(w).alias("n"), F.max("dpd").over(w).alias("hi")))


def test_upsert_delivered_twice(spark, folder):
    out = pl.upsert_stream(stream(spark, folder), "u", ["facility_id"], ["event_time", "event_id"], deliveries=2)
    rows = spark.read.parquet(folder)
    want = rows.groupBy("facility_id").agg(F.max_by("event_id", F.struct("event_time", "event_id")).alias("event_id"))
    same(out.select("facility_id", "event_id"), want)


def test_replay_needs_a_run(spark, folder):
    rows = spark.read.parquet(folder)
    with pytest.raises(ValueError):
        pl.replay(rows, lambda d: d, "BACKFILL", " ", "r")


def arrived(spark, folder, files):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    """Six files in order of arrival, up to 50 minutes late."""
    root, rng = str(tmp_path_factory.mktemp("overlapping")), random.Random(5)
    rows = [(i, i % 5, 1_700_000_000 + i * 900, rng.randrange(0, 121), rng.randrange(3000)) for i in range(300)]
    rows.sort(key=lambda r: r[2] + r[4])
    for part in range(6):
        df = spark.createDataFrame(rows[part * 50 : part * 50 + 50], "event_id long, facility_id long, s long, dpd int, late int")
        df.select("event_id", "facility_id", F.timestamp_seconds("s").alias("event_time"), "dpd", F.lit(None).cast("int").alias("previous_dpd")).coalesce(1).write.mode("append").parquet(root)
    return root


@pytest.mark.parametrize("files", [1, 2, 16])
def test_windows_have_revisions_and_none_is_lost(spark, overlapping, files):
    counts = pl.tumbling_counts(pl.graced(arrived(spark, overlapping, files), "event_time"), ["facility_id"], "event_time", "2 hours")
    got = pl.window_revisions(counts, ["facility_id"], "w").collect()
    rows = spark.read.parquet(overlapping)
    want = rows.groupBy("facility_id", F.window("event_time", "2 hours").alias("w")).count().select("facility_id", "w.start", "w.end", "count").collect()
    assert {(r.facility_id, r.window_start, r.n) for r in got} == {(r.facility_id, r.start, r["count"]) for r in want}
    watermark = rows.agg(F.max("event_time") - F.expr("INTERVAL 1 HOUR")).first()[0]
    assert all(r.final == (r.window_end <= watermark) for r in got) and {r.final for r in got} == {True, False}
    if files == 1:
        assert max(r.revisions for r in got) > 1


def test_windows_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    counts = pl.tumbling_counts(pl.graced(arrived(spark, str(tmp_path / "none"), 1), "event_time"), ["facility_id"], "event_time")
    assert pl.window_revisions(counts, ["facility_id"], "w").collect() == []


def test_policy_published_between_triggers(spark, overlapping, tmp_path):
    """Version 2 holds from the middle of the stretch; with a late publication rows before it keep version 1."""
    middle = 1_700_000_000 + 150 * 900

    def publish(version, since):
        rows = spark.createDataFrame([("P", version, since, version * 10)], "policy_id string, version int, s long, least int")
        rows.withColumn("since", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(path)

    def judged(rows):
        return rows.select("event_id", "version", (F.col("dpd") >= F.col("least")).alias("hit"))

    for at, name in ((1, "early"), (5, "late")):
        path = str(tmp_path / name)
        publish(1, 0)
        stream = arrived(spark, overlapping, 1).withColumn("policy_id", F.lit("P"))
        out = pl.versioned(stream, path, ["policy_id"], "event_time", "since", ["version", "least"], ["version"], judged, name, before=lambda b, at=at: publish(2, middle) if b == at else None)
        rows = spark.read.parquet(out)
        found = {r.event_id: (r.version, r.hit) for r in rows.collect()}
        batch = {r.event_id: r.batch_id for r in rows.collect()}
        assert len(found) == 300
        for r in spark.read.parquet(overlapping).select("event_id", "dpd", F.unix_seconds("event_time").alias("s")).collect():
            version = 2 if r.s >= middle and batch[r.event_id] >= at else 1
            assert found[r.event_id] == (version, r.dpd >= version * 10)


def test_runs_are_isolated_and_recover(spark, overlapping):
    from pyspark.errors import StreamingQueryException

    runs = pl.Runs(spark, "runs")
    job = lambda least: lambda rows: rows.select("event_id", (F.col("dpd") >= least).alias("hit"))
    stream = lambda: arrived(spark, overlapping, 1)
    with pytest.raises(ValueError):
        runs.run(stream(), job(60), "RECOVERY", "")
    with pytest.raises(StreamingQueryException):
        runs.run(stream(), job(60), "LIVE", "", fail_at=2)
    assert runs.results("LIVE", "").count() == 150  # batches 0 to 2 are written, 2 is not committed
    runs.run(stream(), job(60), "RECOVERY", "")
    live = runs.results("LIVE", "").select("event_id", "hit")
    same(live, spark.read.parquet(overlapping).select("event_id", (F.col("dpd") >= 60).alias("hit")))
    runs.run(stream().filter("event_id < 200"), job(30), "COUNTERFACTUAL", "A")
    runs.run(stream(), job(60), "REBUILD", "A")
    same(runs.results("LIVE", "").select("event_id", "hit"), live)
    assert runs.compared(("REBUILD", "A"), ["event_id"], ["hit"]).count() == 0
    rows = {r.event_id: r.dpd for r in spark.read.parquet(overlapping).collect()}
    found = {r.event_id: r.difference for r in runs.compared(("COUNTERFACTUAL", "A"), ["event_id"], ["hit"]).collect()}
    assert found == {e: "CHANGED" if e < 200 else "ONLY_LIVE" for e, d in rows.items() if e >= 200 or 30 <= d < 60}
    for mode, run_id in (("COUNTERFACTUAL", "A"), ("REBUILD", " "), ("PROMOTE", "B")):
        with pytest.raises(ValueError):
            runs.run(stream(), job(60), mode, run_id)


def test_deliveries_follow_arrival(spark, overlapping):
    table = spark.read.parquet(overlapping)
    path, files = pl.deliveries(table, F.col("event_time"), "d", 5)
    assert files == 1 and len(spark.read.parquet(path).inputFiles()) == 5
    same(spark.read.parquet(path), table)
    empty, _ = pl.deliveries(table.limit(0), F.col("event_time"), "d")
    assert spark.read.schema(table.schema).parquet(empty).count() == 0
