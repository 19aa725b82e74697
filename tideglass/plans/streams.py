"""Streaming twins. Each drains a file stream and reads the result back, so it can be compared."""

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from tideglass.functions.scalars import SEVERITIES, dpd_severity, rank_in
from tideglass.operators import policy as pol, temporal as tm
from tideglass.plans.policies import DPD_CASE, flat
from tideglass.plans.sqltext import DPD_CROSSINGS, DPD_FEATURES, UTILIZATION
from tideglass.registry import query
from tideglass.session import new_path
from tideglass.streaming import pipelines as pl, stateful as st


def events(t):
    return pl.file_stream(t.spark, t.sf_dir, "events")


def arrivals(t):
    """The events as they arrive, up to 49 minutes after they happen: four overlapping files, one a trigger, in a session that keeps state in RocksDB."""
    table = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    delay = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 50).cast("int"))
    return pl.delivered(st.session(t.spark), pl.deliveries(table, F.col("ts").cast("timestamp") + delay, "events"), table.schema)


def ordered(t, rows, processor, name):
    """Standing results of a processor over a stream with one hour of grace."""
    out = st.apply(pl.graced(rows, "event_time").withColumn("event_us", F.unix_micros("event_time")), processor)
    return st.latest(t.spark.read.schema(processor.output).parquet(pl.run_to_parquet(out, name)), processor)


def at(us):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def dpd(t, stream=None):
    """The DPD binding on the event stream."""
    value = F.floor("value").cast("int") % 121
    return (events(t) if stream is None else stream).select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("facility_id"),
        F.when(F.col("event_type") == "signup", 0).otherwise(value).alias("current_dpd"), (F.col("event_type") != "error").alias("reconciled"),
    )


def usable(t, stream=None):
    return dpd(t, stream).filter("reconciled AND current_dpd >= 0")


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("stream_file_source", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    path = pl.run_to_parquet(events(t), "copy")
    return t.spark.read.parquet(path).select("event_id", "ts", "user_id", "event_type", "value")


@query("stream_parquet_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = pl.run_to_parquet(events(t), "parts", partitions=["event_type"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


WM = "wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)"


@query(
    "stream_tumbling_counts",
    f"WITH {WM} SELECT user_id AS facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, date_trunc('day', ts) + INTERVAL 1 DAY <= wm AS final FROM events, wm GROUP BY user_id, date_trunc('day', ts), wm",
)
def _(t):
    """Every window, open ones as provisional revisions."""
    counts = pl.tumbling_counts(pl.graced(dpd(t, arrivals(t)), "event_time"), ["facility_id"], "event_time")
    return ntz(pl.window_revisions(counts, ["facility_id"], "tumbling"), "window_start").select("facility_id", "window_start", "n", "final")


@query(
    "stream_watermark",
    f"WITH {WM} SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, count(*) AS n, date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm AS final FROM events, wm GROUP BY date_trunc('hour', ts), wm",
)
def _(t):
    """One hour of grace: a window is final once the watermark has passed its end, provisional until then."""
    counts = pl.tumbling_counts(pl.graced(dpd(t, arrivals(t)), "event_time"), [], "event_time", "1 hour")
    return ntz(pl.window_revisions(counts, [], "hours"), "window_start").select("window_start", "n", "final")


@query(
    "stream_sliding_counts",
    f"""WITH {WM}, ends AS (SELECT DISTINCT CAST(date_trunc('day', ts) + INTERVAL 1 DAY * i AS TIMESTAMP) AS window_end FROM events, range(1, 31) r(i)), d AS (SELECT user_id AS facility_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT facility_id, window_end, CAST(sum(n) AS BIGINT) AS n, window_end <= wm AS final FROM d JOIN ends ON day < window_end AND day >= window_end - INTERVAL 30 DAY, wm GROUP BY ALL""",
)
def _(t):
    """Thirty-day windows hopping by a day, the approximation the exact look-back replaces."""
    counts = pl.tumbling_counts(pl.graced(dpd(t, arrivals(t)), "event_time"), ["facility_id"], "event_time", "30 days", "1 day")
    return ntz(pl.window_revisions(counts, ["facility_id"], "sliding"), "window_end").select("facility_id", "window_end", "n", "final")


@query(
    "stream_session_episodes",
    f"""WITH {WM}, l AS (SELECT user_id AS facility_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY facility_id ORDER BY ts, event_id) AS g FROM l),
c AS (SELECT facility_id, g, min(ts) AS opened_at, max(ts) AS last_activity_at, count(*) AS n FROM s GROUP BY facility_id, g)
SELECT facility_id, opened_at, last_activity_at, n, g < max(g) OVER (PARTITION BY facility_id) OR last_activity_at + INTERVAL 12 HOUR <= wm AS closed FROM c, wm""",
)
def _(t):
    """Sessions of a facility, closed by a timer once twelve hours passed; those still open are provisional."""
    found = ordered(t, dpd(t, arrivals(t)), st.Sessions(43_200_000_000), "sessions")
    return found.select("facility_id", at("opened_us").alias("opened_at"), at("last_us").alias("last_activity_at"), "n", "closed")


@query("stream_dedup_event_id", "SELECT event_id, user_id AS facility_id FROM events")
def _(t):
    """Every event is delivered twice and kept once."""
    twice = pl.graced(dpd(t), "event_time").union(pl.graced(dpd(t), "event_time"))
    return t.spark.read.parquet(pl.run_to_parquet(pl.deduplicated(twice, ["event_id"]), "dedup")).select("event_id", "facility_id")


ROLL = """SELECT event_id, facility_id, {agg} OVER (PARTITION BY facility_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS {name} FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0"""


@query("stream_rolling_count", ROLL.format(agg="count(*)", name="events_30d"))
def _(t):
    out = pl.rolling_batches(usable(t), ["facility_id"], "event_time", "event_id", 30, {"events_30d": ("count", "event_id")}, "rolling-count")
    return out.select("event_id", "facility_id", "events_30d")


@query("stream_rolling_max", ROLL.format(agg="max(current_dpd)", name="max_dpd_30d"))
def _(t):
    out = pl.rolling_batches(usable(t), ["facility_id"], "event_time", "event_id", 30, {"max_dpd_30d": ("max", "current_dpd")}, "rolling-max")
    return out.select("event_id", "facility_id", "max_dpd_30d")


CROSS = DPD_CROSSINGS.replace("ORDER BY event_time, feature_value_id", "ORDER BY event_time, event_id")


@query("stream_dpd_signals", f"WITH {CROSS} SELECT CAST(entity_id AS BIGINT) AS facility_id, event_id, event_time, crossing, CAST(current_dpd AS INT) AS dpd FROM crossed WHERE crossing IS NOT NULL")
def _(t):
    rows = usable(t, arrivals(t)).select("facility_id", "event_id", "event_time", F.col("current_dpd").alias("dpd"), F.lit(None).cast("int").alias("previous_dpd"))
    return ordered(t, rows, st.DpdCrossings(), "crossings").select("facility_id", "event_id", at("event_us").alias("event_time"), "crossing", "dpd")


SEQUENCE = """SELECT facility_id, event_id, CASE WHEN top IS NULL OR s = top + 1 THEN 'OK' WHEN s < top THEN 'STALE' WHEN s = top THEN 'DUPLICATE' ELSE 'GAP' END AS sequence_state, top, s
FROM (SELECT event_id, user_id AS facility_id, CAST(floor(value) AS INT) % 20 AS s, max(CAST(floor(value) AS INT) % 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)"""


def sequence(t):
    rows = arrivals(t).select(
        F.col("user_id").alias("facility_id"), "event_id", F.col("ts").cast("timestamp").alias("event_time"), (F.floor("value").cast("int") % 20).alias("aggregate_sequence")
    )
    return ordered(t, rows, st.SequenceGate(), "sequence")


@query("stream_sequence_state", f"SELECT facility_id, event_id, sequence_state FROM ({SEQUENCE})")
def _(t):
    return sequence(t).select("facility_id", "event_id", "sequence_state")


@query("stream_sequence_gaps", f"SELECT facility_id, event_id, top + 1 AS missing_from, s - 1 AS missing_to FROM ({SEQUENCE}) WHERE sequence_state = 'GAP'")
def _(t):
    """The gate's side output, for reconciliation."""
    return st.gaps(sequence(t))


@query(
    "stream_material_change",
    """WITH RECURSIVE r AS (SELECT facility_id, event_id, current_dpd AS dpd, row_number() OVER (PARTITION BY facility_id ORDER BY event_time, event_id) AS i FROM b_dpd_changed WHERE reconciled AND current_dpd >= 0),
x AS (SELECT facility_id, i, event_id, dpd AS emitted, true AS moved FROM r WHERE i = 1 UNION ALL
SELECT r.facility_id, r.i, r.event_id, CASE WHEN abs(r.dpd - x.emitted) >= 30 THEN r.dpd ELSE x.emitted END, abs(r.dpd - x.emitted) >= 30 FROM x JOIN r ON r.facility_id = x.facility_id AND r.i = x.i + 1)
SELECT facility_id, event_id, CAST(emitted AS INT) AS dpd FROM x WHERE moved""",
)
def _(t):
    rows = usable(t, arrivals(t)).select("facility_id", "event_id", "event_time", F.col("current_dpd").alias("dpd"))
    return ordered(t, rows, st.MaterialChange(30), "material").select("facility_id", "event_id", "dpd")


@query(
    "stream_episode_lifecycle",
    """WITH r AS (SELECT event_id, facility_id, event_time, CASE WHEN current_dpd >= 90 THEN 4 WHEN current_dpd >= 60 THEN 3 WHEN current_dpd >= 30 THEN 2 ELSE 1 END AS rk FROM b_dpd_changed WHERE reconciled AND current_dpd > 0),
l AS (SELECT *, lag(event_time) OVER w AS pt, lag(rk) OVER w AS pr, lead(event_time) OVER w AS nt FROM r WINDOW w AS (PARTITION BY facility_id ORDER BY event_time, event_id)),
x AS (SELECT *, CASE WHEN pt IS NULL THEN 'OPENED' WHEN epoch_us(event_time) - epoch_us(pt) > 64800000000 THEN 'REOPENED' WHEN rk > pr THEN 'ESCALATED' ELSE 'UPDATED' END AS transition FROM l),
n AS (SELECT *, CAST(count(CASE WHEN transition = 'REOPENED' THEN 1 END) OVER (PARTITION BY facility_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS reopen_count FROM x)
SELECT facility_id, event_id, transition, event_time AS changed_at, reopen_count FROM n
UNION ALL SELECT facility_id, event_id, 'RESOLVED', event_time + INTERVAL 18 HOUR, reopen_count FROM n
WHERE epoch_us(nt) - epoch_us(event_time) > 64800000000 OR (nt IS NULL AND event_time + INTERVAL 18 HOUR <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM r))""",
)
def _(t):
    """Eighteen quiet hours resolve an episode at the watermark, whether or not a further row comes."""
    rows = usable(t, arrivals(t)).filter("current_dpd > 0").select(
        "facility_id", "event_id", "event_time", rank_in(dpd_severity(F.col("current_dpd")), SEVERITIES).alias("rank")
    )
    found = ordered(t, rows, st.EpisodeLife(64_800_000_000), "episodes")
    return found.select("facility_id", "event_id", "transition", at("changed_us").alias("changed_at"), "reopen_count")


@query(
    "stream_late_routing",
    """SELECT event_id, CASE WHEN event_id % 72 <= 1 THEN 'live' ELSE 'late' END AS route, CASE WHEN event_id % 72 <= 1 THEN 'L1' WHEN event_id % 72 <= 48 THEN 'L2' ELSE 'L3' END AS late_class FROM events""",
)
def _(t):
    known = F.col("event_time") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 72).cast("int"))
    rows = dpd(t).withColumn("knowledge_time", known)
    paths = pl.route_late(rows, tm.late_class(F.col("event_time"), F.col("knowledge_time"), 1, 48, 168), "late")
    read = lambda r: t.spark.read.parquet(paths[r]).select("event_id", F.lit(r).alias("route"), "late_class")
    return read("live").unionByName(read("late"))


def revisions(t):
    """First revisions, and a corrected one for every twentieth event."""
    base = events(t).select("event_id", F.lit(1).alias("revision"), (F.floor("value").cast("int") % 121).alias("value_numeric"))
    fixed = events(t).filter("event_id % 20 = 0").select("event_id", F.lit(2).alias("revision"), (F.floor("value").cast("int") % 121 + 5).alias("value_numeric"))
    return base.union(fixed)


@query("stream_correction", "SELECT event_id, CAST(count(*) AS BIGINT) AS revisions_kept, arg_min(value_numeric, revision) AS original_value, arg_max(value_numeric, revision) AS corrected_value FROM b_feature_history GROUP BY event_id")
def _(t):
    """A correction adds revision 2 and leaves revision 1 in place."""
    rows = t.spark.read.parquet(pl.append_revisions(revisions(t), "corrections"))
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("revisions_kept"), F.min_by("value_numeric", "revision").alias("original_value"), F.max_by("value_numeric", "revision").alias("corrected_value")
    )


@query("stream_reversal", "SELECT facility_id, count(*) AS counted, count(CASE WHEN event_id % 20 <> 0 THEN 1 END) AS standing FROM b_dpd_changed GROUP BY 1")
def _(t):
    """Signed facts: +1 for an event, -1 for its reversal; both stay in the table."""
    plus = dpd(t).select("event_id", "facility_id", F.lit(1).alias("sign"))
    minus = dpd(t).filter("event_id % 20 = 0").select("event_id", "facility_id", F.lit(-1).alias("sign"))
    rows = t.spark.read.parquet(pl.append_revisions(plus.union(minus), "reversals"))
    return rows.groupBy("facility_id").agg(F.sum((F.col("sign") > 0).cast("int")).alias("counted"), F.sum("sign").alias("standing"))


@query(
    "stream_stream_join",
    f"WITH {UTILIZATION} SELECT event_id, facility_id, effective_at, CAST(outstanding AS DOUBLE) AS outstanding, CAST(limit_amount AS DOUBLE) AS limit_amount, state FROM util",
)
def _(t):
    """Limit and outstanding streams: each outstanding with the limit at its time, both last values in state."""
    own = st.session(t.spark)

    def side(df, n, tie, amount):
        rows = df.select(
            "facility_id", F.col("event_id").cast("string").alias("event_id"), F.col("effective_at").cast("timestamp").alias("event_time"), F.lit(n).alias("side"),
            tie.cast("bigint").alias("tie"), F.col(amount).cast("string").alias("amount"),
        )
        delay = F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.hash("event_id"), F.lit(50)))
        return pl.graced(pl.delivered(own, pl.deliveries(rows, F.col("event_time") + delay, f"side{n}"), rows.schema), "event_time")

    both = side(t.limit_changed, 0, F.col("event_id"), "limit_amount").unionByName(side(t.outstanding_changed, 1, F.lit(0), "outstanding"))
    processor = st.AsOfBoth()
    path = pl.run_to_parquet(st.apply(both.withColumn("event_us", F.unix_micros("event_time")), processor), "as-of")
    found = st.latest(t.spark.read.schema(processor.output).parquet(path), processor)
    limit, outstanding = F.col("as_of").cast("decimal(20,2)"), F.col("amount").cast("decimal(20,2)")
    state = F.when(limit.isNull(), "NOT_AVAILABLE").when(limit <= 0, "INVALID").when(outstanding == 0, "ZERO").otherwise("VALUE")
    return found.select(
        "event_id", "facility_id", at("event_us").alias("effective_at"), outstanding.cast("double").alias("outstanding"), limit.cast("double").alias("limit_amount"), state.alias("state")
    )


@query(
    "stream_interval_join",
    """SELECT o_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_shipdate AS effective_at, CAST(l_extendedprice AS DOUBLE) AS outstanding, CAST(o_totalprice AS DOUBLE) AS limit_amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY""",
)
def _(t):
    """Limit and outstanding streams joined by key within 400 days; both sides may drop old state."""
    lim = pl.file_stream(t.spark, t.sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("limit_at"), F.col("o_totalprice").alias("limit_amount")).withWatermark("limit_at", "1 hour")
    out = pl.file_stream(t.spark, t.sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("timestamp").alias("effective_at"), F.col("l_extendedprice").alias("outstanding")
    ).withWatermark("effective_at", "1 hour")
    joined = lim.join(out, F.expr("k = ok AND effective_at >= limit_at AND effective_at <= limit_at + INTERVAL 400 DAYS"))
    path = pl.run_to_parquet(joined.select("k", "line", "part", "effective_at", "outstanding", "limit_amount"), "joined")
    return ntz(t.spark.read.parquet(path), "effective_at")


@query("stream_static_policy_join", f"WITH {DPD_FEATURES} SELECT event_id, {DPD_CASE.format(missing='INSUFFICIENT_EVIDENCE')} FROM dpdf")
def _(t):
    """The rule policy is compiled into the streaming plan; no lookup per row."""
    state = F.when(~F.expr("reconciled AND current_dpd >= 0"), "INVALID").when(F.col("current_dpd") == 0, "ZERO").otherwise("VALUE")
    out = flat(pol.evaluate(dpd(t).withColumn("current_dpd_state", state), pol.DPD_DETERIORATION), "event_id")
    return t.spark.read.parquet(pl.run_to_parquet(out, "policy"))


#: Governed bands of days past due by policy version; the second is published while the stream runs and holds from its date on.
BANDS = "policy_id string, version int, effective_from timestamp, low int, medium int, high int, critical int"
VERSIONS = [("POL-DPD", 1, "2000-01-01 00:00:00", 1, 30, 60, 90), ("POL-DPD", 2, "2024-01-20 00:00:00", 1, 15, 45, 75)]


@query(
    "stream_policy_versions",
    f"""WITH v(version, since, low, medium, high, critical) AS (VALUES {", ".join(f"({v}, TIMESTAMP '{at}', {', '.join(map(str, bands))})" for _, v, at, *bands in VERSIONS)})
SELECT event_id, CAST(version AS INT) AS policy_version, CASE WHEN current_dpd >= critical THEN 'CRITICAL' WHEN current_dpd >= high THEN 'HIGH' WHEN current_dpd >= medium THEN 'MEDIUM' WHEN current_dpd >= low THEN 'LOW' ELSE 'NONE' END AS severity
FROM b_dpd_changed ASOF JOIN v ON event_time >= since WHERE reconciled AND current_dpd >= 0""",
)
def _(t):
    """A policy table that changes between triggers: version 2 is published before the third, rows follow the version valid at their time."""
    path = new_path(t.spark, "policies")

    def publish(version):
        rows = t.spark.createDataFrame([r for r in VERSIONS if r[1] == version], BANDS.replace("timestamp", "string"))
        rows.withColumn("effective_from", F.col("effective_from").cast("timestamp")).write.mode("overwrite").parquet(f"{path}/published={version}")

    def judged(rows):
        d = F.col("current_dpd")
        severity = F.when(d >= F.col("critical"), "CRITICAL").when(d >= F.col("high"), "HIGH").when(d >= F.col("medium"), "MEDIUM").when(d >= F.col("low"), "LOW").otherwise("NONE")
        return rows.select("event_id", F.col("version").alias("policy_version"), severity.alias("severity"))

    publish(1)
    rows = usable(t, arrivals(t)).withColumn("policy_id", F.lit("POL-DPD"))
    out = pl.versioned(
        rows, path, ["policy_id"], "event_time", "effective_from", ["version", "low", "medium", "high", "critical"], ["version"], judged, "judged",
        before=lambda batch_id: publish(2) if batch_id == 2 else None,
    )
    return t.spark.read.parquet(out).drop("batch_id")


@query("stream_idempotent_sinks", "SELECT event_id, arg_max(value_numeric, revision) AS value_numeric, max(revision) AS revision FROM b_feature_history GROUP BY event_id")
def _(t):
    """The whole stream is delivered twice into the same table."""
    return pl.upsert_stream(revisions(t), "upsert", ["event_id"], ["revision"], deliveries=2)


FLAGGED, STRICTER = 60, 45
#: One event in ten was absent when the live run went over its stretch.
ABSENT = "event_id % 10 = 3"


def flags(threshold):
    return lambda rows: rows.filter("reconciled").select("event_id", "facility_id", "current_dpd", (F.col("current_dpd") >= threshold).alias("flagged"))


def replayed(t):
    """A live run that breaks off and is recovered, and one run of each other mode."""
    runs, source = pl.Runs(t.spark, "replay"), arrivals(t)
    live = dpd(t, source).filter(f"NOT ({ABSENT})")
    try:
        runs.run(live, flags(FLAGGED), "LIVE", "", fail_at=1)
    except StreamingQueryException:
        pass  # the failure that RECOVERY is for
    runs.run(live, flags(FLAGGED), "RECOVERY", "")
    runs.run(live, flags(FLAGGED), "REBUILD", "RUN-1")
    runs.run(dpd(t, source).filter(ABSENT), flags(FLAGGED), "BACKFILL", "RUN-2")
    runs.run(live, flags(STRICTER), "COUNTERFACTUAL", "RUN-3")
    corrected = F.when(F.col("event_id") % 20 == 0, F.col("current_dpd") + 5).otherwise(F.col("current_dpd"))
    runs.run(dpd(t, source).withColumn("current_dpd", corrected), flags(FLAGGED), "AS_CORRECTED", "RUN-4")
    return runs


RUNS = [("RECOVERY", "LIVE"), ("REBUILD", "RUN-1"), ("BACKFILL", "RUN-2"), ("COUNTERFACTUAL", "RUN-3"), ("AS_CORRECTED", "RUN-4")]


def replay_sql(mode, run):
    value = "CASE WHEN event_id % 20 = 0 THEN current_dpd + 5 ELSE current_dpd END" if mode == "AS_CORRECTED" else "current_dpd"
    which = {"BACKFILL": ABSENT, "AS_CORRECTED": "true"}.get(mode, f"NOT ({ABSENT})")
    return f"""SELECT '{mode}' AS execution_mode, '{run}' AS run_id, facility_id, count(*) AS events, max({value}) AS max_dpd, count(CASE WHEN {value} >= {STRICTER if mode == "COUNTERFACTUAL" else FLAGGED} THEN 1 END) AS flagged
FROM b_dpd_changed WHERE reconciled AND {which} GROUP BY facility_id"""


@query("stream_replay", " UNION ALL ".join(replay_sql(*r) for r in RUNS))
def _(t):
    """Five modes, each with its own checkpoint and results; a recovered live run holds every event once."""
    runs = replayed(t)
    rows = reduce(DataFrame.unionByName, [runs.results(*r) for r in RUNS])
    return rows.groupBy("execution_mode", "run_id", "facility_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("current_dpd").alias("max_dpd"), F.count_if("flagged").alias("flagged")
    )


@query(
    "stream_replay_compare",
    f"SELECT event_id, 'CHANGED' AS difference, false AS live_flagged, true AS run_flagged FROM b_dpd_changed WHERE reconciled AND NOT ({ABSENT}) AND current_dpd >= {STRICTER} AND current_dpd < {FLAGGED}",
)
def _(t):
    """What a stricter policy would have flagged, against the official results, which it cannot touch."""
    return replayed(t).compared(("COUNTERFACTUAL", "RUN-3"), ["event_id"], ["flagged"])


@query("stream_replay_table", "SELECT 'REBUILD' AS execution_mode, 'RUN-1' AS run_id, facility_id, max(current_dpd) AS max_dpd FROM b_dpd_changed WHERE reconciled GROUP BY facility_id")
def _(t):
    """A rebuild over the whole table at once."""
    job = lambda d: d.filter("reconciled").groupBy("facility_id").agg(F.max("current_dpd").alias("max_dpd"))
    path = pl.replay(t.dpd_changed, job, "REBUILD", "RUN-1", "replay")
    return t.spark.read.parquet(path).select(F.col("execution_mode"), "run_id", "facility_id", "max_dpd")
