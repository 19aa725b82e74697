"""Episodes over DPD signals."""

from pyspark.sql import functions as F

from tideglass.operators import episodes as ep, features as feat, signals as sig
from tideglass.plans.sqltext import DPD_SIGNALS, uuid_sql
from tideglass.registry import query

INACTIVITY = 0.75

KEYED = f"""{DPD_SIGNALS}, keyed AS (SELECT *, concat_ws('|', 'LIVE', CASE WHEN signal_type = 'DPD_WORSENING' THEN 'EP-POL-DPD-WORSENING-CORP-001' ELSE 'EP-POL-DPD-EMERGED-CORP-001' END, '1', 'FACILITY', entity_id, signal_type, entity_id) AS episode_key,
  list_position(['LOW','MEDIUM','HIGH','CRITICAL'], severity) AS rk FROM dpds),
lagk AS (SELECT *, lag(effective_at) OVER w AS prev_at, lag(rk) OVER w AS prev_rk FROM keyed WINDOW w AS (PARTITION BY episode_key ORDER BY effective_at, signal_id)),
sess AS (SELECT *, max(CASE WHEN prev_at IS NULL OR epoch_us(effective_at) - epoch_us(prev_at) > 64800000000 THEN effective_at END) OVER (PARTITION BY episode_key ORDER BY effective_at, signal_id) AS session_start FROM lagk),
epi AS (SELECT {uuid_sql("episode_key||'|'||CAST(epoch_us(session_start) AS VARCHAR)")} AS episode_id, * FROM sess)"""


def signals(t):
    return sig.dpd_signals(feat.current_dpd_features(t.dpd_changed))


@query("episode_key", f"WITH {KEYED} SELECT signal_id, episode_key FROM keyed")
def _(t):
    return ep.keyed(signals(t)).select("signal_id", "episode_key")


@query(
    "episode_build",
    f"""WITH {KEYED} SELECT episode_id, min(effective_at) AS opened_at, max(effective_at) AS last_activity_at, count(*) AS occurrences,
  ['LOW','MEDIUM','HIGH','CRITICAL'][max(rk)] AS peak_severity, arg_max(severity, (effective_at, signal_id)) AS current_severity FROM epi GROUP BY episode_id""",
)
def _(t):
    episodes, _ = ep.build(signals(t), INACTIVITY)
    return episodes.select("episode_id", "opened_at", "last_activity_at", "occurrences", "peak_severity", "current_severity")


@query(
    "episode_members",
    f"""WITH {KEYED} SELECT episode_id, signal_id, CASE WHEN row_number() OVER (PARTITION BY episode_id ORDER BY effective_at, signal_id) = 1 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role FROM epi""",
)
def _(t):
    _, members = ep.build(signals(t), INACTIVITY)
    return members.select("episode_id", "signal_id", "role")


@query("win_episode_sessions", f"WITH {KEYED} SELECT signal_id, session_start FROM sess")
def _(t):
    from tideglass.operators.ordered import sessions

    tagged, _ = sessions(ep.keyed(signals(t)), ["episode_key"], "effective_at", INACTIVITY, [F.count(F.lit(1)).alias("n")])
    return tagged.select("signal_id", "session_start")


@query("agg_union_evidence", f"WITH {KEYED} SELECT DISTINCT episode_id, feature_value_id AS evidence_id FROM epi")
def _(t):
    _, members = ep.build(signals(t), INACTIVITY)
    return ep.evidence_of(members, "episode_id")


REVS = f"""{KEYED}, revs AS (
  SELECT episode_key, effective_at AS changed_at, signal_id, severity, CASE WHEN prev_at IS NULL THEN 'OPENED' WHEN epoch_us(effective_at) - epoch_us(prev_at) > 64800000000 THEN 'REOPENED' WHEN rk > prev_rk THEN 'ESCALATED' ELSE 'UPDATED' END AS transition FROM lagk
  UNION ALL SELECT episode_key, prev_at + INTERVAL 18 HOUR, '', severity, 'RESOLVED' FROM lagk WHERE epoch_us(effective_at) - epoch_us(prev_at) > 64800000000
  UNION ALL SELECT episode_key, max(effective_at) + INTERVAL 18 HOUR, '', arg_max(severity, (effective_at, signal_id)), 'RESOLVED' FROM lagk GROUP BY episode_key HAVING max(effective_at) + INTERVAL 18 HOUR <= TIMESTAMP '2024-01-30 00:00:00'),
numbered AS (SELECT *, CASE WHEN transition IN ('OPENED','REOPENED','ESCALATED') THEN 'OPEN' WHEN transition = 'RESOLVED' THEN 'RESOLVED' ELSE 'MONITORING' END AS status,
  row_number() OVER (PARTITION BY episode_key ORDER BY changed_at, signal_id) AS revision,
  count(CASE WHEN transition = 'REOPENED' THEN 1 END) OVER (PARTITION BY episode_key ORDER BY changed_at, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reopen_count FROM revs)"""


def revisions(t):
    return ep.lifecycle(signals(t), INACTIVITY, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("episode_lifecycle", f"WITH {REVS} SELECT episode_key, changed_at, signal_id, transition, status, revision, reopen_count FROM numbered")
def _(t):
    return revisions(t).select("episode_key", "changed_at", "signal_id", "transition", "status", "revision", "reopen_count")


@query("episode_analyst_updates", f"WITH {REVS} SELECT episode_key, revision, transition FROM numbered WHERE transition <> 'UPDATED'")
def _(t):
    return ep.analyst_updates(revisions(t)).select("episode_key", "revision", "transition")
