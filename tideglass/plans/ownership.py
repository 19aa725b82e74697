"""Effective ownership, distress of groups, contagion over time, connected exposure."""

from pyspark.sql import functions as F

from tideglass.operators import ownership as ow
from tideglass.registry import query

AS_OF = "1998-06-01 00:00:00"
VALID = f"valid_from <= TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' < valid_to"
LAST_YEAR = f"event_time < TIMESTAMP '{AS_OF}' AND event_time >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"
NODES = "SELECT concat('C', c_custkey) AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal < 0"

#: The sum over paths as a recursion; each step adds exactly and divides once per node.
HELD = f"""ed AS (SELECT src, dst, sum(weight) AS weight FROM b_holding WHERE {VALID} AND src <> dst AND weight > 0 GROUP BY ALL), ew AS (SELECT *, greatest(sum(weight) OVER (PARTITION BY dst), 10000) AS base FROM ed),
pa AS (SELECT src AS owner, src AS node, CAST(1000000 AS HUGEINT) AS amount, 0 AS hop FROM ew GROUP BY src
  UNION ALL SELECT owner, dst, sum(amount * weight) // base, hop + 1 FROM pa JOIN ew ON pa.node = ew.src GROUP BY owner, dst, base, hop HAVING sum(amount * weight) // base > 0),
sh AS (SELECT owner, node AS entity, CAST(sum(amount) AS BIGINT) AS share, CAST(coalesce(sum(amount) FILTER (hop = 1), 0) AS BIGINT) AS direct, CAST(max(hop) AS INT) AS hops FROM pa WHERE hop > 0 GROUP BY owner, node)"""


def held(t):
    return t.holding.filter(VALID)


@query("graph_effective_ownership", f"WITH RECURSIVE {HELD} SELECT *, true AS settled FROM sh")
def _(t):
    return ow.effective_shares(held(t))


@query(
    "signal_group_distress",
    f"""WITH RECURSIVE {HELD}, nd AS ({NODES}) SELECT 'GROUP_ENTITY_DISTRESS' AS signal_type, entity AS entity_id, CAST(sum(share) AS BIGINT) AS share, CAST(sum(direct) AS BIGINT) AS direct, count(*) AS related, arg_min(owner, (-share, owner)) AS foremost
FROM sh WHERE owner <> entity AND owner IN (SELECT node FROM nd) AND entity NOT IN (SELECT node FROM nd) GROUP BY entity HAVING sum(share) >= 50000""",
)
def _(t):
    bad = t.sql(NODES)
    return ow.group_distress(ow.effective_shares(held(t), bad), bad)


QUARTERS = """qs AS (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 3 MONTH)) AS as_of),
dq AS (SELECT as_of, src, dst, sum(weight) AS weight FROM b_dependency JOIN qs ON valid_from <= as_of AND as_of < valid_to WHERE src <> dst AND weight > 0 GROUP BY ALL), dw AS (SELECT *, CAST(greatest(ceil(sum(weight) OVER (PARTITION BY as_of, dst) * 2.5), 1) AS BIGINT) AS base FROM dq)"""
SCORES = f"""{QUARTERS}, nd AS ({NODES}),
pa AS (SELECT DISTINCT as_of, src AS node, CAST(1000000 AS HUGEINT) AS amount, 0 AS hop FROM dw WHERE src IN (SELECT node FROM nd)
  UNION ALL SELECT pa.as_of, dst, sum(amount * weight) // base, hop + 1 FROM pa JOIN dw ON pa.as_of = dw.as_of AND pa.node = dw.src WHERE hop = 0 OR pa.node NOT IN (SELECT node FROM nd) GROUP BY pa.as_of, dst, base, hop HAVING sum(amount * weight) // base > 0),
sc AS (SELECT as_of, node, CAST(sum(amount) AS BIGINT) AS score, CAST(coalesce(sum(amount) FILTER (hop = 1), 0) AS BIGINT) AS direct, CAST(max(hop) AS INT) AS hops FROM pa WHERE hop > 0 AND node NOT IN (SELECT node FROM nd) GROUP BY as_of, node)"""


def quarterly(t):
    """Dependencies at the start of every quarter in which they are valid."""
    first = F.date_trunc("quarter", F.col("valid_from")).cast("timestamp_ntz")
    quarters = F.sequence(first, F.col("valid_to"), F.expr("INTERVAL 3 MONTH"))
    rows = t.dependency.filter("valid_from < valid_to").select("*", F.explode(quarters).alias("as_of"))
    return rows.filter("valid_from <= as_of AND as_of < valid_to").select("as_of", "src", "dst", "weight")


def scores(t, relations):
    seeds = relations.select("as_of", F.col("src").alias("node")).distinct().join(t.sql(NODES), "node", "left_semi")
    return ow.contagion_scores(relations, seeds, ["as_of"])


@query("graph_contagion_score", f"WITH RECURSIVE {SCORES} SELECT *, true AS settled FROM sc")
def _(t):
    return scores(t, quarterly(t))


@query(
    "signal_contagion_spike",
    f"""WITH RECURSIVE {SCORES} SELECT 'CONTAGION_SCORE_SPIKE' AS signal_type, n.node AS entity_id, n.as_of, n.score, n.score - coalesce(p.score, 0) AS rise FROM sc n LEFT JOIN sc p ON p.node = n.node AND p.as_of = n.as_of - INTERVAL 3 MONTH
WHERE n.score - coalesce(p.score, 0) >= 50000 AND n.as_of - INTERVAL 3 MONTH IN (SELECT as_of FROM dw)""",
)
def _(t):
    relations = quarterly(t)
    known = relations.select("as_of").distinct()
    before = known.withColumn("previous", F.expr("as_of - INTERVAL 3 MONTH")).join(known.withColumnRenamed("as_of", "previous"), "previous", "left_semi")
    return ow.spikes(scores(t, relations), before, "as_of", 50_000)


EXPOSURE = f"SELECT concat('C', payer_id) AS entity, concat('S', beneficiary_id) AS party, CAST(amount * 100 AS BIGINT) AS cents FROM b_transfer WHERE {LAST_YEAR}"


@query(
    "signal_relationship_concentration",
    f"""WITH RECURSIVE {HELD}, xp AS (SELECT entity, party, sum(cents) AS cents FROM ({EXPOSURE}) WHERE cents > 0 GROUP BY ALL), tt AS (SELECT entity, CAST(sum(cents) AS BIGINT) AS total_cents FROM xp GROUP BY 1),
th AS (SELECT xp.entity, owner AS on_party, CAST(sum(cents * share) // 1000000 AS BIGINT) AS through FROM xp JOIN sh ON sh.entity = xp.party AND owner <> sh.entity GROUP BY ALL),
cc AS (SELECT th.entity, on_party, CAST(coalesce(xp.cents, 0) AS BIGINT) AS direct_cents, through, total_cents FROM th JOIN tt ON tt.entity = th.entity LEFT JOIN xp ON xp.entity = th.entity AND xp.party = on_party)
SELECT 'RELATIONSHIP_RISK_CONCENTRATION' AS signal_type, entity AS entity_id, on_party, direct_cents, direct_cents + through AS connected_cents, total_cents FROM cc WHERE through > 0 AND entity <> on_party AND 100 * (direct_cents + through) >= 10 * total_cents""",
)
def _(t):
    return ow.connected_exposure(t.sql(EXPOSURE), ow.effective_shares(held(t)), 10)


@query(
    "signal_major_supplier_distress",
    f"""WITH xp AS (SELECT entity, party, sum(cents) AS cents FROM ({EXPOSURE}) WHERE cents > 0 GROUP BY ALL), tt AS (SELECT entity, CAST(sum(cents) AS BIGINT) AS total_cents FROM xp GROUP BY 1)
SELECT 'MAJOR_SUPPLIER_DISTRESS' AS signal_type, xp.entity AS entity_id, party, CAST(cents AS BIGINT) AS cents, total_cents FROM xp JOIN tt ON tt.entity = xp.entity WHERE party IN ({NODES}) AND 100 * cents >= 20 * total_cents""",
)
def _(t):
    return ow.party_distress(t.sql(EXPOSURE), t.sql(NODES), 20)
