"""Effective ownership and contagion: sums of products over all paths of a graph that may have cycles.

An edge (src, dst, weight) gives src a part weight / base of dst, where base is a figure of dst and at least the sum of all weights into it. One round
moves what the nodes hold along all edges at once; the rounds added up are the sum over all paths, A + A^2 + ..., the same as (I - A)^-1 - I.

* Amounts are whole units (a millionth by default) and weights whole numbers. A round adds amount * weight exactly and divides by the base once per
  node, rounded down, so a node loses less than one unit a round however many edges it has, the rows do not depend on the order of adding, and a lost
  task gives the same again. After k rounds an amount is short by less than the sum of the first k parts of all paths that end there, in units.
* The rounds end when nothing is left to move. Every round is written to the shared checkpoint folder; a round costs one join with the edges and one
  sum, combined before its shuffle. A source with very many edges is split by Spark's skew join.
* What a circle holds wholly of itself never gets less. Rounds therefore end at ``rounds`` too, and ``settled`` is false for rows that still had
  something to pass on then; nothing is dropped in silence.

Edges without an end, or with a weight of nothing or less, are passed over, and so are edges from a node to itself (own shares). Several edges of a
pair are added up. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tideglass.session import shared_dir

UNITS = 1_000_000
WHOLE = 10_000  # weights of ownership are parts of ten thousand


def with_base(edges: DataFrame, by: list[str], least: int = WHOLE, times: float = 1) -> DataFrame:
    """One edge a pair with the base of its dst: the sum of its weights times ``times``, but no less than ``least``.

    With ``least`` = 100 % claims on more than all of an entity are scaled down, and a part that nobody claims stays with nobody. ``times`` above
    1 lets each step pass on only 1 / times.
    """
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("weight") > 0) & (F.col("src") != F.col("dst"))
    pairs = edges.filter(ok).groupBy(*by, "src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"))
    base = pairs.groupBy(*by, "dst").agg(F.greatest(F.ceil(F.sum("weight") * times), F.lit(least)).cast("bigint").alias("base"))
    # The sums stand beside their edges, not the edges beside a running frame: a node with many edges meets one row.
    return pairs.join(base, [*by, "dst"])


def over_paths(starts: DataFrame, edges: DataFrame, by: list[str], on: list[str], rounds: int = 100, stop: DataFrame | None = None) -> DataFrame:
    """What arrives at every node over all paths: ``by``, node, amount, direct (over one edge), hops (rounds until the last arrival), settled.

    ``starts``: ``by``, node, amount (whole units). ``edges``: ``on`` (those of ``by`` that edges depend on), src, dst, weight, base.
    ``stop``: ``on``, node; what arrives there is counted and not passed on.
    """
    shared_dir(starts.sparkSession)
    edges = edges.select(*on, "src", "dst", F.col("weight").cast("decimal(18,0)").alias("weight"), "base").checkpoint()
    front = starts.groupBy(*by, "node").agg(F.sum("amount").cast("bigint").alias("amount"))
    arrived = []
    for hop in range(1, rounds + 1):
        moved = front.withColumnRenamed("node", "src").join(edges, [*on, "src"]).groupBy(*by, "dst", "base").agg(
            F.sum(F.col("amount").cast("decimal(18,0)") * F.col("weight")).alias("_sum")
        )
        here = moved.select(*by, F.col("dst").alias("node"), F.expr("_sum div base").alias("amount")).filter("amount > 0")
        here = here.withColumn("_hop", F.lit(hop)).checkpoint()
        if hop > 1 and here.isEmpty():
            break
        arrived.append(here)
        front = here.drop("_hop")
        if stop is not None:
            front = front.join(stop.select(*on, "node"), [*on, "node"], "left_anti")
    every = reduce(DataFrame.unionByName, arrived)
    first = F.coalesce(F.sum(F.when(F.col("_hop") == 1, F.col("amount"))), F.lit(0))
    return every.groupBy(*by, "node").agg(
        F.sum("amount").cast("bigint").alias("amount"), first.cast("bigint").alias("direct"), F.max("_hop").alias("hops"),
        (F.max("_hop") < rounds).alias("settled"),
    )


def effective_shares(holdings: DataFrame, owners: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """Parts of every entity that an owner holds, straight and through others: owner, entity, share, direct (millionths), hops, settled.

    ``holdings``: src, dst, weight (parts of ten thousand). ``owners``: node; all by default. Shares count the whole circle, so with cross-holdings an
    owner's share of itself or of another may come out above its direct one; below a millionth nothing is held.
    """
    edges = with_base(holdings, [])
    if owners is None:
        owners = edges.select(F.col("src").alias("node"))
    starts = owners.select("node").distinct().select(F.col("node").alias("owner"), "node", F.lit(UNITS).cast("bigint").alias("amount"))
    return over_paths(starts, edges, ["owner"], [], rounds).select(
        "owner", F.col("node").alias("entity"), F.col("amount").alias("share"), "direct", "hops", "settled"
    )


def group_distress(shares: DataFrame, distressed: DataFrame, least: int = 50_000) -> DataFrame:
    """GROUP_ENTITY_DISTRESS: entities of which owners in distress effectively hold ``least`` millionths or more, with the one that holds most.

    ``shares``: effective shares of the owners in distress. Entities in distress themselves are none; an owner is not related to itself.
    """
    rows = shares.filter("owner <> entity").join(distressed.select(F.col("node").alias("entity")).distinct(), "entity", "left_anti")
    sums = rows.groupBy("entity").agg(
        F.sum("share").alias("share"), F.sum("direct").alias("direct"), F.count(F.lit(1)).alias("related"),
        F.min_by("owner", F.struct(-F.col("share"), "owner")).alias("foremost"),
    )
    return sums.filter(F.col("share") >= least).select(
        F.lit("GROUP_ENTITY_DISTRESS").alias("signal_type"), F.col("entity").alias("entity_id"), "share", "direct", "related", "foremost"
    )


def contagion_scores(relations: DataFrame, distressed: DataFrame, by: list[str], loss: float = 2.5, rounds: int = 100) -> DataFrame:
    """Distress that reaches a node over all paths of its dependencies, in millionths: ``by``, node, score, direct, hops, settled.

    ``relations``: ``by``, src, dst, weight (what dst depends on src); ``distressed``: ``by``, node. A node's dependencies add up to 1 / ``loss`` and a
    node in distress passes on its own distress only, so no score passes 1 / ``loss`` and rounds fall by that factor each.
    """
    edges = with_base(relations, by, least=1, times=loss)
    seeds = distressed.select(*by, "node").distinct()
    reached = over_paths(seeds.withColumn("amount", F.lit(UNITS).cast("bigint")), edges, by, by, rounds, stop=seeds)
    return reached.join(seeds, [*by, "node"], "left_anti").withColumnRenamed("amount", "score")


def spikes(scores: DataFrame, before: DataFrame, by: str, least: int) -> DataFrame:
    """CONTAGION_SCORE_SPIKE: nodes whose score has risen by ``least`` millionths or more since the period before; none then counts as 0.

    ``before``: ``by`` and previous, one row a period. A period without one before has no spike.
    """
    past = scores.select(F.col(by).alias("previous"), "node", F.col("score").alias("was"))
    rows = scores.join(before.select(by, "previous"), by).filter("previous IS NOT NULL").join(past, ["previous", "node"], "left")
    rise = F.col("score") - F.coalesce("was", F.lit(0))
    return rows.withColumn("rise", rise).filter(F.col("rise") >= least).select(
        F.lit("CONTAGION_SCORE_SPIKE").alias("signal_type"), F.col("node").alias("entity_id"), by, "score", "rise"
    )


def connected_exposure(exposures: DataFrame, shares: DataFrame, least_percent: int) -> DataFrame:
    """RELATIONSHIP_RISK_CONCENTRATION: money of an entity that depends on one other, straight or through what that one holds.

    ``exposures``: entity, party, cents. ``shares``: effective shares. What is owed by a party counts for the party itself wholly and for each of its
    owners by effective share, rounded down to cents; listed where it reaches ``least_percent`` of all that the entity is owed and more than the straight part.
    """
    per = exposures.filter("cents > 0").groupBy("entity", "party").agg(F.sum("cents").cast("decimal(20,0)").alias("cents"))
    held = shares.filter("owner <> entity").select("owner", F.col("entity").alias("party"), "share")
    indirect = per.join(held, "party").groupBy("entity", F.col("owner").alias("on_party")).agg(
        F.expr(f"sum(cents * CAST(share AS DECIMAL(18,0))) div {UNITS}").alias("_through")
    )
    direct = per.select("entity", F.col("party").alias("on_party"), F.col("cents").cast("bigint").alias("direct_cents"))
    both = indirect.join(direct, ["entity", "on_party"], "left").withColumn("direct_cents", F.coalesce("direct_cents", F.lit(0).cast("bigint")))
    total = per.groupBy("entity").agg(F.sum("cents").cast("bigint").alias("total_cents"))
    out = both.withColumn("connected_cents", F.col("direct_cents") + F.col("_through")).join(total, "entity")
    hit = (100 * F.col("connected_cents") >= least_percent * F.col("total_cents")) & (F.col("_through") > 0)
    return out.filter(hit & (F.col("on_party") != F.col("entity"))).select(
        F.lit("RELATIONSHIP_RISK_CONCENTRATION").alias("signal_type"), F.col("entity").alias("entity_id"), "on_party", "direct_cents", "connected_cents", "total_cents"
    )


def party_distress(flows: DataFrame, distressed: DataFrame, least_percent: int) -> DataFrame:
    """MAJOR_SUPPLIER_DISTRESS: a party in distress that takes ``least_percent`` or more of what an entity pays.

    ``flows``: entity, party, cents; ``distressed``: node.
    """
    per = flows.filter("cents > 0").groupBy("entity", "party").agg(F.sum("cents").cast("bigint").alias("cents"))
    total = per.groupBy("entity").agg(F.sum("cents").cast("bigint").alias("total_cents"))
    bad = per.join(distressed.select(F.col("node").alias("party")).distinct(), "party", "left_semi")
    hit = bad.join(total, "entity").filter(100 * F.col("cents") >= least_percent * F.col("total_cents"))
    return hit.select(F.lit("MAJOR_SUPPLIER_DISTRESS").alias("signal_type"), F.col("entity").alias("entity_id"), "party", "cents", "total_cents")
