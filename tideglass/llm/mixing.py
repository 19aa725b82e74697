"""Mixing sources to target weights by Pfair scheduling.

A stream is one source, or all rows whose source is not in the weights (null included). Its documents in id order are cut into
blocks of ``block_docs``. A stream with weight c of W gives its k-th block the window from release ``floor(k W / c)`` to deadline
``ceil((k + 1) W / c)``. Slots 0, 1, 2 ... each take, among the streams whose next block is released, the one with the
earliest deadline (ties: the smaller name). Every block then meets its deadline, so after any number of slots a
stream is less than one block away from its share.

When a stream has no block left, a new phase begins with the other streams, their weights as before, so their shares grow in
proportion. Every document is used once; none is dropped or repeated. The schedule of a phase repeats after W slots, so
the driver makes one table of W rows per phase, and there are at most as many phases as streams: at most
(number of weights + 1) x (sum of the weights) rows, whatever the number of documents. ``MOST_SLOTS`` bounds that product.
Documents find their slot by their place within the stream, with one join on (stream, place within a period).

Null ids come first in their stream, equal ids in any order. An empty table gives an empty result. A weight of a source that does
not occur is left out. Result columns are (id, stream, block, slot, position); other columns are not read by ``positions``
and pass ``mixed`` untouched. ``as_written`` finds the order again in the files that ``mixed`` wrote.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from tideglass.llm.common import numbered, partitions

REST = "(other)"
MOST_SLOTS = 1_000_000


def edf_slots(weights: dict[str, int]) -> list[str]:
    """One period of the schedule: for each slot the stream that fills it."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    waiting: list[tuple[int, str]] = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots.append(s)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // weights[s], s))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int, int, int]]:
    """Rows (stream, first block, blocks, place in the period, streak, first slot, period) of all phases.

    Blocks ``first .. first + blocks - 1`` of the stream belong to the phase; the j-th of them fills slot
    ``first slot + (j // streak) * period + offset`` where j % streak is the place that has this offset.
    """
    left = {s: n for s, n in blocks.items() if n}
    used = dict.fromkeys(left, 0)
    rows, start = [], 0
    while left:
        active = {s: weights[s] for s in left}
        slots = edf_slots(active)
        period = len(slots)
        offsets: dict[str, list[int]] = {s: [] for s in active}
        for t, s in enumerate(slots):
            offsets[s].append(t)

        def slot(s: str, j: int) -> int:
            return j // active[s] * period + offsets[s][j % active[s]]  # noqa: B023

        length = min(slot(s, left[s] - 1) for s in left) + 1
        for s in sorted(left):
            whole, part = divmod(length, period)
            n = whole * active[s] + sum(t < part for t in offsets[s])
            if n:
                rows += [(s, used[s], n, place, active[s], start + t, period) for place, t in enumerate(offsets[s])]
                used[s] += n
                left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += length
    return rows


def with_unlisted(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, source_col: str = "source") -> dict[str, int]:
    """The weights and, at ``rest_weight``, a stream of its own for each other source of the table.

    The largest go first until ``MOST_SLOTS`` is reached; what is left, and rows without a source, share the rest's stream.
    """
    streams, total, most = len(weights) + 1, sum(weights.values()) + rest_weight, 0
    while (streams + most + 1) * (total + (most + 1) * rest_weight) <= MOST_SLOTS:
        most += 1
    source = F.col(source_col)
    others = docs.filter(source.isNotNull() & ~source.isin([*weights, REST])).groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    found = others.orderBy(F.col("n").desc(), "source").limit(most).collect()
    return {**weights, **{r.source: rest_weight for r in found}}


def positions(
    docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 1
) -> DataFrame:
    """(id, stream, block, slot, position): the slot of the document's block and the document's place in the mixed order."""
    if any(w < 1 for w in [*weights.values(), rest_weight]) or REST in weights:
        raise ValueError("weights are whole numbers from 1, and none is named " + REST)
    full = {**weights, REST: rest_weight}
    if len(full) * sum(full.values()) > MOST_SLOTS:
        raise ValueError(f"weights too fine: {len(full)} x {sum(full.values())} slots, at most {MOST_SLOTS}")
    spark = docs.sparkSession
    stream = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)).otherwise(F.lit(REST))
    rows = docs.select(F.col(id_col).alias("id"), stream.alias("stream"))
    counts = {r.stream: r["n"] for r in rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan({s: -(-n // block_docs) for s, n in counts.items()}, full)
    slots = spark.createDataFrame(table, "stream string, first bigint, blocks bigint, place bigint, streak bigint, slot0 bigint, period bigint")
    placed = numbered(rows, ["stream"], ["id"]).withColumn("block", F.expr(f"rank DIV {block_docs}"))
    # The plan is bounded by MOST_SLOTS rows; the join is by stream and place within the period.
    phases = F.broadcast(slots.select("stream", "first", "blocks", "streak").distinct())
    placed = placed.join(phases, "stream").filter("block >= first AND block < first + blocks").withColumn("place", F.expr("(block - first) % streak"))
    found = placed.join(F.broadcast(slots.drop("blocks", "streak")), ["stream", "first", "place"]).withColumn("slot", F.expr("slot0 + ((block - first) DIV streak) * period"))
    # A block before this one is short only where its stream ends there: those slots, one a stream, shift what follows.
    short = [(s, n // block_docs, block_docs - n % block_docs) for s, n in counts.items() if n % block_docs]
    position = F.col("slot") * block_docs + F.col("rank") % block_docs
    if short:
        ends = {s: (max(r for r in table if r[0] == s and r[1] <= b < r[1] + r[2] and (b - r[1]) % r[4] == r[3]), b, gap) for s, b, gap in short}
        for r, b, gap in ends.values():
            position = position - F.when(F.col("slot") > r[5] + (b - r[1]) // r[4] * r[6], F.lit(gap)).otherwise(F.lit(0))
    return found.select(F.col("id").alias(id_col), "stream", "block", "slot", position.cast("bigint").alias("position"))


def mixed(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 1) -> DataFrame:
    """All rows with their columns, in mixed order: range-partitioned by position and sorted, so files written from it follow it.

    Rows of one id (or none) share the first place of theirs.
    """
    spread = positions(docs, weights, rest_weight, id_col, source_col, block_docs).groupBy(id_col).agg(F.min("position").alias("_at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    at = spread.select(F.col(id_col).alias("_other"), F.col("_at"))
    joined = rows.join(at, F.col("_id").eqNullSafe(F.col("_other")))
    return joined.repartitionByRange(partitions(docs), "_at").sortWithinPartitions("_at").select("_row.*")


def as_written(docs: DataFrame, name: str) -> DataFrame:
    """Adds as ``name`` the place from 0 of each row in the Parquet files read: files by their task's number, rows as they lie.

    For files written from ``mixed`` this is the mixed order, however the files are split or dealt out when read. The driver
    holds one count a file.
    """
    about = docs.metadataColumn("_metadata")
    lines = docs.select("*", about["file_path"].alias(f"{name}_file"), about["row_index"].alias(f"{name}_line"))
    file, line = F.col(f"{name}_file"), F.col(f"{name}_line")
    found = lines.groupBy(file).agg(F.max(line).alias("last")).select(file, "last", F.regexp_extract(file, r"/part-(\d+)-[^/]*$", 1).alias("task")).collect()
    starts, at = [], 0
    for path, last, _ in sorted(found, key=lambda r: (int(r[2] or 0), r[0])):
        starts.append((path, at))
        at += last + 1
    first = docs.sparkSession.createDataFrame(starts, f"{name}_file string, {name}_first bigint")
    placed = lines.join(F.broadcast(first), f"{name}_file").withColumn(name, F.col(f"{name}_first") + line)
    return placed.drop(f"{name}_file", f"{name}_line", f"{name}_first")
