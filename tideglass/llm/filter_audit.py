"""Filter interaction audit: what five filters remove, alone and in every order, counted by one pass over a stream of documents.

Failure conditions of a text: A under 100 words, B 100 * distinct words < 80 * words, C 100 * capitals A-Z > 10 * code points, D holds
any of ``#$%&*|``, E identical to the text of a smaller doc_id. Each document so has a mask of the filters it fails. A to D follow from
its text; E depends on documents that may come later.

``counters(...)`` reads the table's files as available-now micro-batches. A task reduces its rows to one entry per text (digest) with the
least id so far, so a text that fills a third of the table reaches the keyed state as a handful of entries. The state of a text holds the
least id and who has it; texts are kept by bucket of their digest, about ``TEXTS`` to a bucket, so that a call into Python and a state entry
serve that many texts. Rows that are not the least fail E at once; when a smaller id arrives, the former holders are retracted from
their counter and added to the one with E. What the state emits are signed changes of part counters (lang by mask), added up
per micro-batch and written under its number, so a batch that is run again replaces its own changes. The counters are the sums of changes:
at most 32 a part and label value. ``audit(...)`` derives all 120 orders from them.

Equality of texts is equality of 128 bits of SHA-256. State takes some 60 bytes a distinct text in the session's state store provider; where
the executors' memory cannot hold that, set ``spark.sql.streaming.stateStore.providerClass`` to RocksDB. Files are dealt into ``BATCHES``
micro-batches, so commits, rewritten buckets and scans of the labels do not grow with the number of files.

Rows: a null text is empty, a null lang the part ''. A null doc_id neither fails E nor makes others fail it. Rows of one id and text
count each; none is smaller than the other. Very long texts are cut into words piece by piece; their distinct words are held in
the task. Labels of an id given twice count as 1 if any is 1; null labels as 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.session import new_path

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Micro-batches a table is read in, texts to a bucket of state, texts that a task holds entries of, bytes of a text cut into words at once.
BATCHES, TEXTS, MOST_TEXTS, STEP = 4, 512, 100_000, 4 << 20

_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def own_mask(text: bytes) -> int:
    """Bits of A to D."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + STEP) if at + STEP < len(text) else None
        to = cut.start() if cut else len(text)
        words = text[at:to].split()  # bytes part at 0x20 and 0x09-0x0D only
        n += len(words)
        distinct.update(words)
        at = to
    points = len(text.decode())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, _SIGNS))
    return (n < 100) | (100 * len(distinct) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (signs > 0) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = 0
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        ids = batch.column("doc_id")
        # A row without an id gets a join key of its own kind, so such rows do not meet in one task.
        spread = pa.array([f"-{row + i}" if not ids[i].is_valid else str(ids[i].as_py()) for i in range(len(texts))], pa.string())
        row += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array([own_mask(t) for t in texts], pa.int32()), ids, ids.is_valid(), spread, batch.column("part")],
            names=["digest", "mask", "doc_id", "_has_id", "_key", "part"],
        )


JUDGED = "digest binary, mask int, doc_id bigint, _has_id boolean, _key string, part string"
ENTRIES = "bucket bigint, digest binary, mask int, low bigint, part string, good boolean, toxic boolean, n_low bigint, n_other bigint, n_null bigint"
_ENTRIES = pa.schema([
    ("bucket", pa.int64()), ("digest", pa.binary()), ("mask", pa.int32()), ("low", pa.int64()), ("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()),
    ("n_low", pa.int64()), ("n_other", pa.int64()), ("n_null", pa.int64()),
])


def _reducer(buckets: int):
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One entry per text and kind of document: rows of the least id here, other rows, rows without an id.

        A text without ids has no row of a least id; its low is 0, so the column has no nulls and keeps all 64 bits in pandas.
        """

        def sent():
            rows = [(int.from_bytes(digest[:8]) % buckets, digest, mask, low or 0, *kind, *n) for digest, (mask, low, kinds) in held.items() for kind, n in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRIES.types)], schema=_ENTRIES)

        held: dict[bytes, list] = {}
        for batch in batches:
            for digest, mask, number, *kind in zip(*(batch.column(c).to_pylist() for c in ("digest", "mask", "doc_id", "part", "good", "toxic"))):
                entry = held.setdefault(digest, [mask, None, {}])
                n = entry[2].setdefault(tuple(kind), [0, 0, 0])
                if number is None:
                    n[2] += 1
                elif entry[1] is None or number < entry[1]:
                    for other in entry[2].values():
                        other[0], other[1] = 0, other[0] + other[1]
                    entry[1] = number
                    n[0] += 1
                else:
                    n[number > entry[1]] += 1
            if len(held) >= MOST_TEXTS:
                yield sent()
                held = {}
        if held:
            yield sent()

    return reduced


CHANGES = "part string, mask int, good boolean, toxic boolean, change bigint"
STATE = "texts binary"
_HOLDERS = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])


def _loaded(data: bytes) -> dict[bytes, tuple[int, dict]]:
    """Per text its least id and the rows that have it, by kind of document."""
    texts: dict[bytes, tuple[int, dict]] = {}
    with pa.ipc.open_stream(data) as stream:
        for digest, low, part, good, toxic, n in zip(*(c.to_pylist() for c in stream.read_all().columns)):
            texts.setdefault(digest, (low, {}))[1][part, good, toxic] = n
    return texts


def _stored(texts: dict[bytes, tuple[int, dict]]) -> bytes:
    rows = [(digest, low, *kind, n) for digest, (low, holders) in texts.items() for kind, n in holders.items()]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _HOLDERS) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _HOLDERS.types)], schema=_HOLDERS))
    return out.getvalue().to_pybytes()


def settle(texts: dict[bytes, tuple[int, dict]], entries: Iterable[tuple], count: Callable[[tuple, int, int], None]) -> None:
    """Applies entries to the least ids in ``texts``; ``count(kind, mask, change)`` takes the signed changes of part counters."""
    for digest, mask, at, part, good, toxic, n_low, n_other, n_null in entries:
        kind = (part, good, toxic)
        count(kind, mask, n_null)
        count(kind, mask | DUPLICATE, n_other)
        if not n_low:
            continue
        low, holders = texts.get(digest, (None, {}))
        if low is not None and at > low:
            count(kind, mask | DUPLICATE, n_low)
            continue
        if low is None or at < low:
            for former, n in holders.items():  # retraction: they fail E from now on
                count(former, mask, -n)
                count(former, mask | DUPLICATE, n)
            low, holders = at, {}
        holders[kind] = holders.get(kind, 0) + n_low
        texts[digest] = (low, holders)
        count(kind, mask, n_low)


def _settled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A trigger's entries of one bucket of texts."""
    texts = _loaded(state.get[0]) if state.exists else {}
    changes: Counter = Counter()

    def count(kind, mask, n):
        changes[kind, mask] += n

    for frame in frames:
        settle(texts, zip(*(frame[c].tolist() for c in _ENTRIES.names[1:])), count)
    if texts:
        state.update((_stored(texts),))
    rows = [(part, mask, good, toxic, n) for ((part, good, toxic), mask), n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "change"])


def counters(documents: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(part, mask, good, toxic, n) of a stream of documents: drains what is available and returns the sums of all changes."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_judged, JUDGED)
    flag = lambda c: F.coalesce(F.max(F.coalesce(F.col(c) == 1, F.lit(False))), F.lit(False)).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("_label_key")).agg(flag("quality"), flag("toxic"))
    rows = rows.join(known, (F.col("_key") == F.col("_label_key")) & F.col("_has_id"), "left")
    rows = rows.select("digest", "mask", "doc_id", "part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    changes = rows.mapInArrow(_reducer(buckets), ENTRIES).groupBy("bucket").applyInPandasWithState(_settled, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
    path = new_path(spark, "filter-counters")

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("part string, mask int, good boolean, toxic boolean, change bigint, batch int").parquet(f"{path}/batch=*") \
        .groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("n")).filter("n <> 0")


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) for all orders."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(o), i + 1, bit[f], sum(bit[x] for x in o[:i])) for o in permutations(FILTERS) for i, f in enumerate(o)]


def interactions(counts: DataFrame) -> DataFrame:
    """Every order's steps from the counters of masks."""
    counts = counts.withColumn("good", F.when(F.col("good"), F.col("n")).otherwise(0)).withColumn("toxic", F.when(F.col("toxic"), F.col("n")).otherwise(0))
    counts = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32
    every = F.expr("inline(array(" + ", ".join(f"struct('{o}' AS filter_order, {s} AS step, {b} AS bit, {p} AS before)" for o, s, b, p in steps()) + "))")
    rows = masks.select("part", "m", every)

    def total(what: str, test: str) -> F.Column:
        return F.expr(f"aggregate(filter(m, x -> {test}), 0L, (a, x) -> a + x.{what})")

    here = "x.mask & before = 0 AND x.mask & bit <> 0"
    rows = rows.select(
        "part", "filter_order", "step", "bit", total("n", "x.mask & (before | bit) = 0").alias("kept"), total("n", here).alias("removed"),
        total("n", "x.mask & bit <> 0 AND x.mask & before <> 0").alias("redundant"), total("n", "x.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "bit"]).drop("bit")


def audit(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of a Parquet table of documents, given by its path."""
    table = spark.read.parquet(documents)
    files = max(1, -(-len(table.inputFiles()) // batches))
    buckets = max(1, -(-table.count() // TEXTS))  # row counts of the files' footers
    documents = documents.rstrip("/")
    # A stream reads folders; a glob of one match also takes a table that is one file.
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{documents[:-1]}[{documents[-1]}]")
    return interactions(counters(stream, labels, buckets))
