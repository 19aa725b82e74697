"""N-gram Jaccard join: groups of documents linked by shingle sets of a Jaccard similarity at or above a threshold.

A document's set holds the hashes of its distinct ``width``-word shingles (fewer words: the whole sequence as one). Sets are
compared exactly, by 64-bit shingle hashes. A grouped prefix join finds the links:

1. Shingles are ordered by how often the corpus holds their bucket (``2**BUCKET_BITS`` buckets, counted over all texts), rarest
   first, then by hash. Two sets at the threshold share a shingle among each one's first ``n - need(n) + 1``: its prefix.
2. Equal sets form a class, classes of equal prefix and size a group. A group's prefix enters the index once. Shingles
   that one group alone has are dropped as they are read.
3. First round: within each shingle's groups the first ``HUBS``, by size, are hubs, and within a group its first class. Hubs are
   compared with their members, so a thousand near copies cost a thousand comparisons a hub, and a shingle of up to ``HUBS`` + 1
   groups of one class each is done. The links found give components; between rounds these may be told incompletely, never wrongly.
4. Further rounds: while many pairs across components are still open, each shingle and group that more than one component
   shares takes ``HUBS`` other hubs, those with the most links so far, and compares them with its members of other components. A
   well linked hub reaches those at the edge of a family of near copies, so a family is joined after a few hubs, not after all
   its pairs. The rounds end when one does not cut the open pairs.
5. Last round: what still may be linked are classes in different components that share a prefix shingle (or a group) and pass the
   positional filter. Groups are expanded to those classes, and all these pairs are verified. So every candidate is either verified
   or known to be connected: no link is lost, and no pair within a component is made.

To verify, only the texts in a pair are read out of the documents: their list is broadcast up to ``BROADCAST_TRIPS`` rows and
joined by shuffle beyond. A hub's text travels once per thousand of its members, a member's text once per hub; a task holds one hub's set. Hot shingles
and hubs spread by these salts and by joins that Spark can split. The index is written in the shared folder, so lost executors
cost their tasks alone.

Null and empty texts have no set, link with nothing and are their own component. Rows without an id link with nothing and have a null
component. Repeated rows are in one class. Rows of one id with different texts are compared each; they share their id's
place in the result. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.llm.common import partitions, slices, text_bytes, written
from tideglass.llm.words import NOT_SPACE, hashes, mixed, shingles, spans

BUCKET_BITS = 22
_SLAB = 1 << 14
#: Rows of at most 60 bytes that a verification broadcasts; beyond that it shuffles the texts.
BROADCAST_TRIPS = 1_000_000
#: Open pairs for each index row from which another hub round pays.
OPEN_A_ROW = 2
#: Hubs of a shingle in one round, and star steps that tell the components between rounds.
HUBS, BETWEEN_STEPS = 16, 2
#: Members that travel with one copy of their hub's text.
MEMBERS_A_COPY = 1000
#: Pairs a task gathers before it passes them on.
_PAIRS = 1 << 20


def need(n, percent: int):
    """Shingles that a set of ``n`` must share with any set at the threshold."""
    return -(-percent * n // 100)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def shingle_hashes(column: pa.Array, width: int) -> list[np.ndarray]:
    """The shingles of each text as they stand, repeated ones repeatedly."""
    data, offsets = text_bytes(column)
    starts, ends = spans(data, offsets, NOT_SPACE)
    words = hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    windows = shingles(words, width)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(windows[a : b - width + 1])
        elif b > a:
            out.append(mixed(shingles(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def set_name(sorted_set: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")


def bucket_counts(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How often the corpus holds the shingles of each bucket; from 2^32 - 1 on they count alike."""
    most = 2**32 - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        waiting: list[np.ndarray] = []

        def tally() -> None:
            nonlocal total
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=len(total))
                waiting.clear()

        for batch in batches:
            for a, b in slices(batch.column(0)):
                found = shingle_hashes(batch.column(0).slice(a, b - a), width)
                waiting.append((np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                if sum(map(len, waiting)) > len(total):
                    tally()
        tally()
        used = [(i, x) for i, x in enumerate(np.minimum(total, most).reshape(-1, _SLAB)) if x.any()]
        yield pa.RecordBatch.from_pydict({"slab": pa.array([i for i, _ in used], pa.int32()), "n": pa.array([_packed(x) for _, x in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[slab] = total.get(slab, 0) + _unpacked(raw).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slab": pa.array(list(total), pa.int32()), "n": pa.array([_packed(np.minimum(x, most)) for x in total.values()], pa.binary())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "slab int, n binary")
    out = np.zeros((1 << BUCKET_BITS, ), np.uint32).reshape(-1, _SLAB)
    for r in parts.repartition(min(64, partitions(docs)), "slab").mapInArrow(add, "slab int, n binary").collect():
        out[r.slab] = _unpacked(r.n)
    return out.ravel()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, set, group, prefix): size and name of each document's set, and its prefix with the name of that and the size."""
    frequency = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, text_col, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = frequency.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                sizes, sets, groups, prefixes = [], [], [], []
                for found in shingle_hashes(part.column(1), width):
                    s = np.unique(found)
                    n = len(s)
                    # Rarest bucket first, then by hash: the set is in hash order and the sort is stable.
                    first = s[np.argsort(rank[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")[: n - need(n, percent) + 1]] if n else s
                    raw = first.astype("<u8").tobytes()
                    sizes.append(n)
                    sets.append(set_name(s))
                    groups.append(hashlib.blake2b(raw, digest_size=16, salt=n.to_bytes(8, "little")).digest())
                    prefixes.append(raw)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (sets, groups, prefixes))], names=["id", "n", "set", "group", "prefix"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "id bigint, n bigint, set binary, group binary, prefix binary")


def index_rows(groups: DataFrame) -> DataFrame:
    """(shingle, gid, n, place, many) for every prefix shingle of a group; many: it has several classes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            many = batch.column(3).to_numpy(zero_copy_only=False)
            prefixes = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in prefixes])
            if len(sizes):
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(prefixes), "gid": np.repeat(gid, sizes), "n": np.repeat(n, sizes).astype(np.int32), "place": place.astype(np.int32), "many": np.repeat(many, sizes)})

    return groups.select("gid", "n", "prefix", "many").mapInArrow(spread, "shingle bigint, gid bigint, n int, place int, many boolean")


def possible(n1, n2, place1, place2, percent: int, least):
    """Whether two sets may be linked if the shingle at these places is the first in order that both have; for arrays or columns.

    Nothing before it is shared, so the overlap is at most one and what follows it on either side. This also bounds the sizes.
    A linked pair has such a shingle, its first common one, within both prefixes.
    """
    most = 1 + least(n1 - place1 - 1, n2 - place2 - 1)
    return 100 * most >= percent * (n1 + n2 - most)


def shared_shingles(index: DataFrame, percent: int) -> DataFrame:
    """Rows of two kinds: (pair true) the gid pairs of each shingle's first ``HUBS`` groups with its others, where they may be
    linked, and the index rows of shingles whose other pairs are open: they have more than ``HUBS`` + 1 groups, or one of several classes."""
    hubs, held = HUBS, HUBS + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[np.ndarray] | None = None  # the first rows of the shingle that may go on in the next batch
        seen, out_already, several = 0, False, False  # how many it has so far, whether they are out, whether a group has several classes
        pairs: list[np.ndarray] = []

        def gathered() -> pa.RecordBatch:
            both = np.unique(np.concatenate(pairs), axis=0)
            pairs.clear()
            zero = np.zeros(len(both), np.int64)
            return pa.RecordBatch.from_pydict({"pair": np.ones(len(both), bool), "shingle": zero, "a": both[:, 0].copy(), "b": both[:, 1].copy(), "n": zero.astype(np.int32), "place": zero.astype(np.int32)})

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(cols[0]):
                continue
            old = 0
            if first is not None and first[0][0] == cols[0][0]:
                old = len(first[0])
                cols = [np.concatenate((x, y)) for x, y in zip(first, cols, strict=True)]
            else:
                seen, out_already, several = 0, False, False
            s, g = cols[0], cols[1]
            n, p = cols[2].astype(np.int64), cols[3].astype(np.int64)
            begins = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            length = np.diff(np.append(begins, len(s)))
            begin = np.repeat(begins, length)
            place = np.arange(len(s)) - begin
            fresh = np.arange(len(s)) >= old
            for k in range(hubs):
                b = np.flatnonzero((place > k) & fresh)
                if not len(b):
                    break
                a = begin[b] + k
                ok = possible(n[a], n[b], p[a], p[b], percent, np.minimum)
                pairs.append(np.stack((g[a[ok]], g[b[ok]]), axis=1))
            whole = length.copy()
            whole[0] += max(0, seen - old)
            mixed_ = np.add.reduceat(cols[4].astype(np.int64), begins) > 0
            mixed_[0] |= several
            open_ = (whole > held) | ((whole > 1) & mixed_)
            out = np.repeat(open_, length)
            if out_already:  # the first rows of this shingle
                out &= fresh
            if out.any():
                m = np.flatnonzero(out)
                yield pa.RecordBatch.from_pydict({"pair": np.zeros(len(m), bool), "shingle": s[m], "a": g[m], "b": np.zeros(len(m), np.int64), "n": cols[2][m], "place": cols[3][m]})
            # Until they are out, all rows of the shingle so far are among those held.
            first, seen, out_already, several = [x[begins[-1] : begins[-1] + held] for x in cols], int(whole[-1]), bool(open_[-1]), bool(mixed_[-1])
            if sum(map(len, pairs)) > _PAIRS:
                yield gathered()
        if pairs:
            yield gathered()

    rows = index.repartition(partitions(index), "shingle").sortWithinPartitions("shingle", "n", "gid").select("shingle", "gid", "n", "place", "many")
    return rows.mapInArrow(read, "pair boolean, shingle bigint, a bigint, b bigint, n int, place int")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` of class ids whose sets are linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[int, np.ndarray] | None = None
        for batch in batches:
            names = batch.schema.names
            col = {x: batch.column(names.index(x)) for x in names}
            for x, y in slices(col["text"]):
                a_out, b_out = [], []
                part = {k: v.slice(x, y - x).to_pylist() for k, v in col.items() if k != "text"}
                for a, own, name, found in zip(part["a"], part["own"], part["set"], shingle_hashes(col["text"].slice(x, y - x), width), strict=True):
                    s = np.unique(found)
                    if set_name(s) != name:  # another text of the same id
                        continue
                    if own == a:
                        hub = (a, s)
                    elif hub is not None and hub[0] == a:
                        at = np.minimum(np.searchsorted(hub[1], s), len(hub[1]) - 1)
                        if linked(int((hub[1][at] == s).sum()), len(s), len(hub[1]), percent):
                            a_out.append(a)
                            b_out.append(own)
                if a_out:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_COPY).alias("copies"))
    salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")))
    trips = salted.select("a", "salt", F.col("b").alias("own")).unionByName(
        copies.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"), F.col("a").alias("own"))
    )
    trips = written(trips.join(classes.select(F.col("cid").alias("own"), "rep", "set"), "own"), "join-trips")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("text"))
    few = trips.limit(BROADCAST_TRIPS + 1).count() <= BROADCAST_TRIPS
    rows = texts.join(F.broadcast(trips) if few else trips, "rep").select("a", "salt", "own", "set", "text")
    rows = rows.repartition(partitions(docs), "a", "salt").sortWithinPartitions("a", "salt", F.col("own") != F.col("a"))
    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, label) of every node in an edge, the label being the smallest node it can reach.

    Large-star and small-star steps: each node hands its smallest neighbour to the others until only stars are left. With
    ``steps`` they end before that may be so: nodes of one label are then connected, but a component may have several labels.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    now, before, step = written(oriented(edges), "edges"), None, 0
    while step != steps:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = oriented(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(oriented(small), "edges")
        if steps is None:
            mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == before:
                break
            before = mark
    ends = now.unionByName(now.select(F.col("b").alias("a"), "b"))
    return ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def _labels(classes: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    found = components(links, steps)
    return classes.join(found, classes["cid"] == found["node"], "left").select(*[classes[c] for c in classes.columns], F.coalesce("label", "cid").alias("label"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every document: the smallest id that links reach, its own included."""
    signed = written(signatures(docs, id_col, text_col, width, percent), "join-sets")
    named = signed.filter("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("group").alias("group"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    hubs = classes.groupBy("group").agg(F.min(F.struct("rep", "cid", "set")).alias("hub"), (F.count(F.lit(1)) > 1).alias("many"))
    classes = written(classes.join(hubs.select("group", F.col("hub.cid").alias("gid"), "many"), "group").select("cid", "set", "rep", "n", "gid", "many"), "join-groups")
    first = classes.filter("cid = gid").select("gid", "set", F.col("rep").alias("id"), "many")
    groups = named.select("id", "set", "n", "prefix").join(first, ["id", "set"]).select("gid", "n", "prefix", "many")
    shared = written(shared_shingles(index_rows(groups), percent), "join-shared")

    stars = shared.filter("pair").select("a", "b").unionByName(classes.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b")))
    done = written(_once(stars), "join-stars")
    links = written(verified(done, classes, docs, id_col, text_col, width, percent), "join-links")
    members = shared.filter("NOT pair").select("shingle", F.col("a").alias("gid"), "n", "place")
    # Classes that open shingles or groups of several classes can still bring into a pair; the others are done.
    touched = members.select("gid").distinct().withColumn("open", F.lit(True))
    active = written(classes.join(touched, "gid", "left").filter("many OR open").select(classes.columns), "join-active")
    before, last = float("inf"), False
    used = done.select(F.col("a").alias("cid")).limit(0)
    while not last:
        labelled = written(_ranked(_labels(active, links, BETWEEN_STEPS), links, used), "join-labels")
        runs = written(_mixed_runs(members, labelled), "join-runs")
        rows, open_ = _size(runs)
        last = open_ <= OPEN_A_ROW * rows or open_ > before * 0.95
        before = open_
        if not last:
            pairs = written(_once(_hub_round(runs, labelled, percent)).join(done, ["a", "b"], "left_anti"), "join-open")
            last = pairs.isEmpty()
        if last:
            pairs = written(_once(_last_round(runs, labelled, percent)).join(done, ["a", "b"], "left_anti"), "join-open")
            if pairs.isEmpty():
                break
        more = written(verified(pairs, classes, docs, id_col, text_col, width, percent), "join-more")
        # Hubs of this round are not chosen again: they met all their members.
        links, done, used = links.unionByName(more), done.unionByName(pairs), used.unionByName(_busy(pairs)).distinct()
    final = _labels(classes, links)
    ids = final.groupBy("label").agg(F.min("rep").alias("component_id"))
    named_sets = final.join(ids, "label").select("set", "component_id")
    out = signed.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set")).alias("set")).join(named_sets, "set", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ranked(labelled: DataFrame, links: DataFrame, used: DataFrame) -> DataFrame:
    """The classes with ``degree``, their links so far, and -1 for hubs of earlier rounds."""
    degree = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("degree"))
    met = used.select("cid", F.lit(True).alias("met"))
    rows = labelled.join(degree, "cid", "left").join(met, "cid", "left")
    return rows.select(*labelled.columns, F.when(F.col("met"), F.lit(-1)).otherwise(F.coalesce("degree", F.lit(0))).alias("degree"))


def _mixed_runs(members: DataFrame, labelled: DataFrame) -> DataFrame:
    """(shingle, gid, label, cid, degree, n, place): index rows, one for each component in a group, of shingles that several components share."""
    kinds = labelled.groupBy("gid", "label").agg(F.max_by(F.struct("cid", "degree"), F.struct("degree", "cid")).alias("top")).select("gid", "label", "top.*")
    rows = members.join(kinds, "gid")
    several = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("shingle")
    return rows.join(several, "shingle", "left_semi")


def _fits(one: str, two: str, percent: int) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}").cast("bigint")
    return possible(c(one, "n"), c(two, "n"), c(one, "place"), c(two, "place"), percent, F.least)


def _size(runs: DataFrame) -> tuple[int, float]:
    """Index rows, and pairs of them that share a shingle and lie in different components."""
    each = runs.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q"))
    found = each.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("pairs")).first()
    return found.rows or 0, found.pairs or 0.0


def _busy(pairs: DataFrame) -> DataFrame:
    """Class ids in more pairs than a member that meets every hub of a shingle."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    return ends.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * HUBS).select("cid")


def _hub_round(runs: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """Class pairs of ``HUBS`` hubs for each shingle, and for each group of several components, with members of other components."""

    def first(rows: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.col("degree").desc(), F.xxhash64("cid"), "cid")
        return rows.filter("degree >= 0").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= HUBS).drop("at")

    across = runs.alias("m").join(first(runs, "shingle").alias("h"), (F.col("m.shingle") == F.col("h.shingle")) & (F.col("m.label") != F.col("h.label")) & _fits("m", "h", percent))
    split = labelled.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("gid")
    parted = labelled.join(split, "gid", "left_semi").select("gid", "cid", "label", "degree")
    inside = parted.alias("m").join(first(parted, "gid").alias("h"), (F.col("m.gid") == F.col("h.gid")) & (F.col("m.label") != F.col("h.label")))
    ends = [F.col("h.cid").alias("a"), F.col("m.cid").alias("b")]
    return across.select(*ends).unionByName(inside.select(*ends))


def _last_round(runs: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """All class pairs in different components that may still be linked."""
    across = runs.alias("l").join(runs.alias("r"), (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.label") < F.col("r.label")) & (F.col("l.gid") != F.col("r.gid")) & _fits("l", "r", percent))
    kinds = labelled.groupBy("gid", "label").agg(F.min("cid").alias("cid"), F.count(F.lit(1)).alias("classes"))
    inside = kinds.alias("l").join(kinds.alias("r"), (F.col("l.gid") == F.col("r.gid")) & (F.col("l.label") < F.col("r.label")))
    ends = [F.col("l.gid").alias("ga"), F.col("l.label").alias("la"), F.col("r.gid").alias("gb"), F.col("r.label").alias("lb")]
    both = across.select(*ends).unionByName(inside.select(*ends)).distinct()
    one = labelled.select(F.col("gid").alias("ga"), F.col("label").alias("la"), F.col("cid").alias("a"))
    two = labelled.select(F.col("gid").alias("gb"), F.col("label").alias("lb"), F.col("cid").alias("b"))
    return both.join(one, ["ga", "la"]).join(two, ["gb", "lb"]).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, the one with the smallest id, with the input's columns; equal rows count once.

    Documents that link with nothing stay, those without an id too.
    """
    kept = join(docs, id_col, text_col, width, percent).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).cast("bigint").alias("_kept")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    found = own.join(kept, F.col("_id") == F.col("_kept")).groupBy("_id", "_text").agg(F.first("_row").alias("_row"))
    return found.select("_row").unionByName(own.filter("_id IS NULL").select("_row")).select("_row.*")
