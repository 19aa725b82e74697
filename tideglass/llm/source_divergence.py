"""Source divergence audit: how far each source of a language stands from the others, and by which terms.

``audit(docs)`` counts terms per (lang, source), keeps the terms that stand in at least ``LEAST_DOCS`` documents of their language,
smooths each count to an integer share of a thousand million (all arithmetic exact) and returns two parts:

* ``pair``: the sum of absolute differences of shares between two sources over all kept terms. Terms and sources are cut into
  blocks; a task holds two source blocks of one term block and sends on one sum per pair, so no term meets a pair of rows.
* ``term``: the ``TOP`` terms whose share in the source exceeds the language's most. A term's difference grows with its count in
  the source and falls with its count in the language, so a term that ``TOP`` others dominate (count in the source not lower,
  count in the language not higher, earlier in UTF-8) cannot rank. Every partition keeps its skyband, the terms dominated by fewer
  than ``TOP`` others; skybands are merged in octaves of the count, and what stays is ranked by exact values.

Rows: null text, lang and source count as ''. Texts are taken whole; very long ones are cut into words piece by piece. Repeated
rows and ids count once a row; doc_id is not read. Ties of value rank by UTF-8. A group without terms has all counts 0; a
language without kept terms gives pairs of value 0. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideglass.llm.common import written

LEAST_DOCS, TOP = 30, 50
#: (lang, source, term) entries that a task counts before it sends them on.
MOST_ENTRIES = 250_000
#: Sources in a block of the pair sums, terms in a block, bytes of text cut into words at once, rows of a group whose skyband is found at once.
SOURCES, TERMS, STEP, ROWS = 64, 2048, 4 << 20, 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OUTSIDE = re.compile(rb"[^a-z\x80-\xff]")

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (bytes outside A-Z, a-z and non-ASCII part them), in lists of a few megabytes."""
    text = text.translate(_LOWER)
    at = 0
    while at < len(text):
        cut = _OUTSIDE.search(text, at + STEP) if at + STEP < len(text) else None
        to = cut.start() if cut else len(text)
        yield _TERM.findall(text, at, to)
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent():
        for (lang, source), (n, docs) in groups.items():
            keys = list(n)
            size = len(keys)
            columns = [pa.array([lang] * (size + 1)), pa.array([source] * (size + 1)), pa.concat_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[k] for k in keys), 0], pa.int64())], schema=COUNTS)

    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for some in terms(text.as_py()):
                n.update(some)
                seen.update(some)
            docs.update(seen)
        if sum(len(n) for n, _ in groups.values()) > MOST_ENTRIES:
            yield from sent()
            groups = {}
    yield from sent()


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the kept terms, written once; one row without a term per group.

    ``first`` marks one row of each kept (lang, term).
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    cells = cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    cells = cells.select("*", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("lang_docs"), (F.row_number().over(same.orderBy("source")) == 1).alias("first"))
    kept = cells.filter(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
    return written(kept.select("lang", "source", "term", "n", "lang_n", "first"), "term-counts")


def share(count: str, total: str) -> F.Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * vocabulary)), exact beyond 64 bits; 0 without a vocabulary."""
    return F.expr(f"CASE WHEN vocabulary > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 5 AS DECIMAL(20,0))) div CAST({total} + 5 * vocabulary AS DECIMAL(20,0)) ELSE 0 END")


def totals(cells: DataFrame) -> DataFrame:
    """Per (lang, source): its total, the language's total and vocabulary, and the share of a term it does not have."""
    langs = cells.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum((F.col("term").isNotNull() & F.col("first")).cast("long")).alias("vocabulary"), F.count_if(F.col("term").isNull()).alias("sources")
    )
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    return groups.join(langs, "lang").withColumn("rest", share("0", "total"))


class _Skyline:
    """Counts retained points at or below (place, name), up to ``k``: a Fenwick tree over places whose nodes hold their k lowest names."""

    def __init__(self, places: int, k: int):
        self.k, self.nodes = k, [[] for _ in range(places + 1)]

    def below(self, place: int, name: int) -> int:
        n, i = 0, place + 1
        while i > 0 and n < self.k:
            n += bisect_right(self.nodes[i], name)
            i -= i & -i
        return n

    def add(self, place: int, name: int) -> None:
        i = place + 1
        while i < len(self.nodes):
            node = self.nodes[i]
            if len(node) < self.k or name < node[-1]:
                insort(node, name)
                del node[self.k :]
            i += i & -i


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int = TOP) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate; repeated rows do not occur.

    Taken by falling count, rising language count and name, every row comes after all that dominate it, and the first k of
    these are themselves in the skyband, so only retained rows need to be counted.
    """
    names = np.empty(len(term), np.int64)
    names[np.argsort(term, kind="stable")] = np.arange(len(term))
    places = np.unique(lang_n, return_inverse=True)[1]
    line = _Skyline(int(places.max()) + 1 if len(places) else 0, k)
    kept = []
    for i in np.lexsort((names, lang_n, -n)).tolist():
        place, name = int(places[i]), int(names[i])
        if line.below(place, name) < k:
            line.add(place, name)
            kept.append(i)
    return np.array(kept, np.int64)


def _bands(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, size = None, 0

        def of_held():
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            names = np.array([t.as_py() for t in rows.column("term").cast(pa.binary())], dtype=object)
            at = skyband(rows.column("n").to_numpy(), rows.column("lang_n").to_numpy(), names, k)
            yield from rows.take(pa.array(np.sort(at))).to_batches()

        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names[3:])))  # all columns after term and the two counts name the group
            at = 0
            while at < len(batch):
                to = at
                while to < len(batch) and keys[to] == keys[at] and to - at < ROWS:
                    to += 1
                if keys[at] != key or size >= ROWS:
                    yield from of_held()
                    held, key, size = [], keys[at], 0
                held.append(batch.slice(at, to - at))
                size += to - at
                at = to
        yield from of_held()

    return found


def _skybands(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The skyband of each group's rows in each partition; the partition is sorted by group, so one piece of a group is held at a time."""
    rows = rows.select("term", "n", "lang_n", *groups).sortWithinPartitions(*groups)
    return rows.mapInArrow(_bands(k), rows.schema)


def top_terms(cells: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """Per (lang, source) the k terms whose share exceeds the language's most."""
    local = _skybands(cells.filter("term IS NOT NULL"), ["lang", "source"], k)
    banded = local.withColumn("octave", F.floor(F.log2("n")).cast("int")).repartition("lang", "source", "octave")
    merged = _skybands(banded, ["lang", "source", "octave"], k).drop("octave")
    valued = merged.join(groups, ["lang", "source"]).withColumn("value", share("n", "total") - share("lang_n", "lang_total")).filter("value > 0")
    ranked = valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= k)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |share - share| over the terms that occur here, for all pairs of sources of one block or of two."""
    lang, low, high = rows.lang.iat[0], rows.low.iat[0], rows.high.iat[0]
    marks = rows[rows.term.isna()].drop_duplicates("source").sort_values("source")
    cells = rows[rows.term.notna()]
    place = {s: i for i, s in enumerate(marks.source)}
    codes, names = pd.factorize(cells.term)
    matrix = np.repeat(marks.share.to_numpy(np.int64)[:, None], max(len(names), 1), axis=1)
    matrix[cells.source.map(place).to_numpy(np.int64), codes] = cells.share.to_numpy(np.int64)
    block, sources = marks.block.to_numpy(), marks.source.to_numpy(object)
    a, b, value = [], [], []
    for i in range(len(sources)):
        others = np.arange(i + 1, len(sources)) if low == high else np.flatnonzero(block > block[i])
        if len(others):
            a.append(np.repeat(sources[i], len(others)))
            b.append(sources[others])
            value.append(np.abs(matrix[others, : len(names)] - matrix[i, : len(names)]).sum(axis=1))
    if not a:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": [], "terms": []}).astype({"lang": object, "a": object, "b": object, "value": "int64", "terms": "int64"})
    return pd.DataFrame({"lang": lang, "a": np.concatenate(a), "b": np.concatenate(b), "value": np.concatenate(value).astype(np.int64), "terms": len(names)})


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every source of a language against each other one."""
    groups = groups.withColumn("blocks", F.ceil(F.col("sources") / SOURCES)).withColumn("block", F.expr("pmod(xxhash64(source), blocks)"))
    groups = groups.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / TERMS)))
    marks = groups.select("lang", "source", "block", "blocks", F.lit(None).cast("string").alias("term"), F.col("rest").alias("share"), F.explode(F.expr("sequence(0L, term_blocks - 1)")).alias("part"))
    held = cells.filter("term IS NOT NULL").join(groups, ["lang", "source"])
    held = held.select("lang", "source", "block", "blocks", "term", share("n", "total").alias("share"), F.expr("pmod(xxhash64(term), term_blocks)").alias("part"))
    met = marks.unionByName(held).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = met.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", "source", "block", "term", "share")
    sums = met.groupBy("lang", "low", "high", "part").applyInPandas(_pair_sums, "lang string, a string, b string, value bigint, terms bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    of = lambda side: groups.select("lang", F.col("source").alias(side), F.col("rest").alias(f"rest_{side}"), *(["vocabulary"] if side == "a" else []))
    sums = sums.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    both = sums.withColumn("value", F.expr("value + (vocabulary - terms) * abs(rest_a - rest_b)")).withColumn("side", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    ranked = both.select("lang", "side.source", "side.item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), both parts."""
    cells = counts(docs, least_docs)
    groups = written(totals(cells), "term-totals")
    return pairs(cells, groups).unionByName(top_terms(cells, groups, top))
