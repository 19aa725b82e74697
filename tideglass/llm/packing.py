"""Best-fit decreasing packing of tokenized documents into sequences of one length.

A document's ids, with an end id, are one piece; a document longer than a sequence is cut into full pieces, and the first
piece is the shorter rest. Pieces are packed longest first, each into the open sequence with the least room that still
holds it; a segment tree over the room left finds it in logarithmic time.

Pieces of one length are interchangeable, so the tree is run over the lengths' counts, for the whole corpus at once: a step puts as
many pieces of a length as fit into a whole run of sequences with the same room, which is what one piece after the other
would do. The driver sees at most ``size`` counts and returns runs (length, first rank, pieces, first sequence ...); each step either ends
a length or uses up a run of sequences, so their number depends on ``size``, not on the number of documents. A
piece finds its sequence by its rank among the pieces of its length, which is counted over all partitions.

With an ``order_col`` of distinct places from 0 the order decides what stands together: documents are cut into windows of
successive places, each window is packed by itself and its sequences follow those of the windows before, and pieces of one length
are ranked by place. So every window's sequences hold the documents that the order gave it, and at most about one sequence a window is
not full. A window has ``LEAST_WINDOW`` documents, or more if the corpus would have over ``WINDOWS`` windows; so the driver sees at most
``WINDOWS`` x ``size`` counts.

Null and empty texts are the end id alone. Null and repeated ids keep their own pieces; equal rows may take each other's
places. An empty table gives an empty result. Only the id and the text are read. Long texts are handled whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tideglass.llm.bpe import tokenizer
from tideglass.llm.common import numbered, slices, written

END_ID = 0
#: Documents of a window at least, and windows at most, where an order is given.
LEAST_WINDOW, WINDOWS = 4096, 64


class RoomTree:
    """Sequences by the room they have left: a segment tree over 0..size whose nodes tell if any is open below."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, room: int, any_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = any_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is at least ``need``."""
        at = need + self.leaves
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, first offset).

    Piece ``first rank + j`` of a run stands in sequence ``first sequence + j // m`` at ``first offset + (j % m) * length``.
    """
    tree = RoomTree(size)
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    opened, out = 0, []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, m = size, size // length
                first, n = opened, -(-left // m)
                opened += n
            else:
                m = room // length
                first, n = runs[room].pop()
                want = -(-left // m)
                if n > want:
                    runs[room].append((first + want, n - want))
                    n = want
                if not runs[room]:
                    tree.mark(room, False)
            placed = min(left, n * m)
            out.append((length, rank, placed, m, first, size - room))
            full, part = divmod(placed, m)
            add(room - m * length, first, full)
            add(room - part * length, first + full, 1 if part else 0)
            rank += placed
            left -= placed
    return out


def pieces(docs: DataFrame, vocabulary: str, size: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids][, place]): every document's pieces; ``ids`` are little-endian 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                for i, tokens in enumerate(own.encode(pc.fill_null(part.column(1), "").to_pylist())):
                    raw = np.append(tokens, END_ID).astype("<u4").tobytes()
                    n = len(raw) // 4
                    first = n % size or size
                    edges = [0, *range(first, n + 1, size)]
                    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append(i)
                        number.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(memoryview(raw)[4 * x : 4 * y]))
                        if with_ids:
                            ids.append(raw[4 * x : 4 * y])
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                if order_col:
                    columns, names = [*columns, part.column(2).take(pa.array(rows, pa.int64()))], [*names, "place"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(order_col).cast("bigint").alias("place")] if order_col else []))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "") + (", place bigint" if order_col else ""))


def pack(docs: DataFrame, vocabulary: str, size: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """The pieces with their sequence_id and offset. Texts are tokenized once; the pieces are written, then counted and placed."""
    cut = written(pieces(docs, vocabulary, size, id_col, text_col, with_ids, order_col), "pieces")
    keys, order = ["length"], ["id", "piece"]
    if order_col:
        n = (cut.agg(F.max("place")).first()[0] or 0) + 1
        cut = cut.withColumn("window", F.expr(f"place DIV {max(LEAST_WINDOW, -(-n // WINDOWS))}"))
        keys, order = ["window", "length"], ["place", "piece"]
    counts: dict[int, dict[int, int]] = {}
    for r in cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["window"] if order_col else 0, {})[r["length"]] = r["n"]
    rows, opened = [], 0
    for window in sorted(counts):
        runs = best_fit(counts[window], size)
        rows += [(window, length, rank, n, m, opened + first, offset) for length, rank, n, m, first, offset in runs]
        opened += max(first + -(-n // m) for _, _, n, m, first, _ in runs)
    plan = docs.sparkSession.createDataFrame(rows, "window bigint, length bigint, rank0 bigint, n bigint, m bigint, sequence0 bigint, offset0 bigint")
    ranked = numbered(cut, keys, order)
    # The plan's rows are bounded by the sequence length, times the windows.
    placed = ranked.join(F.broadcast(plan if order_col else plan.drop("window")), keys).filter("rank >= rank0 AND rank < rank0 + n")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        F.expr("sequence0 + ((rank - rank0) DIV m)").alias("sequence_id"), F.expr("offset0 + ((rank - rank0) % m) * length").alias("offset"),
    )
