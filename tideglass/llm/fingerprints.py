"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded difference between two of them.

Triplets are three bytes at fixed distances (``TRIPLETS``), so they reach across words and differ between texts of one
language. Their hashes are counted in ``BUCKETS`` buckets; each bucket is encoded by the quartile its count falls into (two bits),
after one byte for the length on a logarithmic scale. The difference of two digests adds the quartile steps of all buckets
and the length steps, each part cut off at what unrelated texts reach, so likeness lies between 0 and 1 and equal texts get 1.

``neighbours`` compares every document with an edited text of itself and with the next document, in ascending id order
(after the last: the first). Rows are cut at sampled quantiles of the id; the first row of each piece also goes to the piece
before, as its last row's neighbour. So the texts are shuffled once, a piece is read in order, and two texts are held at a time.

A null text is empty; null ids come first; rows of one id are ordered by their text's hash, so repeated rows are neighbours of each other.
An empty table gives an empty result, and a single row is its own neighbour. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideglass.llm.common import partitions, pieced

TRIPLETS = ((0, 3, 7), (0, 5, 11))
BITS = 9
BUCKETS = 1 << BITS
#: Mean quartile step of texts that have nothing in common, and the length steps (an eighth of a doubling each) that count as most.
FAR_STEP, FAR_LENGTH, LENGTH_SHARE = 1.25, 16, 0.1
_STEP = 4 << 20


def digest(text: str) -> np.ndarray:
    """One number for the length, then a quartile 0 to 3 for each bucket."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for number, (x, y, z) in enumerate(TRIPLETS):
        for at in range(0, len(data) - z, _STEP):
            b = data[at : at + _STEP + z].astype(np.uint64)
            m = len(b) - z
            h = b[x : x + m] | b[y : y + m] << np.uint64(8) | b[z : z + m] << np.uint64(16) | np.uint64(number + 1 << 24)
            counts += np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
    ordered = np.sort(counts)
    out = np.empty(BUCKETS + 1, np.uint8)
    out[0] = min(255, round(8 * np.log2(len(data) + 1)))
    out[1:] = sum(counts > ordered[BUCKETS * q // 4 - 1] for q in (1, 2, 3))
    return out


def encoded(d: np.ndarray) -> str:
    q = d[1:].reshape(-1, 4)
    return bytes([int(d[0])]).hex() + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.concatenate((raw[:1], ((raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()))


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.astype(np.int16), b.astype(np.int16)
    steps = min(1.0, float(np.abs(x[1:] - y[1:]).mean()) / FAR_STEP)
    length = min(1.0, abs(int(x[0]) - int(y[0])) / FAR_LENGTH)
    return max(0.0, 1.0 - (1 - LENGTH_SHARE) * steps - LENGTH_SHARE * length)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns, null where either is null."""
    return pd.Series([None if x is None or y is None else likeness_of(decoded(x), decoded(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of each text, a null text as an empty one."""
    return pd.Series([encoded(digest(t or "")) for t in text], dtype="object")


def edited(text: str, other: str) -> str:
    """The text with its last quarter replaced by as many characters of the other's beginning."""
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (piece, guest, id, text), each piece in one partition and in order; a guest is the row after the piece's last."""
    rows = pieced(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", 8 * partitions(docs), "piece")
    # The pieces' first ids: at most one row a piece.
    first = rows.groupBy("piece").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), F.col("id"))).alias("f")).select("piece", "f.id").collect()
    first.sort(key=lambda r: r.piece)
    known = [(r.piece, r.id, first[i - 1].piece) for i, r in enumerate(first)]
    table = docs.sparkSession.createDataFrame(known, f"piece int, first {docs.schema[id_col].dataType.simpleString()}, before int")
    guests = rows.join(F.broadcast(table), "piece").filter(F.col("id").eqNullSafe(F.col("first"))).select(F.col("before").alias("piece"), F.lit(1).alias("guest"), "id", "text")
    both = rows.select("piece", F.lit(0).alias("guest"), "id", "text").unionByName(guests)
    order = ["piece", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text"), "text"]
    return both.repartition(partitions(docs), "piece").sortWithinPartitions(*order)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose neighbour has not come yet: piece, id, text, digest
        for batch in batches:
            out = []
            for piece, guest, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and guest:
                    continue
                d = digest(text)
                if held is not None:
                    _, own, body, mine = held
                    changed = edited(body, text)
                    theirs = digest(changed)
                    out.append((own, len(body), hashlib.sha256(changed.encode()).hexdigest(), encoded(mine), encoded(theirs), likeness_of(mine, theirs), likeness_of(mine, d)))
                held = None if guest else (piece, number, text, d)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = with_next(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([
        ("id", pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    made = rows.mapInArrow(compare, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)
