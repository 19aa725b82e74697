"""Token counts of whole texts by rank-synchronous merging (see ``bpe``).

Texts become pre-tokens as spans over one array of bytes. Pre-tokens not met before are merged together: all of them
lie in one ragged array, and each round applies every sequence's lowest-ranked pair at once. A document's count is the sum over
its pre-tokens of the symbols that survive, plus one for each special string in it, as the library counts by default.

Null and empty texts have no token. Rows are counted one by one, so repeated rows and ids stay as they are; an empty
table gives an empty result. Only the id and the text are read, so other columns can't clash. Long texts are handled whole; a step
holds one text or 2 MB of texts, and a worker remembers at most ``bpe.REMEMBERED`` pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tideglass.llm.bpe import tokenizer
from tideglass.llm.common import slices, text_lengths


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; ``vocabulary`` is the path of a byte-level BPE file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n = own.counts(pc.fill_null(part.column(1), "").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(text_lengths(part.column(1))), pa.array(n), pa.array(n > np.int64(limit))], names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
