"""License scan: which blocks of a text hold a license template, as an exact set-similarity join.

A block is the text between line ends and sentence ends (``. ! ? ;`` before white space). A template matches a block if
the block holds at least ``threshold`` of the template's distinct words. Words are lower-cased (A-Z) runs of digits,
letters and characters beyond ASCII.

The join: template words are ordered by the number of blocks of the whole table that hold them, rarest first; all other
words come last. A block that matches must share a word with the template's prefix, the ``|T| - need + 1`` rarest
words, so only prefix words open a candidate. Then the length filter (the block has at least ``need`` words) and the
positional filter (what can still match after this word) drop candidates, and the rest are counted exactly. The
order moves work, never results. Templates are a parameter, so their lists stay small whatever the table's size;
documents are read where they lie and nothing is shuffled but one count per template word.

``phrases`` are looked for besides, as words that stand consecutively anywhere in the text.

Null and empty texts have no words and no match. Repeated rows and ids give one row each. An empty table gives an empty
result. Other columns are not read, so their names can't clash. Words are compared by 64-bit hashes and, for phrases and
templates, the lists of hashes are checked to be free of collisions at the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideglass.llm.common import slices, text_bytes
from tideglass.llm.words import ALPHANUMERIC, byte_set, hashes, of_text, spans

#: Wordings of license notices, and phrases that must stand word by word.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("all-rights-reserved", "all rights reserved"),
)
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
THRESHOLD = 0.8

MATCHES = "array<struct<label:string,template:int,block_start:bigint,block_end:bigint,containment:double>>"
PLACES = "array<struct<label:string,word:bigint>>"

_SENTENCE_END = byte_set(lambda b: chr(b) in ".!?;")
_SPACE = byte_set(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


class _Words:
    """The words of one slice of documents and the block of each."""

    def __init__(self, column: pa.Array, known: np.ndarray):
        self.data, self.offsets = text_bytes(column)
        self.starts, self.ends = spans(self.data, self.offsets, ALPHANUMERIC)
        self.firsts = np.searchsorted(self.starts, self.offsets)
        h = hashes(self.data, self.starts, self.ends)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        self.vocab = np.where(known[place] == h, place, -1)
        d = self.data
        ending = d == 10
        if len(d) > 1:
            ending[:-1] |= _SENTENCE_END[d[:-1]] & _SPACE[d[1:]]
        self.cuts = np.unique(np.concatenate((np.flatnonzero(ending) + 1, self.offsets)))
        self.block = np.searchsorted(self.cuts, self.starts, side="right") - 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(block, known word), each once, in order."""
        at = np.flatnonzero(self.vocab >= 0)
        both = np.unique((self.block[at].astype(np.int64) << 20) | self.vocab[at])
        return both >> 20, both & ((1 << 20) - 1)


def _vocabulary(texts) -> tuple[np.ndarray, dict[str, int]]:
    words = sorted({w for t in texts for w in t.split()})
    found = {w: of_text(w) for w in words}
    known = np.array(sorted(set(found.values())), np.uint64)
    if len(known) != len(words):
        raise ValueError("two template words share a hash")
    return known, {w: int(np.searchsorted(known, np.uint64(h))) for w, h in found.items()}


def word_frequencies(docs: DataFrame, text_col: str, known: np.ndarray) -> np.ndarray:
    """For each known word the blocks of all documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column):
                total += np.bincount(_Words(column.slice(a, b - a), known).pairs()[1], minlength=len(known))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(known)), pa.int32()), "n": pa.array(total)})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(known), np.int64)
    for r in rows:
        out[r.word] = r.n
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_words, ``places`` of phrases and ``matches`` of templates (byte spans of the blocks)."""
    known, number = _vocabulary([t for _, t in (*templates, *phrases)])
    frequency = word_frequencies(docs, text_col, known)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((np.arange(len(known)), frequency))] = np.arange(len(known))
    sets = [np.array(sorted({number[w] for w in t.split()}, key=lambda v: rank[v])) for _, t in templates]
    needs = [math.ceil(round(threshold * len(s), 9)) for s in sets]
    orders = [np.array([number[w] for w in t.split()]) for _, t in phrases]
    labels, names = [x for x, _ in templates], [x for x, _ in phrases]

    def found(w: _Words) -> list[tuple[int, int, float]]:
        """(block, template, containment)."""
        block, vocab = w.pairs()
        if not len(block):
            return []
        order = np.lexsort((rank[vocab], block))
        block, vocab = block[order], vocab[order]
        starts = np.searchsorted(block, block, side="left")
        ends = np.searchsorted(block, block, side="right")
        place, size = np.arange(len(block)) - starts, ends - starts
        out = []
        for t, (words, need) in enumerate(zip(sets, needs, strict=True)):
            here = np.full(len(known), -1)
            here[words] = np.arange(len(words))
            i = here[vocab]
            opens = (i >= 0) & (i <= len(words) - need)
            most = np.minimum(i, place) + 1 + np.minimum(len(words) - 1 - i, size - 1 - place)
            candidates = np.unique(starts[opens & (size >= need) & (most >= need)])
            for at in candidates:
                share = int((here[vocab[at : at + size[at]]] >= 0).sum())
                if share >= need:
                    out.append((int(block[at]), t, share / len(words)))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                w = _Words(part.column(1), known)
                places, matches = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                for name, words in zip(names, orders, strict=True):
                    n, m = len(w.vocab), len(words)
                    hit = np.ones(max(n - m + 1, 0), bool)
                    for k, v in enumerate(words):
                        hit &= w.vocab[k : k + len(hit)] == v
                    at = np.flatnonzero(hit)
                    doc = np.searchsorted(w.firsts, at, side="right") - 1
                    for p, d in zip(at, doc, strict=True):
                        if p + m <= w.firsts[d + 1]:
                            places[d].append({"label": name, "word": int(p - w.firsts[d])})
                for block, t, share in found(w):
                    start = w.cuts[block]
                    d = int(np.searchsorted(w.offsets, start, side="right")) - 1
                    matches[d].append({"label": labels[t], "template": t, "block_start": int(start - w.offsets[d]), "block_end": int(w.cuts[block + 1] - w.offsets[d]), "containment": share})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(w.firsts)), pa.array(places, pa_places), pa.array(matches, pa_matches)], names=["id", "n_words", "places", "matches"],
                )

    pa_places = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    pa_matches = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("block_start", pa.int64()), ("block_end", pa.int64()), ("containment", pa.float64())]))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, f"id {kind}, n_words bigint, places {PLACES}, matches {MATCHES}").withColumnRenamed("id", id_col)
