"""Small fixtures and plain-Python counterparts for the document operators."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
#: Nulls in every column, an empty and a very long text, ties and repeated rows.
ODD = [
    (1, None, "en", "src0", None),
    (2, "", None, None, 0),
    (3, LONG, "en", "src0", len(LONG)),
    (4, "one two three", "de", "srcX", 13),
    (4, "one two three", "de", "srcX", 13),
    (5, "one two three", None, "src1", 13),
    (None, "no id here at all", "fr", "src0", 17),
    (None, None, None, None, None),
    (6, "!!! ### 123", "en", "src0", 11),
    (7, "word", "en", "src1", 4),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["_row", "_text", "_words", "id", "piece", "guest", "label", "cid", "n", "own", "kept", "_at", "_id", "rank", "shard", "slot", "position", "rejected_by", "stream", "set", "_kept", "accepted", "key", "size"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=4):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(rows, width=4, percent=85):
    """doc_id -> smallest doc_id it reaches, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
