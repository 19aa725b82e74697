"""Language identification by compression: the language whose dictionary encodes the text in the fewest bytes.

``fit`` builds one zstandard raw-content dictionary per language from at most ``sample_docs`` labelled documents a language (the
ones with the smallest hash of their id), at most ``doc_chars`` characters of each and ``dictionary_bytes`` in all. So
the driver and every task hold at most ``most_languages`` such dictionaries, whatever the table's size; a table with more
languages is refused. ``predict`` brings a whole text to lower-case letters, compresses it in pieces of ``piece_bytes`` with each
dictionary, and picks the smallest sum. Very short texts compress alike everywhere; such a tie goes to the dictionary that holds
most of the text's words by their bytes, then to the first name. The margin, 1 - smallest / second smallest, is the score; a narrow margin rejects the prediction (``accepted`` false).

Null texts and texts without a letter are ``und`` with score 0 and not accepted, and so is every text where no language was
learned. Null labels are not learned from; repeated rows are predicted alike, and copies enter a dictionary once. An empty
table gives an empty result. Only id, text and label are read, the label only to learn, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideglass.llm.common import slices

SAMPLE_DOCS, DOC_CHARS, DICTIONARY_BYTES, PIECE_BYTES, LEVEL, MOST_LANGUAGES = 64, 4096, 1 << 16, 512, 5, 256
#: A margin below this rejects a prediction.
NARROW = 0.01
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def fold(id_col: str, folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def letters(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower())


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES, most_languages: int = MOST_LANGUAGES,
) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled documents."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return {}
    # Eight times the rows wanted pass this filter, so that few rows are ranked; small languages pass whole.
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 8 * sample_docs / r["n"])) for r in counts], "lang string, share double")
    h = F.xxhash64("id", F.lit(17))
    some = rows.join(F.broadcast(share), "lang").withColumn("h", h).filter(F.col("h").bitwiseAND(2**53 - 1) / float(2**53) < F.col("share"))
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).filter(F.col("place") <= sample_docs)
    texts: dict[str, list[str]] = {}
    for r in first.select("lang", "place", F.substring("text", 1, doc_chars).alias("text")).orderBy("lang", "place").collect():
        texts.setdefault(r.lang, []).append(letters(r.text))
    made = {lang: " ".join(dict.fromkeys(parts)).encode()[:dictionary_bytes] for lang, parts in texts.items()}
    return {lang: raw for lang, raw in made.items() if len(raw) >= 8}


def predict(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = NARROW, piece_bytes: int = PIECE_BYTES, level: int = LEVEL, keep: list[str] | None = None
) -> DataFrame:
    """(id, lang_pred, score, accepted), or the columns ``keep`` of the input in place of the id."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, whole = [], {}
        for lang in sorted(dictionaries):
            words = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            whole[lang] = frozenset(dictionaries[lang].split())
            coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)))

        def one(text: str | None) -> tuple[str, float, bool]:
            plain = letters(text or "")
            if not coders or not any(c.isalpha() for c in plain):
                return UNKNOWN, 0.0, False
            raw = memoryview(plain.encode())
            pieces = [raw[at : at + piece_bytes] for at in range(0, len(raw), piece_bytes)]
            sizes = sorted((sum(len(coder.compress(p)) for p in pieces), lang) for lang, coder in coders)
            if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
                parts = bytes(raw).split()
                sizes.sort(key=lambda x: (x[0], -sum(len(w) for w in parts if w in whole[x[1]]), x[1]))
            margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return sizes[0][1], margin, margin >= narrow

        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                lang, score, accepted = zip(*map(one, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["own", "lang_pred", "score", "accepted"])

    own = F.col(id_col) if keep is None else F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(own.alias("own"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(classify, f"own {rows.schema['own'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return made.withColumnRenamed("own", id_col) if keep is None else made


def keep_certain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", narrow: float = NARROW) -> DataFrame:
    """The rows whose language is found with a margin, with the input's columns; learned from the input's own labels."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col, narrow, keep=docs.columns).filter("accepted").select("own.*")
