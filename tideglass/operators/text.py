"""Evidence texts: hashes, exact copies, phrase spans. Whole texts, no prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# (phrase, category, confidence)
PHRASES = [
    ("going concern", "GOING_CONCERN_WARNING", 0.9), ("qualified opinion", "AUDITOR_QUALIFICATION_ADVERSE", 0.9),
    ("material uncertainty", "GOING_CONCERN_WARNING", 0.8), ("license", "LICENCE_REFERENCE", 0.5), ("all rights reserved", "RIGHTS_RESERVED_NOTICE", 0.6),
]


def evidence_hashes(evidence: DataFrame) -> DataFrame:
    return evidence.select("evidence_id", "source_system", F.sha2("text", 256).alias("content_hash"))


def exact_copies(hashes: DataFrame) -> DataFrame:
    """Groups of identical texts: first id and count, no pairs."""
    return hashes.groupBy("content_hash").agg(F.min("evidence_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def _anywhere(phrase: str) -> str:
    """Regular expression of the phrase as it stands, in any case; nothing in it is read as a pattern."""
    return r"(?iu)\Q" + phrase.replace(r"\E", r"\E\\E\Q") + r"\E"


def candidate_spans(evidence: DataFrame, phrases=PHRASES) -> DataFrame:
    """One row per phrase occurrence with its offsets; a candidate, never a confirmed fact.

    Offsets count characters of the text itself (0-based, end excluded): the text is split at the phrase in any case, never
    lower-cased. A start is the sum of the parts before it, as a running sum over the text's own parts.
    """
    hits = F.array(*[
        F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category"), F.lit(conf).alias("confidence"), F.transform(F.split("text", _anywhere(p)), F.length).alias("parts"))
        for p, c, conf in phrases
    ])
    rows = evidence.select("evidence_id", F.monotonically_increasing_id().alias("_row"), F.explode(F.filter(hits, lambda h: F.size(h["parts"]) > 1)).alias("h"))
    parts = rows.select("evidence_id", "_row", "h.phrase", "h.category", "h.confidence", F.size("h.parts").alias("_n"), F.posexplode("h.parts").alias("_i", "_length"))
    before = Window.partitionBy("_row", "phrase").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum("_length").over(before) + F.col("_i") * F.length("phrase")).cast("int")
    return parts.withColumn("span_start", start).filter("_i < _n - 1").select(
        "evidence_id", "phrase", "category", "confidence", "span_start", (F.col("span_start") + F.length("phrase")).alias("span_end")
    )
