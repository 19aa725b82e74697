"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideglass.llm import filter_audit, fingerprints, html_extract, language_id, license_scan, mixing, ngram_join, packing, quality_rules, sharding, source_divergence, token_counts, warc
from tideglass.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words
), facts AS (
  SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(w.text, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
    CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines, CAST(len(l.lines) AS BIGINT) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts
)
"""
MORE_REJECTS = "10 * n_symbols > n_words OR 5 * n_bangs > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 5 * n_lines"


@query(
    "op1_quality_rules",
    QUALITY_SQL
    + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {MORE_REJECTS}) AS kept FROM base""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), always=counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("_row.doc_id", *counts, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


_PHRASES = [(label, phrase.split()) for label, phrase in license_scan.PHRASES]
_TEMPLATES = [(label, sorted(set(phrase.split()))) for label, phrase in license_scan.TEMPLATES]
LICENSE_SQL = rf"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), phrases(label, p) AS (VALUES {", ".join(f"('{label}', {words})" for label, words in _PHRASES)}),
templates(t, label, s) AS (VALUES {", ".join(f"({i}, '{label}', {words})" for i, (label, words) in enumerate(_TEMPLATES))}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS word FROM words, phrases
), base AS (
  SELECT doc_id, count(*) AS n, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(unnest(regexp_split_to_array(text, '\n|[.!?;][\x20\x09-\x0D]')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM lowered
), hits AS (
  SELECT doc_id, label, len(list_intersect(s, b)) / len(s) AS share FROM blocks, templates WHERE len(list_intersect(s, b)) >= {license_scan.THRESHOLD} * len(s)
), best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(b.base_labels, '') AS base_labels, coalesce(n.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM words w LEFT JOIN base b USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN best USING (doc_id)
"""


@query("op9_license_scan", LICENSE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, more = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    words = F.transform("places", lambda p: p["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


SHARDS = 8


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.range_shards(table(spark, sf_dir, "documents"), SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Production weights: the large source at a fifth, the others alike; unlisted sources share one stream.
WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}}
REST_WEIGHT = 4

MIXING_SQL = f"""
WITH RECURSIVE weights(stream, c) AS (VALUES {", ".join(f"('{s}', {c})" for s, c in WEIGHTS.items())}, ('{mixing.REST}', {REST_WEIGHT})),
docs AS (SELECT doc_id, coalesce(w.stream, '{mixing.REST}') AS stream FROM documents d LEFT JOIN weights w ON d.source = w.stream),
ranked AS (SELECT doc_id, stream, row_number() OVER (PARTITION BY stream ORDER BY doc_id NULLS FIRST) - 1 AS block FROM docs),
streams AS (SELECT list({{'s': stream, 'c': c, 'n': n, 'k': 0, 'done': 0}} ORDER BY stream) AS st FROM (SELECT stream, any_value(c) AS c, count(*) AS n FROM docs JOIN weights USING (stream) GROUP BY stream)),
steps AS (
  SELECT 0 AS slot, 0 AS t, list_sum(list_transform(st, lambda x: x.c)) AS total, st, NULL::VARCHAR AS chosen, NULL::BIGINT AS block FROM streams
  UNION ALL
  SELECT slot + 1, CASE WHEN gone THEN 0 ELSE t + 1 END, CASE WHEN gone THEN list_sum(list_transform(list_filter(after, lambda x: x.done < x.n), lambda x: x.c)) ELSE total END,
    CASE WHEN gone THEN list_transform(list_filter(after, lambda x: x.done < x.n), lambda x: {{'s': x.s, 'c': x.c, 'n': x.n, 'k': 0, 'done': x.done}}) ELSE after END, pick.s, pick.done
  FROM (
    SELECT slot, t, total, pick, pick.done + 1 = pick.n AS gone,
      list_transform(st, lambda x: CASE WHEN x.s = pick.s THEN {{'s': x.s, 'c': x.c, 'n': x.n, 'k': x.k + 1, 'done': x.done + 1}} ELSE x END) AS after
    FROM (
      SELECT slot, t, total, st,
        list_sort(list_transform(list_filter(st, lambda x: x.k * total // x.c <= t), lambda x: {{'d': -((-(x.k + 1) * total) // x.c), 's': x.s, 'done': x.done, 'n': x.n}}))[1] AS pick
      FROM steps WHERE len(st) > 0
    )
  )
)
SELECT doc_id, stream, CAST(ranked.block AS BIGINT) AS block, CAST(slot - 1 AS BIGINT) AS slot, CAST(slot - 1 AS BIGINT) AS position
FROM ranked JOIN steps ON steps.chosen = ranked.stream AND steps.block = ranked.block
"""


@query("op5_source_mixing", MIXING_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents"), WEIGHTS, REST_WEIGHT)


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE, TOKEN_LIMIT = 2048, 1024


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, SEQUENCE)


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, TOKEN_LIMIT)


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = language_id.fold("doc_id")
    found = language_id.predict(docs, language_id.fit(docs.filter(remainder != 0)))
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


@query("op8_html_extract")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("own.page_id", "own.url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.ln + 5) // (l.lt + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


FILTER_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails
  FROM w LEFT JOIN k USING (doc_id)
), h AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
f(i) AS (VALUES (1), (2), (3), (4), (5)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, s.i AS step, ord[s.i] AS mine, ord[: s.i - 1] AS before FROM o, f s),
x AS (SELECT h.*, s.*, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, fails[mine] AS fail, len(list_filter(fails, lambda b: b)) = 1 AS single FROM h, s),
r AS (
  SELECT part, ord, step, mine, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant,
    coalesce(sum(n) FILTER (fail AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
  FROM x GROUP BY part, ord, step, mine
)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_interaction", FILTER_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", table(spark, sf_dir, "labels"))


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top OR (page_id IS NULL AND top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top OR (page_id IS NULL AND top IS NOT NULL) THEN top END AS refers_to
FROM t
"""


@query("op13_warc", WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))
