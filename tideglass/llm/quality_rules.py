"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule rejects a document by a few text features. Every rule's work and rejections are estimated on a sample, and the
cascade runs the rules by rejections per unit of work, each among the documents that the rules before it left. The verdict
is one ``coalesce`` over the rules in that order, and a rule's features stand inside it, so a row that one rule has
rejected gets no later feature computed. The sample decides the order only; a document is kept if no rule rejects it, in whatever order they run.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Null and empty texts have no words and are rejected as too short. Ties in
rejections per work keep the given order; repeated rows are judged alike; an empty table gives an empty table and the
given order. All columns of the input pass through whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Feature:
    """A text feature, made from the text and its words, and its work for a document."""

    value: Callable[[Column, Column], Column]
    work: Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects``, given a way to get features by name, is true."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("bigint")


def _windows(words: Column) -> Column:
    """(hash, place) of every three-word window, equal windows side by side. 64-bit hashes within one text."""
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))
    return F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)))


def _repeated(w: Column) -> Column:
    """Places of the windows that occur twice or more, ascending."""
    same = lambda x, i: F.when((F.get(w, i - 1)["h"] == x["h"]) | (F.get(w, i + 1)["h"] == x["h"]), x["at"])
    return F.sort_array(F.filter(F.transform(w, same), lambda p: p.isNotNull()))


def _covered(p: Column) -> Column:
    """Words in windows at these places: each window adds three, less what the next one shares with it."""
    parts = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _repeat_words(words: Column) -> Column:
    return F.coalesce(_let(_windows(words), lambda w: _let(_repeated(w), _covered)), F.lit(0)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


_CHARS = lambda: F.length("_text").cast("double")
_WORDS = lambda: F.size("_words").cast("double")

#: Work in units of one character passed once; the factors are measured once per kind of step, not per data set.
FEATURES = {
    "n_words": Feature(lambda text, words: F.size(words).cast("bigint"), lambda: F.lit(1.0)),
    "word_chars": Feature(lambda text, words: F.length(F.array_join(words, "")).cast("bigint"), lambda: 0.3 * _CHARS()),
    "n_symbols": Feature(lambda text, words: _count(text, SYMBOLS), lambda: 0.8 * _CHARS()),
    "n_bangs": Feature(lambda text, words: _count(text, "!"), lambda: 0.1 * _CHARS()),
    "n_lines": Feature(lambda text, words: F.size(_lines(text)).cast("bigint"), lambda: 1.2 * _CHARS()),
    "n_dup_lines": Feature(lambda text, words: _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"), lambda: 1.5 * _CHARS()),
    "n_repeat_words": Feature(lambda text, words: _repeat_words(words), lambda: 20 * _WORDS() + 4 * _WORDS() * F.log2(_WORDS() + 1)),
}

BASE = (
    Rule("too_short", ("n_words",), lambda f: f("n_words") < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
)
#: Thresholds are parameters of the rules.
MORE = (
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("shouting", ("n_words", "n_bangs"), lambda f: 5 * f("n_bangs") > f("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda f: ~f("word_chars").between(2 * f("n_words"), 20 * f("n_words"))),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda f: 10 * f("n_dup_lines") > 5 * f("n_lines")),
)
RULES = BASE + MORE


def _read(docs: DataFrame, text_col: str) -> DataFrame:
    """One struct of the input's columns, and the text and words under names of our own."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))


def _column(feature: str) -> Column:
    return FEATURES[feature].value(F.col("_text"), F.col("_words")).alias(feature)


def cascade_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per work on at most ``sample_rows`` documents, greedily among those not yet rejected."""
    rows = _read(docs, text_col)
    rows = rows.select("_text", "_words", *[_column(f) for f in dict.fromkeys(f for r in rules for f in r.features)])
    marks = [F.coalesce(r.rejects(F.col), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    works = [sum((FEATURES[f].work() for f in r.features), F.lit(0.0)).alias(f"w{i}") for i, r in enumerate(rules)]
    sample = rows.select(*marks, *works).limit(sample_rows).collect()
    work = [sum(x[f"w{i}"] for x in sample) or 1.0 for i in range(len(rules))]
    left = Counter(tuple(x[f"r{i}"] for i in range(len(rules))) for x in sample)
    order: list[Rule] = []
    todo = list(range(len(rules)))
    while todo:
        best = max(todo, key=lambda i: (sum(n for marks, n in left.items() if marks[i]) / work[i], -i))
        order.append(rules[best])
        todo.remove(best)
        left = Counter({marks: n for marks, n in left.items() if not marks[best]})
    return order


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, always: tuple[str, ...] = (), sample_rows: int = 1000) -> DataFrame:
    """Columns ``_row`` (the input's row), ``rejected_by`` (null: kept) and the features in ``always``, for every document."""
    order = cascade_order(docs, text_col, rules, sample_rows)
    rows = _read(docs, text_col)
    rows = rows.select("*", *[_column(f) for f in always])

    def first(words: Column) -> Column:
        get = lambda f: F.col(f) if f in always else FEATURES[f].value(F.col("_text"), words)
        return F.coalesce(*[F.when(rule.rejects(get), F.lit(rule.name)) for rule in order])

    # The words are bound as a value: Spark may move the verdict, and would else split the text again at every mention.
    return rows.select("_row", _let(F.col("_words"), first).alias("rejected_by"), *always)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with the input's columns."""
    return judge(docs, text_col, rules, (), sample_rows).filter(F.col("rejected_by").isNull()).select("_row.*")
