"""Source divergence: exact values against a plain count, and the skyband against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import LONG, LOWER, ODD, clashing, docs

from tideglass.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=30, top=50):
    group, lang_docs, lang_n, occurring = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        occurring[lang].add(source)
        group[lang, source].update(words)
        lang_n[lang].update(words)
        lang_docs[lang].update(set(words))
    out = set()
    for lang, sources in occurring.items():
        kept = [t for t, d in lang_docs[lang].items() if d >= least]
        share = lambda n: {t: 1 + 10**9 * (n[t] + 5) // (sum(n[x] for x in kept) + 5 * len(kept)) for t in kept}
        q = share(lang_n[lang])
        p = {s: share(group[lang, s]) for s in sources}
        for s in sources:
            other = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(other)}
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if group[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(own[:top])}
    return out


def corpus(n, sources, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("x", "Y", "é", "字", "zz")]
    rows = []
    for i in range(n):
        s = rng.randrange(sources)
        words = rng.choices(vocabulary, weights=[1 + (j * (s + 1)) % 17 for j in range(len(vocabulary))], k=rng.randrange(40))
        rows.append((i, "1 ".join(words), rng.choice(["en", "de", None]), f"s{s}", 0))
    return rows


@pytest.mark.parametrize("top", [50, 3])
def test_audit_equals_a_plain_count(spark, top):
    rows = corpus(400, 5)
    got = sd.audit(clashing(docs(spark, rows)), 30, top)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert {tuple(r) for r in got.collect()} == plain(rows, 30, top)


def test_many_sources_and_terms_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sd, "SOURCES", 3)
    monkeypatch.setattr(sd, "TERMS", 7)
    monkeypatch.setattr(sd, "ROWS", 5)
    monkeypatch.setattr(sd, "MOST_ENTRIES", 10)
    rows = corpus(300, 11, 5)
    assert {tuple(r) for r in sd.audit(docs(spark, rows), 10, 4).collect()} == plain(rows, 10, 4)


def test_odd_rows(spark):
    # Null text, lang and source, an empty and a very long text, repeated rows: here no term stands in 30 documents.
    assert {tuple(r) for r in sd.audit(docs(spark, ODD)).collect()} == plain(ODD)
    # Each row alone is kept with a threshold of one document.
    assert {tuple(r) for r in sd.audit(docs(spark, ODD), 1).collect()} == plain(ODD, 1)
    assert sd.audit(docs(spark, [])).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(sd, "STEP", 16)
    text = LONG[:5000] + "é" * 100 + " X1y"
    assert [t.decode() for part in sd.terms(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_skyband_equals_all_pairs():
    rng = np.random.default_rng(1)
    for k in (1, 2, 5):
        for spread in (3, 40):
            n, lang_n = rng.integers(0, spread, 200), rng.integers(0, spread, 200)
            term = np.array([f"t{i}é".encode() for i in rng.permutation(200)], dtype=object)
            over = [sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and term[j] < term[i] for j in range(200)) for i in range(200)]
            assert sorted(sd.skyband(n, lang_n, term, k)) == [i for i in range(200) if over[i] < k]


def test_shares_beyond_64_bits(spark):
    row = spark.sql("SELECT 4000000000000000000L AS n, 9000000000000000000L AS total, 7L AS vocabulary")
    assert row.select(sd.share("n", "total")).first()[0] == 1 + 10**9 * (4 * 10**18 + 5) // (9 * 10**18 + 35)
