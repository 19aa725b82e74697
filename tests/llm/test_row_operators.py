"""Operators that judge each document by itself: quality rules, token counts, licenses, languages, pages."""

import html
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from helpers_llm import ODD, clashing, docs, words
from tokenizers import Tokenizer

from tideglass.llm import bpe, html_extract, language_id, license_scan, quality_rules, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def base_counts(text):
    text = text or ""
    w = [x for x in quality_words(text)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if quality_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_counts_and_verdict(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = ODD + [
        (20, good, "en", "s", 1), (21, "a b c " * 40, "en", "s", 1), (22, " ".join(f"w{i}###" for i in range(80)), "en", "s", 1),
        (23, "x y z\nx y z\n\n \nq é" + good, "en", "s", 1), (24, "aa aa aa aa\t" + good + "\x0b aa aa aa", "en", "s", 1), (25, good.upper().replace(" ", "!! "), "en", "s", 1),
    ]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.judge(docs(spark, rows), always=counts).select("_row.*", "rejected_by", *counts).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text), r.doc_id
        if r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words:
            assert r.rejected_by is not None
    assert {r.doc_id: r.rejected_by is None for r in got if (r.doc_id or 0) >= 20} == {20: True, 21: False, 22: False, 23: True, 24: True, 25: False}


def test_quality_cascade_drops_what_its_rules_reject(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = ODD + [(20, good, "en", "s", 1), (20, good, "en", "s", 1), (22, " ".join(f"w{i}###" for i in range(80)), "en", "s", 1)]
    table = clashing(docs(spark, rows))
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns
    assert [r.doc_id for r in kept.collect()] == [20, 20]
    assert quality_rules.keep_good(docs(spark, [])).count() == 0
    order = quality_rules.cascade_order(docs(spark, rows))
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
    # The dear rule comes after cheap ones that reject as much.
    assert [r.name for r in order].index("too_short") < [r.name for r in order].index("repeats")


def test_cheap_rejecting_rules_come_first(spark):
    rows = [(i, " ".join(f"w{i}###" for i in range(80)), "en", "s", 1) for i in range(20)]
    assert quality_rules.cascade_order(docs(spark, rows))[0].name == "symbols"


ALPHABET = list("ab'sdtrevml  \n\t\r1２٣é日本語😀İ́  \x00\x1c\x85!?.<|>") + ["'s", "'re", "'ll", "don't", "<|endoftext|>", "aaaaaaaa", "    ", "'ve"]


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40))) for _ in range(n)] + ["", "a" * 3000, "' " * 50, "'" * 40, " " * 100 + "x", "\n\n x"]


def test_ids_and_counts_are_those_of_the_library():
    own, library = bpe.tokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = odd_texts(5000)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in own.encode(texts)] == want
    assert own.counts(texts).tolist() == [len(x) for x in want]


def test_the_memory_of_pretokens_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, library = bpe.Tokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for part in (odd_texts(50)[i : i + 7] for i in range(0, 50, 7)):
        assert [list(x) for x in own.encode(part)] == [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert len(own.known) <= 50 or len(own.known) == len(set(own.known.tolist()))


def test_token_counts(spark):
    rows = ODD + [(30 + i, t, None, None, None) for i, t in enumerate(odd_texts(200))]
    got = token_counts.count_tokens(clashing(docs(spark, rows)), VOCABULARY, 10).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 10) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(docs(spark, []), VOCABULARY, 10).count() == 0


def test_license_scan(spark):
    rows = ODD + [
        (20, "Released under the MIT License.\nand under\nthe MIT license again", None, None, None),
        (21, "This work is licensed under the GNU General Public License, version 3.", None, None, None),
        (22, "Apache License, Version 2.0! CC BY-NC-ND", None, None, None),
        (23, "the license mit under", None, None, None),
        (24, "x " * 500 + ". All rights reserved. y", None, None, None),
        (25, "this work is under the general public license version", None, None, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan(clashing(docs(spark, rows))).collect() if (r.doc_id or 0) >= 20}
    assert [(p.label, p.word) for p in got[20].places] == [("mit", 1), ("mit", 6)]
    assert {m.label for m in got[20].matches} == {"mit"}
    assert {m.label: m.containment for m in got[21].matches} == {"gpl-3": 1.0}
    assert {(p.label, p.word) for p in got[22].places} == {("apache-2", 0), ("cc-by-nc", 5)}
    assert not got[23].places
    m = got[24].matches[0]
    assert (m.label, rows[-2][1].encode()[m.block_start : m.block_end].strip()) == ("all-rights-reserved", b"All rights reserved.")
    assert not got[25].places and not got[25].matches or got[25].matches[0].containment >= license_scan.THRESHOLD
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_join_equals_all_pairs(spark):
    rng = random.Random(3)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["x", "y", "é"]
    texts = []
    for _ in range(400):
        _, t = rng.choice(license_scan.TEMPLATES)
        w = t.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        rng.shuffle(w)
        texts.append(" ".join(w))
    got = {r.doc_id: {(m.template, round(m.containment, 9)) for m in r.matches} for r in license_scan.scan(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        have = set(words(t))
        want = set()
        for k, (_, phrase) in enumerate(license_scan.TEMPLATES):
            s = set(phrase.split())
            if len(s & have) >= license_scan.THRESHOLD * len(s):
                want.add((k, round(len(s & have) / len(s), 9)))
        assert got[i] == want, t


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ei un ge ch er zu ver be".split(), "fr": "eau ou ai le que re ment tion".split()}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 90)))
        rows.append((i, text, lang, None, None))
    return rows


def test_language_is_found_on_held_out_rows(spark, labelled):
    table = docs(spark, ODD[:4] + ODD[6:] + labelled)
    remainder = language_id.fold("doc_id")
    found = language_id.predict(table, language_id.fit(table.filter(remainder != 0))).collect()
    truth = {i: lang for i, _, lang, *_ in labelled}
    held = [r for r in found if r.doc_id in truth and r.doc_id > 7 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in found if r.doc_id in (1, 2, 6)}
    assert len(found) == len(ODD) - 2 + len(labelled)
    assert all(0 <= r.score <= 1 for r in found)
    assert any(r.lang_pred == "und" for r in found if r.doc_id == 2)


def test_language_without_letters_labels_or_rows(spark, labelled):
    words_ = language_id.fit(docs(spark, labelled))
    got = language_id.predict(clashing(docs(spark, ODD)), words_).collect()
    assert Counter(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 6)) == Counter({True: 3})
    assert {r.lang_pred for r in got} <= {*words_, "und"}
    assert {r.lang_pred for r in language_id.predict(docs(spark, ODD), {}).collect()} == {"und"}
    assert language_id.fit(docs(spark, [])) == {}
    assert language_id.predict(docs(spark, []), words_).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(docs(spark, labelled), most_languages=2)
    kept = language_id.keep_certain(clashing(docs(spark, labelled)))
    assert kept.columns == clashing(docs(spark, labelled)).columns and kept.count() > 250


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies to give you the best service on this site. Accept them all.</p></div>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>
<!-- <p>hidden</p> --><aside class="sidebar"><p>Read these other stories that we picked for you today.</p></aside>
<article><h1>A title</h1><p><b>First &amp; line.<br>goes\n on</b><p>Sh.</p><div class="ad">Buy now, buy cheap, buy two.</div>
<ul><li>point one</li><li>point two with <a href="/x">a link</a></li></ul><p>Caf&eacute; &#8211; &lt;tag&gt;.</p></article>
<section id="comments"><p>Great article, I agree with every word of it, thank you.</p></section>
<form><label>Your mail</label><button>Send</button></form><footer>&copy; 2020 Site</footer></body>"""


def test_page_text():
    text = "\n".join(t for t, content in html_extract.labelled(PAGE) if content)
    assert text == "A title\nFirst & line. goes on\nSh.\npoint one\npoint two with a link\nCafé – <tag>."


def test_classes_of_the_page_and_of_wrappers_do_not_count_against_the_article():
    long = " ".join(f"word{i}" for i in range(60)) + "."
    text = lambda page: "\n".join(t for t, content in html_extract.labelled(page) if content)
    for body in ('class="no-sidebar"', 'class="has-cookie-banner"', 'class="page sidebar"', 'class="menu-open"', "id='x'"):
        assert text(f"<body {body}><article><p>{long}</p></article></body>") == long, body
        assert text(f"<body {body}><div><p>{long}</p></div></body>") == long, body
    for wrapper in ('id="content-with-menu"', 'class="sidebar-right-page"', 'class="modal"'):
        for name in ("article", "main"):
            assert text(f"<div {wrapper}><div><{name}><p>{long}</p></{name}></div></div>") == long, wrapper
    for against in ('id="sidebar"', 'class="main-menu"', 'class="cookie-banner"', 'class="comments"'):
        assert text(f"<article><p>{long}</p><div {against}><p>{long}</p></div></article>") == long, against
    assert text(f'<div class="comments"><article><p>{long}</p></article></div>') == ""


def test_formulas_and_fallbacks_are_text():
    page = '<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="t">x=1</annotation></math> holds for all of them.</p><p><object data="a"><param name="b">A map of the town and its river.</object></p></article><object>No player</object>'
    assert [t for t, content in html_extract.labelled(page) if content] == ["So x=1 holds for all of them.", "A map of the town and its river."]


def test_pages(spark):
    long = "<article>" + "".join(f"<p>line {i} &amp; more.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (2, None, ""), (None, "v", "plain text only, without any tag at all."), (4, "w", long), (5, "x", "<p <a <b"), (6, "y", "<nav><p>unclosed"), (7, "z", "<script>never ends")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("own.*", "text", "n_blocks").collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[2] == "" and by[7] == "" and by[6] == ""
    assert by[4].split("\n") == [f"line {i} & more." for i in range(3000)]
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 9)
        odds = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = {(a, b): round(rng.uniform(0, 2), 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(side):
            return round(sum(-s if s < 0 and on else s if s > 0 and not on else 0 for s, on in zip(odds, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b]), 6)

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(odds, edges)) == best


def test_references_are_decoded_once():
    assert html.unescape("&amp;amp;") == "&amp;"
    assert [t for t, _ in html_extract.labelled("<article><p>a &amp;amp; b</p></article>")] == ["a &amp; b"]
