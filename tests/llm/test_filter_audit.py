"""Filter audit: masks and orders against a plain recount, over several micro-batches with smaller ids arriving late."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from helpers_llm import LONG, ODD, SCHEMA, WORD, clashing, docs

from tideglass.llm import filter_audit as fa

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts, flags = defaultdict(list), defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        flags[i] = [flags[i][0] or quality == 1, flags[i][1] or toxic == 1]
    for i, text, lang, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = ""
        fails += "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (i is not None and least[text] < i)
        parts[lang or ""].append((fails, *(flags[i] if i is not None else (False, False))))
    out = []
    for part, found in parts.items():
        removed_by = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order):
                here = [d for d in left if f in d[0]]
                gone = sum(f in d[0] for d in found) - len(here)
                left = [d for d in left if f not in d[0]]
                removed_by[f] += len(here)
                steps.append((f, (part, "".join(order), step + 1, len(left), len(here), gone, sum(d[0] == f for d in found), sum(d[1] for d in here), sum(d[2] for d in here))))
        out += [(*row, removed_by[f]) for f, row in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, folder, labels, batches=fa.BATCHES):
    got = fa.audit(spark, str(folder), spark.createDataFrame(labels, LABELS), batches)
    return sorted(tuple(r) for r in got.select(*COLUMNS).collect())


def text(rng, copies):
    words = [rng.choice(["x", "Y", "Word", "é", "w%d" % rng.randrange(300)]) for _ in range(rng.randrange(60, 160))]
    return " ".join(words) + rng.choice(["", "", " #", " |"]) + (f" {rng.randrange(copies)}" if copies else "")


def corpus(n=160, seed=4):
    rng = random.Random(seed)
    texts = [text(rng, 0) for _ in range(n // 3)] + ["", None]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), "s", None) for i in range(n)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(0, 1, 0), (2, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_smaller_ids_arrive_late(spark, tmp_path, batches):
    """Files are read by time of writing; here the largest ids come first, so nearly every least id is retracted."""
    rows, labels = corpus()
    for at in range(len(rows), 0, -20):
        clashing(docs(spark, rows[max(at - 20, 0) : at])).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    assert audited(spark, tmp_path / "docs", labels, batches) == plain(rows, labels)


def test_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fa, "TEXTS", 3)
    rows, labels = corpus(120, 8)
    docs(spark, rows).repartition(6).write.parquet(str(tmp_path / "docs"))
    assert audited(spark, tmp_path / "docs", labels, 3) == plain(rows, labels)


def test_ids_of_64_bits_beside_null_ids(spark, tmp_path):
    big = 2**62
    rows = [(big + i, "same", "en", "s", 4) for i in (2, 1, 0)] + [(None, "other", "en", "s", 4), (None, "same", "en", "s", 4), (-5, "neg", "en", "s", 4), (-6, "neg", "en", "s", 4)]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "docs"))
    labels = [(big, 1, 1), (big + 1, 0, 1), (-6, 1, 0)]
    assert audited(spark, tmp_path / "docs", labels) == plain(rows, labels)


def test_hot_text_repeated_rows_and_nulls(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(50), "hot text", rng.choice(["en", "de"]), None, None) for _ in range(200)] + ODD + [(3, LONG, "fr", None, None), (None, LONG, "en", None, None), (2, LONG, "en", None, None)]
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "docs"))
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)]
    assert audited(spark, tmp_path / "docs", labels) == plain(rows, labels)


def test_empty_table_and_no_labels(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "none"))
    assert audited(spark, tmp_path / "none", []) == []
    docs(spark, [(1, "a b", "en", "s", 3)]).coalesce(1).write.parquet(str(tmp_path / "one"))
    got = audited(spark, tmp_path / "one", [])
    assert len(got) == 600 and got == plain([(1, "a b", "en", "s", 3)], [])


def test_long_texts_are_cut_between_words(monkeypatch):
    whole = fa.own_mask(LONG.encode())
    monkeypatch.setattr(fa, "STEP", 64)
    assert fa.own_mask(LONG.encode()) == whole == 2
    assert SCHEMA.startswith("doc_id")


def test_state_of_a_bucket_reads_back():
    texts = {bytes([i]) * 16: (i, {("en", True, False): 1, ("", False, False): i + 1}) for i in range(1, 20)}
    assert fa._loaded(fa._stored(texts)) == texts
