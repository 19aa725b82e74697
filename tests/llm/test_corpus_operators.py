"""Operators that relate documents: fingerprints, packing, mixing, near duplicates, shards, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers_llm import ODD, clashing, docs, near_components, shingles
from tokenizers import Tokenizer

from tideglass.llm import common, fingerprints, mixing, ngram_join, packing, sharding

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_fingerprints(spark):
    rng = random.Random(1)
    rows = [(i * 3, prose(rng, rng.randrange(20, 300)), None, None, None) for i in range(60)] + [(1, "", None, None, None), (2, None, None, None, None), (4, "é😀" * 30, None, None, None)]
    got = {r.doc_id: r for r in fingerprints.neighbours(clashing(docs(spark, rows))).collect()}
    order = sorted(rows)
    for i, (number, text, *_) in enumerate(order):
        other = order[(i + 1) % len(order)][1] or ""
        changed = fingerprints.edited(text or "", other)
        r = got[number]
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.encoded(fingerprints.digest(text or ""))
        a, b, c = (fingerprints.digest(x) for x in (text or "", changed, other))
        assert r.near_edited == fingerprints.likeness_of(a, b) and r.near_next == fingerprints.likeness_of(a, c)
    prose_rows = [got[n] for n, t, *_ in rows if t and len(t) > 300 and n < 170]
    assert sum(r.near_edited > r.near_next for r in prose_rows) >= 0.95 * len(prose_rows)


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.neighbours(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert fingerprints.neighbours(docs(spark, [])).count() == 0
    assert [r.near_next for r in fingerprints.neighbours(docs(spark, ODD[:1])).collect()] == [1.0]
    d = fingerprints.digest("some text that is long enough")
    assert (fingerprints.decoded(fingerprints.encoded(d)) == d).all()
    table = docs(spark, ODD).select(fingerprints.fingerprint("text").alias("f"))
    assert table.select(fingerprints.likeness("f", "f").alias("x")).distinct().collect()[0].x == 1.0


def check_packing(got, size):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def best_fit_rooms(counts, size):
    """The room left in each sequence by best-fit decreasing, one piece after the other."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else size) - length)
    return rooms


def test_packing(spark):
    rng = random.Random(4)
    rows = ODD + [(100 + i, prose(rng, rng.randrange(1, 60)), None, None, None) for i in range(300)]
    size = 128
    got = packing.pack(clashing(docs(spark, rows)), VOCABULARY, size, with_ids=True).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            want[i, k, a, b - a, zlib.crc32(raw), raw] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    assert check_packing(got, size) == len(best_fit_rooms(Counter(r.length for r in got), size))
    assert packing.pack(docs(spark, []), VOCABULARY, size).count() == 0


def test_runs_place_pieces_as_one_by_one_best_fit_does():
    rng = random.Random(8)
    for _ in range(200):
        size = rng.choice([7, 10, 64])
        counts = {n: rng.randrange(0, 30) for n in range(1, size + 1)}
        rooms = best_fit_rooms(counts, size)
        placed, used = Counter(), Counter()
        for length, _, n, m, first, offset in packing.best_fit({k: v for k, v in counts.items() if v}, size):
            for j in range(n):
                placed[length] += 1
                used[first + j // m] += length
                assert offset + (j % m) * length + length <= size
        assert placed == Counter({k: v for k, v in counts.items() if v})
        assert sorted(size - v for v in used.values()) == sorted(rooms)


def test_schedule_stays_within_a_block():
    rng = random.Random(6)
    for _ in range(50):
        weights = {f"s{i}": rng.randrange(1, 20) for i in range(rng.randrange(1, 8))}
        total, done = sum(weights.values()), Counter()
        for t, s in enumerate(mixing.edf_slots(weights), 1):
            done[s] += 1
            assert all(abs(done[x] * total - w * t) < total for x, w in weights.items())
        assert done == Counter(weights)


@pytest.mark.parametrize("block", [1, 3])
def test_mixing_uses_every_document_once(spark, block):
    rng = random.Random(block)
    rows = [(i, "t", None, rng.choice(["a", "a", "a", "b", "c", None, "zz"]), None) for i in range(200)]
    weights = {"a": 3, "b": 5, "c": 1, "none": 2}
    got = sorted(mixing.positions(clashing(docs(spark, rows)), weights, 2, block_docs=block).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(200)) and {r.doc_id for r in got} == set(range(200))
    slots = {r.slot: r.stream for r in got}
    assert sorted(slots) == list(range(len(slots)))
    left = Counter(slots.values())
    full = {**weights, mixing.REST: 2}
    active = {s: full[s] for s in left}
    done, start = Counter(), 0
    for t in sorted(slots):
        done[slots[t]] += 1
        left[slots[t]] -= 1
        total = sum(active.values())
        assert all(abs(done[s] * total - w * (t + 1 - start)) < total for s, w in active.items())
        if not left[slots[t]]:
            active = {s: w for s, w in active.items() if left[s]}
            done, start = Counter(), t + 1
    for s in {r.stream for r in got}:
        assert [r.doc_id for r in got if r.stream == s] == sorted(r.doc_id for r in got if r.stream == s)


def test_unlisted_sources_have_streams_of_their_own(spark, monkeypatch):
    rows = [(i, "t", None, ["new0", "new1", None][i * 3 // 150], None) for i in range(150)]
    table = docs(spark, rows)
    assert mixing.with_unlisted(table, {"src0": 20}, 4) == {"src0": 20, "new0": 4, "new1": 4}
    got = mixing.positions(table, mixing.with_unlisted(table, {"src0": 20}, 4), 4).collect()
    assert Counter(r.stream for r in got if r.position < 30) == {"new0": 10, "new1": 10, mixing.REST: 10}
    monkeypatch.setattr(mixing, "MOST_SLOTS", 90)  # 3 streams of 28 together
    assert mixing.with_unlisted(table, {"src0": 20}, 4) == {"src0": 20, "new0": 4}


def test_mixed_rows_and_odd_tables(spark):
    rows = [(i, "t", None, "ab"[i % 2], None) for i in range(40)]
    table = clashing(docs(spark, rows))
    mixed = mixing.mixed(table, {"a": 3, "b": 1})
    assert mixed.columns == table.columns
    order = [r.source for r in mixed.collect()]
    assert len(order) == 40 and order[:8].count("a") == 6
    assert sorted(map(str, mixing.mixed(docs(spark, ODD), {"src0": 1}).collect())) == sorted(map(str, docs(spark, ODD).collect()))
    assert mixing.positions(docs(spark, []), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.positions(docs(spark, rows), {"a": 10_000_000})


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 60), 30) for _ in range(60)]
    for _ in range(6):
        base = prose(rng, rng.randrange(30, 90), 1000).split()
        texts += family(rng, base, 20, 4)
        texts += [" ".join(base[: rng.randrange(len(base) - 12, len(base))]) for _ in range(8)]
    texts += ["a b c"] * 3 + ["A B c", "a b", "", " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.join(clashing(docs(spark, [(i, t, None, None, None) for i, t in rows]))).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert {r.doc_id: r.component_id for r in got} == near_components(rows)


def test_join_of_a_large_family_takes_few_comparisons(spark, monkeypatch):
    """Near copies that are linked by a third of their pairs: all are found, without all pairs."""
    rng = random.Random(11)
    base = prose(rng, 150, 10**6).split()
    rows = list(enumerate(family(rng, base, 250, 9)))
    compared = []
    real = ngram_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    monkeypatch.setattr(ngram_join, "HUBS", 4)
    got = ngram_join.join(docs(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows)
    assert sum(compared) < 250 * 249 / 2 / 3


def test_join_without_broadcast_and_with_salted_hubs(spark, monkeypatch):
    rng = random.Random(12)
    rows = list(enumerate(family(rng, prose(rng, 60, 1000).split(), 60, 4)))
    monkeypatch.setattr(ngram_join, "BROADCAST_TRIPS", 1)
    monkeypatch.setattr(ngram_join, "MEMBERS_A_COPY", 5)
    got = ngram_join.join(docs(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows)


def test_join_of_odd_rows(spark):
    got = ngram_join.join(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7)}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.join(docs(spark, [])).count() == 0
    kept = ngram_join.keep_one(clashing(docs(spark, ODD)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 40)), None, None, None) for i in range(500)] + [(1000 + i, "copy " * 30, None, None, None) for i in range(400)] + [(5000, "x" * 5000, None, None, None)]
    got = sharding.range_shards(clashing(docs(spark, rows)), 8, ranges=16).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 2 * 5001
    # The same shards whatever was sampled.
    again = sharding.range_shards(docs(spark, rows), 8, ranges=300).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    # A group of copies stays together but where a shard is full.
    runs = sorted((r.shard, r.slot) for r in got if r.doc_id >= 1000 and r.doc_id < 5000)
    assert all(b == (a[0], a[1] + 1) or b == (a[0] + 1, 0) for a, b in zip(runs, runs[1:]))


def test_shards_of_odd_rows_and_files(spark, tmp_path):
    got = sharding.range_shards(docs(spark, ODD), 3).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    assert sharding.range_shards(docs(spark, []), 3).count() == 0
    table = clashing(docs(spark, ODD + [(50 + i, f"text {i}", None, None, None) for i in range(50)]))
    sharding.write_shards(table, 4, str(tmp_path / "out"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_ranks_count_over_all_pieces(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(40)]), i) for i in range(600)]
    got = common.numbered(spark.createDataFrame(rows, "k int, v bigint, i int"), ["k"], ["v", "i"], pieces=9).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append(((r.v is not None, r.v or 0, r.i), r["rank"]))
    for v in by.values():
        assert [x for _, x in sorted(v)] == list(range(len(v)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ei un ge ch zu ver be".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["en", "de"]), rng.randrange(60, 120)), lang, f"src{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2], "src0", 0) for i in range(10)] + [(200, "short", "en", "src1", 0), (201, None, None, None, None), (202, "a b c " * 40, "en", "src1", 0)]
    path = str(tmp_path)
    docs(spark, rows).write.parquet(path + "/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    table, kept = spark.read.parquet(path + "/documents.parquet"), []
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = common.written(stage(spark, table, path), name)
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
        if name != "best_fit_packing":
            assert table.columns == columns
    assert kept[0] == set(range(60)) | set(range(100, 110))
    assert kept[1] == kept[0]
    assert kept[2] == kept[3] == kept[4] == set(range(60))
    got = corpus_pipeline.run(spark, path).collect()
    assert check_packing(got, 2048) == -(-sum(r.length for r in got) // 2048)


def test_pipeline_links_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(41)
    rows = []
    for _ in range(30):
        base = prose(rng, 100, 10**6).split()
        rows.append(" ".join(base))
        for edits in (1, 2, 3):
            w = list(base)
            for k in range(edits):
                w[10 + 25 * k] = f"y{rng.randrange(10**6)}"
            w = w[: rng.randrange(94, 101)]
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    roots = near_components(rows, 5, 80)
    assert roots != near_components(rows) and len(set(roots.values())) > 30
    kept = corpus_pipeline.one_of_each(spark, docs(spark, [(i, t, None, None, None) for i, t in rows]), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots.values()))


def test_packing_follows_the_mixed_order(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "LEAST_WINDOW", 40)
    rng = random.Random(51)
    rows = [(i, prose(rng, rng.randrange(100, 400)), "en", "src0" if i % 4 else "src1", 0) for i in range(200)]
    table, got = docs(spark, rows), []
    for n, weights in enumerate(({"src0": 1, "src1": 1}, {"src0": 9, "src1": 1})):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        corpus_pipeline.mix(spark, table, "").write.option("maxRecordsPerFile", 17).parquet(path := f"{tmp_path}/{n}")
        place = {r.doc_id: r.position for r in mixing.positions(table, weights, corpus_pipeline.REST_WEIGHT).collect()}
        mixed = spark.read.parquet(path)
        assert {r.doc_id: r.at for r in mixing.as_written(mixed, "at").collect()} == place
        packed = corpus_pipeline.sequences(spark, mixed, "").collect()
        check_packing(packed, 2048)
        assert sorted({r.doc_id for r in packed}) == list(range(200))
        held = defaultdict(set)
        for r in packed:
            held[place[r.doc_id] // 40].add(r.sequence_id)
        at = 0
        for w in range(5):  # each window fills the sequences after those of the one before, as tightly as by itself
            assert held[w] == set(range(at, at + len(held[w])))
            at += len(held[w])
            tokens = sum(r.length for r in packed if place[r.doc_id] // 40 == w)
            assert len(held[w]) <= -(-tokens // 2048) + 1
        got.append({(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in packed})
        share = Counter("src0" if d % 4 else "src1" for d in place if place[d] < 40)
        assert share["src0"] == [20, 36][n]
    assert got[0] != got[1]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_join_across_groups_of_several_classes(spark):
    """Two groups of equal prefixes whose hubs are not linked, but two other members are."""
    rng = random.Random(31)
    rows = []
    for f in range(12):
        base = prose(rng, 70, 10**6).split()
        for _ in range(25):
            w = list(base)
            at = rng.randrange(len(w) - 12)
            for k in range(rng.randrange(1, 4)):
                w[at + 4 * k] = f"y{rng.randrange(3)}"
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    got = ngram_join.join(docs(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == near_components(rows)
