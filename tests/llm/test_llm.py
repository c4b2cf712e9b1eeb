"""Corpus operators against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, decontam, fingerprint, langid, licenses, linededup, mixing, neardup, ngramlm, passages, urlfilter, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
rng = random.Random(5)


def sentence(n, vocabulary=400, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, ties, nulls, an empty and a long text."""
    base, passage = sentence(120), sentence(60, prefix="p")
    near = base.split()
    near[10], near[60] = "changed", "other"
    texts = [base, base, " ".join(near), passage, sentence(30) + "\n" + passage + "\n" + sentence(20), passage + " tail", sentence(49), "", None, "12 34", "a\nb\nc\nd", "x\na\nb\nc\ny", "a\n\nb", "z z z z", sentence(3000)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "s1", 1), (None, None, None, None, None)]


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes():
    texts = ["a b  c", "", "b", "  c\ta\n"]
    found, sizes = words.hashes([t.encode() for t in texts], words.SPACES)
    assert sizes.tolist() == [3, 0, 1, 2]
    names = [w for t in texts for w in re.findall(WORD, t)]
    assert len(set(zip(names, found.tolist(), strict=True))) == 3
    assert words.windows(found, 2).tolist() == words.windows(found[:], 2).tolist() and len(words.windows(found, 7)) == 0


def test_language_families_and_pairs():
    langs = {"en": "the and with this", "de": "der und mit nicht", "fr": "le et avec pas", "es": "el y con no"}
    texts, labels = [], []
    for lang, words_ in langs.items():
        for _ in range(30):
            texts.append(" ".join(rng.choice(words_.split()) for _ in range(20)))
            labels.append(lang)
    model = langid.train(texts, labels)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    guessed, scores = langid.predict(model, [*texts, None, "", "12 !", "the " * 2_000_000])
    assert guessed[: len(labels)] == labels and guessed[-4:] == ["und", "und", "und", "en"]
    assert all(0 <= s <= 1 for s in scores) and scores[-4] == 0.0
    assert langid.predict(langid.train([], []), ["text"]) == (["und"], [0.0])


def test_language_on_tables(docs, empty):
    model = langid.fit(docs)
    rows = langid.identify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(CORPUS) and {r.lang_pred for r in rows if r.text is None or not re.search("[a-z]", r.text)} == {"und"}
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    for i in (None, 0, 7, 123):
        got = docs.sparkSession.range(1).select(langid.held_out(F.lit(i).cast("long")).alias("h")).first().h
        assert got == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)


def test_decontamination(spark, docs, empty):
    items = [(i, sentence(25, 5000, "q")) for i in range(12)] + [(12, None), (13, ""), (None, "short one")]
    copied, reworded = items[3][1], items[4][1].split()
    for at in (5, 9, 14):
        reworded[at] = "else"
    rows = [(0, sentence(200) + " " + copied.upper() + " " + sentence(200)), (1, sentence(40) + " " + " ".join(reworded)), (2, sentence(500)), (3, None), (4, ""), (5, copied[: len(copied) // 3]), (None, copied), (0, copied)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.text): [h.item_id for h in r.hits] for r in decontam.with_hits(table.withColumn("hits", F.lit(1)), benchmark).collect()}
    assert [found[r] for r in rows] == [[3], [4], [], [], [], [], [3], [3]]
    assert decontam.with_hits(empty, benchmark).count() == 0
    assert decontam.with_hits(table, benchmark.limit(0)).filter("size(hits) > 0").count() == 0
    split = decontam.with_hits(table, benchmark, items_at_once=5).collect()
    assert {(r.doc_id, r.text): [h.item_id for h in r.hits] for r in split} == found


def test_stop_words_are_decided_for_each_item():
    """Items that share words with others keep enough of their own, whatever the order."""
    idf = np.array([1.0, 1.0, 8.0, 8.0, 9.0], np.float32)
    common = np.array([True, True, True, False, False])
    items = [np.array([0, 1, 2]), np.array([2, 3]), np.array([0, 3, 4])]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        assert decontam.unweighted(idf, common, [items[i] for i in order]).tolist() == [False, False, False, False, False]
    assert decontam.unweighted(idf, common, [items[2]]).tolist() == [True, True, True, False, False]


def test_search_skips_nothing_that_can_be_confirmed(spark, monkeypatch):
    """Hits with and without the test of what words are around, over slabs and very long texts."""
    items = [(i, sentence(rng.choice([6, 9, 30, 120]), 300, "w")) for i in range(50)]
    texts = [sentence(rng.randrange(0, 300), 300, "w") + " " + rng.choice(items)[1] + " " + sentence(rng.randrange(0, 90), 300, "w") for _ in range(60)] + [None, "", " ".join(t for _, t in items) * 3]
    latent = decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string"), items)
    found = decontam.search(latent, texts)
    assert sum(map(len, found)) >= 60
    latent.plan.needed[:] = -1
    assert [[h[0] for h in a] for a in decontam.search(latent, texts)] == [[h[0] for h in a] for a in found]
    latent._plan = None
    whole = decontam._search_chunk
    monkeypatch.setattr(decontam, "_search_chunk", lambda *a: whole(*a, slab=8))
    assert [[h[0] for h in a] for a in decontam.search(latent, texts)] == [[h[0] for h in a] for a in found]


def test_search_projects_only_passages_with_a_weighted_word_of_an_item(spark, monkeypatch):
    """An item of frequent words, which any passage might have, was a reason to project every passage."""
    often = "a b c d e f"
    items = [(0, f"{often} rare seldom"), (1, sentence(40, 300, "w"))]
    texts = [f"{often} " * 30 for _ in range(200)] + [f"{often} {sentence(90, 300, 'w')} {items[i % 2][1]} {often}" for i in range(40)]
    latent = decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string"), items)
    rare = latent.plan.lookup(words.hashes([b"rare"], words.NOT_ALPHANUMERIC)[0])[1][0]
    assert latent.plan.needed[0] <= 0
    assert np.flatnonzero(latent.plan.possible(np.array([0, 5]), np.array([rare, rare]), 8)[:, 0]).tolist() == [0, 4, 5]
    found = decontam.search(latent, texts)
    assert [[h[0] for h in own] for own in found[200:]] == [[i % 2] for i in range(40)]
    monkeypatch.setattr(decontam.Plan, "possible", lambda plan, half, number, width: np.ones((width, 2), bool))
    assert [[(h[0], *h[2:]) for h in own] for own in decontam.search(latent, texts)] == [[(h[0], *h[2:]) for h in own] for own in found]


def test_sums_of_short_runs():
    """Sums by rank in the run against plain ones, runs of one to 32 and none at all."""
    draw = np.random.default_rng(3)
    size = draw.integers(1, 33, 200)
    first, number = np.cumsum(size) - size, draw.integers(0, 50, size.sum())
    rows, weight = draw.standard_normal((50, 7)).astype(np.float32), draw.random(size.sum()).astype(np.float32)
    for w in (None, weight):
        plain = [(rows[number[a : a + n]] * (1 if w is None else w[a : a + n, None])).sum(axis=0) for a, n in zip(first, size, strict=True)]
        assert np.allclose(decontam._sums(rows, number, first, w), plain, atol=1e-5)
        assert decontam._sums(rows, number[:0], first[:0], None if w is None else w[:0]).shape == (0, 7)


def test_passage_counts():
    """Passages each word is in, against a direct count."""
    texts = [sentence(rng.randrange(0, 200), 30, "c") for _ in range(20)] + ["", None]
    hashed = [own for _, own in decontam._tokens(texts)]
    vocabulary = np.unique(np.concatenate(hashed))[::2]
    got = next(decontam._document_counts(vocabulary)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    counts = dict(zip(got.column("word").to_pylist(), got.column("passages").to_pylist(), strict=True))
    expected = Counter()
    for own in hashed:
        for p in range(-1, len(own) // 32 + 1):
            expected.update(k for k, v in enumerate(vocabulary) if v in own[max(0, 32 * p) : 32 * p + 64])
    assert {k: v for k, v in counts.items() if k >= 0} == dict(expected)
    assert counts[-1] == sum(len(own) // 32 + 1 for own in hashed) and counts[-2] == len(texts)


def test_common_words():
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert decontam.common_words(decontam._places(a), len(a), b) == row[-1][-1]


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    """Products with all passages against plain ones, and all of 4040 texts in them; a sample of 3000 was fitted before."""
    texts = [sentence(rng.randrange(0, 200), 30, "c") for _ in range(40)] + ["", None, sentence(3000, 30, "c")]
    hashed = [own for _, own in decontam._tokens(texts)]
    vocabulary = np.unique(np.concatenate(hashed))[::2]
    idf, right = np.linspace(0.5, 3, len(vocabulary)).astype(np.float32), np.random.default_rng(1).standard_normal((len(vocabulary), 5))
    rows = []
    for own in hashed:
        for p in range(-1, len(own) // 32 + 1):
            row = np.array([np.count_nonzero(own[max(0, 32 * p) : 32 * p + 64] == v) for v in vocabulary]) * idf
            rows += [row / np.linalg.norm(row)] if row.any() else []
    plain = np.array(rows)
    got = decontam.products(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), vocabulary, idf, right)
    assert np.allclose(got, plain.T @ (plain @ right), rtol=1e-4, atol=1e-4)
    out = np.zeros(right.shape)
    decontam._add_products(out, decontam.Lookup(vocabulary), idf, right.astype(np.float32), np.concatenate(hashed), np.array([len(x) for x in hashed]), slab=2)
    assert np.allclose(out, got, rtol=1e-4, atol=1e-4)
    vectors = decontam.principal(right, plain.T @ (plain @ right))
    assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-8)

    items = [(0, "a b c d e f g h i j"), (1, "k l m n o p q r s t")]
    many = [(f"only {i} here a b c",) for i in range(4000)] + [("k t " * 20,)] * 40
    whole, read = decontam.products, []
    monkeypatch.setattr(decontam, "products", lambda docs, *a: read.append(docs.count()) or whole(docs, *a))
    found = decontam.with_hits(spark.createDataFrame(many, "text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert read == [4040] and found.filter("size(hits) > 0").count() == 0


def test_pipeline_decontaminates_by_all_documents(spark, monkeypatch, tmp_path):
    """The stage's latent space is fitted on every document it gets; it was a sample of 3000."""
    import corpus_pipeline

    spark.createDataFrame([(0, "a b c d e f g h i j")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, f"only {i} here a b c") for i in range(4000)] + [(4000, "x a b c d e f g h i j y")], "doc_id long, text string")
    whole, read = decontam.products, []
    monkeypatch.setattr(decontam, "products", lambda docs, *a: read.append(docs.count()) or whole(docs, *a))
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.count() == 4000 and kept.filter("doc_id = 4000").count() == 0 and read == [4001]


def test_latent_space_finds_items(spark):
    """Candidates of the latent search against exact TF-IDF cosines."""
    items = [(i, sentence(30, 3000, "q")) for i in range(40)]
    texts = [sentence(rng.randrange(30, 200)) + " " + rng.choice(items)[1] + " " + sentence(50) for _ in range(60)]
    latent = decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string"), items)
    hit = decontam.search(latent, texts)
    exact = [[i for i, q in items if q in t] for t in texts]
    found = sum(set(e) <= {h[0] for h in got} for e, got in zip(exact, hit, strict=True))
    assert found >= 0.9 * len(texts)


def test_latent_space_holds_items(spark):
    """Short and reworded items among documents that rule the spectrum: no cosine below the exact one."""
    items = [(i, sentence(9 if i % 2 else 40, 2500, "q")) for i in range(60)]
    texts = [" ".join(rng.choice(["w", "q"]) + str(rng.randrange(2500)) for _ in range(150)) for _ in range(200)]
    latent = decontam.fit(spark.createDataFrame([(t,) for t in texts], "text string"), items)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    counted = next(decontam._document_counts(latent.vocabulary)(iter([batch])))
    counts = dict(zip(counted.column("word").to_pylist(), counted.column("passages").to_pylist(), strict=True))
    idf = np.maximum([math.log((counts[-1] + 2) / (counts.get(k, 0) + 1)) for k in range(len(latent.vocabulary))], 0.1)
    for _, own in latent.items:
        number = decontam.lookup(latent.vocabulary, np.array(own, np.uint64))[1]
        weight = np.bincount(number, minlength=len(idf)) * idf
        assert np.linalg.norm((weight / idf) @ latent.projection) == pytest.approx(np.linalg.norm(weight), rel=1e-3)
    exact = found = 0
    for i, q in items:
        own = [w if rng.random() > 0.2 else "else" for w in q.split()] if i % 4 > 1 else q.split()
        text = sentence(64) + " " + " ".join(own) + " " + sentence(64)
        n, here = len(q.split()), decontam.search(latent, [text])[0]
        common = len([w for w, x in zip(q.split(), own, strict=True) if w == x])
        if common >= decontam.COPIED * n:
            exact, found = exact + 1, found + (i in {h[0] for h in here})
    assert exact >= 30 and found >= 0.9 * exact


def seats_one_by_one(votes, seats, caps):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if given[i] < caps[i] and votes[i] > 0]
        if not open_:
            break
        given[max(open_, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
    return given


def test_apportionment():
    for _ in range(300):
        n = rng.randrange(1, 6)
        votes, caps = [float(rng.randrange(0, 50)) for _ in range(n)], [rng.randrange(0, 30) for _ in range(n)]
        seats = rng.randrange(0, 60)
        assert mixing.apportion(votes, seats, caps) == seats_one_by_one(votes, seats, caps)
    assert mixing.apportion([13.0, 33.0, 1.0, 33.0, 3.0], 25, [27, 10, 4, 7, 10]) == [7, 10, 0, 7, 1]
    assert mixing.water_fill([100, 10, 0], [3, 1, 2], 165.0) == [145.0, 20.0, 0.0]
    assert sum(mixing.apportion([3e13, 1e13], 10**10, [10**11] * 2)) == 10**10


def test_mix(docs, empty):
    rows = mixing.mix(docs, shard_rows=2).collect()
    assert len(rows) == len(CORPUS)
    total, by = sum(r.size for r in rows), {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    sizes = [sum(r.size for r in by[s]) for s in ("s1", "s2", None)]
    targets = mixing.water_fill(sizes, [3, 1, 2], 1.5 * total)
    for s, size, target in zip(("s1", "s2", None), sizes, targets, strict=True):
        assert by[s][0].source_size == size and by[s][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in by[s]) - target) <= max(4, 0.02 * target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, shard_rows=2).collect()))
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=1)


def test_licenses(spark, empty):
    def tokens(t):
        return re.findall("[a-z0-9]+", (t or "").lower())

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows = [(i, sentence(rng.randrange(0, 90)) + "\n" + t + "\n" + sentence(rng.randrange(0, 90))) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(50, "licensed under"), (51, None), (52, ""), (None, licenses.TEMPLATES[5][1]), (0, rows[0][1]), (53, "licensed " * 2000), (54, sentence(5000) + " Released under the MIT License")]
    found = sorted(((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(0))).collect()), key=str)
    expected = [(i, name) for i, t in rows for name in sorted({n for n, x in licenses.TEMPLATES if len(grams(tokens(t)) & grams(tokens(x))) >= 0.8 * len(grams(tokens(x)))})]
    assert found == sorted(expected, key=str)
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.template_sets(spark, (("x", "too short"),))


def brute_removed(rows):
    own = [(float("inf") if i is None else i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, w in own:
        for at in range(len(w) - 49):
            key = tuple(w[at : at + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for at in range(len(w) - 49):
            if first[tuple(w[at : at + 50])] < i:
                gone[at : at + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_passages(spark, docs, empty):
    rows = [(r[0], r[1]) for r in CORPUS]
    long = sentence(400, 50, "r").split()
    rows += [(100 + k, " ".join(long[a : a + n])) for k, (a, n) in enumerate([(0, 400), (30, 60), (100, 49), (90, 200), (350, 50)])]
    rows += [(200, "same " * 300), (201, "same " * 120 + "end"), (202, sentence(10) + " " + "same " * 50)]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(((i, *b) for (i, _), b in zip(rows, brute_removed(rows), strict=True)), key=key)
    assert passages.remove_repeats(empty).count() == 0
    shards = list(passages.automata([(1, " ".join(long)), (2, "same " * 60)], most=100))
    assert len(shards) == 2 and shards[0].seen(5, long[10:90]) == [(0, 80)] and shards[0].seen(1, long) == []


def test_banded_distance():
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = [x for x in a if rng.random() > 0.15] + [rng.randrange(4) for _ in range(rng.randrange(3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        most = rng.randrange(8)
        assert neardup.banded_distance(a, b, most) == min(row[-1], most + 1)


def test_near_duplicates(spark, docs, empty):
    rows = list(CORPUS)
    base = sentence(150).split()
    for k in range(30):  # one large group, each with its own changes
        own = list(base)
        for _ in range(4):
            own[rng.randrange(150)] = f"n{k}"
        rows.append((300 + k, " ".join(own), "en", "s1", 1))
    flat = [[w for w in re.findall("[a-z0-9]+", (r[1] or "").lower())] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            if equal or (flat[i] and flat[j] and neardup.similar(flat[i], flat[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    expected = Counter()
    for m in members.values():
        ids = [x for x in m if x is not None]
        expected.update((x, min(ids) if ids else None) for x in m)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter((r.doc_id, r.class_id) for r in neardup.classes(table).collect()) == expected
    kept = neardup.one_of_each(table)
    assert kept.columns == table.columns and kept.count() == len(members)
    assert neardup.classes(empty).count() == 0 and neardup.one_of_each(empty).count() == 0


def test_pairs_of_blocks():
    """Blocks of a bucket: every pair that word counts allow, once, in its first common bucket."""
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(changed(base, set(rng.sample(range(100), rng.choice([5, 30]))), f"t{k}z")) for k in range(12)]
    word, sizes = neardup.normal_words(texts)
    numbers, has = neardup._sketched(word, sizes)
    at, nodes = 0, []
    for k, n in enumerate(sizes.tolist()):
        nodes.append({"node": k, "root": k % 4, "n_words": n, "block": k % 2, "cells": neardup.word_counts(word[at : at + n]), "numbers": numbers[k][has[k]].tolist(), "sketches": np.flatnonzero(has[k]).tolist()})
        at += n
    seen = Counter()
    kind = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n_words", pa.int64()), ("block", pa.int32()), ("cells", pa.binary()), ("numbers", pa.list_(pa.int64())), ("sketches", pa.list_(pa.int8()))]))
    for value in {v for n in nodes for v in n["numbers"]}:
        members = [n for n in nodes if value in n["numbers"]]
        for i, j in ((0, 0), (0, 1), (1, 1)):
            batch = pa.RecordBatch.from_arrays([pa.array([value]), pa.array([[m for m in members if m["block"] in (i, j)]], kind), pa.array([i]), pa.array([j])], ["value", "nodes", "i", "j"])
            for out in neardup._block_batches(iter([batch])):
                seen.update(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    wanted = {(a, b) for b in range(12) for a in range(b) if a % 4 != b % 4 and set(nodes[a]["numbers"]) & set(nodes[b]["numbers"]) and neardup.similar(*(t.split() for t in (texts[a], texts[b])))}
    assert wanted and wanted <= set(seen) and set(seen.values()) == {1}


def test_word_counts():
    """Both forms of the counts, mixed, over more texts than are counted at once; most words of a cell are 255."""
    texts = [np.array([rng.randrange(1 << 63) for _ in range(rng.choice([0, 1, 9, 511, 512, 700]))], np.uint64) for _ in range(1500)]
    texts += [np.full(n, 12345, np.uint64) for n in (300, 511, 512, 2000)]
    wanted = np.array([[min(c[i], 255) for i in range(neardup.CELLS)] for c in (Counter(((t >> np.uint64(40)) % np.uint64(neardup.CELLS)).tolist()) for t in texts)])
    all_, few = neardup._counted([neardup.word_counts(t) for t in texts])
    assert (all_ == wanted).all() and (few.sum(axis=1) == wanted.sum(axis=1)).all()
    assert neardup._counted([])[0].shape == (0, neardup.CELLS)


def changed(own, at, tag):
    return [f"{tag}{i}" if i in at else w for i, w in enumerate(own)]


def test_near_duplicate_stars_and_chains(spark):
    """Links that hold only by way of a node that isn't a bucket's first."""
    base = [f"s{rng.randrange(5000)}" for _ in range(300)]
    star = [base, *(changed(base, set(rng.sample(range(300), 39)), f"x{k}y") for k in range(40))]
    assert not any(neardup.similar(a, b) for k, a in enumerate(star[1:]) for b in star[k + 2 :])
    link = [f"c{rng.randrange(5000)}" for _ in range(300)]
    chain = [link]
    for k in range(5):
        chain.append(changed(chain[-1], set(range(50 * k, 50 * k + 50)), f"l{k}z"))
    assert not neardup.similar(chain[0], chain[2]) and neardup.similar(chain[0], chain[1])
    short = "one two three four five six seven eight nine".split()
    rows = [(rng.random(), 1, t) for t in star] + [(rng.random(), 2, t) for t in chain] + [(0.5, 3, short), (0.6, 3, changed(short, {4}, "v"))]
    rows = [(i, group, " ".join(t)) for i, (_, group, t) in enumerate(sorted(rows))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, g int, text string").repartition(3)).collect()}
    least = {g: min(i for i, h, _ in rows if h == g) for _, g, _ in rows}
    assert got == {i: least[g] for i, g, _ in rows}


@pytest.mark.parametrize("n", [9, 12, 14, 15, 20, 30, 100, 300])
def test_near_duplicate_recall(n):
    """Pairs at 0.8 (or the next above) are candidates with 0.99, changes at random or even places."""
    d, found, tries = n // 5, 0, 600
    for k in range(tries):
        own = [f"r{k}a{i}" for i in range(n)]
        other = changed(own, set(range(2, n, 5)) if k % 2 and len(range(2, n, 5)) <= d else set(rng.sample(range(n), d)), "q")
        two = [" ".join(own), " ".join(other)]
        (a, b), (word, sizes) = neardup.sketches(two)[0], neardup.normal_words(two)
        keys = [set(neardup.short_keys(w)) for w in (word[: sizes[0]], word[sizes[0] :])]
        found += bool(keys[0] & keys[1]) or (a == b).sum() >= (1 if n < neardup.FEW else neardup.SHARED)
    # Three standard deviations of so many tries.
    assert found >= 0.99 * tries - 3 * math.sqrt(0.0099 * tries)


def test_lm_scores(spark, docs, empty):
    rows = [(r[0], r[1]) for r in CORPUS]
    counts, contexts = [Counter() for _ in range(6)], [Counter() for _ in range(6)]
    laid = ["\x02" * 4 + (t or "") for _, t in rows]
    for t in laid:
        for i in range(4, len(t)):
            for k in range(1, 6):
                counts[k][t[i - k + 1 : i + 1]] += 1
                contexts[k][t[i - k + 1 : i]] += 1

    def score(g):
        k = len(g)
        if k == 1:
            return counts[1][g] / sum(counts[1].values())
        return counts[k][g] / contexts[k][g[:-1]] if counts[k][g] >= 2 else 0.4 * score(g[1:])

    expected = sorted((str(i), len(t) - 4, round(sum(math.log(score(t[at - 4 : at + 1])) for at in range(4, len(t))), 6)) for (i, _), t in zip(rows, laid, strict=True))
    got = ngramlm.score(docs, block_mb=1e-4).collect()
    for a, b in zip(expected, sorted((str(r.doc_id), r.n_chars, round(r.log_score, 6)) for r in got), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
    assert {r.mean_log_score for r in got if r.n_chars == 0} == {None}
    assert ngramlm.score(empty).count() == 0


def parse_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    best = (None, None)
    for said, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, said)
    return best


def test_urls(spark):
    urls = [f"http://a{i}.example.com/{rng.choice(['en', 'de'])}/{i}" for i in range(40)] + [f"https://b{i}.example.net/{rng.choice(['es', 'fr'])}/{i}?q=1" for i in range(40)]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x#f", "http://x.org/fr/1", "http://com", "http://com/", "http://xcom/en/", "http://É.com?a/b", "ftp://www.example.com/en/", urls[0], "a://b://c/d"]
    table = spark.createDataFrame([(i % 90, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = urlfilter.judge(table).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((i % 90, *parse_url(u), brute_rule(*parse_url(u))[0]) for i, u in enumerate(urls))
    assert all(r.verdict == brute_rule(r.host, r.path)[1] for r in rows if r.rule) and {r.verdict for r in rows} == {"allow", "block"}
    salted = urlfilter.judge(table, broadcast_rows=0).collect()
    assert sorted((str(r.page_id), r.verdict, round(r.score, 9)) for r in rows) == sorted((str(r.page_id), r.verdict, round(r.score, 9)) for r in salted)
    assert urlfilter.judge(table.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")).collect()} == {"allow"}


def test_url_scores_by_hand(spark):
    """Witten-Bell mixture of orders against a direct computation."""
    grams = Counter({("\x02a", "a"): 3, ("ab", "a"): 2, ("ab", "r"): 4, ("bb", "r"): 1})
    rows = {}
    for (g, m), n in grams.items():
        rows.setdefault(g, {"a": 0, "r": 0})[m] += n
    labelled = spark.createDataFrame([(g, v["a"], v["r"]) for g, v in rows.items()], "gram string, accepted long, rejected long")
    wanted = spark.createDataFrame([("ab",), ("zz",), ("\x02a",)], "gram string")

    def prob(g, m):
        p = 1 / 65536
        for k in (0, 1):
            cut, context = g[-(k + 1) :], g[-(k + 1) : -1] if k else ""
            own = Counter()
            for (x, y), n in grams.items():
                if y == m and (not k or x[0] == context):
                    own[x[-(k + 1) :]] += n
            if own:
                p = (own[cut] + len(own) * p) / (sum(own.values()) + len(own))
        return p

    for r in urlfilter.gram_scores(labelled, wanted, 1).collect():
        assert r.llr == pytest.approx(math.log(prob(r.gram, "a")) - math.log(prob(r.gram, "r")))


def test_fingerprints(spark, empty):
    rows = [(i, t) for i, t in enumerate(["One. Two. Three.\nFour.\nFive. Six.", "Five. Six.\nOne. Two. Three.\n\nFour.", "Other. Words. Here.\nAnd more.", "", None, "é😀 x", "One. Two. Three.\nFour."])]
    table = spark.createDataFrame([*rows, (None, "last"), (2, "tie")], "doc_id long, text string").withColumn("lanes", F.lit(1))
    for buckets in (1, 3):
        got = fingerprint.with_edits(table, buckets).collect()
        by = {(r.doc_id, r.n_chars): r for r in got}
        order = sorted([*rows, (2, "tie"), (None, "last")], key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
        assert len(got) == len(order)
        for k, (i, t) in enumerate(order):
            own, following = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            assert by[i, len(own)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by[0, len(rows[0][1])].fingerprint == by[1, len(rows[1][1])].fingerprint != by[2, len(rows[2][1])].fingerprint
    pairs = fingerprint.with_fingerprint(spark.createDataFrame([(0, rows[0][1]), (6, rows[6][1]), (9, "Five. Six.")], "i int, text string"), "text", "f")
    x = {r.i: r.f for r in pairs.collect()}
    check = spark.createDataFrame([(x[0], x[6], x[9])], "a array<long>, b array<long>, c array<long>")
    r = check.select((fingerprint.inserted(F.col("b"), F.col("c")) == F.col("a")).alias("plus"), (fingerprint.deleted(F.col("a"), F.col("c")) == F.col("b")).alias("minus"), fingerprint.likeness(F.col("a"), F.col("b")).alias("near"), fingerprint.likeness(F.col("b"), F.col("c")).alias("far")).first()
    assert r.plus and r.minus and r.near > r.far
    assert fingerprint.with_edits(empty, 4).count() == 0


def test_likeness_of_long_texts(spark):
    """Lanes don't wrap: estimates stay near the cosine of the sentence multisets."""
    own = [f"Sentence {i} of many." for i in range(40_000)]
    texts = {"whole": own, "half": own[:20_000], "other": [f"Different {i}." for i in range(40_000)], "one": ["The same."] * 20_000, "mix": own[:10_000] + ["The same."] * 100}
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, text string")
    found = {r.k: r.f for r in fingerprint.with_fingerprint(table, "text", "f").collect()}
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame([(a, b, found[a], found[b]) for a, b in pairs], "a string, b string, x array<long>, y array<long>")
    for r in rows.select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("near")).collect():
        x, y = Counter(texts[r.a]), Counter(texts[r.b])
        exact = sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        assert abs(r.near - exact) < 0.3, (r.a, r.b, r.near, exact)
    assert len(set(map(tuple, found.values()))) == len(texts)


@pytest.mark.parametrize("ids", ["outlier", "null", "one", "large"])
def test_buckets_hold_about_as_much_each(spark, ids):
    """No bucket takes much more than its share, and the order is that of all rows."""
    name = {"outlier": lambda i: 9 * 10**18 if i == 7 else i, "null": lambda i: None, "one": lambda i: 5, "large": lambda i: 2**63 - 1 - i}[ids]
    rows = [(name(i), f"text {i} " + "x" * 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select(F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long").alias("cell"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), F.lit(1).cast("long").alias("weight"))
    _, counted = fingerprint.cells(keyed, 16)
    assert sum(c[1] for c in counted) == 2000 and max(c[1] for c in counted) <= 2000 / 16
    got = {r.text: r.next_text for r in fingerprint.with_next(df, 16, "text").collect()}
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_even_ids_take_one_join_whatever_the_buckets(spark):
    """Rows were joined once more for each level of cuts, of which larger inputs had more."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    for buckets in (4, 64):
        found = fingerprint.with_next(df, buckets, "text")
        assert len(re.findall(r"Join \w", found._jdf.queryExecution().optimizedPlan().toString())) == 1
        assert found.filter("next_text <> concat('text ', if(doc_id = 0, 4999, doc_id - 1))").count() == 0


def brute_lines(rows, least):
    docs = sorted({(2**63 if i is None else i, t) for i, t in rows if t is not None}, key=lambda d: d[0])
    first, gone = {}, {}
    for i, t in docs:
        kept = [(at, x) for at, x in enumerate(t.split("\n")) if x.strip(" ")]
        for at in range(len(kept) - least + 1):
            first.setdefault(tuple(x for _, x in kept[at : at + least]), (i, t, at))
    for i, t in docs:
        kept = [(at, x) for at, x in enumerate(t.split("\n")) if x.strip(" ")]
        for at in range(len(kept) - least + 1):
            if first[tuple(x for _, x in kept[at : at + least])] != (i, t, at):
                gone.setdefault((i, t), set()).update(k for k, _ in kept[at : at + least])
    return {(i, t): "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone.get((2**63 if i is None else i, t), ())) for i, t in rows if t is not None}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(spark, docs, least):
    rows = [(r[0], r[1]) for r in CORPUS if r[0] is not None or r[1] is None]
    rows += [(100 + k, "\n".join(rng.choice("abcd") if rng.random() < 0.8 else f"u{rng.random()}" for _ in range(rng.randrange(25)))) for k in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(3)
    got = linededup.dedup_lines(table, least).collect()
    expected = brute_lines(rows, least)
    assert len(got) == len(rows)
    before = dict(rows)
    for r in got:
        if r.text is None:
            assert r.n_lines == 0 and before[r.doc_id] is None
        else:
            assert r.text == expected[r.doc_id, before[r.doc_id]] and r.n_lines == before[r.doc_id].count("\n") + 1


def test_single_long_lines(spark):
    """A line of enough characters counts alone; inner names don't clash with columns."""
    rows = [(1, "a line that is long enough\nshort\nx"), (2, "y\na line that is long enough\nz\nshort"), (3, "w\nshort\nx\nshort"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit(7), "doc_key": F.lit(8), "kept": F.lit(9)})
    got = {r.doc_id: r for r in linededup.dedup_lines(table, alone=20).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "y\nz\nshort", 3: "w\nshort", None: None}
    assert all((r.gone, r.doc_key, r.kept) == (7, 8, 9) for r in got.values()) and got[3].n_removed == 2
    assert {r.text for r in linededup.dedup_lines(table.limit(4)).collect()} == {rows[0][1], rows[1][1], "w\nshort", None}


def test_line_dedup_of_nothing(empty):
    assert linededup.dedup_lines(empty).count() == 0


def test_shared_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quillstone.llm import common

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(applicationId="app-x", master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_folder(remote)
    assert common.fresh(["gone", "_GONE"], "gone", "other") == ["__gone", "other"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids, repeated rows and further columns go through every stage."""
    import corpus_pipeline

    spark.createDataFrame([(1, "some words of an item that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("empty", []), ("odd", [*CORPUS, CORPUS[4], (None, "alone in the world", None, None, 4)])):
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "gone": F.lit(2), "_row": F.lit(3)})
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns and (kept.count() == 0) == (name == "empty"), stage
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = sentence(30, 4000, "q")
    texts = [sentence(80, 2000) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    near = texts[0].split()
    near[3] = "changed"
    rows += [(100, texts[1], "en", "s0", 1), (101, " ".join(near), "en", "s1", 1), (102, sentence(60) + " " + item, "en", "s2", 1), (103, "123 456", "en", "s0", 1), (104, None, None, None, None), (105, "l1 x\nl2 y\n" + texts[2], "en", "s0", 1), (106, "l1 x\nl2 y\n" + sentence(80, 2000), "en", "s0", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # Copies, the near copy, the benchmark item and texts without letters are gone; a repeated run of lines is cut.
    assert set(got) == {*range(30), 105, 106} - {105} and got[106].size == 80
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mix_sources"]
    assert sum(r.taken for r in got.values()) == pytest.approx(1.5 * sum(r.size for r in got.values()), rel=0.02)


def test_settled_tables(spark):
    before = spark.conf.get(common.SHUFFLE_CLEANUP)
    table = common.settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before
    with pytest.raises(Exception):
        common.settled(spark.range(3).select(F.raise_error(F.lit("no"))), "test")
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before
