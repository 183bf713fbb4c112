"""Importance resampling, n-gram Jaccard join and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ngram_join, resampling, spelling

LOW = {i: i + 32 for i in range(65, 91)}
CLASH = ["place", "gram", "node", "n", "rank", "weight", "bucket", "word", "near", "block", "digit"]


def table(spark, rows):
    """Rows (doc_id, text) in several partitions, with columns whose names operators use."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


# importance resampling


def plain_resample(docs, target):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall((text or "").translate(LOW))
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in found for x in f), Counter(x for text in target for x in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, words, f in found:
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    pool = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(pool[: 25 * len(pool) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("ids", [range(300), range(-150, 150), [2**62 + 7 * i for i in range(300)]])
def test_resampling_against_a_plain_sort(spark, ids):
    rng = random.Random(5)
    words = ["Bank", "rente", "ÉLAN", "x1", "a-b", "42", "straße", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in ids]
    docs += [docs[0], docs[0], (None, docs[1][1]), (ids[1], None), (ids[2], ""), (ids[3], "long text " * 3000)]
    target = ["the bank of 42", "", None, "rente straße"]
    got = resampling.resample(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"))
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(got, key=str) == plain_resample(docs, target)


def test_resampling_of_empty_tables(spark):
    docs, none = table(spark, [(1, "a b " * 20)]), table(spark, []).limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert [r["rank"] for r in resampling.resample(docs, none).collect()] == [None]


def test_radix_sort_is_stable_over_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 3), rng.randint(0, 5000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "major long, minor long, place long").repartition(5)
    got = resampling.radix_sorted(df.withColumn("was", F.col("place")), [(F.col("minor"), 13), (F.col("major"), 2)], width=4, block_bits=6)
    got = [(r.major, r.minor, r.was) for r in got.orderBy("place").collect()]
    assert got == sorted(rows)


def test_words_do_not_depend_on_pieces():
    text = ("Zwölf Boxkämpfer jagen, " * 40).encode() + b"q" * 300 + b" end"
    whole = [w for words in resampling.word_lists(text) for w in words]
    assert [w for words in resampling.word_lists(text, piece=50) for w in words] == whole
    buckets = [b for _, f in resampling.feature_buckets(text) for b in f.tolist()]
    assert len(buckets) == 2 * len(whole) - 1


# n-gram Jaccard join


def plain_components(docs, width=3, share=Fraction(9, 10)):
    sets = []
    for _, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        sets.append({tuple(words)} - {()} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)})
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)), key=str)


def near_copies(rng):
    """Groups of texts at all distances around the threshold, with shared passages and common lines."""
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(25))
    docs = []
    for size in (4, 12, 40, 90, 200, 400):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(22):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                k = rng.randrange(len(text))
                text[k : k + 1] = [[], [f"new{rng.random()}"], [text[k], "the"]][rng.randrange(3)]
            docs.append(" ".join(text) + rng.choice(["", f" {passage}", " THE end"]))
    docs += [f"{passage} {rng.random()}" for _ in range(20)] + ["one", "One", "one two", "a a a a a", "a a a", "", " \n", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 3, "cells": 1, "filter_bits": 64}, {"similarity": Fraction(3, 5), "block_rows": 8}])
def test_ngram_components_against_all_pairs(spark, bounds):
    docs = near_copies(random.Random(11))
    docs += [docs[0], docs[5], (None, docs[7][1]), (None, None)]
    got = ngram_join.ngram_components(table(spark, docs), **bounds)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    assert got == plain_components(docs, share=bounds.get("similarity", Fraction(9, 10)))


def test_ngram_components_of_empty_tables(spark, odd_docs, no_docs):
    assert ngram_join.ngram_components(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.ngram_components(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows)


def test_sets_do_not_depend_on_pieces():
    texts = [t and t.encode() for _, t in near_copies(random.Random(2))] + [b"y" * 900 + b" z z"]
    whole = list(ngram_join.sets_of(texts))
    for piece in (1, 64, 1000):
        assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_join.sets_of(texts, piece=piece), strict=True))


def test_only_postings_of_shared_ngrams_are_written(spark, monkeypatch):
    docs = table(spark, [(i, f"a{i} b{i} c{i} d{i}") for i in range(50)] + [(100, "x y z w"), (101, "x y z w v")])
    written, cut = [], ngram_join.cut_lineage
    monkeypatch.setattr(ngram_join, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    counts = spark.sparkContext.broadcast(ngram_join.cell_counts(docs))
    half = Fraction(1, 2)
    ngram_join.listed_members(ngram_join.postings(docs, counts, 3, half), half).collect()
    lists = Counter(r.gram for r in written[0].collect())
    assert lists and min(lists.values()) > 1



# spelling variants


def edits_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def plain_forms(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits_apart(v, w) == 1] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows)


def test_spelling_forms_against_all_pairs(spark):
    rng = random.Random(8)
    letters = "abéÀ"  # few letters: many equal bigrams and ties
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa"]
    docs = []
    for i in range(700):
        words = []
        for _ in range(12):
            w = rng.choice(base) if rng.random() < 0.5 else base[min(len(base) - 1, int(rng.expovariate(0.3)))]
            k = rng.randrange(len(w))
            words.append(w if rng.random() < 0.6 else rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]]))
        docs.append((i, rng.choice([" ", "-", "7"]).join(words)))
    docs += [docs[0], (None, docs[1][1]), (7, None), (8, ""), (9, "Überaus " * 400)]
    got = [tuple(r) for r in spelling.spelling_forms(table(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_forms(docs)
    assert sorted(got) == want and sum(r[4] for r in want) > 400 and any(r[1] and r[2] != r[1] for r in want)


def test_spelling_of_empty_tables(spark, no_docs):
    assert spelling.spelling_forms(no_docs).count() == 0
    assert spelling.spelling_forms(table(spark, [(1, "short words only")])).count() == 0


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))
        weight = {g: rng.randint(1, 9) for g in spelling.bigrams(word)}
        grams = spelling.prefix(word, {g: (n, g) for g, n in weight.items()}, 3)
        pairs = [weight[a[0]] + weight[b[0]] for a in grams for b in grams if b[1] - a[1] >= 2]
        got = spelling.pivots(grams, weight)
        assert len(got) == 2 and got[1][1] - got[0][1] >= 2 and sum(weight[g] for g, _ in got) == min(pairs)
