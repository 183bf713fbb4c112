"""Quality, SimHash, decontamination, language model and sharding against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import decontamination, graph, language_model, quality, sharding, simhash

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# quality


def labelled(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 120)) for i in range(0, 400, 2)]
    bad = [(i, " ".join(f"{rng.choice(WORDS)}$$$ {rng.choice('%&#')}!!" for _ in range(60))) for i in range(1, 400, 2)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels.where("doc_id % 4 < 2"))
    got = quality.score_quality(docs.where("doc_id % 4 >= 2"), model, ("doc_id",)).collect()
    assert len(got) == 200
    assert sum((r.score >= 0.7) == (r.doc_id % 2 == 0) for r in got) >= 196


def test_quality_judges_the_whole_of_long_texts(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels.where("doc_id % 4 < 2"))
    fresh = docs.where("doc_id % 4 >= 2").collect()
    good, bad = ([r.text for r in fresh if r.doc_id % 2 == k] for k in (0, 1))
    assert b"".join(quality.pieces(b"abc" * 5000)) == b"abc" * 5000
    for size in (10_000, 300_000, 1_000_000):
        long = {k: " ".join(texts * (size // len(" ".join(texts)) + 1))[:size] for k, texts in (("good", good), ("bad", bad))}
        scores = model.score([long["good"], long["bad"]])
        assert scores[0] >= 0.7 > scores[1], size
    # a good head does not stand for a bad rest
    head, rest = " ".join(good)[:20_000], " ".join(bad * 40)[:400_000]
    assert model.score([f"{head} {rest}"])[0] < 0.7


def test_quality_of_odd_rows_and_tables(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(odd_docs, model, tuple(odd_docs.columns), "fresh").collect()
    assert len(got) == 13 and all(0 <= r.fresh <= 1 for r in got)
    empty = {r.fresh for r in got if not r.text}
    assert len(empty) == 1
    assert quality.score_quality(no_docs, model, ("doc_id",)).count() == 0
    nothing = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(odd_docs, nothing, ("doc_id",)).collect()} == {0.5}
    one_class = quality.fit_quality(docs, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in quality.score_quality(odd_docs, one_class, ("doc_id",)).collect()} == {round(201 / 202, 6)}
    nulls = labels.union(spark.createDataFrame([(None, 1), (3, None), (99_999, 0)], "doc_id long, quality int"))
    assert quality.fit_quality(docs, nulls).good


def test_label_rows_of_the_held_out_remainder_are_known_by_their_crc(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r.doc_id: r.h for r in ids.select("doc_id", quality.held_out("doc_id", 4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)} | {None: False}


# SimHash


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def naive_labels(prints, radius):
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)
    return simhash.merged(np.arange(len(prints)), a, b)


def near_prints(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    rows = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(20)]
    rows.append(base[:1] ^ np.array([sum(1 << int(k) for k in rng.choice(64, 4, False)) for _ in range(500)], np.uint64))
    return np.unique(np.concatenate(rows))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 9])
def test_bit_sliced_distances(radius):
    prints = near_prints()
    a, b = simhash.within(simhash.bits_of(prints[:70, None]), simhash.bit_planes(simhash.bits_of(prints[:, None])), len(prints), radius)
    want = np.nonzero(np.bitwise_count(prints[:70, None] ^ prints[None, :]) <= radius)
    assert (a == want[0]).all() and (b == want[1]).all()
    assert (simhash.forest(prints[:, None], radius, block=128, queries=33) == naive_labels(prints, radius)).all()


@pytest.mark.parametrize("hot", [4096, 16])
def test_links_reach_all_components(spark, hot):
    prints = near_prints()
    links = simhash.linked(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f0 long"), 2, hot)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for value, label in zip(prints.view(np.int64).tolist(), naive_labels(prints, 2)):
        groups[roots.get(value, value)].add(value)
        want[label].add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {k: 7 for k in range(8, 60)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_components(spark, odd_docs, no_docs):
    rng = random.Random(4)
    texts = [prose(rng, 200) for _ in range(30)]
    texts += [t + " " + rng.choice(WORDS) for t in texts for _ in range(3)]
    texts += [t.upper() for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd_docs.select(F.col("doc_id") + 1000, "text"))
    rows = docs.collect()
    prints = np.array([naive_fingerprint(r.text) for r in rows], np.uint64)
    ids = [r.doc_id for r in rows]
    labels = naive_labels(prints, 2)
    least, size = {}, Counter(labels.tolist())
    for i, label in zip(ids, labels.tolist()):
        if i is not None:
            least[label] = min(i, least.get(label, i))
    want = Counter((i, f"{int(p):016x}", least.get(k), size[k]) for i, p, k in zip(ids, prints, labels.tolist()))
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == want
    assert simhash.simhash_components(no_docs).count() == 0


def test_near_copies_leave_one_of_each_group(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows, group = [], {}
    for g in range(40):
        words = [rng.choice(WORDS) for _ in range(300)]
        for c in range(5):
            near = list(words)
            for _ in range(c):
                near[rng.randrange(300)] = rng.choice(WORDS)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(near)))
    got = simhash.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keepers = {r.doc_id for r in got if r.keeper}
    assert {5 * g for g in range(40)} <= keepers and len(keepers) <= 41  # similarity 0.87: found at over 0.98
    odd = simhash.near_copy_groups(odd_docs).collect()
    kept = {r.doc_id for r in odd if r.keeper}
    assert kept == {0, 2, 5, 6, 7, 8, 9, None} and {r.copies for r in odd if r.doc_id == 4} == {3}
    assert simhash.near_copy_groups(no_docs).count() == 0


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def keepers_of(spark, texts, **blocks):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.near_copy_groups(docs, **blocks).collect() if r.keeper}


def test_near_copies_are_decided_by_exact_similarity(spark):
    rng = random.Random(8)
    texts, below, above = [], set(), set()
    for g in range(150):
        words = [f"{g}_{k}" for k in range(300)]
        near = list(words)
        for k in range(10, 290, 40 if g % 2 else 35)[: 6 if g % 2 else 8]:
            near[k] = rng.choice(WORDS)
        texts += [" ".join(words), " ".join(near)]
        a, b = map(shingle_set, texts[-2:])
        (above if len(a & b) >= 0.8 * len(a | b) else below).add(2 * g + 1)
    assert len(below) == 75 and len(above) == 75  # similarity 0.76 and 0.82
    got = keepers_of(spark, texts)
    assert below <= got and len(got & above) <= 1


def test_candidates_are_found_by_fingerprints(spark):
    # none of 300 pairs differ by as much as the radius: each shares a bucket, and nothing else does
    rng = np.random.default_rng(3)
    radius = simhash.radius_of(192, simhash.worst_share(0.8, 1, 5), 0.001 / 4)
    one = rng.integers(0, 1 << 63, (300, 3), dtype=np.uint64)
    other = one.copy()
    for row in other:
        for bit in rng.choice(192, 20, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    table = [(k, 40, *map(int, r.view(np.int64))) for k, r in enumerate(np.concatenate((one, other)))]
    prints = spark.createDataFrame(table, "node long, hashes long, f0 long, f1 long, f2 long")
    for fold in (4096, 3):
        got = defaultdict(set)
        for r in simhash.alike_members(prints, 3, 0.8, 0.999, fold=fold).collect():
            got[r.bucket].add(r.node)
        assert set(map(frozenset, got.values())) == {frozenset((k, k + 300)) for k in range(300)}
    assert radius > 20 and simhash.worst_share(0.8, 1, 5) == simhash.differing(4, 5, 4) == 0.1875
    few = simhash.tables_for(192, 6, 0.16, radius, 0.999)
    assert simhash.tables_for(192, 9, 0.16, radius, 0.999) > few


def test_short_near_copies_are_found(spark):
    texts = []
    for g in range(200):
        words = [f"{g}_{k}" for k in range(9)]
        texts += [" ".join(words), " ".join(words[:8])]  # five shingles, four of them shared
    assert len(keepers_of(spark, texts) - set(range(0, 400, 2))) <= 2


def test_a_worker_remembers_one_kind_of_task_only():
    from marketloom.llm import caches

    words = decontamination.word_hashes()
    words["w"]
    assert decontamination.word_hashes() is words and len(caches._held) == 1
    assert caches.remembered(("other",), dict) == {} and decontamination.word_hashes() is not words
    caches.forget()
    assert not caches._held and decontamination.word_hashes() == {}


@pytest.mark.parametrize("rows", [8, 1024])
def test_long_chains_of_near_copies_stay_whole(spark, rows):
    rng = random.Random(9)
    words, texts = [f"a{k}" for k in range(200)], []
    for _ in range(300):
        words[rng.randrange(200)] = rng.choice(WORDS)
        words[rng.randrange(200)] = rng.choice(WORDS)
        words[rng.randrange(200)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    rng.shuffle(texts)
    assert keepers_of(spark, texts, block_rows=rows) == {0}


def test_similar_pairs_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(90, rng.integers(1, 80), False)).astype(np.uint64) for _ in range(90)] + [np.zeros(0, np.uint64)]
    sets += [s[1:] for s in sets[:40]] + [np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)]
    from marketloom.llm import jaccard

    plain = [set(s.tolist()) for s in sets]
    got = set(zip(*(x.tolist() for x in jaccard.similar_pairs(sets, 0.8))))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
    assert got == want and len(want) > 30


def test_large_groups_of_near_copies_are_folded(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    rows = np.tile(centre, (3000, 1))
    for row in rows:
        for bit in rng.choice(256, 9, False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    table = [(k, *map(int, r.view(np.int64))) for k, r in enumerate(rows)]
    prints = spark.createDataFrame(table, "node long, f0 long, f1 long, f2 long, f3 long")
    got = graph.components(simhash.linked_wide(prints, 4, 0.8, fold=500)).collect()
    assert len(got) == 3000 and {r.root for r in got} == {0}


def test_no_member_of_a_large_bucket_is_dropped(spark):
    # one table, and no row differs in its bits: all rows are in one bucket
    free = [k for k in range(256) if k not in set(np.random.default_rng(9).choice(256, 16, replace=False).tolist())]
    differing = [[free[230 + i] for i in range(9) if k >> i & 1] for k in range(400)]
    differing[200] = free[:30]  # near all the others
    differing += [free[100:150], free[:60]]  # near none, and near row 200 only
    rows = np.zeros((402, 4), np.uint64)
    for row, bits in zip(rows, differing):
        for bit in bits:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    table = [(k, *map(int, r.view(np.int64))) for k, r in enumerate(rows)]
    prints = spark.createDataFrame(table, "node long, f0 long, f1 long, f2 long, f3 long")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 50)
    try:
        got = {r.node: r.root for r in graph.components(simhash.linked_wide(prints, 4, 0.8, recall=0.01, fold=100)).collect()}
    finally:
        spark.conf.unset(batch)
    assert got == {k: 0 for k in range(402) if k != 400}


# decontamination


def naive_matches(text, items, share=0.8):
    words, found = decontamination.words_of(text), []
    for item_id, item in items:
        own = decontamination.words_of(item)
        if own:
            w = min(5, len(own))
            s = decontamination.shingles(own, w)
            c = len(s & decontamination.shingles(words, w)) / len(s)
            if c >= share:
                found.append((item_id, round(c, 9)))
    return sorted(found, key=str)


def test_containment_search_loses_nothing(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([3, 4, 5, 6, 12, 40, 120]))) for i in range(60)] + [(60, ""), (61, None), (None, prose(rng, 30)), (7, "W1 w2, w3")]
    rows = []
    for k in range(150):
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if item:
                item[rng.randrange(len(item))] = "other"
        rows.append((k, prose(rng, rng.choice([0, 5, 50, 2000])) + ". " + " ".join(item).upper() + ", " + prose(rng, 30)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (50_000, 7):
        got = decontamination.find_items(docs, table, ("doc_id",), block_items=block).collect()
        have = {r.doc_id: sorted(((m.item_id, round(m.containment, 9)) for m in r.matches), key=str) for r in got}
        assert have == {k: naive_matches(t, items) for k, t in rows}


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, "one")], "item_id long, text string")
    got = decontamination.find_items(odd_docs, items, tuple(odd_docs.columns), name="found").collect()
    assert {r.doc_id for r in got if r.found} == {0, 1, 5} and len(got) == 13
    assert decontamination.find_items(no_docs, items, ("doc_id",)).count() == 0
    nothing = decontamination.find_items(odd_docs, items.limit(0), ("doc_id",)).collect()
    assert len(nothing) == 13 and not any(r.matches for r in nothing)


# language model


def naive_counts(rows):
    word, pair = Counter(), Counter()
    for text, held in rows:
        if not held:
            tokens = (text or "").encode().lower().split() + [b""]
            word.update(tokens)
            pair.update(zip([b"", *tokens], tokens))
    return word, pair


@pytest.mark.parametrize("block", [1 << 30, 3000])
def test_language_model_counts_and_base(spark, odd_docs, block):
    rng = random.Random(9)
    made = [(i, prose(rng, rng.choice([0, 1, 30, 300])), i % 4 == 1) for i in range(120)] + [(900, "never seen words", True)]
    docs = spark.createDataFrame(made, "doc_id long, text string, held boolean").union(
        odd_docs.select("doc_id", "text", F.lit(False).alias("held"))
    )
    rows = [(r.text, r.held) for r in docs.collect()]
    word, _ = naive_counts(rows)
    n, v = sum(word.values()), len(word)
    want = Counter()
    for r in docs.collect():
        tokens = (r.text or "").encode().lower().split() + [b""]
        base = sum(math.log10((word[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want[r.doc_id, r.held, len(tokens), sum(t in word for t in tokens), n, round(base, 6)] += 1
    got = language_model.score_texts(docs, block_bytes=block, range_keys=100).collect()
    assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(10)
    chain = {w: rng.sample(WORDS, 3) for w in WORDS}

    def walk():
        w, out = rng.choice(WORDS), []
        for _ in range(60):
            out.append(w)
            w = rng.choice(chain[w])
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk(), i % 5 == 1) for i in range(400)], "doc_id long, text string, held boolean")
    got = [r for r in language_model.score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_weights_by_expectation_maximisation():
    # one bucket, two kinds of token: the bigram explains 3 of 4, the uniform part the rest
    code = lambda b, x, y: (b * language_model.CELLS + x) * language_model.CELLS + y
    cells = np.array([code(5, 200, 0), code(5, 0, 0)])
    sums = np.array([[300.0, 300 * 1e6, 0.0], [100.0, 0.0, 0.0]])
    weights = language_model.learn_weights(cells, sums)
    assert weights[5] == pytest.approx([0.75, 0, 0.25], abs=1e-3)
    assert weights[30] == pytest.approx(weights[5], abs=1e-3) and weights[0][0] == 0
    assert np.allclose(weights.sum(axis=1), 1)
    assert language_model.learn_weights(np.zeros(0, int), np.zeros((0, 3)))[3].tolist() == [0, 0, 1]


def test_probabilities_sum_to_one():
    pair = np.array([3, 1, 0, 0])  # of a context seen four times; a vocabulary of three words and the unknown one
    word = np.array([5, 4, 3, 0])
    parts = language_model.parts_of(word, pair, np.full(4, 4), 12, 3, False)
    assert parts.sum(axis=1) == pytest.approx([1, 1, 1])


def test_language_model_without_rows(spark, no_docs):
    assert language_model.score_texts(no_docs.withColumn("held", F.lit(False))).count() == 0
    only_held = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")
    row = language_model.score_texts(only_held).collect()[0]
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score == 0.0


@pytest.mark.parametrize("seed", range(4))
def test_arrays_round_trip(seed):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << 64, [0, 1, 1000, 50_000][seed], dtype=np.uint64))
    assert (language_model.unsqueeze_keys(language_model.squeeze_keys(keys)) == keys).all()
    small = rng.integers(0, [1, 2, 70_000, 300][seed], 1000)
    assert (language_model.unsqueeze(language_model.squeeze(small)) == small).all()


# sharding


@pytest.mark.parametrize("cell_rows", [7, 20_000])
def test_shards_are_equal_and_match_the_mixture(spark, cell_rows):
    rows = [(i, f"t{i % 7}", "hot" if i % 3 else f"s{i % 5}" if i % 2 else None) for i in range(2003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(docs, 40, cell_rows=cell_rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(2003))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        text = f"t{r.doc_id % 7}".encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
    sizes = sorted(len(s) for s in shards.values())
    assert len(shards) == 40 and sizes[-1] - sizes[0] <= 1
    total = Counter(r.source for r in got)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        mix = Counter(r.source for r in s)
        assert all(abs(mix[k] - n / 40) <= 4 for k, n in total.items())


def test_shards_do_not_depend_on_the_cells(spark):
    docs = spark.createDataFrame([(i, "x", f"s{i % 3}") for i in range(500)], "doc_id long, text string, source string")
    both = [sorted(map(tuple, sharding.interleave(docs, 8, cell_rows=n).collect())) for n in (5, 20_000)]
    assert both[0] == both[1]


def test_shards_of_odd_rows(odd_docs, no_docs):
    got = sharding.interleave(odd_docs, 40).collect()
    assert len(got) == 13 and {r.slot for r in got} == {0} and len({r.shard for r in got}) == 13
    assert sharding.interleave(no_docs, 40).count() == 0


def test_shards_equal_a_plain_sort(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None, ""]), "x" * rng.randint(0, 9)) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("h")).collect()
    strata = {}
    for r in hashed:
        strata.setdefault("" if r.source is None else "=" + r.source, []).append((r.h % 2**64, r.doc_id))
    parts = [((k + 0.5) / len(held), name, doc) for name, held in strata.items() for k, (_, doc) in enumerate(sorted(held))]
    places = {doc: place for place, (_, _, doc) in enumerate(sorted(parts))}
    for cell_rows in (7, 1000):
        for r in sharding.interleave(docs, 40, cell_rows=cell_rows).collect():
            shard = places[r.doc_id] * 40 // 1003
            assert (r.shard, r.slot) == (shard, places[r.doc_id] - -(-shard * 1003 // 40)), r
