"""Token files, packing and counts against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketloom.llm import packing, token_counts, token_files, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = list("abcdestrmvlZÉé ß́　 \n\t\r\x0b\x0c\x1c\x85᠎​,.!?'’…<|>İıςＡ1²½٣😀한ㄱ_&%$") + [
    "'s", "'ll ", "<|endoftext|>", "don't", "I'LL", " the", "  ", "   ", "'re", "'ve", "ing", "tion", "a,.", "b%%%",
]


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


def fuzz(n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_chunks_give_the_ids_of_the_text(word_tokenizer):
    cache = tokens.ChunkIds(WORDS)
    for text in fuzz(6000, 14):
        assert tokens.encode_text(cache, text) == ids_of(word_tokenizer, text).tobytes(), repr(text)


def test_remembered_chunks_are_bounded(word_tokenizer):
    cache = tokens.ChunkIds(WORDS, entries=3)
    text = "some words and, some more words and so on"
    assert tokens.encode_text(cache, text) == ids_of(word_tokenizer, text).tobytes()
    assert len(cache) <= 3


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [2, 3, 8, 50, 400, 40_000][seed], 20_000).astype(np.uint32)
    rules, symbols = token_files.repair(ids, 49_408, least_count=2, pairs_per_round=300)
    assert (token_files.expand(symbols, token_files.expansions(rules, 49_408)) == ids).all()
    ends = np.cumsum(rules[:, 2]) if len(rules) else []
    assert all(r[2] >= 2 for r in rules) and len(ends) == len(rules)
    # no rule but its last id ends a document
    for text in np.split(token_files.expansions(rules, 49_408)[0][49_408:], ends)[:-1]:
        assert 1 not in text[:-1]


def test_grammar_replaces_runs_without_overlap():
    rules, symbols = token_files.repair(np.full(9, 5, np.uint32), 10, least_count=2, rounds=1)
    assert rules.tolist() == [[5, 5, 2]] and symbols.tolist() == [10, 10, 10, 10, 5]


def test_a_round_counts_only_pairs_that_may_be_frequent(monkeypatch):
    rng, sizes, plain = np.random.default_rng(1), [], np.sort
    phrases = [rng.integers(2, 2000, rng.integers(2, 12)) for _ in range(300)]
    ids = np.concatenate([phrases[int(k)] if k < 300 else rng.integers(2, 2000, 4) for k in rng.exponential(200, 12_000)]).astype(np.uint32)
    monkeypatch.setattr(np, "sort", lambda keys, *args: sizes.append(len(keys)) or plain(keys, *args))
    rules, symbols = token_files.repair(ids, 2000, pairs_per_round=100)
    monkeypatch.undo()
    assert (token_files.expand(symbols, token_files.expansions(rules, 2000)) == ids).all()
    counts = {}
    for pair in zip(symbols[:-1].tolist(), symbols[1:].tolist()):
        counts[pair] = counts.get(pair, 0) + 1
    assert max(n for (a, b), n in counts.items() if a != b) < token_files.LEAST_COUNT
    counted = [n for n in sizes if n > 300]
    # counting every pair takes at least the final length a round
    assert len(counted) > 5 and sum(counted[1:]) < len(counted[1:]) * len(symbols)


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_places_against_a_table(kind):
    rng = np.random.default_rng(2)
    among = np.unique(rng.integers(0, 5000, 900)).astype(kind)
    keys, at = rng.integers(0, 6000, 20_000).astype(kind), {k: i for i, k in enumerate(among.tolist())}
    for bits in (4, 9, 20):  # few slots: most keys share one
        assert token_files._places(keys, among, bits).tolist() == [at.get(k, -1) for k in keys.tolist()]


def test_files_round_trip(spark, odd_docs, word_tokenizer, tmp_path):
    folder = str(tmp_path / "files")
    token_files.write_token_files(odd_docs, folder, WORDS, shard_ids=500)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), r) for r in odd_docs.select("doc_id", "text").collect())
    at, want = 0, []
    for _, r in rows:
        ids = ids_of(word_tokenizer, r.text)
        want.append((at, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shard = max(spark.read.parquet(folder).collect(), key=lambda r: len(r.doc_ids))
    texts = {r.doc_id: r.text for _, r in rows}
    for k, doc_id in enumerate(shard.doc_ids):
        assert (token_files.read_document(shard, k) == ids_of(word_tokenizer, texts[doc_id])).all()


def test_no_documents_give_no_files_and_no_pieces(spark, no_docs, tmp_path):
    token_files.write_token_files(no_docs, str(tmp_path / "none"), WORDS)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack_documents(no_docs, WORDS).count() == 0
    assert token_counts.count_tokens(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_windows_hold_every_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 40, 255, 256, 700, 2047, 2048, 2049, 9000]) for _ in range(rng.choice([0, 1, 7, 400]))]
    windows = packing.pack(lengths)
    seen = defaultdict(list)
    for window, pieces in windows:
        assert sum(n for _, _, n in pieces) <= window and all(n > 0 for _, _, n in pieces)
        for doc, at, n in pieces:
            seen[doc].append((at, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == n
    padded = [w for w, pieces in windows if sum(n for _, _, n in pieces) < w]
    assert len(padded) <= 1
    groups = packing.step_groups(windows, 16)
    assert all(c <= 16 for c in Counter(groups).values())


def test_step_groups_cost_about_the_same():
    rng = random.Random(3)
    windows = packing.pack([rng.randint(1, 4000) for _ in range(2000)])
    cost = defaultdict(int)
    for group, (window, pieces) in zip(packing.step_groups(windows), windows):
        if window == 2048:
            cost[group] += sum(n * n for _, _, n in pieces)
    full = sorted(cost.values())[1:]
    assert full[-1] < 1.3 * full[0]


def test_packing_of_odd_rows(odd_docs, word_tokenizer):
    got = packing.pack_documents(odd_docs, WORDS, payload=("window",)).collect()
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = ids_of(word_tokenizer, r.text)
        want[r.doc_id] += len(ids)
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
        assert r.payload_window == 1
    assert have == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_transducer_counts_as_the_library(byte_tokenizer):
    machine = token_counts.CountTransducer(BYTES)
    for text in fuzz(6000, 24, 2):
        assert machine.count(text) == len(byte_tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_transducer_starts_anew_when_full(byte_tokenizer):
    machine = token_counts.CountTransducer(BYTES, most_transitions=50)
    for text in fuzz(400, 24, 3):
        assert machine.count(text) == len(byte_tokenizer.encode(text, add_special_tokens=False).ids), repr(text)
        assert machine.transitions < 300


def test_chunk_maps_compose():
    machine = token_counts.CountTransducer(BYTES)
    rng = random.Random(5)
    for text in fuzz(1500, 60, 4):
        size = rng.randint(1, 9)
        maps = [token_counts.chunk_map(machine, text[i : i + size]) for i in range(0, len(text), size)]
        assert token_counts.scan(machine, maps) == machine.count(text), (text, size)
        if len(maps) > 2:  # any bracketing
            left = token_counts.compose(machine, token_counts.compose(machine, *maps[:2]), maps[2])
            right = token_counts.compose(machine, maps[0], token_counts.compose(machine, *maps[1:3]))
            assert token_counts.scan(machine, [left, *maps[3:]]) == token_counts.scan(machine, [right, *maps[3:]])


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 16])
def test_counts_of_odd_rows(odd_docs, byte_tokenizer, chunk):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd_docs, BYTES, chunk).collect())
    want = Counter(
        (r.doc_id, len((r.text or "").encode()), len(byte_tokenizer.encode(r.text or "", add_special_tokens=False).ids))
        for r in odd_docs.select("doc_id", "text").collect()
    )
    assert got == want


def test_packed_pieces_match_the_library(spark, word_tokenizer):
    texts = [*fuzz(60, 400, seed=8), "", None, "word " * 5000]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(list)
    places = defaultdict(list)
    for r in packing.pack_documents(docs, WORDS).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(got) == [i * 3 for i in range(len(texts))]
    for i, text in enumerate(texts):
        ids = np.array([*word_tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(got[i * 3], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
