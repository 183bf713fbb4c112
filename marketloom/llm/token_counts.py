"""Token counts by a compiled finite-state transducer of a byte-level BPE tokenizer.

After a prefix of a piece, all that the merges still depend on is the longest suffix that
begins some token, and the last token of the encoding at each place within it. That is a
finite state; from it a byte leads to the next state, and the change of the number of
tokens is annotated on the transition (the number can fall, where a longer token takes the
place of several). The state over characters adds where the pre-tokeniser stands: in a run
of letters, digits, other marks or white space, or in a contraction. States are compiled
when a text first needs them; a worker keeps a bounded number.

A long text is cut into chunks anywhere. Between a mark and a following space every piece
ends, whatever came before, so the map of a chunk from entry to exit state is constant from
the first such place on: (head before it, tokens up to the last such place, tail after).
Maps compose associatively; the composition of a text's chunk maps gives its count.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 65_536
LIMIT = 1024
#: Transitions that one Python worker keeps (beyond, it starts its table anew), and words.
MOST_TRANSITIONS = 300_000
MOST_WORDS = 700_000
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_of_char() -> dict[str, int]:
    """The alphabet in which byte-level vocabularies are written: printable bytes as themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteStates:
    """States and transitions over the bytes of one piece. State 0 is the start of a piece.

    Merges are ranked; as in any trained vocabulary, a token's merge comes after those of its parts.
    """

    def __init__(self, vocabulary: Iterable[bytes], ranks: dict[tuple[bytes, bytes], int]):
        self.vocabulary, self.ranks = frozenset(vocabulary), ranks
        self.made = {a + b: (a, b, rank) for (a, b), rank in ranks.items()}
        self.prefixes = {t[:k] for t in self.vocabulary for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[bytes | None, bytes], bool] = {}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.clear()

    def clear(self) -> None:
        self.keys: list[tuple] = [(b"", (None,), (0,))]
        self.known = {self.keys[0]: 0}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Encoding by the merges themselves, lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (1) end in turn, with the rank that ends it."""
        key = (token, side)
        if key not in self.spines:
            found, ends = [], float("inf")
            while True:
                found.append((token, ends))
                if token not in self.made:
                    break
                ends = self.made[token][2]
                token = self.made[token][side]
            self.spines[key] = found
        return self.spines[key]

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` can follow ``last`` (none: begin a piece) in an encoding.

        It cannot if a merge across the border would come before one of those that take
        its two sides further.
        """
        pair = (last, token)
        fit = self.fits.get(pair)
        if fit is None:
            if last is None:
                fit = self.merge(token) == [token]
            else:
                fit = self.follows(None, token) and not any(
                    (rank := self.ranks.get((x, y))) is not None and rank < x_ends and rank <= y_ends
                    for x, x_ends in self.spine(last, 1)
                    for y, y_ends in self.spine(token, 0)
                )
            self.fits[pair] = fit
        return fit

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the number of tokens)."""
        done = self.moves.get((state, byte))
        if done is None:
            suffix, lasts, counts = self.keys[state]
            suffix += bytes((byte,))
            # places where no token can begin that still goes on are never asked for again
            token, live, size = None, [], len(suffix)
            for k in range(size):
                part = suffix[k:]
                if part in self.prefixes:
                    live.append(k)
                    if token is None and part in self.vocabulary and self.follows(lasts[k], part):
                        token, change = part, counts[k] + 1
            start = live[0] if live else size
            new_lasts, new_counts = [None] * (size - start), [0] * (size - start)
            for k in live:
                new_lasts[k - start], new_counts[k - start] = lasts[k], counts[k] - change
            key = (suffix[start:], (*new_lasts, token), (*new_counts, 0))
            if key not in self.known:
                self.known[key] = len(self.keys)
                self.keys.append(key)
            done = self.moves[state, byte] = self.known[key], change
        return done

    def feed(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            state, change = self.move(state, byte)
            total += change
        return state, total


class Row(dict):
    """Transitions of one state over characters: character -> (next row, change of the count)."""

    __slots__ = ("owner", "key")

    def __missing__(self, char: str):
        self.owner.transitions += 1
        key, change = self.owner.step(self.key, char)
        self[char] = move = (self.owner.row(key), change)
        return move


class Words(dict):
    """Transitions over whole words after a space, from the state where all states meet."""

    def __missing__(self, word: str) -> int:
        change = self.machine.run(" " + word)
        if len(self) < MOST_WORDS:
            self[word] = change
        return change


class CountTransducer:
    """Counts of tokens as the tokenizers library gives them for a byte-level BPE file."""

    FRESH = ("F",)

    def __init__(self, path: str, most_transitions: int = MOST_TRANSITIONS):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, alphabet = told["model"], byte_of_char()
        raw = lambda s: bytes(alphabet[c] for c in s)
        special = {t["content"] for t in told["added_tokens"]}
        vocabulary = [raw(t) for t in model["vocab"] if t not in special]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes = ByteStates(vocabulary, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.most_transitions = most_transitions
        self.words = Words()
        self.words.machine = self
        self.clear()

    def clear(self) -> None:
        """Forget the compiled states; counts of words stay."""
        self.rows: dict[tuple, Row] = {}
        self.transitions = 0
        self.bytes.clear()

    def row(self, key: tuple) -> Row:
        found = self.rows.get(key)
        if found is None:
            found = self.rows[key] = Row()
            found.owner, found.key = self, key
        return found

    @staticmethod
    def kind(char: str) -> str:
        if is_space(char):
            return "W"
        return {"L": "L", "N": "N"}.get(unicodedata.category(char)[0], "P")

    def step(self, key: tuple, char: str) -> tuple[tuple, int]:
        mode, kind, feed = key[0], self.kind(char), self.bytes.feed
        if kind == "W":
            if mode == "W":  # the run goes on
                state, change = feed(key[1], char)
                return ("W", state, -change, char), change
            state, change = feed(0, char)
            return ("W", state, -change, char), change
        if mode == "W":  # all but the last space is a piece; a plain last space joins what follows
            given_back = key[2]
            if key[3] == " ":
                state, change = feed(0, " " + char)
                return (kind, state), given_back + change
            _, space = feed(0, key[3])
            following, change = self.step(self.FRESH, char)
            return following, given_back + space + change
        if mode == kind and mode in "LNP":
            state, change = feed(key[1], char)
            return (kind, state), change
        if mode == "'" and kind == "P":
            state, change = feed(key[1], char)
            return ("P", state), change
        if mode == "'" and "'" + char in CONTRACTIONS:
            return self.FRESH, feed(0, "'" + char)[1] - feed(0, "'")[1]
        if mode == "'" and any(c.startswith("'" + char) for c in CONTRACTIONS):
            state, change = feed(0, char)
            return ("'" + char, state), change
        if len(mode) == 2:  # an apostrophe and the first of two letters
            whole = mode + char
            if whole in CONTRACTIONS:
                return self.FRESH, feed(0, whole)[1] - feed(0, "'")[1] - feed(0, mode[1])[1]
            return self.step(("L", key[1]), char)
        state, change = feed(0, char)
        return ("'" if char == "'" else kind, state), change

    def run(self, text: str) -> int:
        """Tokens of a text without special strings, character by character."""
        row, total = self.row(self.FRESH), 0
        for char in text:
            row, change = row[char]
            total += change
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string is one token."""
        if self.transitions > self.most_transitions:
            self.clear()
        if self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self.count, parts)) + len(parts) - 1
        if _SPACES_BEFORE.search(text):
            return self.run(text)
        first, *words = text.split(" ")
        return self.run(first) + sum(map(self.words.__getitem__, words))


#: White space as the pre-tokeniser's pattern has it.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


def is_space(char: str) -> bool:
    return char in _SPACES


#: A space after white space, where states do not meet.
_SPACES_BEFORE = re.compile(f"[{''.join(sorted(_SPACES))}] ")
_SYNC = re.compile(f"(?<=[^{''.join(sorted(_SPACES))}])(?=[{''.join(sorted(_SPACES))}])")


@dataclass(frozen=True)
class ChunkMap:
    """Text before the first place where all states meet, tokens from there to the last, text after.

    ``synced`` False: there is no such place, and ``head`` is the whole text.
    """

    head: str
    inner: int = 0
    tail: str = ""
    synced: bool = False


def chunk_map(machine: CountTransducer, text: str) -> ChunkMap:
    first = _SYNC.search(text)
    if first is None:
        return ChunkMap(text)
    last = len(text)
    while not (is_space(text[last - 1]) and last >= 2 and not is_space(text[last - 2])):
        last -= 1
    last -= 1
    return ChunkMap(text[: first.start()], machine.count(text[first.start() : last]), text[last:], True)


def compose(machine: CountTransducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    if a.synced and b.synced:
        return ChunkMap(a.head, a.inner + machine.count(a.tail + b.head) + b.inner, b.tail, True)
    if a.synced:
        m = chunk_map(machine, a.tail + b.head)
        if not m.synced:
            return ChunkMap(a.head, a.inner, m.head, True)
        return ChunkMap(a.head, a.inner + machine.count(m.head) + m.inner, m.tail, True)
    m = chunk_map(machine, a.head + b.head)
    if not b.synced:
        return m
    if not m.synced:
        return ChunkMap(m.head, b.inner, b.tail, True)
    return ChunkMap(m.head, m.inner + machine.count(m.tail) + b.inner, b.tail, True)


def scan(machine: CountTransducer, maps: Iterable[ChunkMap]) -> int:
    """Tokens of the chunks' text: maps composed pair by pair, level by level."""
    level = list(maps)
    while len(level) > 1:
        level = [compose(machine, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    m = level[0] if level else ChunkMap("")
    return machine.count(m.head) + m.inner + machine.count(m.tail)


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, tokenizer: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row's whole text.

    A null text counts as empty: no bytes, no tokens. Null ids and repeated rows stay; other
    columns are not read. Texts longer than ``chunk_chars`` are dealt out by chunk. Empty in,
    empty out.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short, long = rows.where(F.length("text") <= chunk_chars), rows.where(F.length("text") > chunk_chars)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            n = [machine.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, n_bytes, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = value.as_py()
                for at in range(0, len(whole), chunk_chars):
                    values = (row, at // chunk_chars, doc_id, n_bytes, whole[at : at + chunk_chars])
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
                row += 1

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            maps = [chunk_map(machine, t.as_py()) for t in batch.column(4)]
            columns = [pa.array([getattr(m, f) for m in maps], k) for f, k in (("head", pa.string()), ("inner", pa.int64()), ("tail", pa.string()), ("synced", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[*names[:4], "head", "inner", "tail", "synced"])

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        maps = [ChunkMap(r["head"], r["inner"], r["tail"], r["synced"]) for r in table.select(["head", "inner", "tail", "synced"]).to_pylist()]
        n = scan(transducer(tokenizer), maps)
        return pa.table([table["doc_id"][:1], table["n_bytes"][:1], pa.array([n], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    names = ["row", "chunk", "doc_id", "n_bytes", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = "doc_id long, n_bytes long, n_tokens long"
    dealt = long.select("doc_id", "n_bytes", "text").mapInArrow(chunks, "row long, chunk long, doc_id long, n_bytes long, text string")
    maps = dealt.repartition("row", "chunk").mapInArrow(mapped, "row long, chunk long, doc_id long, n_bytes long, head string, inner long, tail string, synced boolean")
    return short.select("doc_id", "n_bytes", "text").mapInArrow(counted, out).union(maps.groupBy("row").applyInArrow(composed, out))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
CHECKS: dict[str, str] = {}
