"""Spelling variants of a corpus: words one edit apart, found through pivotal bigrams.

*Vocabulary.* Words and their counts are folded per batch, then per task, then by word.

*Index.* The bigrams of a word are ordered rare first by their counts over the vocabulary (a
table of at most the letters squared). Its prefix is the bigrams up to the third, and all
equal to the third. Among the prefix, dynamic programming picks two bigrams that share no
letter and have the smallest summed count: the pivots. One edit leaves one of two disjoint
bigrams whole, so of two words one edit apart, the pivots of the one whose prefix ends
earlier meet the other's prefix. The edit lies on one side of that bigram, so that the words
agree on the other side up to their start or their end: the place of the pivot is the same
from there. Pivots and prefixes are posted under (bigram, side, letters on that side, length), a pivot
for the three lengths that one edit can give. The join is an equi-join, and a common bigram is dealt out
over places, letters and lengths. Levenshtein's distance verifies within the join.

*Forms.* A word's form is its near word of the greatest count, if that is great enough; roots
follow the forms by pointer doubling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 5
TYPO_MODULUS = 199
#: Words that a task holds before it passes its counts on.
HELD_WORDS = 500_000

_LOW = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def _spelled(doc_id: int | None, run: str, modulus: int) -> str:
    """The run, without one letter where its hash with the id says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % modulus:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = TYPO_MODULUS) -> DataFrame:
    """word and n (occurrences) of the words of ``doc_id``, ``text`` that are long and frequent enough.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, one letter
    left out where 1 / ``modulus`` of the hashes say so. Null and empty texts have none, null
    ids hash as the empty string, repeated rows count as often.
    """
    # a shorter run cannot become a word
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(run.findall((text.as_py() or "").translate(_LOW)))
                for word, n in found.items():
                    word = _spelled(doc_id, word, modulus)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield sent()
        yield sent()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigrams(word: str) -> list[str]:
    return [word[k : k + 2] for k in range(len(word) - 1)]


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """Occurrences of each bigram in the rows of ``word``; as many rows as pairs of letters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))
    rows = words.where(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").count()
    return {gram: n for gram, n in rows.collect()}


def prefix(word: str, order: dict[str, int], length: int = 3) -> list[tuple[str, int]]:
    """The word's (bigram, place) up to the ``length``-th in the order, and all equal to that one."""
    ranked = sorted((order[g], k) for k, g in enumerate(bigrams(word)))
    if not ranked:
        return []
    last = ranked[min(length, len(ranked)) - 1][0]
    return [(word[k : k + 2], k) for rank, k in ranked if rank <= last]


def pivots(grams: list[tuple[str, int]], weight: dict[str, int], many: int = 2) -> list[tuple[str, int]]:
    """The ``many`` grams that share no letter and weigh least in all; none where there are too few.

    ``best[m]`` is the lightest choice of m disjoint grams among those that end before the
    place reached; a gram either stays out or follows a choice that ends two places before.
    """
    places = sorted(grams, key=lambda g: g[1])
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(places) + 1)]
    for m in range(1, many + 1):
        row: list = [None]
        for j, (gram, at) in enumerate(places):
            before = j
            while before and places[before - 1][1] > at - 2:
                before -= 1
            earlier = best[m - 1][before]
            taken = earlier and (earlier[0] + weight[gram], (*earlier[1], (gram, at)))
            options = [x for x in (row[-1], taken) if x]
            row.append(min(options) if options else None)
        best.append(row)
    return list(best[many][-1][1]) if best[many][-1] else []


def near_words(words: DataFrame) -> DataFrame:
    """(word, near) for all ordered pairs of words (distinct, in ``word``) exactly one edit apart.

    Words of fewer than four letters may have no two disjoint bigrams and are left out.
    Empty in, empty out.
    """
    spark = words.sparkSession
    weight = bigram_counts(words)
    ranks = {g: k for k, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
    shared = spark.sparkContext.broadcast((weight, ranks))  # at most the letters squared

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, ranks = shared.value
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                if len(word) < 4:
                    continue
                grams = prefix(word, ranks)
                chosen = set(pivots(grams, weight))
                last = max(ranks[g] for g, _ in grams)
                rows += [(word, len(word), g, at, last, (g, at) in chosen) for g, at in grams]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["word", "len", "gram", "at", "last", "pivot"]
            )

    schema = "word string, len int, gram string, at int, last int, pivot boolean"
    grams = cut_lineage(words.select("word").mapInArrow(indexed, schema))
    before, after = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 3, F.col("len"))

    def keys(lengths):
        """One for each side on which the words agree, and each of the lengths."""
        return F.explode(F.array(*(F.xxhash64(F.lit(k), "gram", side, F.col("len") + n) for k, side in enumerate((before, after)) for n in lengths)))

    posted = grams.where("pivot").select(F.col("word").alias("near"), F.col("last").alias("near_last"), keys((-1, 0, 1)).alias("key"))
    probes = grams.select("word", "last", keys((0,)).alias("key"))
    verified = (F.col("p.last") >= F.col("q.near_last")) & (F.levenshtein(F.col("p.word"), F.col("q.near"), 1) == 1)
    met = probes.alias("p").join(posted.alias("q"), (F.col("p.key") == F.col("q.key")) & verified)
    met = met.select("p.word", "q.near")
    return met.union(met.select("near", "word")).distinct()


def spelling_forms(docs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of the vocabulary of ``docs``.

    ``n_near`` counts the words one edit apart. ``form`` is the one with the greatest n (ties:
    the least in code-point order), null unless that n is ``ratio`` times the word's own or
    more; ``root`` is reached by following forms to the last. Columns other than ``doc_id``
    and ``text`` are not read. No words give no rows. See ``vocabulary`` for odd rows.
    """
    words = cut_lineage(vocabulary(docs))
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near", "near_n")).alias("best")
    )
    found = words.join(best, "word", "left")
    formed = F.col("best.near_n") >= ratio * F.col("n")
    found = cut_lineage(
        found.select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.near_n")).alias("form_n"),
        )
    )
    return found.join(_roots(found.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling; counts grow along forms, so that none goes in a circle."""
    step = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        following = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(step.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        step = step.drop("moved")
        if not moved:
            return step


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spelling": op13_spelling}
CHECKS: dict[str, str] = {}
