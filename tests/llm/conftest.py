import pytest

from pyspark.sql import functions as F

TEXTS = [
    "The quick brown fox jumps over the lazy dog, again and again.",
    "The quick brown fox jumps over the lazy dog, again and again.",
    "",
    None,
    "   \n\t ",
    "one",
    "Élan vital — naïve café, don't I'LL 'tis  x",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 800,
    "x" * 5000,
    "<|endoftext|> and <|startoftext|> inside",
]


@pytest.fixture
def odd_docs(spark):
    """Null and repeated ids, null, empty, blank and long texts, equal rows, and clashing columns."""
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", "en", "s0"), (4, TEXTS[4], None, "s0"), (4, TEXTS[4], None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["score", "matches", "f0", "node", "h", "cell", "row", "keeper", "text_hash", "window"]
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(1) for c in extra}).repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
