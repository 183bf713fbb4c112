"""Entity match, event class and lexicon sentiment as built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import lexicon as lx

WORD = r"[\p{L}\p{N}_]"
SPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def content_hash(*parts: Column) -> Column:
    """Never null, and stated so: a join by the hash would else test it for null below the shuffle,
    with the lower-cased text computed again for every word that the class is looked up by."""
    return F.coalesce(F.sha2(F.concat_ws(":", *parts), 256), F.lit(""))


def article_key(source: Column, headline: Column, published: Column) -> Column:
    return content_hash(F.lower(strip(source)), F.lower(strip(headline)), strip(published))


def announcement_key(symbol: Column, title: Column, date: Column, time: Column) -> Column:
    return content_hash(F.upper(strip(symbol)), F.lower(strip(title)), strip(date), F.lower(strip(time)))


def signal_key(raw_id: Column, symbol: Column, category: Column) -> Column:
    return content_hash(strip(raw_id), F.upper(strip(symbol)), F.upper(strip(category)))


# -- entities ---------------------------------------------------------------------


def alias_table(universe: dict[str, str] | None = None, custom: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Configured names and tickers, the default aliases, then custom ones."""
    table: dict[str, list[str]] = {s.upper(): [n, s.upper()] for s, n in (universe or {}).items()}
    for source in (lx.ALIASES, custom or {}):
        for symbol, names in source.items():
            known = table.setdefault(symbol.upper(), [])
            known.extend(n for n in names if n not in known)
    return table


def _alias_regex(symbol: str, names: list[str]) -> str:
    options = []
    for name in sorted({n.strip() for n in names if n.strip()}, key=lambda n: (-len(n), n)):
        body = re.sub(r"([^\w\s&])", r"\\\1", name).replace("&", "(?:&|and)")
        exact = name.upper() == symbol and symbol in lx.CASE_SENSITIVE
        options.append(f"(?-i:{body})" if exact else body)
    return f"(?<!{WORD})(?:{'|'.join(options)})(?!{WORD})"


def _mentions(lowered: Column, words) -> Column:
    """Plain byte search for any of the words: the cheap test before a regex."""
    hit = F.lit(False)
    for word in sorted(set(words)):
        hit = hit | lowered.contains(word)
    return hit


def match_entities(text: Column, lowered: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of the symbols named in the text.

    One alternation per symbol, run only where the longest word of one of its names
    occurs at all. ``lowered`` is the lower-cased text as a column of its own, so that
    it is computed once per row.
    """
    rules = []
    for symbol, names in sorted((aliases or alias_table()).items()):
        needed = [max(re.findall(r"\w+", n), key=len).lower() for n in names]
        regex = "(?i)" + _alias_regex(symbol, names)
        rules.append(F.when(F.when(_mentions(lowered, needed), text.rlike(regex)), F.lit(symbol)))
    return F.coalesce(F.array_compact(F.array(*rules)), F.array().cast("array<string>"))


def first_entity(matched: Column) -> Column:
    return F.get(matched, F.lit(0))


# -- event class ------------------------------------------------------------------


def _required_word(pattern: str) -> str:
    """A literal every match of the pattern contains: its first word, or the one after a leading group."""
    body = pattern.removeprefix(r"\b")
    if body.startswith("(?:"):
        body = body[body.index(")") + 1 :].removeprefix(r"\s+")
    word = re.match(r"[a-z]+", body).group()
    return word[:-1] if body[len(word) :].startswith("?") else word


def classify_event(text: Column, lowered: Column) -> Column:
    """struct(category, confidence): most pattern hits, ties by list order, OTHER when none.

    A pattern runs only where its literal word occurs in the text; ``lowered`` as above.
    """

    def hit(pattern: str) -> Column:
        found = F.when(lowered.contains(_required_word(pattern)), lowered.rlike("(?U)" + pattern))
        return F.coalesce(found, F.lit(False)).cast("int")

    def outcome(category: Column, confidence: Column) -> Column:
        return F.struct(category.alias("category"), confidence.cast("double").alias("confidence"))

    ranked = F.array(
        *[
            F.struct(
                sum((hit(p) for p in ps), F.lit(0)).alias("hits"),
                F.lit(-i).alias("rank"),
                F.lit(name).alias("category"),
            )
            for i, (name, ps) in enumerate(lx.EVENT_PATTERNS.items())
        ]
    )
    # one pass over a one-element array binds the winner once
    scored = F.transform(
        F.array(F.array_max(ranked)),
        lambda b: F.when(b["hits"] == 0, outcome(F.lit("OTHER"), F.lit(0.5))).otherwise(
            outcome(b["category"], F.bround(F.least(b["hits"] * 0.15 + 0.6, F.lit(0.95)), 2))
        ),
    )[0]
    blank = text.isNull() | (strip(text) == "")
    return F.when(blank, outcome(F.lit("OTHER"), F.lit(0.0))).otherwise(scored)


# -- sentiment --------------------------------------------------------------------

TOKEN = f"(?<!{WORD})[a-zA-Z]{{2,}}+(?!{WORD})"
IS_POS, IS_NEG, IS_NOT, IS_STRONG = 1, 2, 4, 8


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_roles(toks: Column) -> Column:
    """Per token a bit set of its roles; list lookups compile to hash sets.

    One lookup settles the tokens of no list, which most are.
    """
    lists = {IS_POS: lx.POSITIVE, IS_NEG: lx.NEGATIVE, IS_NOT: lx.NEGATION, IS_STRONG: lx.INTENSIFIER}
    listed = sorted(set().union(*lists.values()))

    def role(t: Column) -> Column:
        found = sum((F.when(t.isin(words), bit).otherwise(0) for bit, words in lists.items()), F.lit(0))
        return F.when(t.isin(listed), found).otherwise(0)

    return F.transform(toks, role)


def with_sentiment(df: DataFrame, text: str) -> DataFrame:
    """Adds sentiment_score, sentiment_label, sentiment_confidence, positive_tokens, negative_tokens.

    A hit is negated by a negation among the three tokens before it and strengthened by
    an intensifier among the two before it. Work per text is linear in its tokens.
    """
    toks, roles = F.col("_toks"), F.col("_roles")

    def back(i: Column, k: int) -> Column:
        return F.coalesce(F.get(roles, i - k), F.lit(0))

    def hit(role: Column, i: Column) -> Column:
        negated = (back(i, 1).bitwiseOR(back(i, 2)).bitwiseOR(back(i, 3))).bitwiseAND(IS_NOT) > 0
        strong = back(i, 1).bitwiseOR(back(i, 2)).bitwiseAND(IS_STRONG) > 0
        positive = role.bitwiseAND(IS_POS) > 0
        size = F.when(strong, 1.5).otherwise(1.0)
        word = F.get(toks, i)
        base = F.when(positive, F.when(negated, -1.0).otherwise(1.0)).otherwise(
            F.when(negated, 0.8).otherwise(-1.0)
        )
        return F.when(
            role.bitwiseAND(IS_POS | IS_NEG) > 0,
            F.struct(
                F.when(negated, F.concat(F.lit("not_"), word)).otherwise(word).alias("token"),
                (base * size).alias("weight"),
            ),
        )

    raw = F.aggregate("_hits", F.lit(0.0), lambda acc, h: acc + h["weight"])
    n = F.size("_hits")
    score = F.col("sentiment_score")
    return (
        df.withColumn("_toks", tokens(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_roles", token_roles(toks))
        .withColumn("_hits", F.array_compact(F.transform(roles, hit)))
        .withColumn("sentiment_score", F.bround(F.tanh(raw / 2.5), 4))
        .withColumn(
            "sentiment_label",
            F.when(n == 0, "NEUTRAL").when(score >= 0.05, "POSITIVE").when(score <= -0.05, "NEGATIVE").otherwise("NEUTRAL"),
        )
        .withColumn(
            "sentiment_confidence",
            F.when(n == 0, 0.5).otherwise(F.bround(F.least(n * 0.1 + 0.6, F.lit(0.95)), 2)),
        )
        .withColumn("positive_tokens", F.transform(F.filter("_hits", lambda h: h["weight"] > 0), lambda h: h["token"]))
        .withColumn("negative_tokens", F.transform(F.filter("_hits", lambda h: h["weight"] < 0), lambda h: h["token"]))
        .drop("_toks", "_roles", "_hits")
    )
