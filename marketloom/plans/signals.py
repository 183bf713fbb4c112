"""Articles and announcements to scored signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import alias_table, classify_event, match_entities, signal_key, with_sentiment
from marketloom.operators.dedupe import keep_last, new_only
from marketloom.schemas import SIGNALS


def _scored(df: DataFrame) -> DataFrame:
    """Expects raw_id, source, published_at, headline, body, matched_symbols, primary_symbol."""
    out = with_sentiment(df.withColumn("_event", classify_event(F.col("body"), F.col("_low"))), "body")
    return (
        out.withColumn("event_category", F.col("_event.category"))
        .withColumn("confidence", F.bround((F.col("_event.confidence") + F.col("sentiment_confidence")) / 2.0, 2))
        .withColumn(
            "signal_id",
            signal_key(F.col("raw_id"), F.coalesce("primary_symbol", F.lit("MACRO")), F.col("event_category")),
        )
        .select(*SIGNALS.fieldNames())
    )


def article_signals(articles: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    summary = F.coalesce("summary", F.lit(""))
    body = F.when(summary != "", F.concat("headline", F.lit(". "), summary)).otherwise(F.col("headline"))
    df = articles.select(
        F.col("article_id").alias("raw_id"), "source", "published_at", "headline", body.alias("body")
    ).withColumn("_low", F.lower("body"))
    df = df.withColumn("matched_symbols", match_entities(F.col("body"), F.col("_low"), aliases or alias_table()))
    return _scored(df.withColumn("primary_symbol", F.get("matched_symbols", F.lit(0))))


def announcement_signals(notices: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    symbol = F.upper(F.coalesce("symbol", F.lit("")))
    own = F.when(symbol != "", F.array(symbol)).otherwise(F.array().cast("array<string>"))
    df = notices.select(
        F.col("announcement_id").alias("raw_id"),
        "source",
        F.btrim(F.concat_ws(" ", "announcement_date", "announcement_time")).alias("published_at"),
        F.col("title").alias("headline"),
        F.col("title").alias("body"),
        F.when(symbol != "", symbol).alias("primary_symbol"),
        own.alias("_own"),
    ).withColumn("_low", F.lower("body"))
    named = match_entities(F.col("body"), F.col("_low"), aliases or alias_table())
    df = df.withColumn("matched_symbols", F.array_distinct(F.concat("_own", named)))
    return _scored(df.drop("_own"))


def process_news(
    articles: DataFrame | None,
    notices: DataFrame | None,
    stored: DataFrame | None = None,
    aliases: dict[str, list[str]] | None = None,
) -> DataFrame:
    """New signals of a run: scored, one per id, ids already stored left out."""
    parts = []
    if articles is not None:
        parts.append(article_signals(articles, aliases))
    if notices is not None:
        parts.append(announcement_signals(notices, aliases))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fresh = new_only(scored, stored, ["signal_id"]) if stored is not None else scored
    return keep_last(fresh, ["signal_id"], ["raw_id", "published_at", "headline"])


def distributions(signals: DataFrame) -> DataFrame:
    """Counts per symbol, category and label in one pass (grouping sets over one scan)."""
    keyed = signals.select(
        F.coalesce("primary_symbol", F.lit("MACRO/GENERAL")).alias("symbol"),
        F.col("event_category").alias("category"),
        F.col("sentiment_label").alias("label"),
    )
    sets = keyed.groupingSets(
        [[F.col("symbol")], [F.col("category")], [F.col("label")]], "symbol", "category", "label"
    ).agg(F.count(F.lit(1)).alias("signals"))
    return sets.select(
        F.when(F.col("symbol").isNotNull(), "symbol").when(F.col("category").isNotNull(), "category").otherwise("label").alias("dimension"),
        F.coalesce("symbol", "category", "label").alias("value"),
        "signals",
    )
