"""F: entity match, event class, sentiment, signal jobs; B4 keys."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.registry import query
from marketloom.functions import lexicon as lx
from marketloom.functions import text as tx
from marketloom.plans import signals as sg
from marketloom.session import spread_groups

HEADLINES = (
    "OGDCL reports quarterly results: net profit growth and cash dividend announced",
    "Hydrocarbon discovery at exploration well, flow rate beats estimates; Pakistan Petroleum shares surge",
    "Lucky Cement suffers sharp loss and no dividend payout",
    "Wish you good luck with the operating system, nothing else to report",
    "SYS did not suffer a loss; Systems Limited posts record profit",
    "Engro Corp and Fauji Fertilizer approve rights issue and bonus shares",
    "SECP notice: show-cause notice and penalty imposed on Habib Bank",
    "Monetary policy unchanged, policy rate steady as CPI inflation eases before IMF review",
    "Plant shutdown at Hubco, production halted, shares plunge steeply",
    "Local delegation visits exhibition",
    "United Bank and MCB Bank without growth after failed recovery; debt crisis deepens",
    "Oil & Gas Development and Oil and Gas Development sign; LUCK and luck differ",
    "Board meeting of Ghani Global Glass Ltd. to approve financial results, book closure for dividend",
)


def storied(spark, sf):
    """Documents with a market headline put before the whole text.

    The texts are dealt out by id first: the table comes as one file with one row group, which
    one task would read and score alone.
    """
    head = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), (F.col("doc_id") % len(HEADLINES) + 1).cast("int"))
    return spread_groups(fx.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select(
        "doc_id", "source", head.alias("headline"), F.col("text").alias("summary"),
        F.concat(head, F.lit(". "), F.col("text")).alias("body"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T08:30:00+05:00")).alias("published_at"),
    )


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STORIED = f"""
storied AS (
  SELECT doc_id, source, h AS headline, text AS summary, h || '. ' || text AS body,
         '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T08:30:00+05:00' AS published_at
  FROM (SELECT *, ([{', '.join(_lit(h) for h in HEADLINES)}])[doc_id % {len(HEADLINES)} + 1] AS h FROM documents))"""

EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _alias_sql(symbol: str) -> str:
    loose, exact = [], []
    for name in lx.ALIASES[symbol]:
        target = exact if name == symbol and symbol in lx.CASE_SENSITIVE else loose
        target.append(re.escape(name).replace(r"\ ", " ").replace(r"\&", "&").replace("&", "(?:&|and)"))
    tests = [f"regexp_matches(body, {_lit(EDGE_L + '(?:' + '|'.join(loose) + ')' + EDGE_R)}, 'i')"]
    if exact:
        tests.append(f"regexp_matches(body, {_lit(EDGE_L + '(?:' + '|'.join(exact) + ')' + EDGE_R)})")
    return f"CASE WHEN {' OR '.join(tests)} THEN '{symbol}' END"


MATCH = f"list_filter([{', '.join(_alias_sql(s) for s in sorted(lx.ALIASES))}], lambda x: x IS NOT NULL)"


def _event_sql() -> str:
    def edge(p: str) -> str:
        p = EDGE_L + p.removeprefix(r"\b")
        return p.replace(r"\b", EDGE_R)
    counts = {
        name: " + ".join(f"regexp_matches(body, {_lit(edge(p))}, 'i')::INT" for p in ps)
        for name, ps in lx.EVENT_PATTERNS.items()
    }
    return ", ".join(f"{c} AS c_{n.lower()}" for n, c in counts.items())


NAMES = [n.lower() for n in lx.EVENT_PATTERNS]
TOP = f"greatest({', '.join('c_' + n for n in NAMES)})"
EVENTS = f"""
counted AS (SELECT doc_id, {_event_sql()} FROM storied),
classed AS (
  SELECT doc_id, CASE WHEN {TOP} = 0 THEN 'OTHER' {' '.join(f"WHEN c_{n} = {TOP} THEN '{n.upper()}'" for n in NAMES)} END AS category,
         CASE WHEN {TOP} = 0 THEN 0.5e0 ELSE CAST(round(least(0.6 + 0.15 * {TOP}, 0.95), 2) AS DOUBLE) END AS class_confidence
  FROM counted)"""


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SENT = f"""
toks AS (
  SELECT doc_id, list_transform(list_filter(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}')), lambda w: lower(w)) AS t
  FROM storied),
words AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM toks),
flags AS (
  SELECT doc_id, i, w, w IN {_in(lx.POSITIVE)} AS pos, w IN {_in(lx.NEGATIVE)} AS neg,
         max(w IN {_in(lx.NEGATION)}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS no,
         max(w IN {_in(lx.INTENSIFIER)}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS strong
  FROM words),
weights AS (
  SELECT doc_id, i, CASE WHEN coalesce(no, false) THEN 'not_' || w ELSE w END AS w,
         CASE WHEN pos THEN CASE WHEN coalesce(no, false) THEN -10 ELSE 10 END
              ELSE CASE WHEN coalesce(no, false) THEN 8 ELSE -10 END END
         * CASE WHEN coalesce(strong, false) THEN 3 ELSE 2 END AS x
  FROM flags WHERE pos OR neg),
scored AS (
  SELECT doc_id, sum(x) / 20e0 AS raw, count(*) AS n, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (x > 0), '') AS positive_tokens,
         coalesce(string_agg(w, ' ' ORDER BY i) FILTER (x < 0), '') AS negative_tokens
  FROM weights GROUP BY doc_id),
tanhed AS (
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(positive_tokens, '') AS positive_tokens, coalesce(negative_tokens, '') AS negative_tokens,
         coalesce(round((exp(2 * raw / 2.5e0) - 1) / (exp(2 * raw / 2.5e0) + 1), 4), 0e0) + 0e0 AS sentiment_score
  FROM storied LEFT JOIN scored USING (doc_id)),
sentiment AS (
  SELECT doc_id, sentiment_score, positive_tokens, negative_tokens,
         CASE WHEN n = 0 THEN 'NEUTRAL' WHEN sentiment_score >= 0.05 THEN 'POSITIVE' WHEN sentiment_score <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label,
         CASE WHEN n = 0 THEN 0.5e0 ELSE CAST(round(least(0.6 + 0.1 * n, 0.95), 2) AS DOUBLE) END AS sentiment_confidence
  FROM tanhed)"""


@query("b4_content_hash_keys", fx.sql(STORIED, """
SELECT doc_id, sha256(lower(trim(source)) || ':' || lower(trim(headline)) || ':' || trim(published_at)) AS article_id,
       sha256('BRAND' || (doc_id % 25) || ':' || lower(trim(headline)) || ':' || published_at[1:10] || ':' || '10:15 am') AS announcement_id,
       sha256('doc-' || doc_id || ':MACRO:OTHER') AS signal_id FROM storied"""))
def b4(spark, sf):
    df = storied(spark, sf)
    return df.select(
        "doc_id", tx.article_key(F.col("source"), F.col("headline"), F.col("published_at")).alias("article_id"),
        tx.announcement_key(F.concat(F.lit(" brand"), F.col("doc_id") % 25), F.col("headline"),
                            F.substring("published_at", 1, 10), F.lit("10:15 AM")).alias("announcement_id"),
        tx.signal_key(F.concat(F.lit("doc-"), "doc_id"), F.lit("macro"), F.lit("other")).alias("signal_id"))


@query("f1_entity_match", fx.sql(STORIED, f"""
SELECT doc_id, array_to_string(m, ',') AS matched_symbols, m[1] AS primary_symbol FROM (SELECT doc_id, {MATCH} AS m FROM storied)"""))
def f1(spark, sf):
    m = tx.match_entities(F.col("body"), F.col("low"))
    return storied(spark, sf).withColumn("low", F.lower("body")).select("doc_id", m.alias("m")).select(
        "doc_id", F.array_join("m", ",").alias("matched_symbols"), tx.first_entity(F.col("m")).alias("primary_symbol"))


@query("f2_event_classification", fx.sql(STORIED + "," + EVENTS, "SELECT * FROM classed"))
def f2(spark, sf):
    df = storied(spark, sf).withColumn("low", F.lower("body"))
    return df.select("doc_id", tx.classify_event(F.col("body"), F.col("low")).alias("e")).select(
        "doc_id", "e.category", F.col("e.confidence").alias("class_confidence"))


@query("f3_lexicon_sentiment", fx.sql(STORIED + "," + SENT, "SELECT * FROM sentiment"))
def f3(spark, sf):
    return tx.with_sentiment(storied(spark, sf), "body").select(
        "doc_id", (F.col("sentiment_score") + 0.0).alias("sentiment_score"), "sentiment_label", "sentiment_confidence",
        F.array_join("positive_tokens", " ").alias("positive_tokens"), F.array_join("negative_tokens", " ").alias("negative_tokens"))


def articles(spark, sf):
    return storied(spark, sf).withColumn(
        "article_id", tx.article_key(F.concat("source", F.lit("-"), "doc_id"), F.col("headline"), F.col("published_at")))


def notices(spark, sf):
    """Announcements from the conversation turns: the text as title, the conversation's brand as symbol; dealt out as ``storied``."""
    c = spread_groups(fx.table(spark, sf, "conversations"), "conv_id", "turn", "role")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADLINES]), (F.col("turn") % len(HEADLINES) + 1).cast("int"))
    return c.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit("-"), "role").alias("announcement_id"),
        F.concat(F.lit("brand"), F.col("conv_id") % 25 + 1).alias("symbol"), F.lit("").alias("company_name"),
        F.concat(head, F.lit(": "), F.coalesce("text", F.lit(""))).alias("title"), F.lit("2024-02-01").alias("announcement_date"),
        F.lit("10:15 AM").alias("announcement_time"), F.lit("EXCHANGE").alias("source"))


def run_signals(spark, sf):
    arts = articles(spark, sf)
    seen = sg.article_signals(arts.filter("doc_id % 10 = 0")).select("signal_id")
    return sg.process_news(arts, notices(spark, sf), seen)


BODY = f"""
inputs AS (
  SELECT sha256(lower(trim(source || '-' || doc_id)) || ':' || lower(trim(headline)) || ':' || published_at) AS raw_id,
         'a' AS kind, NULL AS own, body, doc_id % 10 = 0 AS known FROM storied
  UNION ALL
  SELECT 'c' || conv_id || '-' || turn || '-' || role, 'n', 'BRAND' || (conv_id % 25 + 1),
         ([{', '.join(_lit(h) for h in HEADLINES)}])[turn % {len(HEADLINES)} + 1] || ': ' || coalesce(text, ''), false FROM conversations),
numbered AS (SELECT *, row_number() OVER () AS doc_id FROM inputs)"""
SIGNAL_CTES = STORIED + "," + BODY + "," + (EVENTS + "," + SENT).replace("FROM storied", "FROM numbered") + f""",
fused AS (
  SELECT raw_id, kind, CASE WHEN kind = 'n' THEN own ELSE m[1] END AS primary_symbol, category AS event_category,
         list_sort(list_distinct(CASE WHEN kind = 'n' THEN list_append(m, own) ELSE m END)) AS ms, sentiment_label, sentiment_score,
         CAST(round_even((class_confidence + sentiment_confidence) / 2, 2) AS DOUBLE) AS confidence, known
  FROM (SELECT *, {MATCH} AS m FROM numbered) JOIN classed USING (doc_id) JOIN sentiment USING (doc_id)),
fresh AS (
  SELECT sha256(raw_id || ':' || coalesce(primary_symbol, 'MACRO') || ':' || event_category) AS signal_id, * FROM fused
  QUALIFY NOT bool_or(known) OVER (PARTITION BY raw_id, primary_symbol, event_category)
    AND row_number() OVER (PARTITION BY raw_id, primary_symbol, event_category) = 1)"""


@query("f4_signal_processing", fx.sql(SIGNAL_CTES, """
SELECT signal_id, raw_id, primary_symbol, array_to_string(ms, ',') AS matched_symbols, event_category, sentiment_label, sentiment_score, confidence FROM fresh"""))
def f4(spark, sf):
    return run_signals(spark, sf).select(
        "signal_id", "raw_id", "primary_symbol", F.array_join(F.array_sort("matched_symbols"), ",").alias("matched_symbols"),
        "event_category", "sentiment_label", (F.col("sentiment_score") + 0.0).alias("sentiment_score"), "confidence")


@query("f5_signal_distributions", fx.sql(SIGNAL_CTES, """
SELECT 'symbol' AS dimension, coalesce(primary_symbol, 'MACRO/GENERAL') AS value, count(*) AS signals FROM fresh GROUP BY 2
UNION ALL SELECT 'category', event_category, count(*) FROM fresh GROUP BY 2
UNION ALL SELECT 'label', sentiment_label, count(*) FROM fresh GROUP BY 2"""))
def f5(spark, sf):
    return sg.distributions(run_signals(spark, sf))
