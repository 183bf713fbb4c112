"""Landed payloads (JSON, HTML, XML, wide quotes) to typed rows, as column expressions.

Input tables hold one payload per row, so parsing is spread over the payload table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import announcement_key, article_key, strip
from marketloom.schemas import ANNOUNCEMENTS, ARTICLES, PRICES

EPOCH = "1970-01-01"


def _epoch_day(ts: Column) -> Column:
    """UTC date of an epoch value in seconds, or in milliseconds when above 1e11."""
    seconds = F.when(ts > 1e11, ts / 1000.0).otherwise(ts)
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(seconds / 86400.0).cast("int"))


def _as_bars(df: DataFrame) -> DataFrame:
    """Symbol, date, OHLC and volume to the price schema; non-positive prices are dropped."""
    keep = df.filter("trade_date IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0")
    return keep.select(
        F.upper("symbol").alias("symbol"), "trade_date", "open", "high", "low", "close",
        F.col("close").alias("adjusted_close"),
        F.greatest(F.coalesce("volume", F.lit(0)), F.lit(0)).cast("bigint").alias("volume"),
        F.lit(0.0).alias("dividend_amount"), F.lit(1.0).alias("split_ratio"),
        F.lit(False).alias("is_upper_lock"), F.lit(False).alias("is_lower_lock"),
    )


def bars_from_json(payloads: DataFrame) -> DataFrame:
    """(symbol, payload): arrays ``[ts,o,h,l,c,v?]`` or objects, bare or under ``data``."""
    body = F.when(
        F.ltrim("payload").startswith("{"), F.get_json_object("payload", "$.data")
    ).otherwise(F.col("payload"))
    items = payloads.select("symbol", F.explode(F.from_json(body, "array<string>")).alias("item"))
    is_list = F.ltrim("item").startswith("[")
    cells = F.from_json("item", "array<string>")
    named = F.from_json(
        "item", "time string, date string, open string, high string, low string, close string, volume string"
    )
    parsed = items.withColumns({"_c": F.when(is_list, cells), "_o": F.when(~is_list, named)})

    def value(i: int, name: str) -> Column:
        return F.coalesce(F.get("_c", F.lit(i)), F.col(f"_o.{name}")).try_cast("double")

    stamp = F.coalesce(F.get("_c", F.lit(0)), F.col("_o.time"), F.col("_o.date")).try_cast("double")
    rows = parsed.filter(is_list & (F.size("_c") >= 5) | F.col("_o").isNotNull()).select(
        "symbol", _epoch_day(stamp).alias("trade_date"),
        value(1, "open").alias("open"), value(2, "high").alias("high"),
        value(3, "low").alias("low"), value(4, "close").alias("close"),
        value(5, "volume").alias("volume"),
    )
    return _as_bars(rows)


def parse_ms_date(text: Column) -> Column:
    """``/Date(ms)/`` with optional offset, else an ISO date in the first ten characters."""
    ms = F.regexp_extract(text, r"/Date\((\d+)(?:[+-]\d+)?\)/", 1)
    day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(ms.try_cast("double") / 86400000.0).cast("int"))
    return F.when(ms != "", day).otherwise(F.substring(text, 1, 10).try_cast("date"))


def bars_from_records(payloads: DataFrame) -> DataFrame:
    """(symbol, payload): an array of records with ``trading_*`` fields."""
    fields = "trading_Date string, trading_open string, trading_high string, trading_low string, trading_close string, trading_vol string"
    items = payloads.select("symbol", F.explode(F.from_json("payload", f"array<struct<{fields.replace(' string', ':string')}>>")).alias("r"))
    num = lambda c: F.col(f"r.{c}").try_cast("double")
    return _as_bars(
        items.select(
            "symbol", parse_ms_date(F.col("r.trading_Date")).alias("trade_date"),
            num("trading_open").alias("open"), num("trading_high").alias("high"),
            num("trading_low").alias("low"), num("trading_close").alias("close"),
            F.bround(num("trading_vol"), 0).alias("volume"),
        )
    )


# -- HTML -------------------------------------------------------------------------

# Named character references handled when tags are removed.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
INVISIBLE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<!--.*?-->|<![a-z][^>]*>"


def strip_html(html: Column) -> Column:
    """Visible text with single spaces."""
    text = F.regexp_replace(F.regexp_replace(html, INVISIBLE, " "), r"<[^>]+>", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1))


def table_rows(payloads: DataFrame, html: str) -> DataFrame:
    """Rows of the first table (or of the whole page when it has none): position, row html, cells."""
    first = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1)
    body = F.when(first != "", first).otherwise(F.col(html))
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    return (
        payloads.select("*", F.posexplode(rows).alias("row_pos", "row_html"))
        .drop(html)
        .withColumn("cells", F.transform(_cells(F.col("row_html")), strip_html))
    )


def bars_from_html(payloads: DataFrame) -> DataFrame:
    """(symbol, payload): date, open, high, low, close, volume columns under a header row.

    A page without a table has no bars.
    """
    rows = table_rows(payloads.filter(F.col("payload").rlike(r"(?i)<table\b")), "payload").filter((F.col("row_pos") > 0) & (F.size("cells") >= 5))
    num = lambda i: F.regexp_replace(F.get("cells", F.lit(i)), ",", "").try_cast("double")
    return _as_bars(
        rows.select(
            "symbol", F.get("cells", F.lit(0)).try_cast("date").alias("trade_date"),
            num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"),
            num(5).alias("volume"),
        )
    )


# Date layouts seen in notice tables.
NOTICE_DATES = ("MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "yyyy-MM-dd")


def notice_date(text: Column) -> Column:
    """ISO date text, or the input when no layout fits."""
    hits = [F.date_format(F.try_to_timestamp(strip(text), F.lit(f)), "yyyy-MM-dd") for f in NOTICE_DATES]
    return F.coalesce(*hits, strip(text))


def announcements_from_html(payloads: DataFrame, base_url: str = "", source: str = "EXCHANGE") -> DataFrame:
    """(payload): rows of at least five cells (date, time, symbol, company, title) with a document link."""
    rows = table_rows(payloads, "payload").filter(F.size("cells") >= 5)
    cell = lambda i: F.get("cells", F.lit(i))
    hrefs = F.regexp_extract_all("row_html", F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    link = F.get(F.filter(hrefs, lambda h: h.contains("/download/document/") | h.endswith(".pdf")), F.lit(0))
    df = rows.select(
        F.upper(cell(2)).alias("symbol"), cell(3).alias("company_name"), cell(4).alias("title"),
        F.lit("Company Announcement").alias("category"), notice_date(cell(0)).alias("announcement_date"),
        cell(1).alias("announcement_time"),
        F.when(link.startswith("/"), F.concat(F.lit(base_url), link)).otherwise(link).alias("document_url"),
        F.lit(source).alias("source"),
    ).filter("symbol <> '' AND title <> ''")
    key = announcement_key(F.col("symbol"), F.col("title"), F.col("announcement_date"), F.col("announcement_time"))
    return df.withColumn("announcement_id", key).select(*ANNOUNCEMENTS.fieldNames())


# -- wide quotes ------------------------------------------------------------------


def bars_from_quotes(quotes: DataFrame) -> DataFrame:
    """(symbol, Date, Open, ..., optional Adj Close / Dividends / Stock Splits) to bars."""
    has = set(quotes.columns)
    adj = F.col("`Adj Close`") if "Adj Close" in has else F.col("Close")
    div = F.coalesce("Dividends", F.lit(0.0)) if "Dividends" in has else F.lit(0.0)
    split = (
        F.coalesce(F.nullif(F.col("`Stock Splits`"), F.lit(0.0)), F.lit(1.0)) if "Stock Splits" in has else F.lit(1.0)
    )
    num = lambda c, n: c.cast("double").alias(n)
    return quotes.select(
        F.upper("symbol").alias("symbol"), F.to_date("Date").alias("trade_date"),
        num(F.col("Open"), "open"), num(F.col("High"), "high"), num(F.col("Low"), "low"),
        num(F.col("Close"), "close"), num(adj, "adjusted_close"),
        F.coalesce("Volume", F.lit(0)).cast("bigint").alias("volume"),
        num(div, "dividend_amount"), num(split, "split_ratio"),
        F.lit(False).alias("is_upper_lock"), F.lit(False).alias("is_lower_lock"),
    ).filter("open > 0 AND high > 0 AND low > 0 AND close > 0 AND adjusted_close > 0").select(*PRICES.fieldNames())


# -- feeds ------------------------------------------------------------------------

_ITEM = "array<struct<title:string,link:string,description:string,pubDate:string,guid:string,author:string,creator:string>>"
_ENTRY = (
    "array<struct<title:string,link:array<struct<_href:string>>,summary:string,content:string,published:string,"
    "updated:string,id:string>>"
)
FEED_SCHEMA = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}"
FEED_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
# Layouts of a feed date once the weekday is removed.
FEED_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")


def feed_date(text: Column) -> Column:
    """RFC-2822 or ISO to ISO text in UTC; anything else unchanged."""
    s = F.regexp_replace(strip(text), r"^[A-Z][a-z]{2},\s*", "")
    rfc = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FEED_DATES])
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), rfc.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), strip(text))


def articles_from_feed(payloads: DataFrame) -> DataFrame:
    """(source, payload): RSS items or, without any, Atom entries."""
    feeds = payloads.select("source", F.from_xml("payload", FEED_SCHEMA, FEED_OPTIONS).alias("f"))
    none = F.lit("")
    item = F.coalesce("f.channel.item", "f.item")
    rss = F.transform(
        item,
        lambda i: F.struct(
            F.coalesce(i["title"], none).alias("headline"), F.coalesce(i["description"], none).alias("summary"),
            F.coalesce(i["link"], none).alias("url"), F.coalesce(i["pubDate"], none).alias("published_at"),
            F.coalesce(i["author"], i["creator"]).alias("author"), i["guid"].alias("raw_guid"),
            F.lit(True).alias("needs_link"),
        ),
    )
    atom = F.transform(
        F.col("f.entry"),
        lambda e: F.struct(
            F.coalesce(e["title"], none).alias("headline"),
            F.coalesce(e["summary"], e["content"], none).alias("summary"),
            F.coalesce(F.get(e["link"], F.lit(0))["_href"], none).alias("url"),
            F.coalesce(e["published"], e["updated"], none).alias("published_at"),
            F.lit(None).cast("string").alias("author"), e["id"].alias("raw_guid"), F.lit(False).alias("needs_link"),
        ),
    )
    rows = feeds.select("source", F.explode(F.when(F.size(item) > 0, rss).otherwise(atom)).alias("a")).select("source", "a.*")
    rows = rows.filter((strip(F.col("headline")) != "") & (~F.col("needs_link") | (strip(F.col("url")) != "")))
    empty_to_null = lambda c: F.nullif(strip(F.col(c)), none)
    out = rows.withColumns(
        {
            "headline": strip(F.col("headline")), "summary": strip_html(F.col("summary")), "url": strip(F.col("url")),
            "published_at": feed_date(F.col("published_at")), "author": empty_to_null("author"),
            "raw_guid": empty_to_null("raw_guid"),
        }
    )
    key = article_key(F.col("source"), F.col("headline"), F.col("published_at"))
    return out.withColumn("article_id", key).select(*ARTICLES.fieldNames())
