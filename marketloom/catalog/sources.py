"""A: scans, SQL views, payload parsers, universe and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.cleaning import VALID
from marketloom.catalog.registry import query
from marketloom.catalog.text import HEADLINES, _lit
from marketloom.operators import clean as cl
from marketloom.sources import payloads as pl
from marketloom.sources import tables as tb


@query("a1_parquet_projection", "SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity > 25")
def a1(spark, sf):
    df = tb.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_shipdate", "l_quantity"])
    return df.filter((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 25))


@query("a3_glob_views", "SELECT l_returnflag, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY l_returnflag")
def a3(spark, sf):
    tb.register_view(spark, "ml_lineitem", f"{sf}/lineitem*.parquet")
    return spark.sql("SELECT l_returnflag, count(*) AS n, max(l_quantity) AS top FROM ml_lineitem GROUP BY l_returnflag")


@query("a4_parameterised_sql", """
SELECT event_type, count(*) AS n, min(value) AS low FROM events WHERE value >= 100 AND event_type <> 'error' GROUP BY event_type""")
def a4(spark, sf):
    tb.register_view(spark, "ml_events", f"{sf}/events.parquet")
    return tb.sql(spark, "SELECT event_type, count(*) AS n, min(value) AS low FROM ml_events WHERE value >= :floor AND event_type <> :skip GROUP BY event_type",
                  floor=100.0, skip="error")


BARS_OUT = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
BARS_SQL = fx.sql(fx.BARS, "SELECT symbol, trade_date, open, high, low, close, volume FROM bars")


def _months(spark, sf, cell, name="payload"):
    """One payload per (symbol, month): at most 31 cells each."""
    month = F.date_trunc("month", "trade_date").alias("month")
    return fx.bars(spark, sf).groupBy("symbol", month).agg(F.collect_list(cell).alias("cells"), F.count(F.lit(1)).alias("n"))


@query("a6_json_bars", BARS_SQL)
def a6(spark, sf):
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = day * 86400 + 3600
    cell = F.when(
        F.dayofmonth("trade_date") % 3 == 0,
        F.to_json(F.struct(seconds.alias("time"), "open", "high", "low", "close", "volume")),
    ).otherwise(F.concat(
        F.lit("["), F.when(F.dayofmonth("trade_date") % 2 == 0, seconds * 1000).otherwise(seconds),
        *[x for c in ("open", "high", "low", "close", "volume") for x in (F.lit(","), F.col(c).cast("string"))], F.lit("]")))
    broken = F.lit('[1,2],{"time":"x"},[86400,0,1,1,1,5],"junk"')
    body = F.concat(F.lit("["), F.array_join("cells", ","), F.lit(","), broken, F.lit("]"))
    docs = _months(spark, sf, cell).select(
        F.lower("symbol").alias("symbol"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"data":'), body, F.lit("}"))).otherwise(body).alias("payload"))
    return pl.bars_from_json(docs).select(*BARS_OUT)


@query("a7_ms_date_records", BARS_SQL)
def a7(spark, sf):
    ms = F.datediff("trade_date", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000
    day = F.when(F.dayofmonth("trade_date") % 2 == 0, F.concat(F.lit("/Date("), ms, F.lit("+0500)/"))).otherwise(
        F.concat(F.date_format("trade_date", "yyyy-MM-dd"), F.lit("T00:00:00")))
    cell = F.to_json(F.struct(
        day.alias("trading_Date"), F.col("open").alias("trading_open"), F.col("high").alias("trading_high"),
        F.col("low").alias("trading_low"), F.col("close").alias("trading_close"), (F.col("volume") + 0.25).alias("trading_vol")))
    zero = F.lit('{"trading_Date":"2001-01-01","trading_open":0,"trading_high":1,"trading_low":1,"trading_close":1}')
    docs = _months(spark, sf, cell).select("symbol", F.concat(F.lit("["), F.array_join("cells", ","), F.lit(","), zero, F.lit("]")).alias("payload"))
    return pl.bars_from_records(docs).select(*BARS_OUT)


@query("a8_html_bars", BARS_SQL)
def a8(spark, sf):
    td = lambda c: F.concat(F.lit('<td class="n"> '), c, F.lit(" </td>"))
    money = [td(F.format_number(c, 6)) for c in ("open", "high", "low", "close")]
    cell = F.concat(F.lit("<tr>"), td(F.date_format("trade_date", "yyyy-MM-dd")), *money, td(F.format_number("volume", 0)), F.lit("</tr>\n"))
    head = F.lit("<html><table><tr><th>Date</th><th>Open</th></tr><tr><td>short</td></tr>")
    docs = _months(spark, sf, cell).select("symbol", F.concat(head, F.array_join("cells", ""), F.lit("</table></html>")).alias("payload"))
    return pl.bars_from_html(docs).select(*BARS_OUT)


@query("a9_html_announcements", f"""
SELECT sha256(symbol || ':' || lower(title) || ':' || d || ':' || '09:30 am') AS announcement_id, * FROM (
SELECT 'BRAND' || (doc_id % 25 + 1) AS symbol, source AS company_name, h AS title, '2024-0' || (doc_id % 9 + 1) || '-10' AS d,
       CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'https://files.example/download/document/' || doc_id ELSE 'https://cdn.example/' || doc_id || '.pdf' END AS document_url
FROM (SELECT *, ([{', '.join(_lit(h.replace('&', 'and')) for h in HEADLINES)}])[doc_id % {len(HEADLINES)} + 1] AS h FROM documents))""")
def a9(spark, sf):
    d = fx.table(spark, sf, "documents")
    k = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h.replace("&", "and")) for h in HEADLINES]), (k % len(HEADLINES) + 1).cast("int"))
    day = F.make_date(F.lit(2024), (k % 9 + 1).cast("int"), F.lit(10))
    shown = F.when(k % 5 == 0, F.date_format(day, "MMM d, yyyy")).when(k % 5 == 1, F.date_format(day, "MMMM d, yyyy")).when(
        k % 5 == 2, F.date_format(day, "d-MMM-yyyy")).when(k % 5 == 3, F.date_format(day, "d-MMMM-yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    link = F.when(k % 3 == 1, F.concat(F.lit("<a href='#'>x</a><a href='/download/document/"), k, F.lit("'>PDF</a>"))).when(
        k % 3 == 2, F.concat(F.lit('<a class="d" href="https://cdn.example/'), k, F.lit('.pdf">PDF</a>'))).otherwise("none")
    row = F.concat(*[x for c in (shown, F.lit("09:30 AM"), F.concat(F.lit("brand"), k % 25 + 1), F.col("source"), head, link)
                     for x in (F.lit("<td>"), c, F.lit("</td>"))])
    page = F.concat(F.lit("<table><thead><tr><th>Date</th></tr></thead><tr>"), row, F.lit("</tr><tr><td>only</td></tr></table>"))
    return pl.announcements_from_html(d.select(page.alias("payload")), "https://files.example").select(
        "announcement_id", "symbol", "company_name", "title", F.col("announcement_date").alias("d"), "document_url")


@query("a10_wide_quotes", fx.sql(fx.ACTED, """
SELECT symbol, trade_date, close, close * 0.5e0 AS adjusted_close, volume, dividend_amount, split_ratio FROM acted WHERE day(trade_date) <> 3"""))
def a10(spark, sf):
    wide = fx.bars_acted(spark, sf).select(
        F.lower("symbol").alias("symbol"), F.col("trade_date").alias("Date"),
        F.when(F.dayofmonth("trade_date") == 3, 0.0).otherwise(F.col("open")).alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), (F.col("close") * 0.5).alias("Adj Close"),
        F.col("volume").alias("Volume"), F.nullif(F.col("dividend_amount"), F.lit(0.0)).alias("Dividends"),
        F.when(F.col("split_ratio") == 1.0, 0.0).otherwise(F.col("split_ratio")).alias("Stock Splits"))
    return pl.bars_from_quotes(wide).select("symbol", "trade_date", "close", "adjusted_close", "volume", "dividend_amount", "split_ratio")


STRIPPED = r"""
clean AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(safe,
      '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<template\b[^>]*>.*?</template\s*>', ' ', 'gis'),
      '<!--.*?-->', ' ', 'gs'), '<![a-zA-Z][^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
    '[ \t\n\r\f\v]+', ' ', 'g')) AS summary
  FROM (SELECT *, regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\r]', '', 'g') AS safe FROM pages))"""


@query("a11_feed_articles", fx.sql(STRIPPED, """
SELECT 'feed' || page_id % 7 AS source, url AS headline, url, summary,
       CASE WHEN page_id % 2 = 0 THEN '2024-03-05T04:07:09+00:00' ELSE '2024-03-05T09:07:09+05:00' END AS published_at,
       CASE WHEN page_id % 2 = 0 THEN 'Desk' END AS author, 'g' || page_id AS raw_guid FROM clean"""))
def a11(spark, sf):
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    p = fx.table(spark, sf, "pages").withColumn("safe", F.regexp_replace("html", r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]", ""))
    url, body, guid = esc(F.col("url")), esc(F.col("safe")), F.concat(F.lit("g"), "page_id")
    rss = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title><item>'), tag("title", url), tag("link", url),
        tag("description", body), tag("pubDate", F.lit("Tue, 05 Mar 2024 09:07:09 +0500")), tag("guid", guid), tag("dc:creator", F.lit("Desk")),
        F.lit("</item><item><title>No link</title></item></channel></rss>"))
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry>'), tag("title", url), F.lit('<link href="'), url, F.lit('"/>'),
        tag("summary", body), tag("updated", F.lit("2024-03-05T09:07:09+05:00")), tag("id", guid), F.lit("</entry><entry><id>x</id></entry></feed>"))
    feeds = p.select(F.concat(F.lit("feed"), F.col("page_id") % 7).alias("source"), F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("payload"))
    return pl.articles_from_feed(feeds).select("source", "headline", "url", "summary", "published_at", "author", "raw_guid")


@query("a13_universe_dimension", fx.sql(fx.UNIVERSE, "SELECT * FROM universe WHERE enabled"))
def a13(spark, sf):
    return tb.enabled_instruments(fx.universe(spark, sf))


@query("a14_recent_runs", """
SELECT event_id::VARCHAR AS run_id, ts AS started_at, (event_id % 6 + 1)::INT AS total_tasks,
       len(list_filter(range(1, event_id % 6 + 2), lambda i: (event_id + i) % 4 <> 0))::INT AS succeeded
FROM events ORDER BY started_at DESC, run_id DESC LIMIT 5""")
def a14(spark, sf):
    """One run per event with one to six tasks."""
    k = F.col("event_id")
    tasks = F.transform(
        F.sequence(F.lit(1), (k % 6 + 1).cast("int")),
        lambda i: F.struct(F.when((k + i) % 4 == 0, "FAILED").otherwise("SUCCESS").alias("status")))
    return tb.recent_runs(fx.table(spark, sf, "events").select(k.cast("string").alias("run_id"), F.col("ts").alias("started_at"), tasks.alias("tasks")))


@query("a15_run_manifest", fx.sql(VALID, """
SELECT symbol, count(*) AS records, min(trade_date) AS first_date, max(trade_date) AS last_date FROM valid GROUP BY symbol"""))
def a15(spark, sf):
    bars = cl.validate_prices(fx.raw_feed(spark, sf), fx.FEED_SEQ)
    return cl.load_metrics(cl.lock_flags(bars)).select("symbol", "records", "first_date", "last_date")


@query("a16_dataset_inventory", """
SELECT 'prices' AS dataset, count(*) AS row_count, CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date, count(DISTINCT l_partkey) AS distinct_keys FROM lineitem
UNION ALL SELECT 'macro', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'news', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), count(DISTINCT event_type) FROM events""")
def a16(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    return tb.inventory({"prices": (t("lineitem"), "l_shipdate", "l_partkey"), "macro": (t("orders"), "o_orderdate", "o_orderpriority"),
                         "news": (t("events"), "ts", "event_type")})
