import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import calendar as cal
from marketloom.functions import text as tx
from marketloom.plans import news as nw
from marketloom.plans import signals as sg
from marketloom.sources import payloads as pl

CAL = cal.Calendar()


def _align(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.withColumn("published_at", cal.parse_published(F.col("t")))
    dim = CAL.between(spark, "2026-07-01", "2026-12-31")
    return cal.align_to_sessions(df, dim).orderBy("i").collect()


def test_session_rules(spark):
    got = _align(
        spark, "2026-09-08 17:00:00", "2026-09-11 13:00:00", "2026-09-11 10:30:00", "2026-09-11T18:00:00",
        "2026-09-13 14:00:00+05:00", "2026-09-10 08:15:00", "2026-08-14 11:00:00", "2026-09-08 15:30:00",
    )
    seen = [(str(r.session_target_date), r.session_type, r.is_intraday, r.usable_from.strftime("%H:%M")) for r in got]
    assert seen == [
        ("2026-09-09", "REGULAR", False, "09:15"),
        ("2026-09-11", "FRIDAY_SESSION_2", False, "14:30"),
        ("2026-09-11", "FRIDAY_SESSION_2", True, "14:30"),
        ("2026-09-14", "REGULAR", False, "09:15"),
        ("2026-09-14", "REGULAR", False, "09:15"),
        ("2026-09-10", "REGULAR", False, "09:15"),
        ("2026-08-17", "REGULAR", False, "09:15"),
        ("2026-09-09", "REGULAR", True, "09:15"),
    ]


def test_calendar_neighbours_match_brute_force(spark):
    rows = CAL.between(spark, "2024-03-20", "2025-07-15").collect()
    fixed, declared = set(cal.FIXED_HOLIDAYS), {dt.date.fromisoformat(d) for d in cal.DECLARED_HOLIDAYS}

    def trades(d):
        return d.weekday() < 5 and (d.month, d.day) not in fixed and d not in declared

    for r in rows:
        nxt = r.day + dt.timedelta(1)
        while not trades(nxt):
            nxt += dt.timedelta(1)
        prev = r.day - dt.timedelta(1)
        while not trades(prev):
            prev -= dt.timedelta(1)
        assert (r.is_trading, r.next_trading, r.prev_trading) == (trades(r.day), nxt, prev)


def test_custom_holidays(spark):
    c = cal.Calendar(add=["2024-01-02"], remove=["2024-04-10"])
    got = {str(r.day): r.is_trading for r in c.between(spark, "2024-01-01", "2024-04-30").collect()}
    assert got["2024-01-02"] is False and got["2024-04-10"] is True


def _features(spark, signals, days, symbol="OGDC"):
    df = spark.createDataFrame(
        [(symbol, [symbol], s, c, t) for t, s, c in signals],
        "primary_symbol string, matched_symbols array<string>, sentiment_score double, event_category string, t string",
    ).withColumn("published_at", cal.parse_published(F.col("t")))
    symbols = spark.createDataFrame([(symbol,)], "symbol string")
    sessions = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "session_date date")
    return {str(r.session_date): r for r in nw.news_features(df, symbols, sessions).collect()}


def test_news_do_not_leak(spark):
    got = _features(
        spark, [("2026-09-09 08:30:00", 0.8, "OTHER"), ("2026-09-09 10:30:00", -0.9, "OTHER")], ["2026-09-09", "2026-09-10"]
    )
    assert (got["2026-09-09"].news_count_24h, got["2026-09-09"].sentiment_24h) == (1, 0.8)
    assert (got["2026-09-10"].news_count_24h, got["2026-09-10"].sentiment_24h) == (1, -0.9)


def test_news_windows_and_flags(spark):
    got = _features(
        spark,
        [("2026-09-09 08:00:00", 0.6, "EARNINGS"), ("2026-09-08 10:00:00", 0.4, "DIVIDEND"), ("2026-09-07 10:00:00", -0.8, "OTHER")],
        ["2026-09-09"],
    )["2026-09-09"]
    assert (got.news_count_24h, got.sentiment_24h, got.news_count_72h, got.sentiment_72h) == (2, 0.5, 3, 0.0667)
    assert (got.has_earnings_announcement_today, got.has_dividend_announcement_today, got.has_discovery_announcement_today) == (1, 1, 0)


def test_news_window_edges(spark):
    """Exactly at the opening counts; exactly 24 h / 72 h before does not."""
    got = _features(
        spark,
        [("2026-09-09 09:15:00", 1.0, "OTHER"), ("2026-09-08 09:15:00", 1.0, "OTHER"), ("2026-09-06 09:15:00", 1.0, "OTHER")],
        ["2026-09-09"],
    )["2026-09-09"]
    assert (got.news_count_24h, got.news_count_72h) == (1, 2)


def _match(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t"))
    return [r.m for r in df.select("i", tx.match_entities(F.col("t"), F.col("low")).alias("m")).orderBy("i").collect()]


def test_entities(spark):
    assert _match(
        spark, "Oil and Gas Development discovered gas", "Pakistan Petroleum partners with Hubco on energy",
        "Wish you good luck", "The operating system update", "SYS signs contract", "Engro Corp and Fauji Fertilizer",
        "LUCK expands", "Ghani Global Glass Ltd. reports", "xUBLx", "",
    ) == [["OGDC"], ["HUBC", "PPL"], [], [], ["SYS"], ["ENGRO", "FFC"], ["LUCK"], ["GGL"], [], []]


def test_events(spark):
    texts = {
        "OGDC reports quarterly profit after tax and higher EPS": "EARNINGS",
        "FFC declares interim cash dividend of PKR 5.50 per share": "DIVIDEND",
        "Company announces 15% bonus shares": "BONUS_ISSUE",
        "Hydrocarbon discovery with flow rate of 20 MMSCFD": "DISCOVERY",
        "Temporary plant shutdown for annual maintenance turnaround": "PRODUCTION_CHANGE",
        "SECP issues directive and show-cause notice": "REGULATORY",
        "Committee keeps policy rate unchanged as CPI inflation eases": "MACRO_INTEREST_RATE",
        "Local delegation visits exhibition": "OTHER",
        "  ": "OTHER",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    got = {r.t: r.e for r in df.select("t", tx.classify_event(F.col("t"), F.col("low")).alias("e")).collect()}
    assert {t: e.category for t, e in got.items()} == texts
    assert got["  "].confidence == 0.0 and got["Local delegation visits exhibition"].confidence == 0.5


def test_sentiment(spark):
    texts = ["Record profit surge and dividend increase boost investor optimism", "Company did not suffer a loss", "There is no dividend", "", "été"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = tx.with_sentiment(df, "t").orderBy("i").collect()
    assert r[0].sentiment_score > 0.1 and r[0].sentiment_label == "POSITIVE" and "profit" in r[0].positive_tokens
    assert r[1].sentiment_score >= 0 and r[1].positive_tokens == ["not_loss"]
    assert r[2].sentiment_score <= 0 and r[2].negative_tokens == ["not_dividend"]
    assert (r[3].sentiment_score, r[3].sentiment_label, r[3].sentiment_confidence) == (0.0, "NEUTRAL", 0.5)
    assert r[4].sentiment_label == "NEUTRAL"


def test_text_plans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "e")], "article_id string, source string, published_at string, headline string, summary string")
    plan = sg.article_signals(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_signals_are_idempotent(spark):
    arts = spark.createDataFrame(
        [("a1", "S", "2026-01-01", "OGDC net profit jumps", "x"), ("a2", "S", "2026-01-01", "Rain expected", "")],
        "article_id string, source string, published_at string, headline string, summary string",
    )
    notes = spark.createDataFrame(
        [("n1", "luck", "Board Meeting with Hubco", "2026-01-01", "10:00 AM", "EXCHANGE")],
        "announcement_id string, symbol string, title string, announcement_date string, announcement_time string, source string",
    )
    first = sg.process_news(arts, notes).cache()
    assert first.count() == 3
    assert sg.process_news(arts, notes, first).count() == 0
    note = first.filter("raw_id = 'n1'").first()
    assert note.primary_symbol == "LUCK" and sorted(note.matched_symbols) == ["HUBC", "LUCK"]


def test_feed_and_notice_parsers(spark):
    rss = """<?xml version="1.0"?><rss version="2.0"><channel><item><title> Gas find </title><link>https://x/1</link>
      <description>&lt;p&gt;Big &lt;b&gt;well&lt;/b&gt;&lt;/p&gt;</description><pubDate>Tue, 08 Sep 2026 10:00:00 +0500</pubDate></item>
      <item><title>No link</title></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Rates</title><link href="https://x/2"/><summary>s</summary>
      <updated>2026-09-08T10:00:00Z</updated><id>u1</id></entry></feed>"""
    df = spark.createDataFrame([("r", rss), ("a", atom), ("bad", "<oops")], "source string, payload string")
    got = {r.source: r for r in pl.articles_from_feed(df).collect()}
    assert set(got) == {"r", "a"}
    assert (got["r"].headline, got["r"].summary, got["r"].published_at) == ("Gas find", "Big well", "2026-09-08T05:00:00+00:00")
    assert (got["a"].url, got["a"].raw_guid) == ("https://x/2", "u1")
    html = """<table><tr><th>Date</th></tr><tr><td>Sep 10, 2026</td><td>3:45 PM</td><td>ogdc</td><td>Oil Co</td>
      <td>Gas find<a href="/download/document/9.pdf">pdf</a></td></tr></table>"""
    note = pl.announcements_from_html(spark.createDataFrame([(html,)], "payload string"), "https://b").first()
    assert (note.symbol, note.announcement_date, note.document_url) == ("OGDC", "2026-09-10", "https://b/download/document/9.pdf")


@pytest.mark.parametrize("payload", ['[[1705312800,10,11,9,10.5,100],[1705312800000,10,11,9,10.5],[0,0,1,1,1]]',
                                     '{"data":[{"time":1705312800,"open":10,"high":11,"low":9,"close":10.5,"volume":-5}]}'])
def test_json_bars(spark, payload):
    rows = pl.bars_from_json(spark.createDataFrame([("ogdc", payload)], "symbol string, payload string")).collect()
    assert {(r.symbol, str(r.trade_date), r.close) for r in rows} == {("OGDC", "2024-01-15", 10.5)}
    assert min(r.volume for r in rows) >= 0
