"""Tables that are written, broken off, written again and read back: A2, A5, A12, I20, K2 and M6."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog import text as tx
from marketloom.catalog.cleaning import VALID
from marketloom.catalog.models import COLUMNS, panel
from marketloom.catalog.monitoring import PRED, predictions
from marketloom.catalog.registry import query
from marketloom.plans import daily as dl
from marketloom.plans import models as md
from marketloom.plans import registry as rg
from marketloom.session import cut_lineage, shared_folder
from marketloom.sources import commits as cm
from marketloom.sources import tables as tb


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"


def _must_fail(write, *args) -> None:
    """Run a write that breaks off half-way."""
    try:
        write(*args)
    except (PySparkException, Py4JJavaError):
        return
    raise AssertionError("the write was meant to fail")


def _broken(column: str, where):
    """The column, which raises an error where the condition holds."""
    return F.when(where, F.raise_error(F.lit("feed ended"))).otherwise(F.col(column))


@query("a2_atomic_sink", fx.sql(fx.BARS, """
SELECT symbol, trade_date, close AS close_after_failure, CASE WHEN symbol <= 'BRAND2' THEN close + 1 ELSE close END AS close FROM bars"""))
def a2(spark, sf):
    """A revision of some symbols fails half-way, which nobody sees, and is written by the retry."""
    path, bars = f"{_fresh(spark)}/prices", fx.bars(spark, sf)
    tb.write_partitions(bars, path)
    revised = bars.filter("symbol <= 'BRAND2'").withColumn("close", F.col("close") + 1.0)
    _must_fail(tb.write_partitions, revised.withColumn("close", _broken("close", F.col("symbol") == "BRAND13")), path)
    seen = cut_lineage(tb.read_table(spark, path, ["symbol", "trade_date", "close"]).withColumnRenamed("close", "close_after_failure"))
    tb.write_partitions(revised, path)
    return seen.join(tb.read_table(spark, path, ["symbol", "trade_date", "close"]), ["symbol", "trade_date"])


@query("a5_layered_layout", f"""
SELECT 'prices' AS layer, n FROM ({fx.sql(fx.BARS, 'SELECT count(*) AS n FROM bars')})
UNION ALL SELECT 'macro', n FROM ({fx.sql(fx.MACRO, 'SELECT count(*) AS n FROM macro_raw')})
UNION ALL SELECT 'predictions', n FROM ({fx.sql(PRED, 'SELECT count(*) AS n FROM pred')})""")
def a5(spark, sf):
    """Partitioned and versioned layers under one root, read through their views: the latest version counts."""
    layout, macro = tb.Layout(_fresh(spark)), fx.macro_raw(spark, sf)
    tb.write_partitions(fx.bars(spark, sf), layout.prices)
    tb.write_version(macro.filter("indicator = 'USD_PKR'"), layout.macro)
    tb.write_version(macro, layout.macro)
    tb.write_version(predictions(spark, sf), layout.predictions)
    made = tb.register_views(spark, layout)
    return spark.sql(" UNION ALL ".join(f"SELECT '{v}' AS layer, count(*) AS n FROM {v}" for v in made))


def _payloads(spark, sf):
    k = F.col("page_id")
    return fx.table(spark, sf, "pages").select(
        F.concat(F.lit("feed"), k % 7).alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")).alias("ingest_date"),
        F.concat(F.lit("BRAND"), k % 25 + 1).alias("symbol"), F.col("html").alias("payload"), k.alias("k"))


@query("a12_raw_landing", """
SELECT CASE page_id % 3 WHEN 0 THEN 'b0' WHEN 1 THEN 'b1' ELSE 'b2' END AS batch, 'feed' || (page_id % 7) AS source,
       DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS ingest_date, count(*) AS payloads, coalesce(sum(strlen(html)), 0)::BIGINT AS bytes, true AS intact
FROM pages GROUP BY ALL""")
def a12(spark, sf):
    """Three batches: the first is sent twice, the last breaks off and is sent again."""
    root, p = _fresh(spark), _payloads(spark, sf)
    part = lambda i: p.filter(F.col("k") % 3 == i)
    for batch, i in (("b0", 0), ("b1", 1), ("b0", 1)):
        cm.land(part(i), root, batch)
    _must_fail(cm.land, part(2).withColumn("payload", _broken("payload", F.col("k") % 10 == 5)), root, "b2")
    if "b2" in tb.committed(spark, f"{root}/manifest"):
        raise AssertionError("a batch that broke off must not count")
    cm.land(part(2), root, "b2")
    return cm.verify(spark, root)


@query("i20_model_save_load", fx.sql(fx.BARS, "SELECT DISTINCT symbol, true AS scored, 0::BIGINT AS differing FROM bars"))
def i20(spark, sf):
    """Test rows scored by a fitted model and by the same model read back from its folder."""
    rows, path = cut_lineage(panel(spark, sf)), f"{_fresh(spark)}/model"
    model = md.fit("logistic", rows.filter("role = 'train'"), COLUMNS)
    md.save(model, path)
    test, key = rows.filter("role = 'test'"), ["symbol", "trade_date"]
    both = md.score(model, test).select(*key, "p").join(md.score(md.load(path), test).select(*key, F.col("p").alias("q")), key)
    return both.groupBy("symbol").agg((F.count(F.lit(1)) > 0).alias("scored"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("differing"))


REFUSED = PRED + """,
sent AS (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE p * 1.25e0 - 0.125e0 END AS p, CASE WHEN doc_id % 13 = 0 THEN 1.5e0 ELSE confidence END AS c FROM pred)"""


@query("k2_refused_predictions", fx.sql(REFUSED, """
SELECT CASE WHEN p IS NULL THEN 'probability missing' WHEN p NOT BETWEEN 0 AND 1 THEN 'probability out of range' WHEN c NOT BETWEEN 0 AND 1 THEN 'confidence out of range'
       ELSE 'kept' END AS outcome, count(*) AS n FROM sent GROUP BY ALL"""))
def k2r(spark, sf):
    """Kept rows in the registry, refused ones by reason in the side table, where a repeated append adds none."""
    root = _fresh(spark)
    d = F.substring_index("prediction_id", "-", -1).cast("bigint")
    sent = predictions(spark, sf).withColumns({
        "up_probability": F.when(d % 11 != 0, F.col("up_probability") * 1.25 - 0.125),
        "confidence": F.when(d % 13 == 0, 1.5).otherwise(F.col("confidence"))})
    for _ in range(2):
        tb.keep_rejects(rg.refused(sent), root, "predictions", "prediction_id")
    kept = rg.append_predictions(sent.limit(0), sent).agg(F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return kept.unionByName(tb.reject_counts(spark, root).select(F.col("reason").alias("outcome"), F.col("rejected").alias("n")))


@query("m6_resumed_daily_run", fx.sql(VALID + "," + tx.SIGNAL_CTES.strip().replace("QUALIFY NOT bool_or(known) OVER (PARTITION BY raw_id, primary_symbol, event_category)\n    AND", "QUALIFY") + """,
sizes AS (SELECT (SELECT count(*) FROM valid) AS bars, (SELECT count(*) FROM fresh) AS news, (SELECT count(DISTINCT symbol) FROM valid) AS symbols)""", """
SELECT attempt, step, status, CASE WHEN status IN ('FAILED', 'SKIPPED') THEN 0 WHEN step IN ('bars', 'features') THEN bars WHEN step = 'news' THEN news WHEN step = 'predictions' THEN symbols WHEN step = 'audit' THEN 0 END AS n
FROM sizes, (VALUES (1, 'bars', 'SUCCESS'), (1, 'news', 'SUCCESS'), (1, 'macro', 'FAILED'), (1, 'features', 'SKIPPED'), (1, 'predictions', 'SKIPPED'), (1, 'audit', 'SKIPPED'),
  (2, 'bars', 'REUSED'), (2, 'news', 'REUSED'), (2, 'macro', 'SUCCESS'), (2, 'features', 'SUCCESS'), (2, 'predictions', 'SUCCESS'), (2, 'audit', 'SUCCESS')) v(attempt, step, status)"""))
def m6(spark, sf):
    """The daily run whose macro feed fails, and the same run gone on with; macro sessions are not compared."""
    layout, macro, run_id = tb.Layout(_fresh(spark)), fx.macro_raw(spark, sf), uuid.uuid4().hex
    report = []
    for attempt, feed in ((1, macro.withColumn("indicator", _broken("indicator", F.lit(True)))), (2, macro)):
        steps = dl.daily_steps(
            spark, layout, fx.raw_feed(spark, sf), fx.FEED_SEQ, tx.articles(spark, sf), tx.notices(spark, sf), feed,
            ["return_1d", "dist_sma_20", "rsi_14"], "logistic")
        done = dl.run_daily(spark, layout, steps, run_id=run_id)
        report += [(attempt, step, status, rows if step != "macro" or status == "FAILED" else None) for step, status, rows, _ in done]
    return spark.createDataFrame(report, "attempt int, step string, status string, n bigint")
