"""The daily run: fixed steps over the layered tables, with a run report."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.calendar import Calendar, trading_days
from marketloom.operators import clean as cl
from marketloom.plans import features as ft
from marketloom.plans import macro as mc
from marketloom.plans import models as md
from marketloom.plans import news as nw
from marketloom.plans import registry as rg
from marketloom.plans import signals as sg
from marketloom.functions import calendar as cal
from marketloom.schemas import PREDICTIONS, PRICES, SIGNALS
from marketloom.session import cut_lineage
from marketloom.sources import tables as tb

STEPS = ("bars", "news", "macro", "features", "predictions", "audit")


LEDGER = "run_id string, step string, rows bigint"


class Ledger:
    """Finished steps by run id. A step counts once its row is committed, so a rerun of the id goes on after it.

    Steps are idempotent (partitions and versions are replaced, known ids left out), so one
    that ended without its row is run again.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.folder, self.run_id = spark, f"{path}/run={run_id}", run_id

    def finished(self) -> dict[str, int]:
        steps = tb.committed(self.spark, self.folder)
        if not steps:
            return {}
        rows = self.spark.read.schema(LEDGER).json([f"{self.folder}/{s}" for s in steps]).collect()  # one row a step
        return {r.step: r.rows for r in rows}

    def finish(self, step: str, rows: int) -> None:
        row = self.spark.createDataFrame([(self.run_id, step, rows)], LEDGER)
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/{step}")


def run_steps(steps: dict[str, Callable[[], int]], keep_going: bool = False, ledger: Ledger | None = None) -> list[tuple]:
    """Run in order; after a failure the rest is SKIPPED unless told to go on. Steps in the ledger are REUSED."""
    report, failed = [], False
    known = ledger.finished() if ledger else {}
    for name, step in steps.items():
        if name in known:
            report.append((name, "REUSED", known[name], None))
            continue
        if failed and not keep_going:
            report.append((name, "SKIPPED", 0, "an earlier step failed"))
            continue
        try:
            rows = int(step())
            if ledger:
                ledger.finish(name, rows)
            report.append((name, "SUCCESS", rows, None))
        except Exception as exc:  # noqa: BLE001 - recorded in the run report
            failed = True
            report.append((name, "FAILED", 0, str(exc)))
    return report


def daily_steps(
    spark: SparkSession, layout: tb.Layout, feed: DataFrame, order: list[str], articles: DataFrame | None,
    notices: DataFrame | None, macro: DataFrame, model_columns: list[str], kind: str = "boosted",
    params: md.Params = md.Params(),
) -> dict[str, Callable[[], int]]:
    """The six table steps over a layout; each returns the rows it added or wrote."""
    calendar = Calendar()
    prices = lambda: tb.read_or_empty(spark, layout.prices, PRICES).select(*PRICES.fieldNames())

    def bars() -> int:
        before = prices().count()
        fresh = cl.lock_flags(cl.validate_prices(feed, order)).select(*PRICES.fieldNames())
        tb.write_partitions(cl.merge_increment(prices(), fresh), layout.prices)
        return prices().count() - before

    def news() -> int:
        stored = tb.read_or_empty(spark, layout.news, SIGNALS)
        before = stored.count()
        tb.append_rows(sg.process_news(articles, notices, stored), layout.news)
        return tb.read_table(spark, layout.news).count() - before

    def macro_table() -> int:
        sessions = trading_days(calendar.covering(prices(), F.col("trade_date")))
        tb.write_version(mc.macro_daily(macro, sessions), layout.macro)
        return tb.read_version(spark, layout.macro).count()

    def features() -> int:
        signals = tb.read_table(spark, layout.news).withColumn(
            "published_utc", cal.parse_published(F.col("published_at"))
        )
        timeless = signals.filter("published_utc IS NULL").drop("published_utc").withColumn("reason", F.lit("publication time unreadable"))
        tb.keep_rejects(timeless, layout.rejects, "features", "signal_id")
        signals = signals.filter("published_utc IS NOT NULL")
        dim = calendar.covering(signals, F.to_date(cal.local_clock(F.col("published_utc"))), after=60)
        aligned = cal.align_to_sessions(signals, dim, "published_utc")
        table = nw.news_features(aligned, prices().select("symbol"), nw.feature_sessions(aligned, dim), "published_utc")
        built = ft.build_features(prices())
        tb.write_partitions(ft.merge_all(built, table, tb.read_version(spark, layout.macro)), layout.features)
        return tb.read_table(spark, layout.features).count()

    def registry() -> DataFrame:
        try:
            return tb.read_version(spark, layout.predictions)
        except tb.DatasetNotFoundError:
            return spark.createDataFrame([], PREDICTIONS)

    def predictions() -> int:
        made = cut_lineage(md.forward_predictions(tb.read_table(spark, layout.features), model_columns, kind, params=params))
        tb.keep_rejects(rg.refused(made), layout.rejects, "predictions", "symbol")
        tb.write_version(rg.append_predictions(registry(), made), layout.predictions)
        return registry().count()

    def audit() -> int:
        tb.write_version(rg.reconcile(registry(), prices()), layout.predictions)
        return registry().filter("realized_outcome IS NOT NULL").count()

    return dict(zip(STEPS, (bars, news, macro_table, features, predictions, audit), strict=True))


def run_daily(spark: SparkSession, layout: tb.Layout, steps: dict[str, Callable[[], int]], keep_going: bool = False,
              run_id: str | None = None) -> list[tuple]:
    """Run the steps and append one line to the run log; with the id of an earlier run, go on where that ended."""
    started = dt.datetime.now(dt.timezone.utc)
    run_id = run_id or uuid.uuid4().hex
    report = run_steps(steps, keep_going, Ledger(spark, layout.ledger, run_id))
    tb.log_run(spark, layout.runs, [(run_id, started, dt.datetime.now(dt.timezone.utc), report)])
    return report
