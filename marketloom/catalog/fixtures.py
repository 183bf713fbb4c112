"""Market-shaped inputs derived by Spark from the driver's tables, and the same in SQL.

Prices sit on a 1/64 tick and scores on a 1/64 grid, so sums are exact in binary
floating point and do not depend on the order in which an engine adds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MACRO_NAMES = {
    "1-URGENT": "USD_PKR",
    "2-HIGH": "SBP_POLICY_RATE",
    "3-MEDIUM": "CPI_YOY",
    "4-NOT SPECIFIED": "BRENT_CRUDE",
    "5-LOW": "KSE_100",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Trades: lineitem priced per unit, symbol = brand of the part."""
    item = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.to_date("l_shipdate").alias("trade_date"),
        (F.floor(F.col("l_extendedprice") * 64.0 / F.col("l_quantity")) / 64.0).alias("price"),
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.upper(F.regexp_replace("p_brand", "#", "")).alias("symbol"),
    )
    return item.join(part, "l_partkey")


SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def daily_bars(trades: DataFrame, price: str, volume: str, seq: tuple[str, ...]) -> DataFrame:
    """Trades to one bar per (symbol, day); partial aggregation runs before the shuffle.

    A feed with a single numeric sequence column is aggregated by hash; several columns
    need a struct, which Spark aggregates by sorting.
    """
    order = F.struct(*seq) if len(seq) > 1 else F.col(seq[0])
    return trades.groupBy("symbol", "trade_date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("bigint").alias("volume"),
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return daily_bars(ticks(spark, sf), "price", "l_quantity", SEQ)


BARS = """
ticks AS (
  SELECT upper(replace(p_brand, '#', '')) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         floor(l_extendedprice * 64e0 / l_quantity) / 64e0 AS price, l_quantity,
         (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, trade_date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM ticks GROUP BY symbol, trade_date)"""


def with_actions(df: DataFrame) -> DataFrame:
    """Dividend of 2 % of close on the 15th, a 2-for-1 split on every 9 March that traded."""
    return df.withColumns(
        {
            "dividend_amount": F.when(
                F.dayofmonth("trade_date") == 15, F.floor(F.col("close") * 1.28) / 64.0
            ).otherwise(0.0),
            "split_ratio": F.when(
                (F.month("trade_date") == 3) & (F.dayofmonth("trade_date") == 9), 2.0
            ).otherwise(1.0),
        }
    )


def bars_acted(spark: SparkSession, sf: str) -> DataFrame:
    return with_actions(bars(spark, sf))


ACTED = BARS + """,
acted AS (
  SELECT *, CASE WHEN day(trade_date) = 15 THEN floor(close * 1.28e0) / 64e0 ELSE 0e0 END
              AS dividend_amount,
         CASE WHEN month(trade_date) = 3 AND day(trade_date) = 9 THEN 2e0 ELSE 1e0 END
              AS split_ratio
  FROM bars)"""


def raw_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A dirty per-trade feed: every trade is a candidate bar row, some are broken, many share a key."""
    t = ticks(spark, sf)
    k, m = F.col("l_orderkey"), F.col("l_linenumber")
    bad = F.pmod(k, F.lit(11))
    return t.select(
        F.when(k % 2 == 0, F.concat(F.lit(" "), F.lower("symbol"), F.lit(" "))).otherwise(
            F.when(bad == 7, F.concat("symbol", F.lit("-X"))).otherwise(F.col("symbol"))
        ).alias("symbol"),
        "trade_date",
        F.when(bad == 1, F.lit(0.0)).otherwise(F.col("price")).alias("open"),
        F.when(bad == 2, F.col("price") * 0.5).otherwise(F.col("price") * 1.25).alias("high"),
        F.when(bad == 3, F.col("price") * 2.0).otherwise(F.col("price") * 0.75).alias("low"),
        F.col("price").alias("close"),
        F.col("price").alias("adjusted_close"),
        F.when(bad == 4, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint").alias("volume"),
        F.when(bad == 5, F.lit(-1.0)).otherwise(F.lit(0.0)).alias("dividend_amount"),
        F.when(bad == 6, F.lit(0.0)).otherwise(F.lit(1.0)).alias("split_ratio"),
        k.alias("feed_order"), m.alias("feed_line"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )


FEED_SEQ = ["feed_order", "feed_line", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

FEED = """
feed AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN ' ' || lower(b) || ' '
              WHEN l_orderkey % 11 = 7 THEN b || '-X' ELSE b END AS symbol,
         trade_date,
         CASE WHEN l_orderkey % 11 = 1 THEN 0e0 ELSE price END AS open,
         CASE WHEN l_orderkey % 11 = 2 THEN price * 0.5e0 ELSE price * 1.25e0 END AS high,
         CASE WHEN l_orderkey % 11 = 3 THEN price * 2e0 ELSE price * 0.75e0 END AS low,
         price AS close,
         CAST(CASE WHEN l_orderkey % 11 = 4 THEN -l_quantity ELSE l_quantity END AS BIGINT) AS volume,
         CASE WHEN l_orderkey % 11 = 5 THEN -1e0 ELSE 0e0 END AS dividend_amount,
         CASE WHEN l_orderkey % 11 = 6 THEN 0e0 ELSE 1e0 END AS split_ratio,
         (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
         l_orderkey * 8 + l_linenumber AS feed_row
  FROM (SELECT *, upper(replace(p_brand, '#', '')) AS b, CAST(l_shipdate AS DATE) AS trade_date,
               floor(l_extendedprice * 64e0 / l_quantity) / 64e0 AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """One row per brand: sector = type of its first part, some disabled."""
    return (
        table(spark, sf, "part")
        .groupBy(F.upper(F.regexp_replace("p_brand", "#", "")).alias("symbol"))
        .agg(
            F.min("p_name").alias("name"),
            F.min_by("p_type", "p_partkey").alias("sector"),
            (F.sum("p_size") % 4 != 0).alias("enabled"),
        )
    )


UNIVERSE = """
universe AS (
  SELECT upper(replace(p_brand, '#', '')) AS symbol, min(p_name) AS name, arg_min(p_type, p_partkey) AS sector,
         sum(p_size) % 4 <> 0 AS enabled
  FROM part GROUP BY 1)"""


def macro_raw(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_macro(table(spark, sf, "orders"))


def monthly_sums(orders: DataFrame) -> DataFrame:
    """Cents and number of orders per (indicator, month): partials that add up."""
    names = F.create_map(*[F.lit(x) for kv in MACRO_NAMES.items() for x in kv])
    month = F.last_day(F.to_date("o_orderdate"))
    return orders.groupBy(names[F.col("o_orderpriority")].alias("indicator"), month.alias("observation_date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100.0).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("n")
    )


def monthly_means(sums: DataFrame) -> DataFrame:
    return (
        sums.groupBy("indicator", "observation_date")
        .agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
        .select(
            "indicator",
            "observation_date",
            F.date_add("observation_date", 3).alias("public_release_date"),
            (F.floor(F.col("cents") / F.col("n")) / 100.0).alias("value"),
        )
    )


def monthly_macro(orders: DataFrame) -> DataFrame:
    """Monthly mean order value per priority as a slow series, public three days after month end."""
    return monthly_means(monthly_sums(orders))


MACRO = """
macro_raw AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'USD_PKR' WHEN '2-HIGH' THEN 'SBP_POLICY_RATE'
              WHEN '3-MEDIUM' THEN 'CPI_YOY' WHEN '4-NOT SPECIFIED' THEN 'BRENT_CRUDE'
              WHEN '5-LOW' THEN 'KSE_100' END AS indicator,
         last_day(CAST(o_orderdate AS DATE)) AS observation_date,
         CAST(last_day(CAST(o_orderdate AS DATE)) + INTERVAL 3 DAY AS DATE) AS public_release_date,
         floor(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) / count(*)) / 1e2 AS value
  FROM orders GROUP BY 1, 2)"""

CATEGORIES = (
    "EARNINGS", "DIVIDEND", "DISCOVERY", "OTHER",
    "REGULATORY", "BONUS_ISSUE", "PRODUCTION_CHANGE", "MACRO_INTEREST_RATE",
)


def scored_signals(spark: SparkSession, sf: str) -> DataFrame:
    """One signal per document with a score and category computed from its columns."""
    d = F.col("doc_id")
    first = F.concat(F.lit("BRAND"), F.pmod(d, F.lit(25)) + 1)
    second = F.concat(F.lit("BRAND"), F.pmod(d * 7, F.lit(25)) + 1)
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), d).alias("signal_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT) * 17, 0)").alias("published_at"),
        F.when(d % 5 != 0, first).alias("primary_symbol"),
        F.when(d % 3 == 0, F.array(first, second)).otherwise(F.array(second)).alias("matched_symbols"),
        ((F.pmod(F.col("n_chars") * 37 + d * 11, F.lit(129)) - 64) / 64.0).alias("sentiment_score"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (d % 8 + 1).cast("int")).alias("event_category"),
    )


SIGNALS = """
signals AS (
  SELECT 'doc-' || doc_id AS signal_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 17) AS published_at,
         CASE WHEN doc_id % 5 <> 0 THEN 'BRAND' || (doc_id % 25 + 1) END AS primary_symbol,
         CASE WHEN doc_id % 3 = 0 THEN ['BRAND' || (doc_id % 25 + 1), 'BRAND' || (doc_id * 7 % 25 + 1)]
              ELSE ['BRAND' || (doc_id * 7 % 25 + 1)] END AS matched_symbols,
         ((n_chars * 37 + doc_id * 11) % 129 - 64) / 64e0 AS sentiment_score,
         (['EARNINGS', 'DIVIDEND', 'DISCOVERY', 'OTHER', 'REGULATORY', 'BONUS_ISSUE',
           'PRODUCTION_CHANGE', 'MACRO_INTEREST_RATE'])[doc_id % 8 + 1] AS event_category
  FROM documents)"""


def sql(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"
