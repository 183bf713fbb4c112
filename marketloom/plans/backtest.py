"""Strategies, positions, trades, equity and metrics as table operators.

All tables are keyed by (symbol, strategy) with one row per trading day, so every
group is bounded by the number of days on record.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.indicators import sma
from marketloom.operators.windows import longest_run, per_symbol
from marketloom.schemas import col_or
from marketloom.session import spread_groups

KEYS = ["symbol", "strategy"]
SESSIONS_PER_YEAR = 250
RISK_FREE = 0.15


@dataclass(frozen=True)
class Costs:
    """One-way fractions of trade value."""

    brokerage: float = 0.0015
    regulatory: float = 0.00015
    slippage: float = 0.0010

    @property
    def one_way(self) -> float:
        return self.brokerage + self.regulatory + self.slippage


def days(spec_keys=KEYS):
    return Window.partitionBy(*spec_keys).orderBy("trade_date")


def strategy_signals(bars: DataFrame) -> DataFrame:
    """Bars stacked once per rule strategy with a 0/1 signal; undefined averages give 0."""
    c = F.col("close").cast("double")
    base = bars.withColumns(
        {
            **{f"_sma_{n}": sma(c, n) for n in (10, 20, 30, 50)},
            "_ret": F.try_divide(c, F.lag(c, 1).over(per_symbol())) - 1.0,
            "is_upper_lock": col_or(bars, "is_upper_lock", False),
            "is_lower_lock": col_or(bars, "is_lower_lock", False),
        }
    )

    def rule(name: str, test: Column) -> Column:
        return F.struct(F.lit(name).alias("strategy"), F.when(test, 1.0).otherwise(0.0).alias("signal"))

    m = {n: F.col(f"_sma_{n}") for n in (10, 20, 30, 50)}
    up = F.coalesce(F.col("_ret"), F.lit(0.0)) > 0
    rules = F.array(
        rule("sma_crossover", m[20] > m[50]),
        rule("naive_persistence", up),
        rule("sma_fast", m[10] > m[30]),
        rule("price_over_sma20", c > m[20]),
        rule("momentum", up),
        rule("buy_and_hold", F.lit(True)),
    )
    return base.withColumn("_r", F.explode(rules)).select(
        "symbol", "_r.strategy", "trade_date", "close", "is_upper_lock", "is_lower_lock", "_r.signal"
    )


def action() -> Column:
    """1 = may hold from today, 0 = may be flat from today, null = blocked by a lock."""
    go = F.col("signal") > 0.5
    return F.when(go & ~F.col("is_upper_lock"), 1).when(~go & ~F.col("is_lower_lock"), 0)


def positions(signals: DataFrame) -> DataFrame:
    """Position after each session: the latest unblocked action, flat before the first."""
    held = F.last(action(), ignorenulls=True).over(days().rowsBetween(Window.unboundedPreceding, 0))
    out = signals.withColumn("position", F.coalesce(held, F.lit(0)))
    return out.withColumn("previous_position", F.lag("position", 1, 0).over(days()))


def rejections(signals: DataFrame) -> DataFrame:
    """Orders refused by a price limit."""
    p, go = F.col("previous_position"), F.col("signal") > 0.5
    buy = (p == 0) & go & F.col("is_upper_lock")
    sell = (p == 1) & ~go & F.col("is_lower_lock")
    return positions(signals).filter(buy | sell).select(
        *KEYS, "trade_date", F.when(buy, "BUY").otherwise("SELL").alias("side"), F.col("close").alias("price"),
        F.when(buy, "UPPER_CIRCUIT_BREAKER_LOCK").otherwise("LOWER_CIRCUIT_BREAKER_LOCK").alias("reason"),
    )


def trades(signals: DataFrame, cash: float = 1_000_000.0, costs: Costs = Costs()) -> DataFrame:
    """Executed trades with whole shares and friction.

    Cash decides the next share count, so each (symbol, strategy) is folded in date
    order with ``aggregate`` over its days (one small struct per day). A buy that cannot
    afford one share leaves the position flat and is tried again on the next day.
    """
    c = costs.one_way
    trade_type = (
        "array<struct<trade_date:date,side:string,shares:bigint,price:double,gross_value:double,"
        "cost:double,net_value:double,cash_after:double,shares_after:bigint>>"
    )

    def fill(d: Column, side: str, shares: Column, cost: Column, net: Column, after: Column, held: Column) -> Column:
        return F.array(
            F.struct(
                d["trade_date"].alias("trade_date"), F.lit(side).alias("side"), shares.alias("shares"),
                d["close"].alias("price"), (shares * d["close"]).alias("gross_value"), cost.alias("cost"),
                net.alias("net_value"), after.alias("cash_after"), held.cast("bigint").alias("shares_after"),
            )
        ).cast(trade_type)

    def step(state: Column, d: Column) -> Column:
        money, held = state["cash"], state["shares"]
        wanted = F.floor(money / (d["close"] * (1.0 + c))).cast("bigint")
        spend = wanted * d["close"] + wanted * d["close"] * c
        gross = held * d["close"]
        earn = gross - gross * c
        buys = (held == 0) & (d["act"] == 1) & (wanted > 0) & (spend <= money)
        sells = (held > 0) & (d["act"] == 0)
        bought = F.struct(
            (money - spend).alias("cash"), wanted.alias("shares"),
            F.concat(state["log"], fill(d, "BUY", wanted, wanted * d["close"] * c, spend, money - spend, wanted)).alias("log"),
        )
        sold = F.struct(
            (money + earn).alias("cash"), F.lit(0).cast("bigint").alias("shares"),
            F.concat(state["log"], fill(d, "SELL", held, gross * c, earn, money + earn, F.lit(0))).alias("log"),
        )
        return F.when(buys, bought).when(sells, sold).otherwise(state)

    start = F.struct(
        F.lit(cash).alias("cash"), F.lit(0).cast("bigint").alias("shares"), F.array().cast(trade_type).alias("log")
    )
    day = F.struct("trade_date", F.col("close").cast("double").alias("close"), action().alias("act"))
    folded = (
        spread_groups(signals.filter(action().isNotNull()), *KEYS)
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(day)).alias("_days"))
        .withColumn("_log", F.aggregate("_days", start, step)["log"])
    )
    return folded.select(*KEYS, F.explode("_log").alias("t")).select(*KEYS, "t.*")


def account(signals: DataFrame, cash: float = 1_000_000.0, costs: Costs = Costs()) -> DataFrame:
    """Every signal row with its trade (if any) and the account state carried forward."""
    done = trades(signals, cash, costs).select(
        *KEYS, "trade_date", "side", "cost", "net_value", "cash_after", "shares_after"
    )
    w, run = days(), days().rowsBetween(Window.unboundedPreceding, 0)
    out = signals.join(done, [*KEYS, "trade_date"], "left").withColumns(
        {
            "cash": F.coalesce(F.last("cash_after", ignorenulls=True).over(run), F.lit(cash)),
            "shares": F.coalesce(F.last("shares_after", ignorenulls=True).over(run), F.lit(0)),
        }
    )
    out = out.withColumn("holdings_value", F.col("shares") * F.col("close")).withColumn(
        "total_equity", F.col("cash") + F.col("holdings_value")
    )
    out = out.withColumns(
        {
            "daily_return": F.coalesce(F.try_divide("total_equity", F.lag("total_equity").over(w)) - 1.0, F.lit(0.0)),
            "cum_return": F.col("total_equity") / cash - 1.0,
            "peak_equity": F.max("total_equity").over(run),
            "held_before": F.lag("shares", 1, 0).over(w) > 0,
        }
    )
    return out.withColumn("drawdown", (F.col("total_equity") - F.col("peak_equity")) / F.col("peak_equity"))


CURVE = [
    *KEYS, "trade_date", "close", "signal", "shares", "cash", "holdings_value", "total_equity",
    "daily_return", "cum_return", "peak_equity", "drawdown",
]


def equity_curve(signals: DataFrame, cash: float = 1_000_000.0, costs: Costs = Costs()) -> DataFrame:
    """Daily cash, holdings, equity, returns and drawdown."""
    return account(signals, cash, costs).select(*CURVE)


def drawdown_duration(curve: DataFrame) -> DataFrame:
    return longest_run(curve, F.col("drawdown") < 0, KEYS, "trade_date", "max_drawdown_days")


def round_trips(executed: DataFrame) -> DataFrame:
    """Sell proceeds minus the cost of the preceding buy."""
    paid = F.lag("net_value").over(days())
    return executed.withColumn("_paid", paid).filter("side = 'SELL'").select(
        *KEYS, "trade_date", (F.col("net_value") - F.col("_paid")).alias("pnl")
    )


def _trade_figures(pnl: Column) -> list[Column]:
    won = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    lost = F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)))
    return [
        F.count(pnl).alias("total_trades"),
        F.count_if(pnl > 0).alias("winning_trades"),
        F.count_if(pnl <= 0).alias("losing_trades"),
        F.coalesce(F.try_divide(F.count_if(pnl > 0), F.count(pnl)), F.lit(0.0)).alias("win_rate"),
        F.when(lost > 0, F.try_divide(won, lost)).when(won > 0, 99.0).otherwise(0.0).alias("profit_factor"),
    ]


def trade_stats(executed: DataFrame) -> DataFrame:
    return round_trips(executed).groupBy(*KEYS).agg(*_trade_figures(F.col("pnl")))


def metrics(
    signals: DataFrame, cash: float = 1_000_000.0, costs: Costs = Costs(), risk_free: float = RISK_FREE
) -> DataFrame:
    """One row per (symbol, strategy): return, risk, drawdown, trade and rejection figures.

    Everything is read off one account table, so the trade fold runs once.
    """
    run = days().rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("drawdown") < 0
    go, held = F.col("signal") > 0.5, F.col("held_before")
    book = account(signals, cash, costs).withColumns(
        {
            "_isl": F.sum(F.when(under, 0).otherwise(1)).over(run),
            "_paid": F.last(F.when(F.col("side") == "BUY", F.col("net_value")), ignorenulls=True).over(run),
            "_refused": (go & ~held & F.col("is_upper_lock")) | (~go & held & F.col("is_lower_lock")),
        }
    )
    inside = days([*KEYS, "_isl"]).rowsBetween(Window.unboundedPreceding, 0)
    book = book.withColumns(
        {
            "_under_days": F.sum(F.when(under, 1).otherwise(0)).over(inside),
            "_pnl": F.when(F.col("side") == "SELL", F.col("net_value") - F.col("_paid")),
        }
    )
    daily_rf = (1.0 + risk_free) ** (1.0 / SESSIONS_PER_YEAR) - 1.0
    root = math.sqrt(SESSIONS_PER_YEAR)
    excess = F.col("daily_return") - daily_rf
    agg = book.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.max_by("total_equity", "trade_date").alias("final_equity"),
        F.stddev_pop("daily_return").alias("_sd"),
        F.avg(excess).alias("_ex"),
        F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("_under_days").alias("max_drawdown_days"),
        *_trade_figures(F.col("_pnl")),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_friction"),
        F.count_if("_refused").alias("rejections"),
    )
    sd, ex, down = F.col("_sd"), F.col("_ex"), F.col("_down")
    grown = F.col("final_equity") / cash
    return agg.withColumns(
        {
            "total_return": grown - 1.0,
            "cagr": F.when(grown > 0, F.pow(grown, SESSIONS_PER_YEAR / F.col("sessions")) - 1.0).otherwise(0.0),
            "annualized_volatility": sd * root,
            "sharpe_ratio": F.when(sd > 1e-9, F.try_divide(ex, sd) * root).otherwise(0.0),
            "sortino_ratio": F.when(down > 1e-9, F.try_divide(ex, down) * root).otherwise(0.0),
        }
    ).drop("_sd", "_ex", "_down")


def against_benchmark(curve: DataFrame, benchmark: str = "buy_and_hold") -> DataFrame:
    """Each strategy's equity next to the all-long run of the same symbol."""
    held = curve.filter(F.col("strategy") == benchmark).select(
        "symbol", "trade_date", F.col("total_equity").alias("benchmark_equity")
    )
    return curve.join(held, ["symbol", "trade_date"]).select(
        *KEYS, "trade_date", "total_equity", "benchmark_equity",
        (F.col("total_equity") - F.col("benchmark_equity")).alias("excess_equity"),
    )


def downsample(curve: DataFrame, points: int = 200) -> DataFrame:
    """Every floor(n / points)-th row per curve, and always the last (a chart report)."""
    rn, n = F.row_number().over(days()) - 1, F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    numbered = curve.withColumns({"_rn": rn, "_n": n})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return numbered.filter((F.pmod(F.col("_rn"), step) == 0) | (F.col("_rn") == F.col("_n") - 1)).drop("_rn", "_n")
