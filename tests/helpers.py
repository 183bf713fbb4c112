"""Small fixtures for the tests."""

from __future__ import annotations

import datetime as dt
import random

BAR_DDL = "symbol string, trade_date date, open double, high double, low double, close double, volume bigint"


def day(i: int, start: str = "2024-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


def closes(spark, prices, symbol="AAA", **extra):
    """Bars whose open, high and low equal the close."""
    names = "".join(f", {k} double" for k in extra)
    rows = [
        (symbol, day(i), p, p, p, p, 100 + i, *[v[i] for v in extra.values()]) for i, p in enumerate(prices)
    ]
    return spark.createDataFrame(rows, BAR_DDL + names)


def walk(n=300, symbols=("AAA", "BBB"), seed=42):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        p = 100.0
        for i in range(n):
            p = max(5.0, p * (1 + rng.uniform(-0.03, 0.03)))
            o = p * (1 + rng.uniform(-0.01, 0.01))
            rows.append((s, day(i), o, max(o, p) * 1.01, min(o, p) * 0.99, p, rng.randint(1, 1000)))
    return rows


def by_date(df, column, symbol=None):
    if symbol:
        df = df.filter(df.symbol == symbol)
    return [r[column] for r in df.orderBy("trade_date").collect()]
