"""Streams over several batches, in either order, give the tables of one batch."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.streaming import streams as st

SCHEMA = "event_id long, symbol string, ts timestamp, price double"


def ticks(n=300):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    return [(i, rng.choice("AB"), start + dt.timedelta(minutes=rng.randint(0, 5000)), rng.randint(1, 99) / 4) for i in range(n)]


def feed(spark, inbox, rows, parts, backwards, schema=SCHEMA):
    """One file per part, with times of arrival in the wanted order."""
    chunks = [rows[k::parts] for k in range(parts)]
    for k, chunk in enumerate(reversed(chunks) if backwards else chunks):
        part = f"{inbox}/tmp{k}"
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.rename(f"{part}/{name}", f"{inbox}/{k}.parquet")
        os.utime(f"{inbox}/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def run(spark, tmp_path, name, rows, parts, backwards, handle_of, read, schema=SCHEMA):
    home = tmp_path / f"{name}{parts}{backwards}"
    (home / "in").mkdir(parents=True)
    feed(spark, str(home / "in"), rows, parts, backwards, schema)
    for attempt in range(2):  # a replay with a new checkpoint changes nothing
        stream = st.read_files(spark, str(home / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
        st.run_batches(stream, str(home / f"c{attempt}"), handle_of(str(home / "t")))
    return sorted(map(tuple, read(str(home / "t")).collect()))


CASES = {
    "bars": (
        lambda folder: st.keep_partials(folder, st.tick_partials("symbol", "ts", F.col("price"), F.lit(1), ["event_id"])),
        st.merge_ticks,
    ),
    "windows": (
        lambda folder: st.keep_partials(folder, st.news_windows(["symbol"], "ts", 72, F.col("price"))),
        lambda p: st.merge_windows(p, ["symbol"]),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_batches_do_not_change_the_result(spark, tmp_path, name):
    make, merge = CASES[name]
    rows = ticks()
    read = lambda folder: merge(st.read_partials(spark, folder))
    whole = run(spark, tmp_path, name, rows, 1, False, make, read)
    assert run(spark, tmp_path, name, rows, 2, False, make, read) == whole
    assert run(spark, tmp_path, name, rows, 2, True, make, read) == whole
    if name == "bars":
        days = {}
        for i, s, ts, p in rows:
            days.setdefault((s, ts.date()), []).append((ts, i, p))
        want = [(*k, min(v)[2], max(x[2] for x in v), min(x[2] for x in v), max(v)[2], len(v)) for k, v in days.items()]
        assert whole == sorted(want)


def test_monthly_means_divide_the_sums_of_all_batches(spark):
    rows = [("1-URGENT", dt.date(2024, 1, d), float(d)) for d in range(1, 29)]
    orders = spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double")
    parts = fx.monthly_sums(orders.where("o_totalprice < 5")).union(fx.monthly_sums(orders.where("o_totalprice >= 5")))
    assert fx.monthly_means(parts).collect() == fx.monthly_macro(orders).collect()


def test_keys_are_first_seen_once_over_runs_and_batches(spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "symbol string, price bigint, note string"
    empty = spark.createDataFrame([], schema)
    days = [
        [("AAA", 1, "a"), ("AAA", 1, "b"), ("BBB", 2, "a"), (None, 1, "a")],
        [("AAA", 1, "c"), ("AAA", 2, "a"), (None, 1, "b")],
        [("AAA", None, "a"), ("AAA", 2, "b"), ("AAA", None, "b")],
    ]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen = set()
    for rows in [*days, []]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        st.keep_first_seen(st.read_files(spark, inbox, empty.schema, files_per_batch=1), ["symbol", "price"], out, ckpt)
        seen |= {r[:2] for r in rows}
        got = [(r.symbol, r.price) for r in spark.read.schema(schema).parquet(out).collect()]
        assert len(got) == len(seen) and set(got) == seen
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
