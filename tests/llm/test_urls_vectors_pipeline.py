"""URL lists, nearest neighbours, the pipeline and the registered SQL checks."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marketloom.llm import neighbours, url_filter

DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=round(60 * hours))


CHANGES = "list string, verdict string, kind string, key string, action string, at timestamp"


def naive_verdict(url, fetched, changes):
    """(blocked, number of entries in force, deciding key)."""
    if not url or not fetched or "://" not in url:
        return False, 0, None
    host = url.split("://")[1].split("/")[0].split("?")[0].lower()
    path = [s for s in url.split("://")[1].split("?")[0].split("/")[1:] if s]
    force = []
    for e in {c[:4] for c in changes}:
        lst, verdict, kind, key = e
        hit = {
            "host": host == key,
            "domain": host == key or host.endswith("." + key),
            "prefix": any("/".join([host, *path[:i]]) == key for i in range(1, len(path) + 1)),
        }[kind]
        log = sorted((c[5], c[4] == "add") for c in changes if c[:4] == e and c[5] <= fetched)
        log = [x for x in log if x[0] == log[-1][0]] if log else []
        if hit and log and all(a for _, a in log):
            weight = {"host": 1000, "domain": len(key.split(".")), "prefix": 1000 + key.count("/")}[kind]
            force.append((weight, verdict == "allow", lst, key))
    return (not max(force)[1], len(force), max(force)[3]) if force else (False, 0, None)


def test_urls_against_the_entries_of_their_time(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "example.com", "spam.org"]
    keys = [("host", h) for h in hosts] + [("domain", "example.com"), ("domain", "com"), ("prefix", "spam.org/x"), ("prefix", "spam.org/x/y")]
    changes = []
    for _ in range(80):
        kind, key = rng.choice(keys)
        changes.append((rng.choice(["l1", "l2"]), rng.choice(["block", "block", "allow"]), kind, key, rng.choice(["add", "add", "remove"]), at(rng.randint(0, 60) / 2)))
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y', 'x/y/z?q=1', 'z'])}", at(rng.randint(0, 70) / 2)) for i in range(300)]
    captures += [(300, None, at(3)), (301, "not a url", at(3)), (302, "http://spam.org/x", None), (303, "", at(1)), (5, *captures[5][1:]), (304, "HTTP://me@SPAM.org:80/x", at(9))]
    rows = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("since", F.lit("clash")).withColumn("key", F.lit("k"))
    for name in ("active", "d", "_url", "_at", "at", "salt", "capture", "list", "a.b"):
        rows = rows.withColumn(name, F.lit("own"))
    got = url_filter.filter_urls(rows, spark.createDataFrame(changes, CHANGES)).collect()
    assert len(got) == len(captures) and all(r.key == "k" for r in got)
    for r in got:
        url = r.url.replace("HTTP://me@SPAM.org:80", "http://spam.org") if r.url else r.url
        assert (r.blocked, r.n_active, r.decided_by) == naive_verdict(url, r.fetched_at, changes), r


def test_validity_intervals(spark):
    key = ("l", "block", "host", "h")
    changes = [(*key, "add", at(1)), (*key, "remove", at(5)), (*key, "add", at(5)), (*key, "add", at(9)), (*key, "noise", at(7)), (*key, "add", None)]
    got = url_filter.validity_intervals(spark.createDataFrame(changes, CHANGES)).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.added) for r in got] == [(at(1), at(5), True), (at(5), at(9), False), (at(9), None, True)]


def test_no_captures_and_no_list(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c", at(1))], "page_id long, url string, fetched_at timestamp")
    changes = spark.createDataFrame([("l", "block", "host", "a.b", "add", at(0))], CHANGES)
    assert [r.blocked for r in url_filter.filter_urls(rows, changes.limit(0)).collect()] == [False]
    assert [r.blocked for r in url_filter.filter_urls(rows, changes).collect()] == [True]
    assert url_filter.filter_urls(rows.limit(0), changes).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:1200] = x[500] + rng.normal(size=(700, 32)).astype(np.float32) * 0.01  # a dense group
    x[1200:1500] = x[1200]  # copies
    rows = vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    got = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", block_rows=700, block_queries=60).collect()
    exact = x[::20].astype(float) @ x.T.astype(float)
    exact[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    recall = []
    for k in range(150):
        mine = sorted(found[20 * k])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(p[2] > q[2] or (p[2] == q[2] and p[1] < q[1]) for p, q in zip(mine, mine[1:]))
        assert all(abs(exact[k, i] - s) < 1e-9 for _, i, s in mine)
        best = np.lexsort((np.arange(3000), -np.round(exact[k], 9)))[:20]
        recall.append(len(set(best.tolist()) & {m[1] for m in mine}) / 20)
    assert np.mean(recall) >= 0.9


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(spark, [(0, [1.0, 0.0], 1), (20, [0.0, 0.0], 1), (40, None, 1), (60, [nan, 1.0], 1), (80, [inf, 1.0], 1), (100, [None, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (None, [5.0, 5.0], 1), (2, [-1.0, 0.0], 1)])
    got = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]
    assert neighbours.nearest(rows.limit(0), rows, "vec_id", "embedding").count() == 0
    assert neighbours.nearest(rows, rows.limit(0), "vec_id", "embedding").count() == 0


@here
def test_pipeline_keeps_clean_documents_and_packs_them(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DIR)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0 < kept.count() <= before.count()
        assert kept.exceptAll(before).count() == 0
    pieces = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


@here
def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, DIR)
        rows = out.collect()
        assert rows, name
        if name == "near_copies":
            assert out.columns == odd_docs.columns
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids))
        assert stage(spark, no_docs, DIR).count() == 0


@here
@pytest.mark.parametrize("name", ["op1_url_filter", "op3_decontamination"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([row[cols.index(c)] for c in sorted(cols)]) for row in cur.fetchall())
    assert sorted(repr([row[c] for c in sorted(cols)]) for row in df.collect()) == want


def test_all_ten_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
