"""The registered queries against their SQL checks on the smallest tables, where present."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["b1_quarantine_counts", "b6_back_adjusted_close", "c4_ema", "e10_news_features", "f3_lexicon_sentiment", "g5_asof_releases", "j7_performance_metrics", "k6_audit_summary"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([row[cols.index(c)] for c in sorted(cols)]) for row in cur.fetchall())
    got = sorted(repr([row[c] for c in sorted(cols)]) for row in df.collect())
    assert got == want
