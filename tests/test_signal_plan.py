"""The plan of the signal job: texts are classified once, not again in an inferred filter."""

from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.plans import signals as sg


def articles(spark, many):
    rows = [(f"a{i}", "s", "2024-01-01T08:30:00+05:00", "OGDCL reports results", "profit growth" if i % 2 else "loss") for i in range(many)]
    return spark.createDataFrame(rows, "article_id string, source string, published_at string, headline string, summary string")


def test_stored_ids_are_not_classified_in_a_filter(spark):
    known = sg.article_signals(articles(spark, 4)).select("signal_id")
    out = sg.process_news(articles(spark, 10), None, known)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line.split("[")[0] and "sha2" in line]
    assert plan.count("isnotnull(sha2(") == 0
    assert sorted(r.raw_id for r in out.collect()) == [f"a{i}" for i in range(4, 10)]


def test_hash_of_nulls_is_not_null(spark):
    row = spark.range(1).select(tx.content_hash(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("h")).first()
    assert row.h == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
