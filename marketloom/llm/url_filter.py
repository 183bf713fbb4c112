"""URL filters by a temporal join with dated lists; DataFrame operations only.

A list is a log of changes: an entry (``list``, ``verdict``, ``kind``, ``key``) is added or
removed at an instant. Changes of one entry become validity intervals [from, to). A capture
is evaluated against the entries that held when it was fetched, by an as-of join: captures
and changes of an entry are ordered by time together, and a capture takes the state that
the last change left. The order is kept by (entry, hour), so that a host with a third of
all captures is spread; the state at the start of an hour comes from the changes and the
hours alone. Kinds of entry: ``domain`` (a host and all hosts below it), ``host`` and
``prefix`` (a host and leading path segments). The most specific entry in force decides;
between equals ``allow`` goes before ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = ["list", "verdict", "kind", "key"]
#: Tasks over which the captures of one key are spread before they meet the list.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host: without scheme, user, port and a closing dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path segments, as they are written."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys_of(url: Column, depth: int) -> Column:
    """(kind, key, weight) that may list the url; a larger weight is more specific."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("weight")),
    )
    hosts = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1_000).alias("weight")))
    deepest = F.least(F.size(path), F.lit(depth))
    prefixes = F.when(deepest > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(deepest, F.lit(1))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(path, 1, i), "/")).alias("key"), (1_000 + i).alias("weight")),
    ))
    none = F.filter(hosts, lambda _: F.lit(False))
    return F.when(host.isNotNull(), F.concat(domains, hosts, F.coalesce(prefixes, none))).otherwise(none)


def validity_intervals(changes: DataFrame) -> DataFrame:
    """Entries with ``valid_from`` and ``valid_to`` (null: open), from changes with ``action``, ``at``.

    Of changes of an entry at one instant a removal stands. A repeated addition goes on from
    its own instant; a removal of what is not there changes nothing. Changes without an
    entry, an action add or remove, or an instant say nothing.
    """
    known = changes.where(F.col("action").isin("add", "remove")).select(*ENTRY, "at", (F.col("action") == "add").alias("added")).dropna()
    states = known.groupBy(*ENTRY, "at").agg(F.min("added").alias("added"))
    until = F.lead("at").over(Window.partitionBy(*ENTRY).orderBy("at"))
    return states.select(*ENTRY, F.col("at").alias("valid_from"), until.alias("valid_to"), "added")


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """The captures with ``host``, ``blocked``, ``n_active``, ``decided_by``, ``decided_kind``, ``decided_list``, ``since``.

    ``captures`` has ``url``, ``fetched_at`` and any other columns, which come along unless
    they bear one of the new names (those are replaced). A change counts from its instant
    on. Null and unusable urls, null fetch times and captures that no entry in force lists
    are not blocked, with ``n_active`` 0. Repeated rows stay. Empty tables are fine.
    """
    new = ["host", "blocked", "n_active", "decided_by", "decided_kind", "decided_list", "since"]
    captures = captures.drop(*new)
    intervals = validity_intervals(changes)
    depth = intervals.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    distinct = captures.select("url", "fetched_at").dropna().distinct()
    # a key with a third of all captures meets its entries in several tasks, each with a copy of them
    salt = F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALTS)).cast("int").alias("salt")
    keys = distinct.select("url", "fetched_at", salt, F.inline(keys_of(F.col("url"), depth)))
    entries = intervals.select(*ENTRY).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    listed = keys.join(entries, ["kind", "key", "salt"])
    hour = lambda c: F.date_trunc("hour", c).alias("hour")
    probes = listed.select(*ENTRY, hour("fetched_at"), F.col("fetched_at").alias("at"), F.lit(2).alias("o"), F.lit(None).cast("struct<added:boolean,valid_from:timestamp>").alias("state"), "url", "weight")
    state = F.struct("added", F.col("valid_from")).alias("state")
    none = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("weight")]
    moves = intervals.select(*ENTRY, hour("valid_from"), F.col("valid_from").alias("at"), F.lit(1).alias("o"), state, *none)
    # the state at the start of each hour that has captures: changes before it, one row an hour
    hours = probes.select(*ENTRY, "hour").distinct().select(*ENTRY, "hour", F.col("hour").alias("at"), F.lit(0).alias("o"), F.lit(None).cast("struct<added:boolean,valid_from:timestamp>").alias("state"), *none)
    before = hours.unionByName(moves).withColumn("state", F.last("state", True).over(Window.partitionBy(*ENTRY).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carried = before.where("o = 0 and state is not null")
    asof = Window.partitionBy(*ENTRY, "hour").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = probes.unionByName(moves).unionByName(carried).withColumn("state", F.last("state", True).over(asof)).where("o = 2 and state.added")
    rank = F.struct("weight", (F.col("verdict") == "allow").alias("allow"), "list", "key", "kind", F.col("state.valid_from").alias("since"))
    verdicts = active.groupBy("url", F.col("at").alias("fetched_at")).agg(F.max(rank).alias("d"), F.count("*").alias("active"))
    # the capture's own columns stay inside one struct, so that none of their names can meet another
    packed = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture"), "url", "fetched_at")
    joined = packed.join(verdicts, ["url", "fetched_at"], "left")
    return joined.select(
        *[F.col("capture").getField(c).alias(c) for c in captures.columns],
        host_of(F.col("url")).alias("host"),
        F.coalesce(~F.col("d.allow"), F.lit(False)).alias("blocked"),
        F.coalesce("active", F.lit(0)).cast("long").alias("n_active"),
        F.col("d.key").alias("decided_by"),
        F.col("d.kind").alias("decided_kind"),
        F.col("d.list").alias("decided_list"),
        F.col("d.since").alias("since"),
    )


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time in 2024 that follows from the page's number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.timestamp_seconds(1704067200 + (F.col("page_id") * 7919 % 8784) * 3600 + F.col("page_id") % 3600).alias("fetched_at"))


def page_changes(captures: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts; all of it follows from the host's first page.

    By the remainder of that page's number by four, the list names the host, the host's
    domain without its first label, or the host's first path segment; every seventh host is
    also allowed as a whole for a time.
    """
    hosts = captures.select("page_id", host_of(F.col("url")).alias("host"), F.element_at(F.concat(path_of(F.col("url")), F.array(F.lit("none"))), 1).alias("first")).where("host is not null")
    hosts = hosts.groupBy("host").agg(F.min("page_id").alias("p"), F.min_by("first", "page_id").alias("first"))
    day = lambda c: F.timestamp_seconds(1704067200 + c * 86400)
    kind = F.when(F.col("p") % 4 == 1, "domain").when(F.col("p") % 4 == 2, "prefix").otherwise("host")
    key = F.when(kind == "domain", F.regexp_replace("host", r"^[^.]*\.", "")).when(kind == "prefix", F.concat_ws("/", "host", "first")).otherwise(F.col("host"))
    start = F.col("p") * 37 % 300
    stop = start + F.col("p") * 11 % 60 + 1
    blocked = hosts.where("p % 4 <> 3").select(
        F.lit("listed").alias("list"), F.lit("block").alias("verdict"), kind.alias("kind"), key.alias("key"),
        F.explode(F.filter(F.array(
            F.struct(F.lit("add").alias("action"), day(start).alias("at")),
            F.when(F.col("p") % 5 != 0, F.struct(F.lit("remove").alias("action"), day(stop).alias("at"))),
            F.when(F.col("p") % 3 == 0, F.struct(F.lit("add").alias("action"), day(start + 90).alias("at"))),
        ), lambda c: c.isNotNull())).alias("c"),
    )
    allowed = hosts.where("p % 7 = 0").select(
        F.lit("trusted").alias("list"), F.lit("allow").alias("verdict"), F.lit("host").alias("kind"), F.col("host").alias("key"),
        F.explode(F.array(F.struct(F.lit("add").alias("action"), day(start + 10).alias("at")), F.struct(F.lit("remove").alias("action"), day(stop + 10).alias("at")))).alias("c"),
    )
    return blocked.union(allowed).select(*ENTRY, "c.action", "c.at")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    return filter_urls(captures, page_changes(captures))


QUERIES = {"op1_url_filter": op1_url_filter}
CHECKS = {
    "op1_url_filter": r"""
WITH captures AS (
  SELECT row_number() OVER () AS r, page_id, url,
         TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 8784 * 3600 + page_id % 3600) AS fetched_at,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host,
         [s FOR s IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') IF s <> ''] AS path
  FROM pages
), hosts AS (
  SELECT host, min(page_id) AS p, arg_min(coalesce(path[1], 'none'), page_id) AS first FROM captures WHERE host IS NOT NULL GROUP BY host
), named AS (
  SELECT p, CASE p % 4 WHEN 1 THEN 'domain' WHEN 2 THEN 'prefix' ELSE 'host' END AS kind,
         CASE p % 4 WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '') WHEN 2 THEN host || '/' || first ELSE host END AS key,
         host, p * 37 % 300 AS d1, p * 37 % 300 + p * 11 % 60 + 1 AS d2
  FROM hosts
), changes AS (
  SELECT 'listed' AS list, 'block' AS verdict, kind, key, true AS added, d1 AS d FROM named WHERE p % 4 <> 3
  UNION ALL SELECT 'listed', 'block', kind, key, false, d2 FROM named WHERE p % 4 <> 3 AND p % 5 <> 0
  UNION ALL SELECT 'listed', 'block', kind, key, true, d1 + 90 FROM named WHERE p % 4 <> 3 AND p % 3 = 0
  UNION ALL SELECT 'trusted', 'allow', 'host', host, true, d1 + 10 FROM named WHERE p % 7 = 0
  UNION ALL SELECT 'trusted', 'allow', 'host', host, false, d2 + 10 FROM named WHERE p % 7 = 0
), states AS (
  SELECT list, verdict, kind, key, TIMESTAMP '2024-01-01' + to_days(d::INTEGER) AS since, min(added) AS added FROM changes GROUP BY ALL
), intervals AS (
  SELECT *, lead(since) OVER (PARTITION BY list, verdict, kind, key ORDER BY since) AS until FROM states
), labels AS (
  SELECT r, host, path, string_split(host, '.') AS l FROM captures WHERE host IS NOT NULL
), keys AS (
  SELECT r, 'host' AS kind, host AS key, 1000 AS weight FROM labels
  UNION ALL SELECT r, 'domain', array_to_string(l[i:], '.'), len(l) - i + 1 FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels)
  UNION ALL SELECT r, 'prefix', host || '/' || array_to_string(path[1:i], '/'), 1000 + i FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM labels)
), active AS (
  SELECT r, n.*, k.weight, row_number() OVER (PARTITION BY r ORDER BY weight DESC, verdict, list DESC, n.key DESC, n.kind DESC) AS place
  FROM keys k JOIN captures c USING (r) JOIN intervals n ON n.kind = k.kind AND n.key = k.key
   AND c.fetched_at >= n.since AND (n.until IS NULL OR c.fetched_at < n.until)
  WHERE n.added
), decided AS (
  SELECT r, count(*) AS n_active, max(verdict) FILTER (place = 1) AS verdict, max(key) FILTER (place = 1) AS key,
         max(kind) FILTER (place = 1) AS kind, max(list) FILTER (place = 1) AS list, max(since) FILTER (place = 1) AS since
  FROM active GROUP BY r
)
SELECT page_id, url, fetched_at, host, coalesce(verdict = 'block', false) AS blocked, coalesce(n_active, 0) AS n_active,
       key AS decided_by, kind AS decided_kind, list AS decided_list, since
FROM captures LEFT JOIN decided USING (r)
""",
}
