"""URL filters by a temporal list join, in DataFrame expressions only.

Dated list entries become validity intervals of their rule (each entry holds until the rule's
next one), and a rule's intervals one row, its history. Every capture is matched, through the
suffixes of its host and its host with first path segment, against the rules' histories: an
equi-join on the rule, in which the history is looked up as of the fetch time, so a rule with many
entries makes no more rows. The most specific active rule decides. Captures are reduced to distinct
(host, segment, time) first, so a host with a third of all rows is evaluated once a time, and the
join back can be split where it is skewed.

Defined cases: hosts are matched in lower case, path segments as they are; entries with a null rule
or date are void; of entries of one rule and date "block" wins over "allow"; a null or unreadable
URL and a null time match nothing and are not blocked; hosts and URLs of any length are matched
whole; repeated rows are kept; empty tables are fine; other columns of the captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rules (some 100 bytes and 50 for each of their entries) up to which the list is broadcast; beyond, the join shuffles.
BROADCAST_RULES, BROADCAST_ENTRIES = 100_000, 300_000


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and last dot; "" if there is none."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(h), r"\.$", "")


def segment(url: Column) -> Column:
    """The first path segment of a URL, or ""."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def rules_of(host_: Column, segment_: Column) -> Column:
    """All rules that can match, as array<struct<rule, depth>>; depth is larger for more specific ones."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.array_join(F.slice(labels, n - k + 1, k), ".").alias("rule"), k.alias("depth")))
    path = F.filter(F.array(F.struct(F.concat(host_, F.lit("/"), segment_).alias("rule"), (n + 1).alias("depth"))), lambda _: segment_ != "")
    return F.when(host_ != "", F.concat(suffixes, path)).otherwise(F.array().cast("array<struct<rule:string,depth:int>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """rule, action, since, until (null: open) from dated entries rule, action, listed."""
    named = F.concat(F.lower(F.regexp_extract("rule", "^([^/]*)", 1)), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1))
    one = entries.filter("rule is not null and listed is not null").groupBy(named.alias("rule"), "listed").agg(F.max("action").alias("action"))
    return one.select("rule", "action", F.col("listed").alias("since"), F.lead("listed").over(Window.partitionBy("rule").orderBy("listed")).alias("until"))


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """key, host, fetched, rule (the deciding one or null), action (null without one), blocked; one row for each capture."""
    rows = captures.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), segment(F.col(url)).alias("segment"), F.col(fetched).alias("fetched"))
    valid = common.saved(intervals(entries))
    history = valid.groupBy("rule").agg(F.collect_list(F.struct("since", "until", "action")).alias("history"))
    if common.small(valid, BROADCAST_ENTRIES):
        history = common.broadcast_if(history, BROADCAST_RULES)
    asked = rows.select("host", "segment", "fetched").distinct()
    asked = asked.select("host", "segment", "fetched", F.explode(rules_of(F.col("host"), F.col("segment"))).alias("x")).select("host", "segment", "fetched", "x.*")
    holds = lambda e: (e["since"] <= F.col("fetched")) & (e["until"].isNull() | (F.col("fetched") < e["until"]))
    active = asked.join(history, "rule").withColumn("e", F.get(F.filter("history", holds), F.lit(0))).filter("e is not null")
    said = active.groupBy("host", "segment", "fetched").agg(F.max(F.struct("depth", "rule", F.col("e.action").alias("action"))).alias("top"))
    df = rows.join(said, ["host", "segment", "fetched"], "left")
    action = F.col("top.action")
    return df.select(F.col("key").alias(key), "host", F.col("fetched").alias(fetched), F.col("top.rule").alias("rule"), action.alias("action"), F.coalesce(action == "block", F.lit(False)).alias("blocked"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts, as the tables have none: each host is blocked on a day that its MD5 names and allowed again some days later, a quarter of the first path segments is blocked from a day on (written with the host in capitals), and example.org from June on."""
    h = F.conv(F.substring(F.md5("rule"), 1, 8), 16, 10).cast("long")
    hosts = pages.select(host(F.col("url")).alias("rule")).filter("rule != ''").distinct().withColumn("h", h)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    block = hosts.select("rule", F.lit("block").alias("action"), day(F.col("h") % 366).alias("listed"))
    allow = hosts.select("rule", F.lit("allow").alias("action"), day(F.col("h") % 366 + 1 + F.floor(F.col("h") / 366) % 90).alias("listed"))
    named = pages.select(host(F.col("url")).alias("host"), segment(F.col("url")).alias("segment")).filter("host != '' and segment != ''").distinct()
    paths = named.select(F.concat("host", F.lit("/"), "segment").alias("rule"), F.concat(F.upper("host"), F.lit("/"), "segment").alias("written")).withColumn("h", h).filter("h % 4 = 0")
    paths = paths.select(F.col("written").alias("rule"), F.lit("block").alias("action"), day(F.col("h") % 366).alias("listed"))
    broad = pages.sparkSession.createDataFrame([("example.org", "block", 152)], "rule string, action string, n int").select("rule", "action", day(F.col("n")).alias("listed"))
    return block.unionByName(allow).unionByName(paths).unionByName(broad)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all pages; the fetch day, which the table lacks, is a day of 2024 by page_id."""
    pages = common.table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    return evaluate(captures, sample_entries(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.$', '') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment,
         DATE '2024-01-01' + (page_id % 366)::INT AS fetched FROM pages),
h AS (SELECT host AS rule, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM p WHERE host <> '' GROUP BY host),
e AS (
  SELECT rule, 'block' AS action, DATE '2024-01-01' + (h % 366)::INT AS listed FROM h
  UNION ALL SELECT rule, 'allow', DATE '2024-01-01' + (h % 366 + 1 + (h // 366) % 90)::INT FROM h
  UNION ALL SELECT rule, 'block', DATE '2024-01-01' + (h % 366)::INT FROM (
    SELECT DISTINCT host || '/' || segment AS rule, ('0x' || substr(md5(host || '/' || segment), 1, 8))::BIGINT AS h FROM p WHERE host <> '' AND segment <> '') WHERE h % 4 = 0
  UNION ALL SELECT 'example.org', 'block', DATE '2024-01-01' + 152),
i AS (
  SELECT *, lead(listed) OVER (PARTITION BY rule ORDER BY listed) AS until FROM (SELECT rule, listed, max(action) AS action FROM e GROUP BY ALL)),
m AS (
  SELECT p.*, i.rule, i.action, length(i.rule) AS depth FROM p JOIN i
  ON (p.host = i.rule OR ends_with(p.host, '.' || i.rule) OR (p.segment <> '' AND p.host || '/' || p.segment = i.rule))
     AND i.listed <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)),
t AS (SELECT page_id, arg_max(rule, depth) AS rule, arg_max(action, depth) AS action FROM m GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched, t.rule, t.action, coalesce(t.action = 'block', false) AS blocked FROM p LEFT JOIN t USING (page_id)
"""
