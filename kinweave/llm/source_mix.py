"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; running sums over the buckets find, for each source,
the bucket in which its budget is used up; only that bucket is divided again, down to single
hashes; what is at or below the threshold is taken. Documents are never sorted, and the sums
combine on the map side, so a source with a third of all rows moves no more than any other.

Defined cases: a null text has size 0; a null source is a source of its own, placed last; rows
with the same key and text share a hash and are taken together, others of one key are told apart by
their texts; texts of any length are counted whole; sources without words get target 0; an empty
table gives an empty table; other columns are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Hash bits by level; what is left of the 60 bits is the last level, single hashes.
LEVELS = (12, 12)
BITS = 60
#: Up to so many sources the thresholds are broadcast (some 50 bytes each).
BROADCAST_SOURCES = 100_000


def _hash(key: str, text: str) -> Column:
    """A hash of key and text from 0 to 2^60 that any SQL engine can compute."""
    both = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size (words) and h."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(common.WORD)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n.alias("size"), _hash(key, text).alias("h"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> with target: weights by place, share of all sizes, none above most times its size, the excess reshared by weight.

    The resharing ends at target = min(most * size, level * weight), with one level for all; sorted
    by most * size / weight, the capped sources come first, and the first that fits its share sets
    the level. One row a source: the window is as small as the list of sources."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    df = totals.select("source", "source_size", w.cast("long").alias("weight"), (most * F.col("source_size")).alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(all_)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", (budget - capped) / rest)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_)["level"]
    least = F.least(F.col("cap").cast("double"), F.coalesce(fits * F.col("weight"), F.col("cap").cast("double")))
    return df.select("source", "source_size", least.alias("target"))


def _boundary(hist: DataFrame, quotas: DataFrame) -> DataFrame:
    """The bucket of each source in which the running size first reaches the quota: source, bucket, left (the quota not used up before it), bucket_size."""
    w = Window.partitionBy("source").orderBy("bucket")
    run = F.sum("size").over(w)
    df = hist.join(quotas, hist["source"].eqNullSafe(quotas["q_source"])).drop("q_source").withColumn("run", run)
    df = df.filter((F.col("run") >= F.col("quota")) & (F.col("run") - F.col("size") < F.col("quota")) & (F.col("size") > 0))
    return df.select("source", "bucket", (F.col("quota") - (F.col("run") - F.col("size"))).alias("left"), F.col("size").alias("bucket_size"))


def _bucket(levels: int) -> Column:
    """The bucket number of h with the bits of the first levels."""
    return F.shiftrightunsigned(F.col("h"), BITS - sum(LEVELS[:levels])) if levels <= len(LEVELS) else F.col("h")


def thresholds(sized: DataFrame, totals: DataFrame) -> DataFrame:
    """source, source_size, target, passes, last: take passes times every document and once more those with h <= last."""
    t = targets(totals)
    q = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = t.withColumn("passes", q).withColumn("quota", F.col("target") - q * F.col("source_size"))
    quotas = plan.filter("quota > 0").select(F.col("source").alias("q_source"), "quota")
    inside = sized.filter("size > 0")
    for level in range(1, len(LEVELS) + 2):
        hist = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        edge = common.saved(_boundary(hist, quotas))
        if level <= len(LEVELS):
            e = common.broadcast_if(edge.select(F.col("source").alias("q_source"), F.col("bucket").alias("q_bucket")), BROADCAST_SOURCES)
            inside = inside.join(e, F.col("source").eqNullSafe(F.col("q_source")) & (_bucket(level) == F.col("q_bucket")), "left_semi")
            quotas = edge.select(F.col("source").alias("q_source"), F.col("left").alias("quota"))
    # The documents of the last hash are taken if that comes nearer to the target than leaving them.
    last = F.when(2 * F.col("left") >= F.col("bucket_size"), F.col("bucket")).otherwise(F.col("bucket") - 1)
    edge = edge.select(F.col("source").alias("q_source"), last.alias("last"))
    return plan.join(edge, plan["source"].eqNullSafe(F.col("q_source")), "left").select("source", "source_size", "target", "passes", F.coalesce("last", F.lit(-1)).alias("last"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, taken (words, repeats counted) and repeats, for every row."""
    sized = common.saved(sizes(docs, key, text, source))
    totals = common.saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = common.saved(thresholds(sized, totals))
    plan = common.broadcast_if(plan.withColumnRenamed("source", "q_source"), BROADCAST_SOURCES)
    repeats = F.col("passes") + (F.col("h") <= F.col("last")).cast("long")
    df = sized.join(plan, F.col("source").eqNullSafe(F.col("q_source")))
    return df.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' own columns only."""
    sized = common.saved(sizes(docs, key, text, source))
    totals = common.saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = common.saved(thresholds(sized, totals))
    names = {n: common.fresh(docs, n) for n in ("source", "passes", "last", "h")}
    plan = common.broadcast_if(plan.select(F.col("source").alias(names["source"]), F.col("passes").alias(names["passes"]), F.col("last").alias(names["last"])), BROADCAST_SOURCES)
    df = docs.join(plan, docs[source].eqNullSafe(F.col(names["source"])))
    repeats = F.col(names["passes"]) + (_hash(key, text) <= F.col(names["last"])).cast("long")
    return df.withColumn(names["h"], F.explode(F.array_repeat(F.lit(0), repeats.cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The same selection by sorting: documents up to the one that reaches the quota, that one if it brings the sum nearer.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level, cap::DOUBLE / weight AS ratio FROM s
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(f.level * weight, cap::DOUBLE)) AS target FROM l, f),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.*, q.source_size, q.target, q.passes, q.target - q.passes * q.source_size AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target,
       size * (passes + CASE WHEN quota > 0 AND (run < quota OR (run - own < quota AND 2 * (quota - (run - own)) >= own)) THEN 1 ELSE 0 END) AS taken
FROM r
"""
