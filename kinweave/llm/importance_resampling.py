"""Importance resampling towards a target distribution, over hashed n-grams in a position table.

Every word of every text becomes a row of the position table (posexplode); window lead() within the
document puts the following words beside it, so that each row holds one feature of each order;
features are hashed to buckets. Grouped counts of the buckets in both tables give each bucket's
gain, joined back to the rows and averaged by document; Gumbel noise that is a function of the
document's id turns the weights into scores, and the highest scores are drawn.

Long texts are cut into pieces of PIECE words, each followed by the words that its last features
need, so that no window and no task holds a very long document: pieces are dealt out once, before
the words are exploded, and the windows need no further shuffle. Counts combine on the map side. The
gains are one row a bucket, a bound that doesn't grow with the tables, and are broadcast. Scores
are ranked by a range sort in which each task numbers its own rows.

Defined cases: a null text has no words; a text without words has weight 0 and is never drawn where
a least number of words is asked for; a null id takes part with the noise of an empty id; rows of
one id are drawn row by row, those of one score by id (null first), then in any order; texts of any length
are counted whole; an empty target gives the gains of t = T = 0, an empty table an empty table; other
columns are ignored by scored() and kept by drawn().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
ORDERS = 2
#: Documents drawn, in hundredths of those with LEAST words.
SHARE = 25
LEAST = 20
SEED = 7
#: Words of a piece of a long text.
PIECE = 4096
#: What lies between words once A-Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(word: Column) -> Column:
    """A-Z to a-z, nothing else; words of one byte a character can take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def features(docs: DataFrame, key: str | None, text: str, buckets: int = BUCKETS, orders: int = ORDERS, piece: int = PIECE, row: str | None = None) -> DataFrame:
    """The position table: row (a number for each row of docs, from the column of that name if given), key (in one row of each, else null), b1, b2... (the bucket of the feature of each order that starts here, or null)."""
    docs = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), (F.col(key) if key else F.lit(None).cast("long")).alias("key"), F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "").alias("w"))
    # One piece at least, so that texts without words stay.
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(piece))
    pieces = docs.select("row", "key", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice("w", i + 1, piece + orders - 1)).alias("words")))).alias("p"))
    pieces = pieces.select("row", F.col("p.at").alias("at"), F.when(F.col("p.at") == 0, F.col("key")).alias("key"), "p.words").repartition("row", "at")
    words = pieces.select("row", "at", "key", F.posexplode(F.split("words", " ")).alias("pos", "word")).withColumn("word", F.when(F.col("word") != "", _lower(F.col("word"))))
    place = Window.partitionBy("row", "at").orderBy("pos")
    grams = words.select("*", *[F.lead("word", n).over(place).alias(f"w{n}") for n in range(1, orders)]).filter(F.col("pos") < piece)
    spelled = [F.concat(*([F.col("word")] + [x for n in range(1, k) for x in (F.lit(" "), F.col(f"w{n}"))])) for k in range(1, orders + 1)]
    hashed = [F.pmod(F.crc32(F.encode(x, "UTF-8")), F.lit(buckets)).cast("int").alias(f"b{k}") for k, x in enumerate(spelled, 1)]
    return grams.select("row", F.when(F.col("pos") == 0, F.col("key")).alias("key"), *hashed)


def _orders(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c[0] == "b"]


def counts(table: DataFrame) -> DataFrame:
    """bucket, n over all features of a position table."""
    bucket = F.explode(F.array(*_orders(table))).alias("bucket")
    return table.select(bucket).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for each bucket, from two position tables: floor(1000 * ln of the smoothed share in target over that in source)."""
    spark = source.sparkSession
    of = lambda table, name: counts(table).withColumnRenamed("n", name)
    n = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(of(source, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    n = common.saved(n)
    all_s, all_t = n.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    return n.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def _noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise), a function of key and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS, share: int = SHARE, least: int = LEAST, seed: int = SEED, row: str | None = None) -> DataFrame:
    """row, key, n_words, n_features, weight, score, rank (null: not drawn) for every row of docs; target holds texts in the same column."""
    table = common.saved(features(docs, key, text, buckets, orders, row=row))
    gain = common.saved(gains(table, common.saved(features(target, None, text, buckets, orders)), buckets))
    names = _orders(table)
    df = table
    for b in names:
        df = df.join(F.broadcast(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))), b, "left")
    plus = lambda xs: reduce(lambda x, y: x + y, xs)
    each = df.select("row", "key", F.col("b1").isNotNull().cast("long").alias("word"), plus([F.col(b).isNotNull().cast("long") for b in names]).alias("features"), plus([F.coalesce(f"g_{b}", F.lit(0)) for b in names]).alias("gains"))
    sums = each.groupBy("row").agg(F.max("key").alias("key"), F.sum("word").alias("n_words"), F.sum("features").alias("n_features"), F.sum("gains").alias("gains"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (gains - pmod(gains, n_features)) div n_features END").cast("long")
    sums = sums.select("row", "key", "n_words", "n_features", mean.alias("weight"))
    sums = sums.withColumn("score", F.col("weight") + _noise(F.col("key"), seed)).withColumn("out", F.col("n_words") < least)
    ranked, _ = common.numbered(sums, "place", F.col("out"), F.col("score").desc(), F.col("key"))
    able = ranked.filter(~F.col("out")).count()
    rank = F.when(F.col("place") < share * able // 100, F.col("place") + 1)
    return ranked.select("row", "key", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs that are drawn, with docs' own columns."""
    row = common.fresh(docs, "row")
    kept = common.saved(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = scored(kept, target, key, text, row=row, **settings).filter("rank is not null").select(F.col("row").alias(row))
    return kept.join(rows, row, "left_semi").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents towards the texts of benchmark."""
    df = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return df.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


#: Distinct features are hashed bit by bit, as SQL has no CRC-32.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
n AS (SELECT kind, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
bits AS (SELECT f, list_transform(range(0, 4 * len(x)), lambda i: (('0x' || x[2 * (i // 8) + 1 : 2 * (i // 8) + 2])::BIGINT >> (i % 8)) & 1) AS bits FROM x),
h AS (SELECT f, xor(list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bits),
k AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM n JOIN h USING (f) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM k),
g AS (SELECT bucket, floor(1000 * ln((k.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((k.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS gain FROM k, z),
m AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN h USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
d AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || sha256('7:' || doc_id)[1:8])::BIGINT AS h
  FROM w LEFT JOIN m USING (doc_id) WHERE kind = 'd'),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS able_n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * able_n // 100 THEN place END AS rank FROM r
"""
