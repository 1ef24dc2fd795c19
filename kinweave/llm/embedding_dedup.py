"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank.

Rotations are learned on a bounded sample (SAMPLE vectors of each length) from what the vectors
don't have in common: within random directions each rotation is turned until the signs of the
centred sample lose as little as they can, which balances its bits; every vector is encoded and indexed. The
cuts themselves go through the origin: a bit of two vectors at cosine 0.93 then differs with a
probability of about an eighth (angle / pi) however the vectors cluster, while cuts through the middle of
the data would split the densest group at random; and as no rotation is turned towards the common
direction, pairs that share nothing else differ in their due share of bits. Codes are cut into substrings; two vectors of a label meet when a
substring is equal, or differs in one bit that is among the FLIPS least certain bits of either.
That is an equi-join of the substrings, in which each pair comes out once, in the first table in
which it meets. Pairs whose whole codes differ in more bits than a pair at the threshold would (by
SPREAD standard deviations) go in the join; the rest is reranked by the cosine of the original
vectors in double precision.

Equal vectors of a label form one class first, so copies are counted, never paired. All links
between different vectors within a dense group are made, since n_links counts them: their number,
not the index, is what a dense group costs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null label, link with nothing and stay; vectors are compared with those of their own
length, each length with codes of its own; a null id takes part but names no component unless all
ids of it are null, and such rows aren't kept; of ties the least id names the component; repeated
rows count as copies; vectors of any length are used whole; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

THRESHOLD = 0.93
#: Vectors of a length that the rotations are fitted on, at most.
SAMPLE = 20_000
CODES = 4
#: Bits of a code (one long) and its substrings.
BITS = 60
SUBSTRINGS = 3
FLIPS = 4
ITERATIONS = 40
#: A pair at the threshold differs in more bits once in 30,000 times.
SPREAD = 4
SEED = 7


def fit(sample: np.ndarray, codes: int = CODES, bits: int = BITS) -> list[np.ndarray]:
    """The projection (length x bits) of each code: random directions turned by iterative quantisation of the centred sample. Vectors shorter than bits get several rotations side by side."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x, rng, out = x - x.mean(axis=0), np.random.default_rng(SEED), []
    width = min(bits, x.shape[1])
    for _ in range(codes):
        parts = []
        while sum(p.shape[1] for p in parts) < bits:
            axes, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
            axes = axes[:, :width]
            v, r = x @ axes, np.eye(width)
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
                r = left @ right
            parts.append(axes @ r)
        out.append(np.concatenate(parts, axis=1)[:, :bits])
    return out


def most_bits(threshold: float, bits: int = CODES * BITS) -> int:
    """The differing bits of a pair at the threshold, and SPREAD standard deviations more."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def _usable(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as one long each."""
    return np.packbits(np.pad(bits, ((0, 0), (0, 64 - bits.shape[1]))), axis=1, bitorder="little").view(np.int64)[:, 0]


def _codes(vectors: DataFrame, model: list[np.ndarray]) -> DataFrame:
    """vectors with codes (one long each: the signs) and unsure (one long each: the FLIPS least certain bits of each substring)."""
    size = BITS // SUBSTRINGS

    @F.pandas_udf("codes array<long>, unsure array<long>")
    def encode(column: pd.Series) -> pd.DataFrame:
        if not len(column):
            return pd.DataFrame({"codes": pd.Series([], dtype=object), "unsure": pd.Series([], dtype=object)})
        x = np.stack(column.to_list()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes, unsure = np.zeros((2, len(x), len(model)), np.int64)
        for k, turned in enumerate(model):
            y = x @ turned
            codes[:, k] = _packed((y >= 0).astype(np.uint8))
            margin, low = np.abs(y).reshape(len(x), SUBSTRINGS, size), np.zeros((len(x), SUBSTRINGS, size), np.uint8)
            np.put_along_axis(low, np.argsort(margin, axis=2, kind="stable")[:, :, :FLIPS], 1, axis=2)
            unsure[:, k] = _packed(low.reshape(len(x), BITS))
        return pd.DataFrame({"codes": list(codes), "unsure": list(unsure)})

    return vectors.withColumn("e", encode("v")).select("*", "e.codes", "e.unsure").drop("e")


def candidates(classes: DataFrame, model: list[np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """a, b (class numbers), na, nb (their sizes): the pairs of different vectors of a label that meet in the index, each once."""
    size = BITS // SUBSTRINGS
    spans = [(r, size * k) for r in range(len(model)) for k in range(SUBSTRINGS)]
    coded = common.saved(_codes(classes, model).select("c", "n", "label", "codes", "unsure"))
    mask = F.lit((1 << size) - 1).cast("long")
    cut = lambda x, r, lo: F.shiftrightunsigned(x[r], lo).bitwiseAND(mask)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), cut(F.col("codes"), *s).alias("s"), cut(F.col("unsure"), *s).alias("u")) for t, s in enumerate(spans)])
    index = coded.select("label", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("cb"), F.col("unsure").alias("ub"), F.explode(keys).alias("k")).select("label", "b", "nb", "cb", "ub", "k.t", "k.s")
    probes = coded.select("label", F.col("c").alias("a"), F.col("n").alias("na"), F.col("codes").alias("ca"), F.col("unsure").alias("ua"), F.explode(keys).alias("k"))
    bits = F.concat(F.array(F.lit(0).cast("long")), F.filter(F.transform(F.array(*[F.lit(1 << k).cast("long") for k in range(size)]), lambda x: x.bitwiseAND(F.col("k.u"))), lambda x: x != 0))
    probes = probes.select("label", "a", "na", "ca", "ua", F.col("k.t").alias("t"), F.col("k.s").alias("s0"), F.explode(bits).alias("flip"))
    probes = probes.select("label", "a", "na", "ca", "ua", "t", "flip", F.col("s0").bitwiseXOR(F.col("flip")).alias("s"))
    apart = lambda r, lo: cut(F.col("ca"), r, lo).bitwiseXOR(cut(F.col("cb"), r, lo))
    either = lambda r, lo: cut(F.col("ua"), r, lo).bitwiseOR(cut(F.col("ub"), r, lo))
    first = F.lit(len(spans))
    for t, s in reversed(list(enumerate(spans))):
        first = F.when((apart(*s) == 0) | ((F.bit_count(apart(*s)) == 1) & (apart(*s).bitwiseAND(either(*s)) != 0)), t).otherwise(first)
    # A pair that both sides find is taken from the smaller number's probe.
    theirs = reduce(lambda rest, x: F.when(F.col("t") == x[0], cut(F.col("ub"), *x[1])).otherwise(rest), enumerate(spans), F.lit(0).cast("long"))
    once = (F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("flip") != 0) & (F.col("flip").bitwiseAND(theirs) == 0))
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("ca")[r].bitwiseXOR(F.col("cb")[r])) for r in range(len(model))])
    # Exploded rows look small to the planner: without the hint it would broadcast the index, which grows with the input.
    pairs = probes.join(index.hint("merge"), ["label", "t", "s"])
    return pairs.filter((differ <= most_bits(threshold, BITS * len(model))) & once & (F.col("t") == first)).select("a", "na", "b", "nb")


def links(classes: DataFrame, model: list[np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The candidates whose vectors reach the threshold."""
    of = lambda k: classes.select(F.col("c").alias(k), F.col("v").alias(f"v{k}"), F.col("norm").alias(f"norm{k}"))
    pairs = candidates(classes, model, threshold).join(of("a"), "a").join(of("b"), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.filter(dot / (F.col("norma") * F.col("normb")) >= threshold).select("a", "na", "b", "nb")


def different(rows: DataFrame) -> DataFrame:
    """label, v, least (key), n, norm, dim, c (a number) of the different vectors of each label in rows (key, v, label)."""
    classes = rows.groupBy("label", "v").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return classes.select("label", "v", "least", "n", norm.alias("norm"), F.size("v").alias("dim"), F.monotonically_increasing_id().alias("c"))


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label")).withColumn("usable", _usable(F.col("v"), F.col("label")))
    classes = common.saved(different(rows.filter("usable")))
    found = []
    # One pass for each length of vectors: as many as there are kinds of embeddings.
    for (dim,) in classes.groupBy("dim").count().filter("count > 1").select("dim").orderBy("dim").collect():
        same = classes.filter(F.col("dim") == dim)
        drawn = same.orderBy(F.xxhash64("v"), "c").limit(sample).select("v").toArrow().column("v").combine_chunks()
        found.append(common.saved(links(same, fit(drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)), threshold)))
    empty = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("c").alias("b"), F.col("n").alias("nb")).limit(0)
    result = reduce(DataFrame.unionByName, found, empty)
    roots = connected_components(result.select("a", "b"), "a", "b")
    each = result.select(F.col("a").alias("c"), F.col("nb").alias("m")).unionByName(result.select(F.col("b").alias("c"), F.col("na").alias("m"))).groupBy("c").agg(F.sum("m").alias("m"))
    named = classes.select("c", "label", "v", "least", "n").join(roots.withColumnRenamed("node", "c"), "c", "left").join(each, "c", "left")
    named = common.saved(named.select("label", "v", "least", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.saved(named.join(ids, "root").select("label", "v", "n_links", "component_id"))
    linked = rows.filter("usable").join(named, ["label", "v"]).select("key", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    df = linked.unionByName(alone)
    return df.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all embeddings."""
    return dedup(common.table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of a label.
ORACLE = r"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = vec_id
"""
