"""Exact top-k search by columnar branch-and-bound.

All vectors are written once in vertical layout: a column for each block of dimensions and one for
the lengths of what remains after each block. A task adds up the inner products of its candidates
and a block of queries column by column. After each column a candidate's score lies within
(sum so far) +- (remaining length of the query) * (remaining length of the candidate): the k-th best lower
bound raises the query's threshold, candidates whose upper bound is below it go, and the next
column is read for the survivors alone. Nothing is estimated: what remains at the last column has
its whole score, and a candidate goes only if k others are surely better.

Defined cases: rows whose id or vector is null, or whose vector holds null or non-finite components,
take no part, nor do vectors whose scaled length is 2^31 or more; vectors are compared with
those of their own length, empty ones with score 0; a row's own id is never its neighbour, and a
repeated query row is answered once for each time it occurs; ties go to the smaller id; a query
with fewer than k candidates gets all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import vector_blocks as vb

K = 10
EVERY = 100
SCALE = 1024
#: Columns of the vertical layout.
COLUMNS = 8
_FOUND = "n long, query_id long, vec_id long, score long"


def _cuts(dim: int) -> list[tuple[int, int]]:
    """Start and size of each column's dimensions."""
    ends = [round(dim * (j + 1) / COLUMNS) for j in range(COLUMNS)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def vertical(rows: DataFrame, dim: int) -> DataFrame:
    """rows with the columns d0, d1... (slices of v), rest (lengths of what follows each) and norm."""
    cuts = _cuts(dim)
    length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    rest = [length(F.slice("v", a + size + 1, dim)) for a, size in cuts]
    return rows.select("key", *[F.slice("v", a + 1, size).alias(f"d{j}") for j, (a, size) in enumerate(cuts)], F.array(*rest).alias("rest"), length(F.col("v")).alias("norm"))


def _columns(table: pa.Table | pa.RecordBatch) -> dict:
    """A block's or chunk's arrays."""
    n = table.num_rows
    rest = table["rest"].combine_chunks() if isinstance(table, pa.Table) else table["rest"]
    return {"ids": vb.numbers(table["key"]), "d": [vb.matrix(table[f"d{j}"], n) for j in range(COLUMNS)], "rest": rest.flatten().to_numpy(zero_copy_only=False).reshape(n, COLUMNS), "norm": vb.numbers(table["norm"])}


def _survivors(q: dict, i: int, c: dict, first: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whole scores) of the candidates c that can be among query i's k best; floor: a score that k others are known to reach."""
    slack = 1 + 1e-12 * q["norm"][i] * c["norm"].max()
    at = np.flatnonzero(c["ids"] != q["ids"][i])
    part = first[at]
    for j in range(COLUMNS):
        if j:
            part = part + c["d"][j][at] @ q["d"][j][i]
        if j == COLUMNS - 1:
            break
        room = c["rest"][at, j] * q["rest"][i, j] * (1 + 1e-9) + slack
        if len(at) > k:
            low = part - room
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        alive = part + room >= floor
        if not alive.all():
            at, part = at[alive], part[alive]
    return at, part


def _task(q: dict, k: int, dim: int):
    """The search of one task: the k best of its candidates for each query of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(q["ids"])
        ids, scores = [np.zeros(0, np.int64)] * m, [np.zeros(0, np.int64)] * m
        longest = q["norm"].max()
        for batch in batches:
            for chunk in vb.chunks(batch, dim):
                c = _columns(chunk)
                kind = vb.exact(longest, c["norm"].max())
                c["d"] = [x.astype(kind) for x in c["d"]]
                for low in range(0, m, vb.PART_ROWS):
                    part = {"ids": q["ids"][low : low + vb.PART_ROWS], "rest": q["rest"][low : low + vb.PART_ROWS], "norm": q["norm"][low : low + vb.PART_ROWS], "d": [x[low : low + vb.PART_ROWS].astype(kind) for x in q["d"]]}
                    first = part["d"][0] @ c["d"][0].T
                    for i in range(len(part["ids"])):
                        have = scores[low + i]
                        at, sums = _survivors(part, i, c, first[i], float(have[-1]) if len(have) == k else -np.inf, k)
                        if len(at):
                            both, keys = np.concatenate([have, sums.astype(np.int64)]), np.concatenate([ids[low + i], c["ids"][at]])
                            top = vb.best(both, keys, k)
                            scores[low + i], ids[low + i] = both[top], keys[top]
        counts = [len(x) for x in ids]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["n"], counts)), pa.array(np.repeat(q["ids"], counts)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["n", "query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the highest integer inner products for each row of queries (same columns), other than those of its own id."""
    spark = vectors.sparkSession
    rows, asked = (vb.integers(df, scale, key, vector) for df in (vectors, queries))
    rows, asked = common.saved(rows), common.saved(asked)
    found = []
    for dim in vb.dims(asked):
        table = common.saved(vertical(rows.filter(F.col("dim") == dim), dim))
        for block in vb.blocks(vertical(asked.filter(F.col("dim") == dim), dim), dim):
            shared = spark.sparkContext.broadcast(_columns(block) | {"n": vb.numbers(block["n"])})
            lists = table.mapInArrow(lambda batches, shared=shared, dim=dim: _task(shared.value, k, dim)(batches), _FOUND)
            place = Window.partitionBy("n").orderBy(F.col("score").desc(), "vec_id")
            found.append(common.saved(lists.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
            shared.unpersist()
        common.discard(table)
    common.discard(rows, asked)
    return common.joined(spark, found, "query_id long, rank int, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the rows whose id is divisible by 100 ask, all rows of embeddings answer."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


#: Brute force over all pairs of a query and a row.
ORACLE = r"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
