"""Blocks of integer vectors: what the exact searches over embeddings share.

A search walks a set of query rows against all rows. The query rows are numbered and taken in
blocks of at most BLOCK_ROWS rows and BLOCK_BYTES bytes; each block is broadcast, and the tasks of
one job hold it against their own part of the written table of all rows. What a task keeps is a
short list for each query row, and the lists of all tasks merge in one grouped window. So the size
that is broadcast doesn't depend on the table, no pair of rows is shuffled, and a lost executor costs
its own tasks.

Components are integers. Products are summed in float64 where every sum stays below 2^53, so that
each is exact, and in int64 otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
#: Query rows that a task multiplies at once, and bytes of candidates.
PART_ROWS = 256
CHUNK_BYTES = 8 << 20
#: Vectors this long or longer could give a sum beyond a long.
LONGEST = 2.0**31


def integers(vectors: DataFrame, scale: int, key: str, vector: str, label: str | None = None) -> DataFrame:
    """key (long), label where asked for, v (floor(scale * x) as longs), dim of the rows that take part.

    Left out are rows whose key, vector or label is null, that hold null or non-finite components,
    or whose scaled vector is 2^31 or longer, as its products could leave a long's range."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    cols = [F.col(key).cast("long").alias("key"), *([F.col(label).cast("long").alias("label")] if label else [])]
    rows = vectors.filter(F.col(key).isNotNull() & (F.col(label).isNotNull() if label else F.lit(True)) & F.coalesce(~bad, F.lit(False)))
    rows = rows.select(*cols, F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.filter(square < LONGEST * LONGEST).withColumn("dim", F.size("v"))


def dims(rows: DataFrame) -> list[int]:
    """The lengths of vectors that occur: as many as there are kinds of embeddings."""
    return sorted(r["dim"] for r in rows.select("dim").distinct().collect())


def blocks(rows: DataFrame, dim: int) -> Iterator[pa.Table]:
    """rows in blocks of bounded size, each with its rows' numbers in n."""
    table, total = common.numbered(rows, "n")
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    for low in range(0, total, size):
        yield table.filter((F.col("n") >= low) & (F.col("n") < low + size)).toArrow().combine_chunks()
    common.discard(table)


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A list column as a matrix of int64, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows, -1) if rows and len(column.flatten()) else np.zeros((rows, 0), np.int64)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, in float64."""
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


def exact(a: float, b: float) -> type:
    """The type in which sums of products of vectors no longer than a and b are exact."""
    return np.float64 if a * b < 2.0**53 else np.int64


def chunks(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of some CHUNK_BYTES."""
    size = max(64, CHUNK_BYTES // (8 * max(1, dim)))
    for low in range(0, batch.num_rows, size):
        yield batch.slice(low, size)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id, in that order."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]
