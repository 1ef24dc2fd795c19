"""Hard-negative mining by blocked dense products.

Blocks of anchors are broadcast against blocks of candidates. A first pass multiplies them and
keeps, in each task, an anchor's best rows of its own label; the tasks' lists merge into its
positives. A second pass multiplies the same blocks again and keeps, for each anchor and positive,
the best rows of other labels whose score lies within the window that the positive's score sets;
these lists merge in the same way. A list has at most positives or negatives rows, whatever the number
of candidates, so nothing but the lists is shuffled.

Defined cases: rows whose id, label or vector is null, or whose vector holds null or non-finite
components, take no part, nor do vectors whose scaled length is 2^31 or more; vectors are compared with
those of their own length; an anchor's own id is neither its positive nor its negative, and
repeated anchors are answered once for each time they occur; ties go to the smaller id; an anchor without
positives and a positive whose window is empty (as every window of a negative score is) give no
rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import vector_blocks as vb

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score in hundredths of the positive's, at least and at most.
WINDOW = (50, 95)
_LISTS = "n long, pair int, vec_id long, score long"


def _columns(table: pa.Table | pa.RecordBatch) -> dict:
    x = vb.matrix(table["v"], table.num_rows)
    return {"ids": vb.numbers(table["key"]), "labels": vb.numbers(table["label"]), "x": x, "norm": vb.norms(x)}


def _products(a: dict, batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, dict]]:
    """(anchor's place in the block, its integer scores, the candidates) for each chunk of candidates."""
    longest = a["norm"].max()
    for batch in batches:
        for chunk in vb.chunks(batch, dim):
            c = _columns(chunk)
            kind = vb.exact(longest, c["norm"].max())
            x = c["x"].astype(kind).T
            for low in range(0, len(a["ids"]), vb.PART_ROWS):
                s = a["x"][low : low + vb.PART_ROWS].astype(kind) @ x
                for i, scores in enumerate(s):
                    yield low + i, scores, c


class _Lists:
    """The best (score, id) rows seen for each (anchor, pair)."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, to: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if to in self.held:
            have, keys = self.held[to]
            if len(have) == self.k:
                near = scores >= have[-1]
                scores, ids = scores[near], ids[near]
            scores, ids = np.concatenate([have, scores]), np.concatenate([keys, ids])
        if len(scores):
            top = vb.best(scores, ids, self.k)
            self.held[to] = scores[top], ids[top]

    def batches(self, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.held:
            counts = [len(s) for s, _ in self.held.values()]
            column = lambda x: pa.array(np.repeat(np.asarray(x), counts))
            at = list(self.held)
            yield pa.RecordBatch.from_arrays([column(numbers[[i for i, _ in at]]), column(np.array([p for _, p in at], np.int32)), pa.array(np.concatenate([k for _, k in self.held.values()])), pa.array(np.concatenate([s for s, _ in self.held.values()]))], names=["n", "pair", "vec_id", "score"])


def _best_positives(a: dict, k: int, dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = _Lists(k)
    for i, scores, c in _products(a, batches, dim):
        at = np.flatnonzero((c["labels"] == a["labels"][i]) & (c["ids"] != a["ids"][i]))
        lists.add((i, 0), scores[at].astype(np.int64), c["ids"][at])
    yield from lists.batches(a["n"])


def _best_negatives(a: dict, k: int, dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a["windows"]: the (pair, least, most) of each anchor."""
    lists = _Lists(k)
    for i, scores, c in _products(a, batches, dim):
        windows = a["windows"].get(i)
        if windows:
            at = np.flatnonzero((scores >= min(w[1] for w in windows)) & (scores <= max(w[2] for w in windows)) & (c["labels"] != a["labels"][i]) & (c["ids"] != a["ids"][i]))
            found, ids = scores[at].astype(np.int64), c["ids"][at]
            for pair, least, most in windows:
                inside = (found >= least) & (found <= most)
                lists.add((i, pair), found[inside], ids[inside])
    yield from lists.batches(a["n"])


def _merged(table: DataFrame, task: Callable, block: dict, k: int, dim: int) -> DataFrame:
    """One pass of a block over all candidates: n, pair, place, vec_id, score."""
    shared = table.sparkSession.sparkContext.broadcast(block)
    lists = table.mapInArrow(lambda batches: task(shared.value, k, dim, batches), _LISTS)
    place = Window.partitionBy("n", "pair").orderBy(F.col("score").desc(), "vec_id")
    out = common.saved(lists.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k))
    shared.unpersist()
    return out


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of anchors (same columns as vectors)."""
    spark = vectors.sparkSession
    rows, asked = (common.saved(vb.integers(df, scale, key, vector, label)) for df in (vectors, anchors))
    out = []
    for dim in vb.dims(asked):
        table = rows.filter(F.col("dim") == dim)
        for taken in vb.blocks(asked.filter(F.col("dim") == dim), dim):
            block = _columns(taken) | {"n": vb.numbers(taken["n"])}
            first = _merged(table, _best_positives, block, positives, dim)
            places = {int(n): i for i, n in enumerate(block["n"])}
            windows: dict[int, list] = {}
            for r in first.collect():  # a block's own lists: at most BLOCK_ROWS * positives rows
                windows.setdefault(places[r["n"]], []).append((r["place"], -(-window[0] * r["score"] // 100), window[1] * r["score"] // 100))
            second = _merged(table, _best_negatives, block | {"windows": windows}, negatives, dim)
            ids = spark.createDataFrame(zip(block["n"].tolist(), block["ids"].tolist()), "n long, anchor_id long")
            pairs = first.select("n", F.col("place").alias("pair"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(F.broadcast(ids), "n")
            named = second.join(pairs, ["n", "pair"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.append(common.saved(named))
            common.discard(first, second)
    common.discard(rows, asked)
    return common.joined(spark, out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the rows whose id is divisible by 50 are anchors; each seventh row's label is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = common.table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


#: Brute force over all pairs of an anchor and a row.
ORACLE = r"""
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM ok a JOIN ok c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.place <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
