"""Token counts of whole texts without their tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in each unit of text, and dynamic
programming carries the piece count under the tokenizer's own choice: the best score for unigram
models, the merge order for BPE models (see pieces.Pieces.count). The counts equal the lengths
of the tokenizer's encodings. Work is per row; nothing is shuffled, and each worker's memo of
units is bounded by its characters.

Defined cases: a null text gives a null count, an empty one 0; a text of any length is counted
whole; of cuts with equal score the one whose last piece is longest counts; repeated rows are
counted row by row; an empty table gives an empty table; other columns are kept, but a column
named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import MODEL, Pieces

#: Characters of the units that a worker remembers, and the longest unit that it does.
MEMO_CHARS, MEMO_UNIT = 6_000_000, 200

_LOADED: dict = {}


class _Counts(dict):
    """Unit -> its number of pieces, counted when first asked for."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.chars = pieces, 0

    def __missing__(self, unit: str) -> int:
        n = self.pieces.count(unit)
        if len(unit) <= MEMO_UNIT:
            if self.chars > MEMO_CHARS:
                self.clear()
                self.chars = 0
            self.chars += len(unit)
            self[unit] = n
        return n


def with_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", model: str | Pieces = MODEL) -> DataFrame:
    """docs with the number of tokens of each text in column out; model is a file or a table."""
    table = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Pieces) else Pieces.read(model))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if table.value is not _LOADED.get("table"):
            _LOADED.update(table=table.value, counts=_Counts(table.value))
        units, known = table.value.units, _LOADED["counts"].__getitem__
        for batch in batches:
            yield pd.Series([None if x is None else sum(map(known, units(x))) for x in batch], dtype="Int64")

    return docs.withColumn(out, count(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_counts(docs).select("doc_id", "n_tokens")
