"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.shared import discard  # noqa: F401
from kinweave.sources.shared import written as saved  # noqa: F401

#: Runs of white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; a plain column that is used inside a lambda may be inlined there and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken, name, k = {c.lower() for c in df.columns}, f"__kw_{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__kw_{stem}_{k}"
    return name


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else left to the planner (sort-merge with skew splitting)."""
    return F.broadcast(df) if small(df, rows) else df


def numbered(df: DataFrame, name: str, *order: Column) -> tuple[DataFrame, int]:
    """(df with the rows' numbers 0, 1, 2... in the order given, or in any; how many rows). Written once.

    Rows are sorted by range over all tasks, each task numbers its own, and the tasks' counts (one
    number a task) give where each starts; no task sees all rows."""
    at, task = fresh(df, "at"), fresh(df, "task")
    kept = saved((df.orderBy(*order) if order else df).withColumn(at, F.monotonically_increasing_id()))
    counts = sorted(kept.groupBy(F.shiftright(at, 33).alias("task")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for r in counts:
        starts.append((r["task"], total))
        total += r["n"]
    table = kept.sparkSession.createDataFrame(starts, f"{task} long, {name} long")
    out = kept.join(F.broadcast(table), F.shiftright(at, 33) == F.col(task)).withColumn(name, F.col(name) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).drop(at, task)
    out._kinweave_path = kept._kinweave_path
    return out, total



def joined(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    """The rows of all written tables of one schema, read as one table."""
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(empty.schema).parquet(*[p._kinweave_path for p in parts]) if parts else empty
