"""The last answer to each question from a stream in which answers are repeated, come out of order and come late.

State is kept for each key: how many answers came, how many of them too late, and the last one in
time that didn't. None of it depends on the order in which rows or batches come, so a replay gives what a
batch query over the same rows gives. Before the shuffle each task combines a key's rows to one, so that a
key with a large share of all answers sends one row from each batch of rows.

Defined cases: answers with a null key are a key of their own; an answer without a time counts but is
never the last; one without an arrival isn't late; of answers at the same time the one with the higher number is
the last; a key whose answers all came late, or have no time, has a null last answer; an empty stream gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_answers(answers: DataFrame, delay: str) -> DataFrame:
    """The states of a stream of answers (key: string, answered, arrived: times, seq: long, response: string): a key's counts and its last answer in time, given out again after each batch that holds some; late are those that arrive more than delay after answered. replayed() appends what has changed, and merged() reads it."""
    late = F.coalesce(F.col("arrived") > F.col("answered") + F.expr(f"INTERVAL {delay}"), F.lit(False))
    rows = answers.select("key", "answered", F.coalesce("seq", F.lit(0)).alias("seq"), "response", late.alias("late"))
    timely = ~F.col("late") & F.col("answered").isNotNull()
    kept = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("late").alias("late"), F.max(F.when(timely, F.struct("answered", "seq", "response"))).alias("last"))
    return kept.select("key", "n", "late", "last.*")


def merged(states: DataFrame) -> DataFrame:
    """key, n, late, answered, seq, response: the newest state of each key, the one that counts most answers."""
    newest = states.groupBy("key").agg(F.max(F.struct("n", "late", "answered", "seq", "response")).alias("x"))
    return newest.select("key", "x.*")


def replayed(spark: SparkSession, path: str, schema: StructType | str, build, files: int | None = None) -> DataFrame:
    """What build(stream) gives out once all files of path have gone through it, so many files a batch; progress, states and results are in the shared folder, so a run that is broken off goes on where it was."""
    at = f"{folder(spark)}/kinweave/{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    # As a pattern the path may be one file as well as a folder of files.
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # which this kind of state needs
    try:
        out = build(stream)
        spark.createDataFrame([], out.schema).write.parquet(f"{at}/out/none")  # for a stream without files
        # A batch that is repeated after a break replaces its own rows.
        keep = lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}")
        query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{at}/out")
