"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and everything runs in one process (tests, one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: driver and executors need a folder that all of them see")
        path = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: the plan starts anew with true sizes, and lost executors cost no recomputation."""
    path = f"{folder(df.sparkSession)}/kinweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_kinweave_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns to spark.sql.shuffle.partitions tasks: rows that are small but cost much work; adaptive execution joins partitions by bytes and would leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
