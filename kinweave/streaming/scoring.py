"""Answers scored as they arrive: files of responses, questions at rest, windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """question_id, response, answered (a time) from JSON-lines files that appear in folder."""
    return spark.readStream.schema("question_id string, response string, answered timestamp").json(folder)


def scored_stream(responses: DataFrame, questions: DataFrame, cot: bool = False) -> DataFrame:
    """Each response with its question's fields (gold: array<string>) and scores; row by row, without state."""
    return scoring.score(responses.join(questions, "question_id"), cot=cot)


def windowed(scored: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kinship_system, category, n, exact, errors, mean_f1 for each window of time; answers later than the watermark are left out, and a window's state goes when it passes."""
    g = scored.withWatermark("answered", late).groupBy(F.window("answered", every).alias("w"), "kinship_system", "category")
    df = g.agg(F.count("*").alias("n"), F.count_if("exact_match").alias("exact"), F.count_if("is_error").alias("errors"), F.avg("f1").alias("mean_f1"))
    return df.select(F.col("w.start").alias("start"), "kinship_system", "category", "n", "exact", "errors", "mean_f1")
