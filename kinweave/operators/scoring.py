"""Scoring of predicted against gold answers, and grouped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """exact_match, partial_match, precision, recall, f1 of two arrays as sets; empty sides give 0."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    precision, recall = ratio(both, F.size(p)), ratio(both, F.size(g))
    return {
        "exact_match": (F.size(p) == both) & (F.size(g) == both),
        "partial_match": both > 0,
        "precision": precision,
        "recall": recall,
        "f1": F.when(both > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-300))).otherwise(F.lit(0.0)),
    }


def score(rows: DataFrame, response: str = "response", question: str = "question_text", gold: str = "gold", cot: bool = False) -> DataFrame:
    """rows (gold: array<string>) with question_type, predicted (array), is_error and the scores. Counts compare numbers, relationships compare terms leniently, names compare sets of normalised names."""
    answer = X.cot_answer(F.col(response)) if cot else F.col(response)
    df = rows.withColumns({"is_error": F.coalesce(X.is_error(F.col(response)), F.lit(True)), "question_type": X.question_type(F.col(question)), "answer": answer})
    kind = F.col("question_type")
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    predicted = F.when(kind == "count", one(X.extract_number(F.col("answer")).cast("string"))).when(kind == "relationship", one(X.extract_relationship(F.col("answer")))).otherwise(X.extract_names(F.col("answer")))
    df = df.withColumn("predicted", F.when(F.col("is_error"), F.array().cast("array<string>")).otherwise(predicted))
    norm = lambda a: F.filter(F.transform(a, X.normalize_name), lambda x: x != "")
    sets = set_scores(norm(F.col("predicted")), norm(F.col(gold)))
    same = F.when(kind == "count", F.coalesce(F.get("predicted", F.lit(0)) == F.get(gold, F.lit(0)), F.lit(False))).when(kind == "relationship", X.same_relationship(F.get("predicted", F.lit(0)), F.get(gold, F.lit(0))))
    flat = {k: F.when(kind == "name", v).otherwise(same.cast("boolean") if v is sets["exact_match"] or v is sets["partial_match"] else same.cast("double")) for k, v in sets.items()}
    return df.withColumns(flat)


def summary(scored: DataFrame) -> DataFrame:
    """One pass with grouping sets: overall, by category, by n_hops and by override flag; n, exact, partial, errors, mean precision, recall and f1."""
    groups = scored.groupingSets([[], ["category"], ["n_hops"], ["has_override"]], "category", "n_hops", "has_override")
    return groups.agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("n"),
        F.count_if("exact_match").alias("exact"),
        F.count_if("partial_match").alias("partial"),
        F.count_if("is_error").alias("errors"),
        *[(F.sum(m) / F.greatest(F.count("*"), F.lit(1))).alias(f"mean_{m}") for m in ("precision", "recall", "f1")],
    )


def error_class(predicted: Column, gold: Column, default: Column) -> Column:
    """The kind of a wrong answer, from its set relation to the gold answer and to the biological default."""
    p, g, d = F.array_distinct(predicted), F.array_distinct(gold), F.array_distinct(default)
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    return (
        F.when(within(p, g) & within(g, p), F.lit(None).cast("string"))
        .when(F.size(p) == 0, "empty_format")
        .when(within(g, p), "over_inclusion")
        .when(within(p, g), "partial_under")
        .when(F.size(F.array_intersect(p, g)) > 0, "partial_overlap")
        .when(within(p, d), "default_substitution")
        .otherwise("wrong_disjoint")
    )
