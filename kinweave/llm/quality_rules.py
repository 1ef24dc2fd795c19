"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression; no exchange, no Python on the executors. The work for a
document depends on that document alone, so hot sources, copies or long texts move no data.

Defined cases: a null or empty text has no words (all counts 0) and fails; repeated rows are
judged row by row; an empty table gives an empty table; other columns of the input are ignored
by measure() and kept untouched by keep().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "au", "aux", "ce", "dans", "des", "du", "est", "et", "les", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "sich", "und", "von", "zu",
    "al", "como", "con", "de", "del", "el", "en", "la", "las", "le", "lo", "los", "no", "o", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: least <= metric <= most; None leaves a side open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are integers' quotients, so SQL gives the same doubles.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression over the metric columns."""
    tests = [F.col(r.metric) >= r.least for r in rules if r.least is not None]
    tests += [F.col(r.metric) <= r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the base measures of each whole text, one row for each input row."""
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.select("key", "text", common.words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD)).alias("lines"))
    n = F.size("words")
    gram = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    df = df.withColumn("grams", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)).otherwise(F.array().cast("array<string>")))
    # Only texts in which a window comes twice sort their windows, to find each of its places.
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda s, j: F.coalesce(F.get("placed", j)["g"] == s["g"], F.lit(False))
    df = df.withColumn("starts", F.sort_array(F.transform(F.filter("placed", lambda s, j: ((j > 0) & same(s, F.greatest(j - 1, F.lit(0)))) | same(s, j + 1)), lambda s: s["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
        lambda a: a["n"],
    )
    long = lambda c: c.cast("long")
    return df.select(
        F.col("key").alias(key),
        long(n).alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        long(F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter(common.words(F.lower("text")), lambda w: w.isin(*STOP_WORDS)))).alias("n_stop_words"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure() with base_failed, the ratios, and kept: the base test and every rule of the table."""
    df = measure(docs, key, text)
    by = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "mean_word_chars": by("word_chars", "n_words"),
            "symbol_ratio": by("n_symbols", "n_words"),
            "stop_word_ratio": by("n_stop_words", "n_words"),
            "dup_line_ratio": by("n_dup_lines", "n_lines"),
        }
    )
    # A filter on plain columns would be pushed down with all measures inlined into their own lambdas; none is pushed through a row number.
    return df.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & compiled(rules)))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with docs' own columns only."""
    row = common.fresh(docs, "row")
    judged = judge(docs.select(F.struct(*docs.columns).alias(row), F.col(text).alias(f"{row}_text")), row, f"{row}_text", rules)
    return judged.filter("kept").select(*[F.col(row)[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return judge(common.table(spark, sf_dir, "documents"))


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS low,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2])) AS gram,
         unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
f AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g),
p AS (
  SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY r),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars0,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(list_filter(low, lambda x: x IN ({_LIST})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN p ON p.r = w.r),
q AS (
  SELECT doc_id, n_words, coalesce(word_chars0, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
         (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
         coalesce(word_chars0, 0)::DOUBLE / greatest(n_words, 1) AS mean_word_chars,
         n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio,
         n_stop_words::DOUBLE / greatest(n_words, 1) AS stop_word_ratio,
         n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio FROM m)
SELECT *, (NOT base_failed AND mean_word_chars >= 2.0 AND mean_word_chars <= 16.0 AND symbol_ratio <= 0.1
           AND stop_word_ratio >= 0.02 AND dup_line_ratio <= 0.5) AS kept
FROM q
"""
