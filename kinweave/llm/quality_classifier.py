"""Quality classifier trained without labels.

Overlapping heuristics vote good, bad or nothing on every whole text. Expectation-maximisation
over the counts of vote patterns (all documents; at most 3^6 patterns) estimates the share of good
texts and each heuristic's accuracies; the patterns' posteriors are the labels of a hashed linear
scorer, trained on a bounded sample of distinct texts (SAMPLE, those of the least hashes). The
scorer then judges all texts, row by row, without a shuffle.

A heuristic has two accuracies, on good and on bad texts, as lacking one defect says little about
the others; a vote of nothing is no evidence. All of them are estimated without bounds: START says
which class is the bad one (the one whose texts the heuristics call bad more often), with the
weight of PSEUDO texts. Shares are smoothed by a few words, so that short texts get no vote where
they are too short to tell, and none depends on the text's length otherwise.

Defined cases: null and empty texts get no votes and the scorer's intercept; texts of any length
are read whole; repeated rows are scored row by row, and a text counts once in training; a score of
exactly 0.5 is kept; an empty table gives an empty table; other columns are ignored by judge() and
kept by keep(); where all sampled texts have one label, the score is that label's share.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .linear import Sparse, logistic, sigmoid
from .quality_rules import STOP_WORDS

#: Texts that the scorer is trained on, at most.
SAMPLE = 6_000
BUCKETS = 1 << 16
ROUNDS = 200
#: Before the data say otherwise, a labeller calls these shares of bad and of good texts bad, and this share of texts is good; the weight of that, in texts.
START_HIT, START_SLIP, START_GOOD, PSEUDO = 0.3, 0.003, 0.9, 20.0
#: Words in whose runs the variety of words is measured.
RUN = 100
RIDGE = 1e-4
#: Words that a task remembers.
MEMO = 400_000
NOTHING, BAD, GOOD = 0, 1, 2

_STOP = frozenset(STOP_WORDS)
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"
_SHAPES = ((re.compile(r"\d"), "9"), (re.compile(r"[^\W\d_]+"), "x"))


def _vote(value: float, good: float, bad: float) -> int:
    """GOOD from good on, BAD from bad on, NOTHING between; good < bad means that small is good."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else NOTHING
    return GOOD if value >= good else BAD if value <= bad else NOTHING


def votes(text: str | None) -> tuple[int, ...]:
    """The heuristics' votes on one whole text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (NOTHING,) * len(LABELLERS)
    raw = text.encode()
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower = count(_UPPER), count(_LOWER)
    repeats = sum(map(operator.eq, words, words[1:]))
    variety = sum(len(set(words[k : k + RUN])) for k in range(0, n, RUN)) / n
    return (
        _vote((sum(map(_STOP.__contains__, text.lower().split())) + 0.4) / (n + 8), 0.08, 0.01),
        _vote(count(_SYMBOLS) / n, 0.02, 0.2),
        _vote((repeats + 0.4) / (n + 4), 0.05, 0.25),
        _vote((upper + 2) / (upper + lower + 10), 0.25, 0.6),
        _vote(text.count("!") / n, 0.02, 0.3),
        _vote(variety, 0.5, 0.35),
    )


LABELLERS = ("stop_words", "symbols", "repeats", "capitals", "exclamations", "variety")


def pattern(text: str | None) -> int:
    """The votes as one number in base 3."""
    out = 0
    for v in votes(text):
        out = 3 * out + v
    return out


def unpacked(code: int) -> list[int]:
    """The votes of a pattern."""
    return [code // 3**k % 3 for k in reversed(range(len(LABELLERS)))]


def estimate(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float, dict[int, float]]:
    """(how often each labeller that votes calls a bad text bad, a good text bad, the share of good texts, pattern -> posterior of good) by expectation-maximisation over pattern counts."""
    codes = sorted(counts)
    v = np.array([unpacked(c) for c in codes], np.int64).reshape(len(codes), len(LABELLERS))
    n = np.array([counts[c] for c in codes], np.float64)
    said, bad = v != NOTHING, v == BAD
    hit, slip, good = np.full(len(LABELLERS), START_HIT), np.full(len(LABELLERS), START_SLIP), START_GOOD
    for _ in range(ROUNDS):
        lean = np.where(bad, np.log(hit / slip), np.log((1 - hit) / (1 - slip)))
        p = sigmoid(np.log(1 - good) - np.log(good) + np.where(said, lean, 0.0).sum(axis=1))  # of bad
        share = lambda weight, start: ((bad * (weight * n)[:, None]).sum(axis=0) + PSEUDO * start) / ((said * (weight * n)[:, None]).sum(axis=0) + PSEUDO)  # noqa: E731, B023
        hit, slip = share(p, START_HIT), share(1 - p, START_SLIP)
        good = float((((1 - p) * n).sum() + PSEUDO * START_GOOD) / (n.sum() + PSEUDO))
    return hit, slip, good, dict(zip(codes, (1 - p).tolist() if len(codes) else []))


def _buckets(word: str) -> tuple[int, int]:
    """The hash buckets of a word and of its shape (letters as x, digits as 9, capitals marked)."""
    shape = word
    for at, sign in _SHAPES:
        shape = at.sub(sign, shape)
    shape = ("A " if word.isupper() and len(word) > 1 else "a ") + shape
    return xxhash.xxh32_intdigest(word.lower()) % BUCKETS, xxhash.xxh32_intdigest(shape, 1) % BUCKETS


_REPEAT = xxhash.xxh32_intdigest("repeated word", 2) % BUCKETS


def features(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: counts of words, word shapes and immediate repeats, scaled to length 1."""
    words = (text or "").split()
    out: Counter = Counter()
    for w, n in Counter(words).items():
        found = memo.get(w)
        if found is None:
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[w] = _buckets(w)
        out[found[0]] += n
        out[found[1]] += n
    repeats = sum(map(operator.eq, words, words[1:]))
    if repeats:
        out[_REPEAT] += repeats
    values = np.fromiter(out.values(), np.float32, len(out))
    return np.fromiter(out.keys(), np.int32, len(out)), values / max(1.0, float(np.linalg.norm(values)))


def patterns(docs: DataFrame, text: str) -> DataFrame:
    """h (hash of the text), pattern for every row."""

    @F.pandas_udf("int")
    def voted(column: pd.Series) -> pd.Series:
        return pd.Series([pattern(x) for x in column], dtype="int32")

    return docs.select(F.xxhash64(text).alias("h"), voted(F.col(text)).alias("pattern"))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float, dict]:
    """(weights, intercept, report): the scorer, trained on the posteriors of a sample; the report has the labellers' accuracies."""
    voted = common.saved(patterns(docs, text))
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    hit, slip, good, posterior = estimate(counts)
    drawn = voted.dropDuplicates(["h"]).orderBy("h").limit(sample)

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        memo: dict = {}
        return pd.Series([b"".join(a.tobytes() for a in features(x, memo)) for x in column], dtype=object)

    # The sampled texts, one of each, before their features are made.
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(F.broadcast(common.saved(drawn)), "h").dropDuplicates(["h"])
    rows = texts.select("h", "pattern", packed("text").alias("x")).toPandas().sort_values("h", kind="stable")
    common.discard(voted)
    rows = rows[~rows["x"].duplicated()]
    sizes = np.array([len(x) // 8 for x in rows["x"]], np.int64)
    cols = np.concatenate([np.frombuffer(x, np.int32, len(x) // 8) for x in rows["x"]] or [np.zeros(0, np.int32)]).astype(np.int64)
    values = np.concatenate([np.frombuffer(x, np.float32, -1, len(x) // 2) if x else np.zeros(0, np.float32) for x in rows["x"]] or [np.zeros(0, np.float32)]).astype(np.float64)
    x = Sparse(np.repeat(np.arange(len(rows)), sizes), cols, values, (len(rows), BUCKETS))
    w, _, b = logistic(x, np.zeros((len(rows), 0)), np.array([posterior[p] for p in rows["pattern"]], np.float64), RIDGE)
    return w, b, {"hit": dict(zip(LABELLERS, hit.tolist())), "slip": dict(zip(LABELLERS, slip.tolist())), "good": good, "sampled": len(rows)}


def scored(docs: DataFrame, model: tuple[np.ndarray, float, dict], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the scorer's probability of good quality in column out."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        memo: dict = {}
        for batch in batches:
            z = np.empty(len(batch))
            for i, x in enumerate(batch):
                cols, values = features(x, memo)
                z[i] = float(values @ w[cols]) + b
            yield pd.Series(sigmoid(z))

    return docs.withColumn(out, score(F.col(text)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, kept (score >= 0.5) for every row."""
    df = scored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), fit(docs, text))
    return df.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).alias("kept"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns only."""
    out = common.fresh(docs, "score")
    return scored(docs, fit(docs, text), text, out).filter(F.col(out) >= 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    return judge(common.table(spark, sf_dir, "documents"))
