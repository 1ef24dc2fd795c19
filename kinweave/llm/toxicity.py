"""Toxicity by a classifier chain.

Categories are predicted in order by linear models over hashed word presence; each model also
gets the earlier categories' probabilities. In training those are out-of-fold predictions, so a
later model sees them as unsure as they will be on new texts. Training takes at most SAMPLE
labelled rows (by hash of the key, so reruns agree) and keeps the SELECTED hashed words that
tell the categories apart best; all texts are scored whole, row by row, without a shuffle.

Defined cases: a null or empty text gets the intercepts' probabilities; texts of any length are
read whole; labels that are null, or of no document, aren't trained on; a category of one class
gives its constant share; without labels all probabilities are near zero; of tied hashed words the
smaller bucket is selected, and a probability at the cut is called; repeated rows are scored row by
row, and a text counts once in training; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .linear import Sparse, logistic, sigmoid

#: Labelled rows that the chain is trained on, at most.
SAMPLE = 10_000
BUCKETS = 1 << 18
SELECTED = 2_048
#: A bucket counts if so many texts have it and its squared deviation, in variances, is so large (chance hardly reaches it).
LEAST_SEEN, LEAST_SURE = 4, 30.0
#: Lengths of the word beginnings that are features too.
BEGINNINGS = (4, 5, 6)
FOLDS = 5
RIDGE = 1e-4
#: Words that a scoring task remembers.
MEMO = 400_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*_~-"


def _buckets(word: str) -> list[int]:
    """The hash buckets of a word and of its beginnings, so that inflected forms count together."""
    w = word.strip(PUNCTUATION)
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in {w, *("^" + w[:k] for k in BEGINNINGS if len(w) >= k)}]


def features(text: str | None) -> np.ndarray:
    """The distinct hash buckets of the words of a whole text."""
    return np.unique(np.array([b for w in set((text or "").lower().split()) for b in _buckets(w)], np.int32))


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, categories: dict[str, Column], sample: int) -> pd.DataFrame:
    """x (buckets, 32-bit integers) and the categories of the sampled labelled rows. categories: name -> expression over labels' columns and text, null to leave a row out."""
    drawn = common.saved(labels.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), *[c for c in labels.columns if c != key]).limit(sample).distinct())
    row = common.fresh(docs, "key")
    texts = docs.select(F.col(key).alias(row), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # A key may repeat: of the distinct texts of the drawn keys, sample at most, one row each.
    pairs = texts.select(row, "h").join(F.broadcast(drawn.select(key).distinct()), F.col(row) == F.col(key), "left_semi").distinct()
    pairs = common.saved(pairs.orderBy(F.xxhash64(row), "h").limit(sample))

    @F.pandas_udf("binary")  # 32-bit integers; lists would take ten times the driver's memory
    def hashed(column: pd.Series) -> pd.Series:
        return pd.Series([features(x).tobytes() for x in column], dtype=object)

    one = texts.join(F.broadcast(pairs), [row, "h"], "left_semi").dropDuplicates([row, "h"])
    rows = one.join(F.broadcast(drawn), F.col(row) == F.col(key))
    rows = rows.select(row, "h", hashed("text").alias("x"), *[c.cast("double").alias(name) for name, c in categories.items()])
    return rows.dropna(subset=list(categories)).toPandas().sort_values([row, "h", *categories], kind="stable")


def fit(rows: pd.DataFrame, categories: list[str]) -> tuple[np.ndarray, list, float]:
    """(selected buckets, [(weights, weights of earlier categories, intercept)], least probability at which the last category is called)."""
    rows = rows[~rows["x"].duplicated()]  # copies would pass for evidence
    n = len(rows)
    y = rows[categories].to_numpy(np.float64).reshape(n, len(categories))
    sizes = np.array([len(x) // 4 for x in rows["x"]], np.int64)
    cols = np.frombuffer(b"".join(rows["x"]), np.int32).astype(np.int64)
    at = np.repeat(np.arange(n), sizes)
    seen = np.bincount(cols, minlength=BUCKETS)
    best = np.zeros(BUCKETS)
    for k in range(y.shape[1]):  # how far the category's count in a bucket is from what chance gives
        share = y[:, k].mean() if n else 0.0
        hits = np.bincount(cols, weights=y[at, k], minlength=BUCKETS)
        best = np.maximum(best, (hits - share * seen) ** 2 / np.maximum(seen * share * (1 - share), 1e-9))
    best[(seen < LEAST_SEEN) | (best < LEAST_SURE)] = 0
    chosen = np.sort(np.argsort(-best, kind="stable")[: min(SELECTED, int((best > 0).sum()))])
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[cols] >= 0
    x = Sparse(at[keep], place[cols[keep]], np.ones(int(keep.sum())), (n, len(chosen)))
    fold = np.arange(n) % FOLDS
    before, models = np.zeros((n, 0)), []
    for k in range(y.shape[1]):
        held = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            w, e, b = logistic(x.taken(~out), before[~out], y[~out, k], RIDGE)
            held[out] = sigmoid(x.taken(out).dot(w) + before[out] @ e + b)
        models.append(logistic(x, before, y[:, k], RIDGE))
        before = np.column_stack((before, held))
    return chosen, models, _cut(before[:, -1], y[:, -1])


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which the last category is called, of the best F1 out of fold; 0.5 where that can't tell."""
    best, at = 0.0, 0.5
    for cut in np.arange(0.5, 0.1, -0.02):
        called = p >= cut
        f1 = 2 * float(y[called].sum()) / max(1.0, called.sum() + y.sum())
        if f1 > best:
            best, at = f1, float(cut)
    return at


def score(docs: DataFrame, model: tuple[np.ndarray, list, float], categories: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and p_<category> for every row."""
    chosen, models, _ = model
    place = {int(b): k for k, b in enumerate(chosen)}
    weights = np.stack([m[0] for m in models])
    shared = docs.sparkSession.sparkContext.broadcast((place, weights, [(m[1], m[2]) for m in models]))

    @F.pandas_udf(", ".join(f"p_{c} double" for c in categories))
    def chain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place, weights, rest = shared.value
        memo: dict[str, tuple] = {}
        for batch in batches:
            out = np.zeros((len(batch), len(rest)))
            for i, x in enumerate(batch):
                found = set()
                for w in set((x or "").lower().split()):
                    k = memo.get(w)
                    if k is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = tuple(place[b] for b in _buckets(w) if b in place)
                    found.update(k)
                z = weights[:, sorted(found)].sum(axis=1)
                for k, (earlier, intercept) in enumerate(rest):
                    out[i, k] = sigmoid(z[k] + out[i, :k] @ earlier + intercept)
            yield pd.DataFrame(out, columns=[f"p_{c}" for c in categories])

    return docs.select(F.col(key), chain(F.col(text)).alias("p")).select(key, "p.*")


#: The labels table has one toxic label; its toxic rows are told apart by these words.
INSULTS = ("idiot", "moron", "loser", "clown", "stupid", "scum")
CONTEMPT = ("trash", "worthless", "pathetic", "disgusting", "garbage", "useless")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents scored by the chain insult -> contempt -> toxic; toxic is its last link."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    said = lambda words: F.col("text").rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    toxic = F.col("toxic") == 1
    categories = {"insult": toxic & said(INSULTS), "contempt": toxic & said(CONTEMPT), "toxic": toxic}
    model = fit(sampled(docs, labels, "doc_id", "text", categories, SAMPLE), list(categories))
    return score(docs, model, list(categories)).withColumn("toxic", F.col("p_toxic") >= model[2])
