"""The trained operators on rows held out of training, and their defined cases."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import quality_classifier, quality_rules, toxicity

BASE = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BASE}/labels.parquet").select("doc_id", "toxic")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    toxic = F.col("toxic") == 1
    categories = {"first": toxic & F.col("text").rlike("(?i)\\b(idiot|moron|stupid)\\b"), "toxic": toxic}
    model = toxicity.fit(toxicity.sampled(docs, labels.filter(half == 0), "doc_id", "text", categories, 10_000), list(categories))
    got = toxicity.score(docs, model, list(categories)).join(labels.filter(half == 1), "doc_id").toPandas()
    called, true = got["p_toxic"] >= model[2], got["toxic"] == 1
    print("toxic held out:", int((called & true).sum()), "found of", int(true.sum()), "with", int((called & ~true).sum()), "false alarms of", len(got))
    assert (called & true).sum() >= 0.6 * true.sum() and (called & ~true).sum() <= 0.03 * len(got)


def test_toxicity_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (77, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.sampled(docs, labels, "doc_id", "text", {"toxic": F.col("toxic") == 1}, 10), ["toxic"])
    rows = toxicity.score(docs, model, ["toxic"]).collect()
    assert len(rows) == 4 and all(r["p_toxic"] < 0.01 for r in rows)
    assert toxicity.score(docs.limit(0), model, ["toxic"]).count() == 0


def test_weak_labels_recover_known_accuracies():
    # Patterns of six labellers drawn from a model whose bad texts are called bad by labellers 1 and 3.
    B, G, N = quality_classifier.BAD, quality_classifier.GOOD, quality_classifier.NOTHING
    code = lambda v: sum(x * 3 ** (5 - k) for k, x in enumerate(v))
    counts = {code((G,) * 6): 8000, code((G, B, G, B, G, G)): 700, code((G, B, G, G, G, G)): 40, code((N,) * 6): 100}
    hit, slip, good, posterior = quality_classifier.estimate(counts)
    assert posterior[code((G,) * 6)] > 0.8 and posterior[code((G, B, G, B, G, G))] < 0.05
    assert hit[1] > 0.5 and hit[3] > 0.5 and max(slip) < 0.02 and abs(good - 8100 / 8840) < 0.03


def test_weak_labels_equal_a_plain_estimation():
    """The same model over single texts instead of pattern counts, in plain loops, on votes drawn from known accuracies."""
    Q, rng = quality_classifier, np.random.default_rng(2)
    hit, slip = [0.9, 0.5, 0.4, 0.7, 0.3, 0.6], [0.02, 0.05, 0.01, 0.03, 0.02, 0.04]
    rows = []
    for _ in range(1500):
        rates = hit if rng.random() < 0.2 else slip
        rows.append([Q.NOTHING if rng.random() < 0.1 else Q.BAD if rng.random() < r else Q.GOOD for r in rates])
    code = lambda v: sum(x * 3 ** (5 - k) for k, x in enumerate(v))
    got_hit, got_slip, got_good, posterior = Q.estimate(Counter(map(code, rows)))
    h, s, g = [Q.START_HIT] * 6, [Q.START_SLIP] * 6, Q.START_GOOD
    for _ in range(Q.ROUNDS):
        bad = []
        for v in rows:
            x, y = 1 - g, g
            for k, vote in enumerate(v):
                if vote != Q.NOTHING:
                    x *= h[k] if vote == Q.BAD else 1 - h[k]
                    y *= s[k] if vote == Q.BAD else 1 - s[k]
            bad.append(x / (x + y))
        for k in range(6):
            for rates, weight, start in ((h, bad, Q.START_HIT), (s, [1 - b for b in bad], Q.START_SLIP)):
                votes = [(w, v[k] == Q.BAD) for w, v in zip(weight, rows) if v[k] != Q.NOTHING]
                rates[k] = (sum(w for w, b in votes if b) + Q.PSEUDO * start) / (sum(w for w, _ in votes) + Q.PSEUDO)
        g = (sum(1 - b for b in bad) + Q.PSEUDO * Q.START_GOOD) / (len(rows) + Q.PSEUDO)
    assert np.allclose(got_hit, h) and np.allclose(got_slip, s) and np.isclose(got_good, g)
    assert np.abs(np.array(h) - hit).max() < 0.12 and abs(g - 0.8) < 0.04
    assert all(np.isclose(posterior[code(v)], 1 - b) for v, b in zip(rows, bad))


def test_sampled_texts_are_bounded_where_a_key_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k % 300}") for k in range(900)] + [(2, "you idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.sampled(docs, labels, "doc_id", "text", {"toxic": F.col("toxic") == 1}, 50)
    assert len(rows) <= 51 and set(rows["toxic"]) <= {0.0, 1.0}


def test_classifier_stage_rejects_junk_that_the_rules_keep(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    words = [w for w in quality_rules.STOP_WORDS]
    shout = [" ".join((f"{words[(k + i) % 70]} SALE{k}{i} DEAL!".upper()) for i in range(40)) for k in range(60)]
    junk = spark.createDataFrame([(50_000 + k, t, "en", "shop", len(t)) for k, t in enumerate(shout)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    ruled = corpus_pipeline.common.saved(stages["quality rules"](spark, docs.unionByName(junk), BASE))
    assert ruled.filter("doc_id >= 50000").count() == 60
    kept = stages["quality classifier"](spark, ruled, BASE)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 50000").count() <= 3
    assert kept.filter("doc_id < 50000").count() >= 0.99 * ruled.filter("doc_id < 50000").count()


def test_classifier_rejects_junk_and_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    junk = [(10_000 + k, t) for k, t in enumerate(["BUY NOW!!! $$$ CLICK HERE!!! ### " * 20 + f"OFFER{k}!!!" for k in range(30)])]
    odd = [(20_000, None), (20_001, ""), (20_001, "")]
    df = docs.unionByName(spark.createDataFrame(junk + odd, "doc_id long, text string")).withColumn("score", F.lit("mine"))
    out = quality_classifier.judge(df).toPandas()
    assert len(out) == df.count() and out["kept"].notna().all()
    labels = spark.read.parquet(f"{BASE}/labels.parquet").select("doc_id", "quality").toPandas()
    seen = pd.merge(out, labels, on="doc_id")
    good, bad = seen[seen["quality"] == 1]["kept"].mean(), seen[seen["quality"] == 0]["kept"].mean()
    print("kept of labelled good, bad:", good, bad, "rejected of all:", int((~out["kept"]).sum()))
    assert out[out["doc_id"].between(10_000, 10_029)]["kept"].mean() < 0.1
    assert good >= 0.97 and good > bad
    kept = quality_classifier.keep(df)
    assert kept.columns == df.columns and kept.count() == out["kept"].sum()


def test_classifier_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_classifier.judge(none).count() == quality_classifier.keep(none).count() == 0


def test_toxicity_query_equals_a_plain_chain(spark):
    """The registered query against the same fit, applied to every text in plain loops."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    said = lambda words: F.col("text").rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    toxic = F.col("toxic") == 1
    categories = {"insult": toxic & said(toxicity.INSULTS), "contempt": toxic & said(toxicity.CONTEMPT), "toxic": toxic}
    chosen, models, cut = toxicity.fit(toxicity.sampled(docs, labels.select("doc_id", "toxic"), "doc_id", "text", categories, toxicity.SAMPLE), list(categories))
    place = {int(b): k for k, b in enumerate(chosen)}
    got = {r["doc_id"]: r for r in toxicity.query(spark, small).collect()}
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        mine, before = [place[int(b)] for b in toxicity.features(r["text"]) if int(b) in place], []
        for w, earlier, intercept in models:
            z = sum(float(w[k]) for k in mine) + sum(e * p for e, p in zip(earlier, before)) + intercept
            before.append(1 / (1 + np.exp(-z)))
        assert np.allclose([got[r["doc_id"]][f"p_{c}"] for c in categories], before, atol=1e-9)
        assert got[r["doc_id"]]["toxic"] == (before[-1] >= cut)
