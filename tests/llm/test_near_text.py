"""Near-duplicates by five-word shingles against brute force."""

import random
from itertools import combinations

import numpy as np
from conftest import SMALL
from test_dedup import roots

import corpus_pipeline
from kinweave.llm import simhash


def grams(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def by_hand(texts):
    sets = {k: grams(t) for k, t in texts.items()}
    alike = lambda x, y: x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0
    return roots(sorted(sets), [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])])


def test_edited_copies_go_in_the_pipeline_stage(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:  # one edit: 111 of 121 shingles shared; four edits spread out: below 0.8
        texts.append(" ".join(b[:60] + ["edited"] + b[61:]))
        texts.append(" ".join("other" if i in (20, 45, 70, 95) else w for i, w in enumerate(b)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, rows, SMALL).collect())
    want = by_hand(dict(enumerate(texts)))
    assert got == sorted(k for k, r in want.items() if k == r) and len(got) == 12


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = by_hand({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs).collect()} == want


def test_crowded_buckets_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(300):  # chains of edits round one text: some pairs reach 0.8, many do not
        t = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            t[at] = f"x{rng.integers(0, 3)}"
        texts[k] = " ".join(t[: rng.integers(40, 61)])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = by_hand(texts)
    assert len(set(want.values())) > 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(rows).collect()} == want


def test_defined_cases(spark):
    rows = [(5, None), (4, " \t\n"), (3, "One"), (2, "one"), (2, "one"), (None, "one"), (9, "lone words here that differ from all"), (2, "a second text under a repeated id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "one"), (2, "a second text under a repeated id"), (2, "one"), (4, " \t\n"), (9, "lone words here that differ from all")]
    assert simhash.near_dedup(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_components_are_right_and_finished_stars_cost_few_jobs(spark):
    from kinweave.llm.graph import connected_components

    rng = random.Random(5)
    shapes = {
        "chain": [(k, k + 1) for k in range(40)],
        "two chains, mixed": [(k * 7 % 41, (k + 1) * 7 % 41) for k in range(40)] + [(100 + k, 101 + k) for k in range(9)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "repeated and reversed": [(1, 2), (2, 1), (1, 2), (3, 2), (5, 5), (-4, 9), (9, 8)],
        "stars": [(k, 10 * (k // 10)) for k in range(1, 60) if k % 10],
        "double star": [(k, 0) for k in range(2, 20)] + [(k, 1) for k in range(2, 20)],
        "loops only": [(3, 3)],
        "none": [],
    }
    jobs = {}
    for name, edges in shapes.items():
        df = spark.createDataFrame(edges, "a long, b long")
        rows, jobs[name] = _jobs(spark, name, lambda df=df: connected_components(df, "a", "b").collect())
        assert len(rows) == len({r["node"] for r in rows}), name
        assert {r["node"]: r["root"] for r in rows} == _components([e for e in edges if e[0] != e[1]]), name
    assert jobs["stars"] <= 12, jobs
