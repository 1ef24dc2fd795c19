"""SimHash and embedding near-duplicates against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from kinweave.llm import embedding_dedup, registry, simhash


def roots(keys, pairs):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {k: find(k) for k in keys}


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {k: by_hand(t) for k, t in texts.items()}
    want = roots(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = registry.queries()["op2_simhash_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}
    assert len(got) == len(fps)


def test_simhash_components_in_full_buckets(spark):
    rng = np.random.default_rng(1)
    fps = {0}
    while len(fps) < 400:  # one block pair in common: a bucket far beyond PAIRED
        x = rng.choice(sorted(fps)) if rng.random() < 0.6 else int(rng.integers(0, 1 << 32)) << 32
        for b in rng.integers(32, 64, rng.integers(1, 4)):
            x = int(x) ^ (1 << int(b))
        fps.add(int(x))
    order = sorted(fps)
    keys = {f: k for k, f in enumerate(order)}
    want = roots(range(len(order)), [(keys[a], keys[b]) for a, b in combinations(order, 2) if (a ^ b).bit_count() <= 2])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(keys[f], signed(f)) for f in order], "key long, fp long")
    got = {r["cls"]: r["component_id"] for r in simhash.components(rows).collect()}
    assert got == {signed(f): want[keys[f]] for f in order}


def test_simhash_defined_cases(spark):
    rows = [(5, None), (4, " \t\n"), (3, "One"), (2, "one"), (2, "one"), (None, "one"), (9, "lone words here that differ from all")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.dedup(df).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 2), (4, 4), (5, 4), (9, 9)]
    for similarity in (None, simhash.SIMILARITY):
        kept = simhash.representatives(df, similarity=similarity)
        assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4, 9]
    assert simhash.dedup(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def test_embedding_query_equals_brute_force(same_rows):
    same_rows(registry.queries()["op4_embedding_dedup"], registry.oracle_sql()["op4_embedding_dedup"])


def test_embedding_recall_on_a_dense_cloud(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    v = (centres[rng.integers(0, 60, 900)] + 0.22 * rng.standard_normal((900, 32))).astype(np.float32)
    label = rng.integers(0, 3, 900)
    rows = spark.createDataFrame([(k, v[k].tolist(), int(label[k]), "x") for k in range(900)], "vec_id long, embedding array<float>, label int, c string")
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    want = linked.sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(rows).collect()}
    assert all(got[k] <= want[k] for k in got) and want.sum() > 500
    assert sum(got.values()) >= 0.9 * want.sum()


@pytest.mark.parametrize("share, dim, spread", [(1.0, 64, 0.1), (0.6, 64, 0.1), (0.33, 64, 0.1), (0.6, 16, 0.2), (0.5, 200, 0.06), (0.9, 3, 0.3)])
def test_embedding_recall_where_one_group_is_dense(spark, share, dim, spread):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(dim) / np.sqrt(dim)
    dense = rng.random(300) < share
    v = np.where(dense[:, None], centre + spread * rng.standard_normal((300, dim)) / np.sqrt(dim) * 2, rng.standard_normal((300, dim))).astype(np.float32)
    rows = spark.createDataFrame([(k, v[k].tolist(), 1) for k in range(300)], "vec_id long, embedding array<float>, label int")
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(rows).collect()}
    print("recall", share, dim, sum(got.values()) / want.sum(), want.sum())
    assert all(got[k] <= want[k] for k in got) and want.sum() > 500 and sum(got.values()) >= 0.97 * want.sum()


@pytest.mark.parametrize("dim, mean", [(64, 0.2), (64, 0.5), (64, 0.7), (384, 0.5), (384, 0.7)])
def test_few_candidates_and_all_links_where_vectors_share_a_direction(spark, dim, mean):
    rng = np.random.default_rng(dim)
    common = rng.standard_normal(dim) / np.sqrt(dim)
    v = np.sqrt(mean) * common + np.sqrt(1 - mean) * rng.standard_normal((1000, dim)) / np.sqrt(dim)
    for k in range(100):  # links at cosines from 0.93 to 0.97
        x, e = v[k], rng.standard_normal(dim)
        e -= x * (e @ x) / (x @ x)
        c = 0.932 + 0.038 * k / 100
        v[500 + k] = c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * e / np.linalg.norm(e)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))}
    classes = embedding_dedup.different(spark.createDataFrame([(k, v[k].tolist(), 1) for k in range(1000)], "key long, v array<double>, label int")).cache()
    key = {r["c"]: r["least"] for r in classes.collect()}
    met = [tuple(sorted((key[r["a"]], key[r["b"]]))) for r in embedding_dedup.candidates(classes, embedding_dedup.fit(v)).collect()]
    print("candidates", dim, mean, len(met) / (1000 * 999 / 2), "recall", len(want & set(met)) / len(want), len(want))
    assert len(met) == len(set(met)) < 0.05 * 1000 * 999 / 2
    assert len(want) >= 100 and len(want & set(met)) >= 0.9 * len(want)


def test_every_length_of_vectors_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [*map(float, 5 * np.eye(d)[0] + 0.1 * rng.standard_normal(d))], 1) for k, d in enumerate([2] * 7 + [3] * 4 + [70] * 5 + [9])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (6, 0) for k in range(7)} | {k: (3, 7) for k in range(7, 11)} | {k: (4, 11) for k in range(11, 16)} | {16: (0, 16)}


def test_embedding_defined_cases(spark):
    nan = float("nan")
    rows = [(4, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (5, [2.0, 4.0], 1), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 2.0], None), (12, [float("inf"), 1.0], 1), (13, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(df).collect()}
    assert len(got) == len(rows)
    assert got[3] == (2, 3, True) and got[4] == (2, 3, False) and got[5] == (2, 3, False)
    assert all(got[k] == (0, k, True) for k in (2, 6, 7, 8, 9, 10, 11, 12, 13))
    assert embedding_dedup.dedup(df.limit(0)).count() == 0
