"""Importance resampling against a plain computation, and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from kinweave.llm import importance_resampling as ir
from kinweave.llm import registry


def grams(text, orders=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, orders=2, least=20, share=25, seed=7):
    """(doc_id, n_features, weight, score, rank) of each row."""
    s, t = Counter(b for _, x in docs for b in grams(x, orders)[1]), Counter(b for x in target for b in grams(x, orders)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        n, f = grams(x, orders)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: share * len(able) // 100], 1)}
    return sorted(((r[0], *r[2:], drawn.get(id(r))) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "w") for i, t in rows], "doc_id long, text string, row string, b1 int, score string")


def scored(docs, target, **kw):
    return sorted((tuple(r) for r in ir.scored(docs, target, **kw).select("key", "n_features", "weight", "score", "rank").collect()), key=str)


def test_small_tables_give_the_oracle_rows(same_rows):
    same_rows(registry.queries()["op12_importance_resampling"], registry.oracle_sql()["op12_importance_resampling"])


ROWS = [(1, None), (2, ""), (3, " .,\n"), (4, "One"), (5, "É Éa ÉA b AB ab straße \U0001f600 x9 9 a-b_c"), (None, "word " * 30), (7, "the same words over again " * 12), (7, "the same words over again " * 12), (8, "the same words over again " * 12), (9, "x " * 25 + "end"), *((k, f"text {k % 5} of some words " * 6) for k in range(10, 40))]
TARGET = ["text 3 of some words", None, "", "same words"]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_rows_equal_a_plain_computation(spark, orders):
    docs, target = frame(spark, ROWS), frame(spark, list(enumerate(TARGET)))
    assert scored(docs.repartition(3), target, orders=orders) == plain(ROWS, TARGET, orders)


def test_very_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    rows = [(k, " ".join(f"W{(i * i + k) % 977}" for i in range(n))) for k, n in enumerate((20_000, 4096, 4097, 8192, 19, 4095))]
    docs, target = frame(spark, rows), frame(spark, [(1, rows[0][1][:5000])])
    for orders in (2, 3):
        assert scored(docs, target, orders=orders) == plain(rows, [rows[0][1][:5000]], orders)


def test_empty_tables(spark):
    docs = frame(spark, ROWS)
    none = docs.limit(0)
    assert scored(none, docs) == [] and scored(none, none) == [] and ir.drawn(none, docs).count() == 0
    assert scored(docs, none) == plain(ROWS, [])


def test_drawn_rows_keep_their_columns(spark):
    docs, target = frame(spark, ROWS), frame(spark, list(enumerate(TARGET)))
    got = ir.drawn(docs, target, share=50)
    want = [r[0] for r in plain(ROWS, TARGET, share=50) if r[4] is not None]
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0 for r in got.collect())) == sorted(x or 0 for x in want)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} <= set(ROWS)
