"""Regular paths along lines of descent: answers from those a step on, against relations composed pair by pair and against the walk."""

import random

import pytest
from test_regular_paths import relation

from kinweave.operators import regular_paths as RP
from kinweave.operators.regular_paths import any_of, step

A, B, C = step("a"), step("b"), step("c")
EXPRESSIONS = [(A | B).plus(), (~A).star() + C + any_of("b", "a"), (~(A | B)).plus() + A, A.star() + B.star() + (~C).maybe()]


def _graph(spark, k):
    """Edges only from greater to less nodes, by which some nodes are reached in several ways and lengths."""
    rng = random.Random(k)
    edges = {(x, p, rng.randrange(max(0, x - 7), max(1, x - 1))) for x in range(1, 15) for p in "abc" if rng.random() < 0.7}
    rows = [*edges, *list(edges)[:4], (None, "a", 3), (2, "a", None), (2, "other", 4)]
    return edges, spark.createDataFrame(rows, "src int, pred string, dst int")


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)))
def test_answers_from_a_step_on_equal_composed_relations(spark, k, monkeypatch):
    edges, frame = _graph(spark, k)
    anchors = spark.createDataFrame([(n,) for n in [*range(12), 3, None]], "id int")
    monkeypatch.setattr(RP, "_walked", lambda *_: pytest.fail("rows were walked"))
    got = {(r["anchor"], r["node"]): (r["dist"], tuple(r["word"])) for r in RP.reach(frame, anchors, EXPRESSIONS[k]).collect()}
    assert got == {p: v for p, v in relation(EXPRESSIONS[k], edges, range(15)).items() if p[0] < 12}


def test_long_answers_are_walked(spark, monkeypatch):
    edges, frame = _graph(spark, 9)
    anchors = spark.createDataFrame([(n,) for n in range(15)], "id int")
    whole = {tuple(map(str, r)) for r in RP.reach(frame, anchors, (A | B).plus()).collect()}
    walked, walk = [], RP._walked
    monkeypatch.setattr(RP, "ARRAY", 3)
    monkeypatch.setattr(RP, "_walked", lambda *x: walked.append(1) or walk(*x))
    assert {tuple(map(str, r)) for r in RP.reach(frame, anchors, (A | B).plus()).collect()} == whole and walked
