"""Regular paths against relations composed pair by pair, on graphs with circles."""

import random

import pytest

from kinweave.operators import regular_paths as RP
from kinweave.operators.regular_paths import NOTHING, any_of, step

A, B, C = step("a"), step("b"), step("c")


def relation(path, edges, nodes):
    """(x, y) -> (distance, word), built up from the parts."""
    better = lambda into, k, v: into.__setitem__(k, min(into.get(k, v), v))
    out = {}
    if path.kind == "step":
        for s, p, d in edges:
            if p == path.pred:
                better(out, (d, s) if path.back else (s, d), (1, ("^" * path.back + p,)))
    elif path.kind == "then":
        out = {(n, n): (0, ()) for n in nodes}
        for part in path.parts:
            out = joined(out, relation(part, edges, nodes))
    elif path.kind == "either":
        for part in path.parts:
            for k, v in relation(part, edges, nodes).items():
                better(out, k, v)
    else:
        out, one = {(n, n): (0, ()) for n in nodes}, relation(path.parts[0], edges, nodes)
        while True:
            more = dict(out)
            for k, v in joined(out, one).items():
                better(more, k, v)
            if more == out:
                break
            out = more
    return out


def joined(one, two):
    out, by = {}, {}
    for (m, y), v in two.items():
        by.setdefault(m, []).append((y, v))
    for (x, m), (d, w) in one.items():
        for y, (e, z) in by.get(m, ()):
            out[x, y] = min(out.get((x, y), (d + e, w + z)), (d + e, w + z))
    return out


EXPRESSIONS = [A, ~A, A + ~B, A | B, (A | B).star(), (A + B).plus(), ((A | ~C) + B.maybe()).plus() + C, A.times(2, 4), any_of("a", "b", "c").times(3), (~(A + B)).star() + C.maybe(), NOTHING, (A.star() + B).star(), A.times(0, 2) + (B | NOTHING)]


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)))
def test_reach_equals_composed_relations(spark, k):
    rng = random.Random(k)
    nodes = list(range(14))
    edges = {(rng.choice(nodes), rng.choice("abc"), rng.choice(nodes)) for _ in range(26)}
    rows = [*edges, *list(edges)[:5], (None, "a", 3), (2, None, 3), (2, "a", None), (2, "other", 4)]
    frame = spark.createDataFrame([(*e, "x") for e in rows], "src int, pred string, dst int, node string")
    anchors = spark.createDataFrame([(n, 1) for n in [*nodes[:9], 3, None]], "id int, anchor int")
    got = {(r["anchor"], r["node"]): (r["dist"], tuple(r["word"])) for r in RP.reach(frame, anchors, EXPRESSIONS[k]).collect()}
    want = relation(EXPRESSIONS[k], edges, nodes)
    assert got == {p: v for p, v in want.items() if p[0] < 9}


def test_empty_tables_and_bounds(spark):
    frame = spark.createDataFrame([(1, "a", 2)], "src int, pred string, dst int")
    anchors = spark.createDataFrame([(1,)], "id int")
    assert RP.reach(frame, anchors.limit(0), A.star()).count() == 0 and RP.reach(frame.limit(0), anchors, A).count() == 0
    assert [tuple(r) for r in RP.reach(frame.limit(0), anchors, A.star()).collect()] == [(1, 1, 0, [])]
    with pytest.raises(ValueError):
        A.times(3, 2)


def test_equal_futures_share_a_state():
    plan = RP.automaton((A | B | C).star())
    assert plan.cyclic and len({s for s, *_ in plan.moves}) == 1
    assert not RP.automaton(A.times(1, 3) + B.maybe()).cyclic


def test_exactly_lists_every_word(spark):
    edges = [(1, "a", 2), (1, "b", 2), (2, "a", 3), (2, "a", 1), (3, "c", 4), (1, "c", 5)]
    frame = spark.createDataFrame(edges, "src int, pred string, dst int")
    anchors = spark.createDataFrame([(1,), (2,)], "id int")
    got = {(r["anchor"], r["node"]): [tuple(w) for w in r["words"]] for r in RP.exactly(frame, anchors, ["a", "b"], 2).collect()}
    assert got == {(1, 3): [("a", "a"), ("b", "a")]}
