"""Contexts are made for the questions that are left, not for every candidate."""

from conftest import SMALL

from kinweave.operators import dataset as D
from kinweave.operators import paths as P
from kinweave.plans import registry
from kinweave.sources.pedigree import persons


def test_contexts_only_of_sampled_questions(spark, monkeypatch):
    p = persons(spark, SMALL).localCheckpoint()
    edges, people = registry._edges(p).localCheckpoint(), registry._people(p)
    anchors, walk = [], P.walk
    monkeypatch.setattr(P, "walk", lambda e, a, w: anchors.append(a.count()) or walk(e, a, w))
    got = {(r["anchor_person"], r["question_text"]): (r["context"], r["proof_graph_size"]) for r in D.further(edges, people, "crow", (4,), 5).collect()}
    assert anchors and max(anchors) <= 5
    monkeypatch.undo()
    mine = sorted({x for s, x, *_ in D.K.overrides(True) if s == "crow" and x.count(".") == 3})
    rows = D.override_rows(D.path_rows(edges, people, mine), "crow", True).collect()
    whole = {(f"person_{r['anchor']}", r["question_text"]): (r["context"], r["size"]) for r in rows}
    assert len(got) == 5 and all(whole[k] == v for k, v in got.items())
