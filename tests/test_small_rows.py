"""What walks and rules carry along: a letter a step, and no ancestors beyond those that a rule can ask about."""

from conftest import SMALL

from kinweave.operators import genealogy as G
from kinweave.operators import regular_paths as RP
from kinweave.operators.regular_paths import step
from kinweave.plans import registry


def test_words_grow_as_texts(spark, monkeypatch):
    kept, written = [], RP.written
    monkeypatch.setattr(RP, "written", lambda df: kept.append(df) or written(df))
    edges = spark.createDataFrame([(1, "b", 2), (3, "a", 2), (3, "long name", 4)], "src int, pred string, dst int")
    got = RP.reach(edges, spark.createDataFrame([(1,)], "id int"), step("b") + ~step("a") + step("long name"))
    assert [tuple(r) for r in got.collect()] == [(1, 4, 3, ["b", "^a", "long name"])]
    assert all(t != "array<string>" for df in kept for _, t in df.dtypes)


def test_near_rules_ask_for_near_ancestors(spark, monkeypatch):
    depths, arrays = [], G.ancestor_arrays
    monkeypatch.setattr(G, "ancestor_arrays", lambda p, depth=None: depths.append(depth) or arrays(p, depth))
    for system in ("eskimo", "sudanese", "hawaiian"):
        registry.queries()[f"marriage_ok_{system}"](spark, SMALL)
    assert depths == [4, 4, None]
