"""Given pairs go up only until they meet, with the results of the relation of all pairs."""

import random

from conftest import SMALL

from kinweave.operators import genealogy as G
from kinweave.plans import registry

PERSON = "id int, sex string, mother_id int, father_id int, spouse_id int"


def _people():
    """Half siblings, single parents, unions across generations and a line of 30 generations with two ends."""
    rng, rows = random.Random(3), []
    for i in range(1, 61):
        mother = rng.choice([None, *range(max(1, i - 16), i)]) if i > 8 else None
        father = rng.choice([None, *range(max(1, i - 16), i)]) if i > 8 else None
        if rng.random() < 0.4 and i > 12:
            mother, father = rows[-1][2:4]
        rows.append((i, rng.choice("MF"), mother, father if father != mother else None, None))
    for line in (100, 200):
        rows += [(line + k, rng.choice("MF"), line + k - 1 if k else 60, None, None) for k in range(14)]
    return rows


def test_pairs_have_the_relation_of_all_pairs(spark):
    p = spark.createDataFrame(_people(), PERSON)
    ids = p.select("id").withColumnRenamed("id", "a")
    pairs = ids.crossJoin(ids.withColumnRenamed("a", "b"))
    mrca, kin = ({tuple(r) for r in G.mrca(*args).collect()} for args in ((p,), (p, pairs)))
    assert mrca == kin and any(0 in r[3:] for r in kin) and (113, 213, 60, 14, 14) in kin and len(kin) > 500
    every, given = ({tuple(r) for r in G.cousins(*args).collect()} for args in ((p,), (p, pairs)))
    assert every == given and len(given) > 20


def test_a_rule_compares_whole_lines_of_few_persons(spark, monkeypatch):
    asked, arrays = [], G.ancestor_arrays
    monkeypatch.setattr(G, "ancestor_arrays", lambda p, depth=None: asked.append(p.count()) or arrays(p, depth))
    all_ = registry.queries()["marriage_ok_hawaiian"](spark, SMALL)
    assert all_.count() > 700 and asked[0] < 40  # of 150 persons
