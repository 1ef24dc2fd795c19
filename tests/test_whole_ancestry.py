"""Ancestors, MRCA, cousins and marriage rules of any depth, against a walk over the pedigree."""

from collections import Counter

import pytest
from conftest import SMALL

from kinweave.operators import genealogy as G
from kinweave.plans import registry
from kinweave.sources.pedigree import persons


@pytest.fixture(scope="module")
def people(spark):
    return {r["id"]: r for r in persons(spark, SMALL).collect()}


@pytest.fixture(scope="module")
def closest(people):
    """(a, b) -> (mrca, da, db)."""

    def above(x):
        dist, front, k = {}, {x}, 0
        while front:
            dist |= {y: k for y in front if y not in dist}
            front = {z for y in front for z in (people[y]["mother_id"], people[y]["father_id"]) if z is not None and z not in dist}
            k += 1
        return dist

    up = {x: above(x) for x in people}
    out = {}
    for a in people:
        for b in people:
            shared = [(up[a][c] + up[b][c], c, up[a][c], up[b][c]) for c in up[a].keys() & up[b].keys()]
            if a != b and shared:
                out[a, b] = min(shared)[1:]
    return out


def test_all_common_ancestors(spark, closest):
    got = {(r["a"], r["b"]): (r["mrca"], r["da"], r["db"]) for r in G.mrca(persons(spark, SMALL)).collect()}
    assert got == closest and max(x[1] for x in got.values()) > 2
    counts = {(r["a"], r["da"], r["db"]): r["n"] for r in registry.queries()["mrca_pairs"](spark, SMALL).collect()}
    assert counts == Counter((a, da, db) for (a, _), (_, da, db) in closest.items())


def test_cousins_of_any_degree(spark, people, closest):
    def link(x, m, n):
        """The relative of x through whom m is reached, as the walk finds it."""
        parents = lambda y: (people[y]["mother_id"], people[y]["father_id"])
        cur = x
        for _ in range(n - 1):
            if parents(cur) == (None, None):
                return None
            for side in (0, 1):
                step = parents(cur)[side]
                if step is not None:
                    if step == m or m in parents(step):
                        return step
                    cur = step
        mother, father = parents(x)
        return mother if mother is not None and m in parents(mother) else father

    want = {}
    for (a, b), (m, da, db) in closest.items():
        if da == db >= 2:
            la, lb = link(a, m, da), link(b, m, db)
            if la is not None and lb is not None:
                want[a, b] = (da - 1, "parallel" if people[la]["sex"] == people[lb]["sex"] else "cross")
    got = {(r["src"], r["dst"]): (r["degree"], r["type"]) for r in G.cousins(persons(spark, SMALL)).collect()}
    assert got == want and max(d for d, _ in want.values()) > 1


def test_hawaiian_forbids_cousins_of_any_degree(spark, closest):
    got = {(r["a"], r["b"]): r["allowed"] for r in registry.queries()["marriage_ok_hawaiian"](spark, SMALL).collect()}
    far = [k for k in got if k in closest and min(closest[k][1:]) >= 2]
    assert not any(got[k] for k in far) and any(max(closest[k][1:]) > 2 for k in far)


@pytest.mark.parametrize("system", ["crow", "omaha"])
def test_clan_totals_are_those_of_the_pairs(spark, system):
    p = persons(spark, SMALL)
    pairs = Counter((r["src"], r["pred"]) for r in G.clan_edges(p, system).collect())
    assert {(r["src"], r["pred"]): r["n"] for r in G.clan_degrees(p, system).collect()} == pairs


def test_long_lines_end_at_their_founder(spark):
    p = spark.range(1, 151).selectExpr("int(id) as id", "'F' as sex", "int(null) as father_id", "int(nullif(id - 1, 0)) as mother_id", "int(null) as spouse_id")
    assert {r["founder"] for r in G.clans(p).collect()} == {1}
