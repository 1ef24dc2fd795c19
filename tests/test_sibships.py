"""Relatives counted by sibship in many small blocks, against the relations pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import genealogy as G
from kinweave.operators import sibships as S


@pytest.fixture(scope="module", params=range(2))
def people(spark, request):
    """Persons with one, two or no known parents, kin who have children together, also of different generations, and a person of unknown sex."""
    rng, rows = random.Random(request.param), [(1, "M", None, None), (2, "F", None, None), (3, "M", None, None), (4, "F", None, None)]
    while len(rows) < 90:
        near = rows[-24:]
        father, mother = (rng.choice([x[0] for x in near if x[1] != sex] or [None]) for sex in "FM")
        father, mother = (None if rng.random() < 0.06 else x for x in (father, mother))
        rows += [(len(rows) + k, rng.choice("MF") if rng.random() < 0.97 else None, father, mother) for k in range(1, rng.choice((2, 3, 4)))]
    return spark.createDataFrame([(*r, None) for r in rows], "id int, sex string, father_id int, mother_id int, spouse_id int").localCheckpoint()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 24)
    monkeypatch.setattr(S, "PART_BYTES", 1 << 13)


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_totals_of_common_ancestors(people):
    pairs = G.mrca(people).groupBy("a", "da", "db").agg(F.count("*").alias("n"), F.sum("b"), F.sum("mrca"))
    assert _set(G.mrca_totals(people)) == _set(pairs)


def test_totals_of_cousins_and_kin(people):
    found = G.cousins(people).localCheckpoint()
    assert _set(G.cousin_totals(people)) == _set(found.groupBy("src", "degree", "type").agg(F.count("*"), F.sum("dst")))
    for system in ("hawaiian", "dravidian"):
        edges = G.kin_edges(people, system, found).groupBy("src", "pred").agg(F.count("*"), F.sum("dst"))
        assert _set(G.kin_totals(people, system)) == _set(edges)


def test_no_parents_no_relatives(spark):
    alone = spark.createDataFrame([(1, "M"), (2, "F")], "id int, sex string").selectExpr("*", "int(null) as father_id", "int(null) as mother_id", "int(null) as spouse_id")
    assert G.mrca_totals(alone).count() == 0 and G.cousin_totals(alone.limit(0)).count() == 0


def test_pairs_are_compared_by_profile(people, monkeypatch):
    """Far fewer comparisons than pairs of persons, for all their relatives."""
    import numpy as np

    block = lambda number, members: S._Block({"block": number, "ships": len(members), "of_member": np.arange(len(members), dtype=np.int32).tobytes(), "member": np.array(members, np.int64).tobytes(), "known": np.array([1, 2], np.int64).tobytes(), "of_anc": np.repeat(np.arange(len(members), dtype=np.int32), 2).tobytes(), "column": np.tile(np.array([0, 1], np.int32), len(members)).tobytes(), "dist": np.tile(np.array([3, 3], np.uint16), len(members)).tobytes(), "code": np.zeros(2 * len(members), np.uint8).tobytes()})
    seen, closest = [], S._closest
    monkeypatch.setattr(S, "_closest", lambda a, b, shared, da, db: seen.append(len(da) * len(db)) or closest(a, b, shared, da, db))
    a, b = block(0, range(10, 1010)), block(1, range(2000, 3000))
    whole, single = S._Totals(1000), S._Totals(1000)
    S._meet(a, b, False, whole, single)
    assert seen == [1] and whole.cells[0][whole.columns[3 << 32 | 3]].tolist() == [1000] * 1000


def test_blocks_that_share_no_younger_ancestors_do_not_meet(people, monkeypatch):
    """Relatives by the oldest are counted by kinds; the same totals, whichever are the oldest."""
    monkeypatch.setattr(S, "MANY", 2)
    monkeypatch.setattr(S, "totals", lambda *_: pytest.fail("every block met every other"))
    pairs = G.mrca(people).groupBy("a", "da", "db").agg(F.count("*").alias("n"), F.sum("b"), F.sum("mrca"))
    assert _set(G.mrca_totals(people)) == _set(pairs)
    found = G.cousins(people).localCheckpoint()
    assert _set(G.cousin_totals(people)) == _set(found.groupBy("src", "degree", "type").agg(F.count("*"), F.sum("dst")))
    monkeypatch.setattr(S, "_oldest", lambda members, above: members.filter("id % 3 = 0").select(F.col("id").alias("anc")))
    assert _set(G.mrca_totals(people)) == _set(pairs)
