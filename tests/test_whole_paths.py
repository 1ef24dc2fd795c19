"""Override questions over all paths: golds of paths that share a wording are united."""

from conftest import SMALL

from kinweave.functions import kinship_terms as K
from kinweave.plans import registry


def test_golds_of_a_wording_are_united(same_rows, spark):
    name = "cat4_hawaiian"
    same_rows(registry.queries()[name], registry.oracle_sql()[name])
    rows = registry.queries()[name](spark, SMALL).collect()
    assert len({r["question_text"] for r in rows}) == len(rows)
    assert max(r["path"].count(".") for r in rows) >= 3
    every = {t for p, t in K.paths(extended=True).items()}
    assert any("|" in r["gold"] for r in rows) and all(set(r["gold"].split("|")) <= every for r in rows if r["kind"] == "disambiguation")


def test_every_path_is_counted(same_rows):
    same_rows(registry.queries()["cultural_terms_crow"], registry.oracle_sql()["cultural_terms_crow"])
