"""Further questions of all systems, each from the graph that it needs."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from kinweave.operators import dataset as D
from kinweave.operators import genealogy as G
from kinweave.sources.pedigree import persons
from kinweave.sources.shared import written


def test_each_system_takes_its_own_graph(spark):
    p = written(persons(spark, SMALL))
    edges = written(G.parent_edges(p).unionByName(G.spouse_edges(p)).unionByName(G.sibling_edges(p)))
    people = p.select("id", F.concat(F.lit("P"), "id").alias("name"))
    other = people.withColumn("name", F.concat(F.lit("Q"), "id"))
    graphs = {(s, span): (edges, other if span == "extended" else people) for s, span in D.LONG_HOP_GRAPH.items()}
    rows = D.further_of_all(graphs).select("question_id", "kinship_system", "anchor_name", "n_hops", D.path_label(F.col("path")).alias("label")).collect()
    assert {r["kinship_system"] for r in rows} == set(D.LONG_HOP_GRAPH) and len({r["question_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["anchor_name"][0] == ("Q" if D.LONG_HOP_GRAPH[r["kinship_system"]] == "extended" else "P")
        assert r["n_hops"] in (5, 6) and r["label"].count("/") == r["n_hops"] - 1 and r["label"].startswith("has")
    del graphs["crow", "200yr"]
    with pytest.raises(ValueError, match="crow"):
        D.further_of_all(graphs)
