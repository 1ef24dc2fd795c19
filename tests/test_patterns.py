"""Graph patterns against plain matching."""

import pytest

from kinweave.operators.patterns import Group, solutions

TRIPLES = [
    ("p1", "a", "Person"), ("p2", "a", "Person"), ("p3", "a", "Person"), ("p1", "label", "Ann"), ("p2", "label", "Bo"), ("p3", "label", "Cy"), ("p2", "a", "Male"), ("p1", "a", "Female"),
    ("p1", "child", "p2"), ("p2", "child", "p3"), ("p1", "child", "p3"), ("p3", "knows", "p3"), ("p3", "knows", "p1"), ("p1", "label", "Ann"), (None, "a", "Person"), ("p4", None, "Person"), ("p4", "a", None),
]
PERSON = (("?p", "a", "Person"), ("?p", "label", "?name"))
SEX = Group(either=[Group(("?p", "a", "Male"), bind={"sex": "male"}), Group(("?p", "a", "Female"), bind={"sex": "female"})])


@pytest.fixture
def triples(spark):
    return spark.createDataFrame([(*t, "x") for t in TRIPLES], "subj string, pred string, obj string, p string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_optional_and_alternatives(triples):
    assert rows(solutions(triples, Group(*PERSON, optional=[SEX]), "p", "name", "sex")) == [("p1", "Ann", "female"), ("p2", "Bo", "male"), ("p3", "Cy", None)]
    assert rows(solutions(triples, Group(*PERSON, either=SEX.either), "p", "sex")) == [("p1", "female"), ("p2", "male")]


def test_chains_join_in_any_order(triples):
    chain = [("?a", "child", "?b"), ("?c", "label", "?name"), ("?b", "child", "?c")]
    for patterns in (chain, chain[::-1]):
        assert rows(solutions(triples, Group(*patterns), "a", "c", "name")) == [("p1", "p3", "Cy")]
    assert rows(solutions(triples, Group(("?a", "?how", "p3")), "a", "how")) == [("p1", "child"), ("p2", "child"), ("p3", "knows")]


def test_repeated_variables_constants_and_bags(triples):
    assert rows(solutions(triples, Group(("?a", "knows", "?a")))) == [("p3",)]
    assert rows(solutions(triples, Group(("?a", "child", "?b"), ("p1", "label", "Ann")), "a")) == [("p1",), ("p1",), ("p2",)]
    assert rows(solutions(triples, Group(("?a", "child", "?b"), ("p1", "label", "Bo")), "a")) == []
    both = Group(either=[Group(("?a", "child", "p3")), Group(("?a", "child", "p2"))])
    assert rows(solutions(triples, both, "a")) == [("p1",), ("p1",), ("p2",)]


def test_refused(triples):
    with pytest.raises(ValueError, match="in common"):
        solutions(triples, Group(("?a", "child", "?b"), ("?c", "label", "?d")))
    with pytest.raises(ValueError, match="unbound"):
        solutions(triples, Group(("?a", "child", "?b"), optional=[Group(("?b", "knows", "?c")), Group(("?c", "label", "?n"))]))
    with pytest.raises(ValueError, match="twice"):
        solutions(triples, Group(("?a", "child", "?b"), bind={"a": "x"}))
    with pytest.raises(ValueError, match="variable"):
        solutions(triples, Group(("p1", "child", "p2")))


def test_empty_table_and_pushed_filters(spark, triples, tmp_path):
    assert rows(solutions(triples.limit(0), Group(*PERSON, optional=[SEX]))) == []
    triples.write.parquet(f"file://{tmp_path}/t")
    df = solutions(spark.read.parquet(f"file://{tmp_path}/t"), Group(("?a", "child", "?b"), ("?b", "child", "?c")))
    assert "EqualTo(pred,child)" in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
