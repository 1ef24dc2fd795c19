"""Calls that go on where a broken run stopped, and default answers."""

import os
import time

import pytest

from kinweave.operators import evaluation


def test_a_broken_run_asks_no_finished_round_again(spark, tmp_path):
    calls, fixed = tmp_path / "calls", tmp_path / "fixed"
    calls.mkdir()

    def generate(prompt):
        (calls / f"{prompt}-{time.time_ns()}").touch()
        if prompt == "p17" and not fixed.exists():
            os._exit(1)  # the worker dies, and the job with it
        return prompt.upper()

    rows = [(f"q{k}", f"p{k}", 1) for k in range(40)] + [("q3", "p3", 1), (None, "p none", 1), (None, "p none", 2)]
    prompts = spark.createDataFrame(rows, "question_id string, prompt string, extra int")
    table = f"file://{tmp_path}/answers"
    with pytest.raises(Exception):
        evaluation.resumed(prompts, generate, table, every=8)
    kept = {r["prompt"] for r in spark.read.parquet(table).collect()} if (tmp_path / "answers").exists() else set()
    before = {f.name for f in calls.iterdir()}
    fixed.touch()
    got = evaluation.resumed(prompts, generate, table, every=8).collect()
    assert sorted(r["response"] for r in got) == sorted([f"P{k}" for k in range(40)] + ["P NONE"])
    again = {f.name.rsplit("-", 1)[0] for f in calls.iterdir() if f.name not in before}
    assert not again & kept and again | kept == {f"p{k}" for k in range(40)} | {"p none"}
    n = len(list(calls.iterdir()))
    assert evaluation.resumed(prompts, generate, table, every=8).count() == 41 and len(list(calls.iterdir())) == n


def test_calls_are_paced_and_empty_tables_ask_nothing(spark, tmp_path):
    called = []
    paced = evaluation._paced(lambda p: called.append(time.monotonic()) or p, 20)
    for k in range(40):
        paced(str(k))
    assert called[-1] - called[0] > 0.8 and len(called) == 40  # twenty at once, then twenty in a second
    none = spark.createDataFrame([], "question_id string, prompt string")
    out = evaluation.resumed(none, str.upper, f"file://{tmp_path}/none")
    assert out.count() == 0 and "response" in out.columns


def test_default_answers_are_what_the_plain_word_reaches(spark):
    edges = spark.createDataFrame([(1, "hasFather", 2), (1, "hasMother", 3), (1, "hasSibling", 4), (4, "hasChild", 5), (2, "hasFather", 6), (1, "hasChild", 7)], "src int, pred string, dst int")
    terms = ["classificatory father", "classificatory sibling", "parallel niece/nephew (classificatory)", "male mother (skewed generation)", "classificatory paternal grandfather (parallel)", "classificatory grandchild", "no kin word", None, "classificatory parent"]
    questions = spark.createDataFrame([(1, t, "x") for t in terms] + [(None, terms[0], "x")], "anchor int, kin_term string, more string")
    got = {(r["anchor"], r["kin_term"]): r["default"] for r in evaluation.with_defaults(questions, edges).collect()}
    assert got == {(1, terms[0]): [2], (1, terms[1]): [4], (1, terms[2]): [5], (1, terms[3]): [3], (1, terms[4]): [6], (1, terms[5]): [], (1, terms[6]): [], (1, None): [], (1, terms[8]): [2, 3], (None, terms[0]): []}
