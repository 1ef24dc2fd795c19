"""Queries on persons whose ids are as large as those of large tables."""

from conftest import SMALL
from pyspark.sql import functions as F

from kinweave.plans import registry
from kinweave.sources.pedigree import persons


def test_sampled_order_of_large_ids(spark):
    far = 900_000
    p = persons(spark, SMALL).filter("id <= 60").select(*[c if c == "sex" else (F.col(c) + far).alias(c) for c in ("id", "sex", "father_id", "mother_id", "spouse_id")]).localCheckpoint()
    by_path = {}
    for r in registry._sample(p).collect():
        by_path.setdefault(r["path"], []).append((r["rank"], r["anchor"]))
    assert len(by_path["F"]) == 50
    for rows in by_path.values():
        anchors = [a for _, a in sorted(rows)]
        assert anchors == sorted(anchors, key=lambda a: ((a * 7919 + 13) % 10007, a))
