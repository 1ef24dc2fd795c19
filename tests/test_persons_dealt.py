"""Persons are dealt out to many tasks, however small their table is."""

from conftest import SMALL

from kinweave.plans import registry


def test_persons_are_dealt_out(spark):
    df = registry._graph(lambda p: p)(spark, SMALL)
    assert len(df.inputFiles()) > 1 and df.count() == spark.read.parquet(f"{SMALL}/customer.parquet").count()
