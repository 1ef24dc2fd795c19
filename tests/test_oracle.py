"""Every query of the star-schema registry against DuckDB on the smallest tables."""

import pytest

from kinweave.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracle_rows(name, same_rows):
    same_rows(registry.queries()[name], ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(registry.queries())
