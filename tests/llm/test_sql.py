"""The numbered operators against their SQL."""

import pytest

from gradus.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(check, name):
    assert check(QUERIES[name], ORACLES[name]) > 0
