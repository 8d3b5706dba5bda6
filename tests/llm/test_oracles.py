"""Queries that have a SQL twin give its rows."""

import pytest

from tests.compare import DATA, differences, duck
from waymark.llm.oracles import ORACLES
from waymark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001"), ORACLES[name]) == ""
