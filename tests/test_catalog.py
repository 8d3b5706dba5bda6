"""Every query with a SQL twin gives its rows; the others run."""

import pytest

import __spark_entry__
from waymark.plans import catalog

from .compare import DATA, differences, duck

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, f"{DATA}/{SF}"), duck(SF), catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/{SF}").count() > 0


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_golden(spark):
    rows = {r["kind"]: r for r in catalog.QUERIES["a07_time_distance_by_kind"](spark, f"{DATA}/sf0.01").collect()}
    assert (rows[0]["edges"], rows[0]["distance_m"], rows[0]["time_s"], rows[0]["unknown_speed_m"]) == (5454, 545400.0, 29384.588412, 57000.0)
    assert (rows[1]["edges"], rows[1]["time_s"]) == (962, 14712.0)
    assert __spark_entry__.entry(spark).count() > 0
