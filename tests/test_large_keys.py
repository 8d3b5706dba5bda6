"""Keys larger than those of the small tables."""

import duckdb
import pytest

from waymark.plans import catalog

from .compare import DATA, TABLES, differences


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """Tables of the smallest size, some with a few more rows of far larger keys."""
    folder = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    more = {"part": ("p_partkey", [499_999, 500_000, 620_003, 770_007, 1_199_999, 2_400_003]), "orders": ("o_orderkey", [2_932_000, 2_933_000, 8_999_999, 30_000_000])}
    for t in TABLES:
        rows = f"SELECT * FROM '{DATA}/sf0.001/{t}.parquet'"
        if t in more:
            key, keys = more[t]
            rows += f" UNION ALL SELECT t.* REPLACE (k AS {key}) FROM (SELECT * FROM '{DATA}/sf0.001/{t}.parquet' LIMIT 1) t, (SELECT unnest({keys}::BIGINT[]) AS k)"
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["f17_tile_id", "f37_calendar", "p11_sector_names"])
def test_same_rows_as_sql(spark, shifted, name):
    folder, con = shifted
    assert differences(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name]) == ""
