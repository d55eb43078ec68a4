"""Sky queries on keys beyond those of the given tables, against SQL."""

import duckdb
import pytest

from rasterloom.plans.queries import QUERIES, SQL


@pytest.fixture
def customers(spark, tmp_path):
    """A folder with a customer table of these keys, and DuckDB with it."""

    def made(keys):
        spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        return str(tmp_path), c

    return made


def test_a_round_trip_ends_below_a_full_turn(spark, customers):
    folder, duck = customers([34200, 99360, 99361])  # right ascension 0, and a little less than 360 on the way back
    got = sorted(map(tuple, QUERIES["gnomonic_round_trip"](spark, folder).collect()))
    assert got == sorted(duck.execute(SQL["gnomonic_round_trip"]).fetchall()) and got
