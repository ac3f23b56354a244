"""Every query of the contract engine against its SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from pactline import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    return round(float(x), 6) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, tables, name):
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=str)
    want = tables.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in want), key=str)


def test_name_similarity_grid_keeps_all_names(spark, tmp_path):
    from pactline.queries import queries

    spark.createDataFrame([("FRANCE",), ("PERU",)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1200).selectExpr("concat('name', id) AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert queries()["name_similarity_grid"](spark, str(tmp_path)).count() == 2400
