"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessera import plans
from tessera.operators import report

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = rows_of(names, want.fetchall())
    assert expected and rows_of(got.columns, got.collect()) == expected


def test_entry(spark):
    assert driver.entry(spark).columns == ["month", "cents"]
    assert set(plans.QUERIES) <= set(driver.queries()) and set(plans.ORACLES) <= set(driver.oracle_sql())
    assert not set(driver.oracle_sql()) - set(driver.queries())


def test_library_stands_alone():
    """Nothing of the library but its own subpackage knows the training-data operators."""
    import pathlib

    root = pathlib.Path(plans.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tessera.llm" not in path.read_text(), path


def test_lineage_has_every_order(spark, tmp_path):
    keys = [*range(1, 200), *range(3990, 4130), *range(9001, 9101)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want, known = {}, set(keys)
    for k in sorted(keys):
        up = k - 1 if k % 40 != 1 and k - 1 in known else None
        want[k] = (want[up][0], want[up][1] + 1) if up else (k, 0)
    rows = plans.QUERIES["recursive_lineage"](spark, str(tmp_path)).collect()
    assert len(rows) == len(keys) and {r["node"]: (r["root"], r["depth"]) for r in rows} == want


@pytest.mark.parametrize("page", [1, 3, 90, 150, 10**6])
def test_pages_by_number(spark, monkeypatch, page):
    """Pages near the begin and pages that are numbered in ranges are the same rows."""
    monkeypatch.setattr(report, "NEAR", 300)
    rows = spark.range(1, 14951).selectExpr("id", "id % 7 AS v")
    want = sorted(range(1, 14951), key=lambda i: (-(i % 7), i))
    begin = (min(page, 150) - 1) * 100
    got = report.offset_page(rows, [F.col("v").desc(), F.col("id")], page)
    assert sorted(r["id"] for r in got.collect()) == sorted(want[begin : begin + 100])
