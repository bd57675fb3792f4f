"""Every query of the catalog with SQL is held against DuckDB on the smallest tables."""

import duckdb
import pytest

from casegrain.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark".split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return ("f", round(v, 6)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = duck.sql(catalog.SQL[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(rel.columns) == columns
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_unchecked_queries_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_human_size_of_every_order(spark, tmp_path):
    """Keys past 30,000 are answered too, and their sizes reach GB."""
    spark.createDataFrame([(k,) for k in (5, 100, 29999, 30000, 32767, 32768, 150000)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r["size"] for r in catalog.QUERIES["s18_human_size"](spark, str(tmp_path)).collect()}
    assert got == {5: "25 B", 100: "9.8 KB", 29999: "858.2 MB", 30000: "858.3 MB", 32767: "1023.9 MB", 32768: "1.0 GB", 150000: "21.0 GB"}
