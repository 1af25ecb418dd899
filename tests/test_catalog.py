import duckdb
import pytest

import __spark_entry__
from tallywood.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(rows):
    return sorted(tuple(f"{float(v):.4f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


# one is written out for the shape that its histogram has at the middle scale
@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n != "bound_quick_2pt"])
def test_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert cells(tuple(r) for r in got.select(*(f"`{n}`" for n in names)).collect()) == cells(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run_and_leave_no_cache(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"n", "expected_distinct"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
