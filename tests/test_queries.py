import duckdb
import pytest

from quillspark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return v


def rows(columns, records):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    records = [r.asDict() for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(sorted(names), records) == rows(sorted(names), [dict(zip(names, r)) for r in found.fetchall()])


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
