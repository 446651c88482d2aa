"""Every core query equals its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from trailspark.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    want = db.execute(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    normal = lambda rows: sorted((tuple(cell(v) for v in r) for r in rows), key=repr)
    assert normal(got.select(*names).collect()) == normal(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_templates_replay_without_violations(spark):
    got = queries.QUERIES["trace_replay"](spark, SF).collect()
    assert len(got) == 2 * spark.read.parquet(f"{SF}/supplier.parquet").count() and all(r.violations == 0 and r.final_success for r in got)
