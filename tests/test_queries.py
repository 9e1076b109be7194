"""Every registered query with SQL equals DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.session import TABLES

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, datetime.datetime | str | bool):
            return str(x)
        return f"{float(x):.6g}"

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_selection_respects_k(spark):
    out = registry.QUERIES["mmr_selection"](spark, SF).toPandas()
    assert len(out) and out.groupby("query_id").size().max() <= 10
    assert not out.duplicated(["query_id", "id"]).any()
