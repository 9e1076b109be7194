"""Queries of this subpackage that have SQL, against DuckDB."""

import duckdb
import pytest

llm = pytest.importorskip("lodestone.llm.registry")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = llm.QUERIES[name](spark, SF)
    cur = db.execute(llm.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda rows, columns: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    got = [tuple(r) for r in df.collect()]
    assert text(got, df.columns) == text(cur.fetchall(), names)
    if name == "tool_call_graphs":
        assert {r.status for r in df.select("status").distinct().collect()} >= {"ok", "cycle", "invalid_arguments"}
