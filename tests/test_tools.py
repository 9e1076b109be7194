"""The tools on small fixtures with known answers, nulls and empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import tools

EDGES = "src long, dst long, type string, strength double"


@pytest.fixture(scope="module")
def workspace(spark):
    chunks = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", None), (4, "b", []), (5, "c", [-1.0, 0.0]), (6, "c", [1.0, 0.0])]
    edges = [(1, 3, "calls", 0.9), (1, 3, "calls", 0.8), (3, 4, "calls", 0.9), (4, 1, "calls", 0.9), (4, 99, "calls", 0.9), (1, 5, "imports", 0.9), (2, 1, "calls", 0.9), (None, 2, None, None)]
    return tools.Workspace(spark.createDataFrame(chunks, "chunk_id long, file_path string, embedding array<double>"), spark.createDataFrame(edges, EDGES))


def found(df):
    return {r.chunk_id: (r.hop, round(r.score, 4)) for r in df.collect()}


def test_search_expands_and_decays(workspace):
    assert found(workspace.semantic_search([1.0, 0.0], k=1)) == {1: (0, 1.0), 3: (1, 0.8), 4: (2, 0.64)}
    assert found(workspace.semantic_search([1.0, 0.0], k=2, hops=0)) == {1: (0, 1.0), 6: (0, 1.0)}
    assert found(workspace.relationship_analysis([1.0, 0.0], ("imports",), 1))[5][0] == 0  # all vectors are seeds
    assert found(workspace.contextual_read([0.0, 1.0], "a")) == {2: (0, 1.0), 1: (0, 0.0)}
    assert set(found(workspace.code_intelligence([1.0, 0.0], 200))) == {1, 3, 4, 5}
    assert set(found(workspace.find_code_patterns([1.0, 0.0], k=1))) == {1, 3, 4, 5}


def test_trace_backward_and_empty(workspace, spark):
    shape = tools.Shape(1, 5, ("calls",), 0.5, direction="in")
    assert found(workspace.search([1.0, 0.0], shape)) == {1: (0, 1.0), 2: (1, 0.5), 4: (1, 0.5), 3: (2, 0.25)}
    none = tools.Workspace(workspace.chunks.limit(0), workspace.edges.limit(0))
    assert found(none.semantic_search([1.0, 0.0])) == {}


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(1, "x" * 45000), (2, ""), (3, None)], "id long, text string")
    p = tools.result_pages(df, "id", "text")
    assert sorted((r.id, r.page, r.total, len(r.part)) for r in p.collect()) == [(1, 0, 3, 20000), (1, 1, 3, 20000), (1, 2, 3, 5000), (2, 0, 1, 0), (3, 0, 1, 0)]
    assert [(r.id, r.page) for r in tools.next_chunk(p, tools.fetch_chunk(p, 1), "id").collect()] == [(1, 2)]
    assert tools.next_chunk(p, tools.fetch_chunk(p, 2), "id").count() == 0


def test_projects(spark, tmp_path):
    p = tools.Projects(spark, f"file://{tmp_path}/projects")
    assert p.list_projects() is None and p.get_current_project() is None
    p.add_project(spark.createDataFrame([("a", "A", "/a"), ("b", "B", "/b")], "project_id string, name string, path string"))
    p.switch_project("a")
    p.switch_project("b")
    assert [r.name for r in p.get_current_project().collect()] == ["B"]
    with pytest.raises(KeyError):
        p.switch_project("c")
    assert p.get_current_project().count() == 1


def test_health(spark):
    t = datetime.datetime(2024, 1, 1, 12)
    ago = lambda s: t - datetime.timedelta(seconds=s)
    rows = [("s1", "p", "active", ago(90), ago(1), [True]), ("s2", "p", "error", ago(90), ago(1), []), ("s3", "q", "active", ago(90), ago(61), [True]), ("s4", "r", "active", ago(90), ago(60), [True, True, False, False]), ("s5", "r2", "active", None, None, None), ("s6", "t", None, ago(5), ago(5), [False, True, True, True])]
    df = spark.createDataFrame(rows, "session string, project string, status string, started timestamp_ntz, last_activity timestamp_ntz, checks array<boolean>")
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'")
    got = {r.session: (r.uptime_s, r.health) for r in tools.session_health(df, now).collect()}
    assert got == {"s1": (90, "good"), "s2": (90, "error"), "s3": (90, "warning"), "s4": (90, "warning"), "s5": (None, "warning"), "s6": (5, "good")}
    one = lambda d, **k: tuple(tools.multi_instance_health(d, now, **k).first())
    assert one(df) == (6, 1, 3, "unhealthy")
    assert one(df.where("session in ('s1', 's3')")) == (2, 0, 1, "degraded")
    assert one(df.where("session = 's1'")) == (1, 0, 0, "healthy") and one(df.where("session = 's1'"), recent_errors=4)[3] == "unhealthy"
    assert one(df.limit(0)) == (0, 0, 0, "healthy")


def test_dashboard(spark):
    df = spark.createDataFrame([(i, float(i), i == 3) for i in range(150)], "ts long, ms double, failed boolean")
    assert tuple(tools.request_dashboard(df).first()) == (150, 1, 99.5, 149.0)
    assert tuple(tools.request_dashboard(df.limit(0)).first()) == (0, 0, None, None)
