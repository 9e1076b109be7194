"""Files and stores: what is written is what is read."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import staging
from lodestone.sources import files, stores


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.ts": "export const a = 1\n", "src/b.py": "b = 2\n", "node_modules/x.js": "x", "README.md": "# Title\n", "data.bin": "zz"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "src/bad.py").write_bytes(b"\xff\xfe")
    (root / "package.json").write_text(json.dumps({"name": "p", "version": "1.0.0", "dependencies": {"a": "1", "b": "2"}}))
    return root


def test_scan_and_changed(spark, repo):
    scan = files.scan_repository(spark, str(repo))
    got = {r.file_path: r.content for r in scan.collect()}
    assert got["src/a.ts"] == "export const a = 1\n" and got["README.md"] == "# Title\n"
    assert got["src/bad.py"] is None
    assert "node_modules/x.js" not in got and "data.bin" not in got
    stored = spark.createDataFrame([(r.file_path, r.content_hash) for r in scan.collect()], "file_path string, content_hash string")
    (repo / "src/b.py").write_text("b = 3\n")
    (repo / "src/c.py").write_text("c = 1\n")
    assert {r.file_path for r in files.scan_changed(spark, str(repo), stored).collect()} == {"src/b.py", "src/c.py"}


def test_read_file_and_manifest(spark, repo):
    assert files.read_file(spark, str(repo / "README.md")).first().content == "# Title\n"
    with pytest.raises(Exception, match="(?i)path"):
        files.read_file(spark, str(repo / "none.md")).collect()
    assert files.project_manifest(spark, str(repo)).select("name", "dependencies", "dev_dependencies").first() == ("p", 2, 0)


def test_change_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [("add", "a.ts"), ("addDir", "d"), ("change", "node_modules/x.js"), ("unlink", "b.py")]
    (log / "1.json").write_text("\n".join(json.dumps({"type": t, "path": p, "timestamp": 1000 + i, "size": None}) for i, (t, p) in enumerate(rows)))
    seen = []
    q = files.change_stream(spark, str(log)).writeStream.foreachBatch(lambda b, _: seen.extend((r.type, r.path) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [("add", "a.ts"), ("unlink", "b.py")]


def test_store_backup_registry(spark, tmp_path):
    s = stores.TableStore(spark, str(tmp_path / "s"))
    assert s.load() is None
    with pytest.raises(ValueError, match="nothing"):
        stores.backup(s, str(tmp_path / "b"))
    s.save(spark.range(3).withColumn("x", F.lit("old")))
    s.upsert(spark.range(2, 5).withColumn("x", F.lit("new")), "id")
    assert {(r.id, r.x) for r in s.load().collect()} == {(0, "old"), (1, "old"), (2, "new"), (3, "new"), (4, "new")}
    row = stores.backup(s, str(tmp_path / "b")).first()
    assert row["rows"] == 5 and stores.restore(spark, str(tmp_path / "b"), row["backup"]).count() == 5
    other = stores.TableStore(spark, str(tmp_path / "o"))
    assert stores.sync(other, s) == "second to first" and stores.sync(other, s) == "equal"
    assert other.load().count() == 5


def test_report_and_provider(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id long, text string")
    assert "| 1 | a\\|b |" in stores.export_report(df.orderBy("id"), str(tmp_path / "r"), "T")
    out = stores.embed_with(df, "id", "text", lambda texts: [[len(t), 1.0] for t in texts])
    assert {(r.id, *r.embedding) for r in out.collect()} == {(1, 3.0, 1.0), (2, 0.0, 1.0)}


def test_staging_and_invalidation(spark):
    f = spark.createDataFrame([("a", True, 10, 1), ("b", False, 10, 2), ("c", False, 10, 3), ("x/d", True, 10, 4), ("e", True, 9999, 5)], "file_path string, tracked boolean, size long, arrived long")
    staged = staging.stage(f, 1, 5, ("x/*",))
    assert {(r.file_path, r.status) for r in staged.collect()} == {("a", "modified"), ("b", "new")}
    done = staging.mark_indexed(staged, spark.createDataFrame([("b",)], "file_path string"))
    assert {(r.file_path, r.status) for r in done.collect()} == {("a", "modified"), ("b", "indexed")}
    changes = spark.createDataFrame([("k", i, 30) for i in range(4)], "key string, ts long, n long")
    assert [(r.run, r.pending) for r in staging.invalidation_runs(changes, "key", "ts", "n").orderBy("ts").collect()] == [(0, 30), (1, 0), (1, 30), (2, 0)]
    assert tuple(staging.freshness(spark.range(0)).first()) == (0, True, False)
