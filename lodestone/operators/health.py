"""State of an index: issues found by rules, the verdict on them, and what to do.

Issues are rows (type, rule, severity, affected, action). Severities are
critical, warning and info; actions full_rebuild and incremental_update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vector import is_finite

#: Bounds of the rules.
INVALID_SHARE, MISSING_SHARE, LEAST_COVERAGE = 0.5, 0.05, 0.8
COMMITS_BEHIND, STALE_DAYS, OLD_DAYS, LARGE_CHUNKS = 20, 7, 30, 10_000
SCHEMAS = ("1.0.0", "1.1.0")
FOLLOW_UP, COVERAGE, LOW_USE, HIGH_USE, SLOW_MS = 0.3, 0.9, 0.6, 0.95, 2000
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _rows(facts: DataFrame, rules: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """One row for each rule whose number of affected things is above 0."""
    one = [F.struct(F.lit(t).alias("type"), F.lit(r).alias("rule"), s.alias("severity"), n.cast("long").alias("affected"), a.alias("action")) for t, r, s, n, a in rules]
    return facts.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("affected > 0")


def corruption(chunks: DataFrame, scan: DataFrame) -> DataFrame:
    """Invalid embeddings (against the dimension of the first chunk), duplicate chunk_ids, chunks of files that are gone.

    chunks: chunk_id, file_path, embedding; scan: file_path.
    """
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    first = chunks.agg(F.min_by(size, "chunk_id").alias("dim"))
    bad = F.col("embedding").isNull() | (size != F.col("dim")) | ~is_finite("embedding")
    one = chunks.join(F.broadcast(first)).agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("invalid"))
    again = chunks.groupBy("chunk_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("again"))
    gone = chunks.join(scan.select("file_path").distinct(), "file_path", "left_anti").agg(F.count("*").alias("gone"))
    facts = one.join(again).join(gone)
    most = F.col("invalid") > F.col("n") * INVALID_SHARE
    full, update = F.lit("full_rebuild"), F.lit("incremental_update")
    rules = [
        ("corruption", "invalid_embeddings", F.when(most, "critical").otherwise("warning"), F.col("invalid"), F.when(most, full).otherwise(update)),
        ("corruption", "duplicate_ids", F.lit("critical"), F.col("again"), full),
        ("corruption", "deleted_files", F.lit("warning"), F.col("gone"), update),
    ]
    return _rows(facts, rules)


def changed_hashes(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (kind, file) of ``current`` whose hash is not the indexed one; a file that was not indexed has changed."""
    old = indexed.select("kind", "file", F.col("hash").alias("was"))
    return current.join(old, ["kind", "file"], "left").where(~F.col("hash").eqNullSafe(F.col("was"))).select("kind", "file")


def staleness(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Branch, distance in commits, changed dependencies and build configurations, age.

    state: one row (branch, indexed_branch, commits_behind, age_days); changed: kind (dependency or build), file.
    """
    n = changed.agg(F.count_if(F.col("kind") == "dependency").alias("dependencies"), F.count_if(F.col("kind") == "build").alias("builds"))
    update = F.lit("incremental_update")
    rules = [
        ("staleness", "branch_changed", F.lit("warning"), (~F.col("branch").eqNullSafe(F.col("indexed_branch"))).cast("int"), update),
        ("staleness", "commits_behind", F.lit("warning"), F.when(F.col("commits_behind") > COMMITS_BEHIND, F.col("commits_behind")).otherwise(0), update),
        ("staleness", "dependencies_changed", F.lit("info"), F.col("dependencies"), update),
        ("staleness", "build_changed", F.lit("warning"), F.col("builds"), F.lit("full_rebuild")),
        ("staleness", "old", F.lit("info"), F.when(F.col("age_days") > STALE_DAYS, F.floor("age_days")).otherwise(0), update),
    ]
    return _rows(state.join(n), rules)


def coverage(chunks: DataFrame, scan: DataFrame) -> DataFrame:
    """Files missing from or left over in the index, once under ``LEAST_COVERAGE`` of them is indexed; chunks without a vector."""
    have, want = chunks.select("file_path").distinct(), scan.select("file_path").distinct()
    sizes = have.agg(F.count("*").alias("indexed")).join(want.agg(F.count("*").alias("files")))
    missing = want.join(have, "file_path", "left_anti").agg(F.count("*").alias("missing"))
    extra = have.join(want, "file_path", "left_anti").agg(F.count("*").alias("extra"))
    bare = chunks.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).alias("bare"))
    low = F.col("indexed") < F.col("files") * LEAST_COVERAGE
    update = F.lit("incremental_update")
    rules = [
        ("performance", "left_over_files", F.lit("warning"), F.when(low, F.col("extra")).otherwise(0), update),
        ("performance", "missing_files", F.lit("warning"), F.when(low, F.col("missing")).otherwise(0), update),
        ("performance", "missing_embeddings", F.when(F.col("bare") > F.col("n") * MISSING_SHARE, "critical").otherwise("warning"), F.col("bare"), update),
    ]
    return _rows(sizes.join(missing).join(extra).join(bare), rules)


def verdict(issues: DataFrame) -> DataFrame:
    """One row: health, whether and how to rebuild, whether a rebuild is forced."""
    forced = (F.col("type") == "corruption") & (F.col("severity") == "critical") & F.col("rule").isin("duplicate_ids", "invalid_embeddings")
    n = issues.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("action") == "full_rebuild").alias("full"), F.count_if(F.col("action") == "incremental_update").alias("update"), F.count_if(forced).alias("forced"))
    health = F.when(F.col("critical") > 0, "critical").when(F.col("issues") > 0, "degraded").otherwise("healthy")
    reason = F.when(F.col("critical") > 0, "critical issues").when(F.col("full") > 0, "build configuration changed").when(F.col("update") > 0, "code changed or index stale").otherwise("index is healthy")
    mode = F.when((F.col("critical") > 0) & (F.col("forced") > 0), "full").otherwise("incremental")
    return n.select(health.alias("health"), (F.col("critical") + F.col("full") + F.col("update") > 0).alias("should_rebuild"), mode.alias("mode"), reason.alias("reason"), ((F.col("critical") > 0) & (F.col("forced") > 0)).alias("forced"))


def index_mode(has_index: Column, requested: Column, forced: Column) -> Column:
    """What an index request does: incremental; full with a backup; full without one if there is no index."""
    recover = F.when(forced, "full_after_backup").otherwise("incremental")
    return F.when(~has_index, "full").when(requested == "incremental", recover).otherwise("full_after_backup")


def model_compatible(cached: Column, current: Column) -> Column:
    """Structs of name, version, hash. A missing record is compatible; hashes count only if both are there."""
    same = (cached["name"] == current["name"]) & (cached["version"] == current["version"])
    hashes = cached["hash"].isNull() | current["hash"].isNull() | (cached["hash"] == current["hash"])
    return cached.isNull() | F.coalesce(same & hashes, F.lit(False))


def rebuild_advice(issues: DataFrame, meta: DataFrame) -> DataFrame:
    """Recommendations (category, severity, rank), the most severe first. meta: one row (schema_version, compatible, age_days, chunks)."""
    n = issues.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    schema = F.when(~F.col("schema_version").isin(*SCHEMAS), "high")
    model = F.when(~F.col("compatible"), "high")
    broken = F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "medium")
    old = F.when(F.col("age_days") > OLD_DAYS, "low")
    large = F.when((F.col("age_days") <= OLD_DAYS) & (F.col("chunks") > LARGE_CHUNKS), "low")
    parts = [("schema", schema), ("model", model), ("corruption", broken), ("staleness", old), ("performance", large)]
    rows = meta.join(n).select(F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("category"), s.alias("severity")) for i, (k, s) in enumerate(parts)))).alias("x")).select("x.*").where("severity is not null")
    order = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return rows.withColumn("weight", F.element_at(order, F.col("severity")))


def quick_health(exists: Column, listed: Column, counted: Column) -> Column:
    """healthy, or the first thing that is wrong."""
    empty = F.coalesce(listed, F.lit(0)) == 0
    return F.when(~exists, "no index").when(empty, "empty or corrupt index").when(listed != counted, "chunk count mismatch").otherwise("healthy")


def store_issues(stores: DataFrame) -> DataFrame:
    """Inconsistencies of stores (location, kind, exists, modified): a vector store without its graph, halves over an hour apart, copies over a day apart."""
    kind = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    per = stores.where("exists").groupBy("location").agg(kind("embeddings", "modified").alias("e"), kind("relationships", "modified").alias("r"))
    apart = lambda a, b, s: F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) > s
    lone = per.where("e is not null and r is null").select("location", F.lit("relationships_missing").alias("issue"))
    synced = per.agg(F.coalesce(F.bool_or(~apart("e", "r", 3599)), F.lit(False)).alias("ok")).where("not ok").select(F.lit("all").alias("location"), F.lit("not_synchronised").alias("issue"))
    far = stores.where("exists").groupBy("kind").agg(F.min("modified").alias("a"), F.max("modified").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & apart("a", "b", 86400))
    return lone.unionByName(synced).unionByName(far.select(F.lit("all").alias("location"), F.concat("kind", F.lit("_apart")).alias("issue")))


def telemetry_advice(usage: DataFrame) -> DataFrame:
    """Recommendations from usage: one row (queries, follow_up_rate, coverage, utilisation, response_ms)."""
    none = F.col("queries") == 0
    rules = [
        ("more_data", none), ("tune_relevance", ~none & (F.col("follow_up_rate") > FOLLOW_UP)), ("raise_budget_for_coverage", ~none & (F.col("coverage") < COVERAGE)),
        ("lower_budget", ~none & (F.col("utilisation") < LOW_USE)), ("raise_budget", ~none & (F.col("utilisation") > HIGH_USE)), ("speed_up", ~none & (F.col("response_ms") > SLOW_MS)),
    ]
    return usage.select(F.explode(F.array_compact(F.array(*(F.when(hit, name) for name, hit in rules)))).alias("advice"))
