"""Context packages: lookup, expansion, critical sets, projections, telemetry helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import queries as q
from lodestone.operators.delta import keep_first
from lodestone.plans.registry import query
from lodestone.session import load

#: Documents as chunks of code files with symbols, imports, exports, calls and flows.
_CODE_SQL = "c AS (SELECT doc_id, 'src/' || source || '.ts:' || doc_id AS chunk_id, 'src/' || source || '.ts' AS file_path, 'fn' || (doc_id % 97) AS symbol_name, (['function', 'class', 'config', 'documentation', 'section'])[doc_id % 5 + 1] AS chunk_type, doc_id % 60 + 1 AS start_line, doc_id % 60 + 10 AS end_line, ['e' || (doc_id % 13)] AS exports, ['e' || (doc_id % 7), 'e' || (doc_id % 11)] AS imports, ['fn' || (doc_id * 7 % 97)] AS calls, ['fn' || (doc_id * 3 % 97)] AS flows, 'src/src' || (doc_id % 9) || '.ts' AS co_changed, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, text FROM documents)"


def code(spark, sf_dir):
    k = F.col("doc_id")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    path = F.concat(F.lit("src/"), "source", F.lit(".ts"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("function", "class", "config", "documentation", "section"))), (k % 5 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.concat(path, F.lit(":"), k.cast("string")).alias("chunk_id"), path.alias("file_path"), text("fn", k % 97).alias("symbol_name"), kind.alias("chunk_type"),
        (k % 60 + 1).alias("start_line"), (k % 60 + 10).alias("end_line"), F.array(text("e", k % 13)).alias("exports"), F.array(text("e", k % 7), text("e", k % 11)).alias("imports"),
        F.array(text("fn", k * 7 % 97)).alias("calls"), F.array(text("fn", k * 3 % 97)).alias("flows"), F.concat(F.lit("src/src"), (k % 9).cast("string"), F.lit(".ts")).alias("co_changed"),
        F.ceil(F.length("text") / F.lit(4)).cast("long").alias("tokens"), "text",
    )


@query(f"WITH {_CODE_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS r FROM c WHERE doc_id % 40 = 0) WHERE r = 1), x AS (SELECT t.doc_id, 'imports' AS via FROM (SELECT DISTINCT unnest(imports) AS name FROM s) n JOIN (SELECT doc_id, unnest(exports) AS name FROM c) t USING (name) UNION ALL SELECT c.doc_id, 'calls' FROM c WHERE symbol_name IN (SELECT unnest(calls) FROM s) UNION ALL SELECT c.doc_id, 'data_flow' FROM c WHERE symbol_name IN (SELECT unnest(flows) FROM s) UNION ALL SELECT c.doc_id, 'co_change' FROM c WHERE file_path IN (SELECT co_changed FROM s) UNION ALL SELECT doc_id, 'seed' FROM c WHERE doc_id % 40 = 0) SELECT doc_id, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM x GROUP BY doc_id")
def code_expansion(spark, sf_dir):
    """JOIN-1, 2, 3, 4, GRAPH-12, WIN-3: the first seed of every file expands by imports, calls, flows and co-changes."""
    c = code(spark, sf_dir)
    seeds = c.where("doc_id % 40 = 0")
    first = keep_first(seeds, ["file_path"], ["doc_id"])
    names = lambda column: first.select(F.explode(column).alias("name")).distinct()
    exported = c.select("doc_id", F.explode("exports").alias("name")).join(names("imports"), "name").select("doc_id", F.lit("imports").alias("via"))
    by_name = [c.join(names(column).withColumnRenamed("name", "symbol_name"), "symbol_name", "left_semi").select("doc_id", F.lit(via).alias("via")) for column, via in (("calls", "calls"), ("flows", "data_flow"))]
    files = first.select(F.col("co_changed").alias("file_path")).distinct()
    changed = c.join(files, "file_path", "left_semi").select("doc_id", F.lit("co_change").alias("via"))
    every = exported.unionByName(by_name[0]).unionByName(by_name[1]).unionByName(changed).unionByName(seeds.select("doc_id", F.lit("seed").alias("via")))
    return every.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


@query(f"WITH {_CODE_SQL}, w AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN chunk_id ELSE symbol_name END AS wanted FROM c WHERE doc_id % 23 = 0), h AS (SELECT wanted, arg_min(chunk_id, (place, doc_id)) AS chunk_id FROM (SELECT wanted, 0 AS place, c.doc_id, c.chunk_id FROM w JOIN c ON c.chunk_id = wanted UNION ALL SELECT wanted, 1, c.doc_id, c.chunk_id FROM w JOIN c ON c.symbol_name = wanted) GROUP BY wanted) SELECT wanted, chunk_id, split_part(chunk_id, ':', 1) AS file, split_part(chunk_id, ':', 2) AS name FROM h")
def symbol_lookup(spark, sf_dir):
    """FILT-6, SCALAR-3, SCALAR-35: by chunk id, else the first chunk of that symbol."""
    c = code(spark, sf_dir).select("doc_id", "chunk_id", "symbol_name")
    w = c.where("doc_id % 23 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.col("chunk_id")).otherwise(F.col("symbol_name")).alias("wanted")).distinct()
    by = lambda column, place: c.select(F.col(column).alias("wanted"), F.lit(place).alias("place"), "doc_id", "chunk_id").join(w, "wanted", "left_semi")
    hit = by("chunk_id", 0).unionByName(by("symbol_name", 1)).groupBy("wanted").agg(F.min_by("chunk_id", F.struct("place", "doc_id")).alias("chunk_id"))
    return hit.select("wanted", "chunk_id", F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("file"), F.split_part("chunk_id", F.lit(":"), F.lit(2)).alias("name"))


@query(f"WITH {_CODE_SQL} SELECT 'export' AS kind, count(*) AS n, min(doc_id) AS first FROM c WHERE list_contains(exports, 'e5') UNION ALL SELECT 'symbol', count(*), min(doc_id) FROM c WHERE symbol_name = 'fn13' UNION ALL SELECT 'focus', count(*), min(doc_id) FROM c WHERE contains(symbol_name, 'fn1') OR contains(symbol_name, 'fn23') UNION ALL SELECT 'keyword', count(*), min(doc_id) FROM (SELECT doc_id FROM c WHERE contains(lower(symbol_name || ' ' || file_path), 'src3.ts') OR contains(lower(symbol_name || ' ' || file_path), 'fn42') ORDER BY doc_id LIMIT 10)")
def symbol_filters(spark, sf_dir):
    """FILT-5, FILT-8 (first ten), FILT-9."""
    c = code(spark, sf_dir)
    words = q.keyword_match(F.col("symbol_name"), F.col("file_path"), F.lit("in SRC3.ts or fn42"))
    parts = [("export", c.where(F.array_contains("exports", "e5"))), ("symbol", c.where("symbol_name = 'fn13'")), ("focus", c.where(F.contains("symbol_name", F.lit("fn1")) | F.contains("symbol_name", F.lit("fn23")))), ("keyword", c.where(words).orderBy("doc_id").limit(10))]
    out = None
    for kind, rows in parts:
        one = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


#: Questions: user turns with what they could name.
_TASK_SQL = r"t AS (SELECT conv_id, turn, (['Fix function parseIt in src/a' || conv_id || '.ts', 'Why does run' || turn || '( fail? See class FooBar and interface baz', 'plain words for the user', 'calling loadAll with getUserName from node_modules/x.js', 'path lib/deep/Util.java and type Thing and method x'])[(conv_id + turn) % 5 + 1] || ' ' || left(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'), 30) AS task FROM conversations WHERE role = 'user')"


def _tasks(spark, sf_dir):
    k, t = F.col("conv_id"), F.col("turn")
    kinds = F.array(F.concat(F.lit("Fix function parseIt in src/a"), k.cast("string"), F.lit(".ts")), F.concat(F.lit("Why does run"), t.cast("string"), F.lit("( fail? See class FooBar and interface baz")), F.lit("plain words for the user"), F.lit("calling loadAll with getUserName from node_modules/x.js"), F.lit("path lib/deep/Util.java and type Thing and method x"))
    tail = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", ""), 1, 30)
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.element_at(kinds, ((k + t) % 5 + 1).cast("int")), F.lit(" "), tail).alias("task"))


_STOP = "lower(x) NOT IN ('and', 'or', 'not', 'the', 'for', 'with', 'from')"
_CRITICAL_SQL = rf"""
{_TASK_SQL},
x AS (SELECT *,
  list_distinct(list_filter(list_concat(regexp_extract_all(lower(task), '[/\\]?([a-zA-Z0-9._-]+\.[a-zA-Z]+)', 1), regexp_extract_all(lower(task), '(?:file|path|in)\s+([a-zA-Z0-9._/-]+\.[a-zA-Z]+)', 1)), lambda x: regexp_extract(x, '(\.[^.]*)$', 1) IN ('.ts', '.js', '.tsx', '.jsx', '.py', '.java', '.cpp', '.c', '.h') AND length(x) > 3 AND NOT contains(x, 'node_modules'))) AS files,
  list_distinct(list_filter(list_concat(regexp_extract_all(lower(task), '(?:function|method|call(?:ing)?)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), regexp_extract_all(lower(task), '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)), lambda x: length(x) >= 2 AND {_STOP})) AS functions,
  list_distinct(list_concat(list_filter(regexp_extract_all(task, '(?i)(?:class|interface|type|component)\s+([A-Z][a-zA-Z0-9]*)', 1), lambda x: length(x) >= 2 AND {_STOP}), list_filter(regexp_extract_all(task, '\b([A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+)\b', 1), lambda x: length(x) > 2 AND {_STOP}))) AS symbols FROM t),
y AS (SELECT *, len(files) + len(functions) + len(symbols) AS n FROM x)
"""


@query(f"WITH {_CRITICAL_SQL} SELECT conv_id, turn, array_to_string(list_sort(files), ',') AS files, array_to_string(list_sort(functions), ',') AS functions, array_to_string(list_sort(symbols), ',') AS symbols, round(CASE WHEN n = 0 THEN 0.1 ELSE least(0.95, least(0.9, 0.3 + n * 0.15) + CASE WHEN len(files) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(functions) > 0 THEN 0.1 ELSE 0 END) END, 6)::DOUBLE AS confidence FROM y")
def critical_sets(spark, sf_dir):
    """SCALAR-9 to SCALAR-12 over the questions of conversations."""
    from lodestone.functions.scores import extraction_confidence

    x = _tasks(spark, sf_dir).select("conv_id", "turn", q.file_paths(F.col("task")).alias("files"), q.function_names(F.col("task")).alias("functions"), q.symbol_names(F.col("task")).alias("symbols"))
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("files", "functions", "symbols")]
    return x.select("conv_id", "turn", *joined, F.round(extraction_confidence(F.size("files"), F.size("functions"), F.size("symbols")), 6).alias("confidence"))


@query(f"WITH {_CODE_SQL}, k AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'lib/src3.ts' ELSE file_path END AS file_path, symbol_name, tokens FROM c), m AS (SELECT *, contains(file_path, 'src3.ts') OR contains('src3.ts', file_path) OR contains(lower(symbol_name), 'fn4') OR contains('fn4', lower(symbol_name)) AS critical FROM k) SELECT critical, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, round(least(1.0, CASE WHEN critical THEN count(*) / 2.0 ELSE 0 END), 6)::DOUBLE AS coverage, round(CASE WHEN critical THEN count(*) / 2.0 ELSE 0 END, 6)::DOUBLE AS raw_coverage, round(sum(tokens) / 100000.0, 6)::DOUBLE AS utilisation FROM m GROUP BY critical")
def critical_chunks(spark, sf_dir):
    """FILT-10, JOIN-10, MMR-5 (coverage, utilisation): chunks that a question names, and the rest."""
    c = code(spark, sf_dir).withColumn("file_path", F.when(F.col("doc_id") % 6 == 0, "lib/src3.ts").otherwise(F.col("file_path")))
    names = lambda *x: F.array(*(F.lit(y) for y in x)).cast("array<string>")
    m = c.select("doc_id", "tokens", q.is_critical(F.col("file_path"), F.lit(None).cast("string"), F.col("symbol_name"), names("src3.ts"), names(), names("Fn4")).alias("critical"))
    raw = F.when(F.col("critical"), F.col("chunks") / F.greatest(F.lit(2), F.lit(1))).otherwise(0.0)
    g = m.groupBy("critical").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return g.select("critical", "chunks", "tokens", F.round(F.least(F.lit(1.0), raw), 6).alias("coverage"), F.round(raw, 6).alias("raw_coverage"), F.round(F.col("tokens") / 100_000, 6).alias("utilisation"))


@query(rf"WITH {_TASK_SQL}, w AS (SELECT conv_id, turn, task, string_split_regex(lower(task), '\s+') AS l FROM t) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(range(2, len(l) + 1), lambda i: CASE WHEN l[i - 1] IN ('function', 'class', 'method', 'component', 'service') THEN l[i] END), lambda x: x IS NOT NULL), list_filter(regexp_extract_all(task, '\b([a-z][a-zA-Z0-9]*)|[A-Z][a-zA-Z0-9]*', 1), lambda x: length(x) > 2), list_filter(regexp_extract_all(task, '([A-Z][a-zA-Z0-9]*)', 1), lambda x: length(x) > 2)))), ',') AS focus FROM w")
def focus_symbols(spark, sf_dir):
    """SCALAR-13."""
    return _tasks(spark, sf_dir).select("conv_id", "turn", F.array_join(q.focus_symbols(F.col("task")), ",").alias("focus"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, file_path, start_line || '-' || end_line AS lines, CASE WHEN symbol_name <> 'fn0' THEN symbol_name END AS symbol, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM c")
def lean_results(spark, sf_dir):
    """PROJ-1, PROJ-2: what a search returns of a chunk (a placeholder symbol is left out; excerpts of 200 characters)."""
    text = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return code(spark, sf_dir).select("doc_id", "file_path", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.when(F.col("symbol_name") != "fn0", F.col("symbol_name")).alias("symbol"), text.alias("excerpt"))


@query(f"WITH {_CODE_SQL}, g AS (SELECT file_path, avg(doc_id % 10) / 10 AS importance, sum(tokens) AS tokens FROM c WHERE doc_id % 3 > 0 GROUP BY 1), u AS (SELECT chunk_type, count(*) AS n FROM c GROUP BY 1) SELECT (SELECT round(least(0.95, greatest(0.1, avg(importance))), 6) FROM g) AS efficiency, (SELECT string_agg(n || ' ' || chunk_type || 's', ', ' ORDER BY n DESC, chunk_type) FROM (SELECT * FROM u ORDER BY n DESC, chunk_type LIMIT 3)) AS top_types, (SELECT count(*) FROM c WHERE doc_id % 3 = 0) AS ungrouped, (SELECT 'Found ' || count(DISTINCT file_path) || ' files with ' || count_if(chunk_type = 'function') || ' functions and ' || count_if(chunk_type = 'class') || ' classes' FROM c) AS summary")
def package_summary(spark, sf_dir):
    """AGG-5, AGG-34, JOIN-9 (chunks in no group), SCALAR-36: one row on a package whose groups hold two of three chunks."""
    c = code(spark, sf_dir)
    grouped = c.where("doc_id % 3 > 0")
    g = grouped.groupBy("file_path").agg((F.avg(F.col("doc_id") % 10) / 10).alias("importance"))
    one = g.agg(F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.avg("importance"))), 6).alias("efficiency"))
    top = c.groupBy("chunk_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_type").limit(3)
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "chunk_type"))), lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["chunk_type"], F.lit("s")))
    left = c.join(grouped.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("ungrouped"))
    text = c.agg(F.concat(F.lit("Found "), F.countDistinct("file_path").cast("string"), F.lit(" files with "), F.count_if(F.col("chunk_type") == "function").cast("string"), F.lit(" functions and "), F.count_if(F.col("chunk_type") == "class").cast("string"), F.lit(" classes")).alias("summary"))
    return one.join(top.agg(F.array_join(names, ", ").alias("top_types"))).join(left).join(text)


@query(f"WITH {_CODE_SQL}, k(doc_id, class) AS (SELECT doc_id, 'seed' FROM c WHERE doc_id % 40 = 0 UNION ALL SELECT doc_id, 'critical' FROM c WHERE chunk_type = 'class' UNION ALL SELECT doc_id, 'forward' FROM c WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'backward' FROM c WHERE doc_id % 4 = 2) SELECT doc_id, CASE min(CASE class WHEN 'seed' THEN 0 WHEN 'critical' THEN 1 WHEN 'forward' THEN 2 WHEN 'backward' THEN 3 END) WHEN 0 THEN 'seed' WHEN 1 THEN 'critical' WHEN 2 THEN 'forward' WHEN 3 THEN 'backward' ELSE 'contextual' END AS class FROM c LEFT JOIN k USING (doc_id) GROUP BY doc_id")
def class_tags(spark, sf_dir):
    """JOIN-30, WIN-2: every chunk with the first of the classes that hold it, else contextual."""
    c = code(spark, sf_dir)
    parts = {"seed": F.col("doc_id") % 40 == 0, "critical": F.col("chunk_type") == "class", "forward": F.col("doc_id") % 4 == 1, "backward": F.col("doc_id") % 4 == 2}
    table = None
    for place, (name, hit) in enumerate(parts.items()):
        one = c.where(hit).select("doc_id", F.struct(F.lit(place).alias("place"), F.lit(name).alias("class")).alias("tag"))
        table = one if table is None else table.unionByName(one)
    first = table.groupBy("doc_id").agg(F.min("tag").alias("tag"))
    return c.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("tag.class", F.lit("contextual")).alias("class"))


@query("SELECT o_orderkey, list_filter([CASE WHEN n = 0 THEN 'use other terms' END, CASE WHEN n > 0 AND n < 5 THEN 'widen the question' END, CASE WHEN n >= 20 THEN 'name a file or a symbol' END, CASE WHEN e < 0.5 THEN 'raise the weight of relevance' END, CASE WHEN o_totalprice > 50000 THEN 'lower the token budget' END, CASE WHEN o_orderkey % 3 = 0 THEN 'split the question' END], lambda x: x IS NOT NULL) AS l, 0 AS z FROM (SELECT *, o_orderkey % 25 AS n, o_orderkey % 10 / 10.0 AS e FROM orders)".replace("SELECT o_orderkey, list_filter", "SELECT o_orderkey, array_to_string(tips, '; ') AS tips FROM (SELECT o_orderkey, list_filter").replace("AS l, 0 AS z FROM", "AS tips FROM") + ")")
def follow_ups(spark, sf_dir):
    """SCALAR-28 over results derived from orders."""
    k = F.col("o_orderkey")
    tips = q.follow_ups(k % 25, k % 10 / 10, F.col("o_totalprice"), F.when(k % 3 == 0, "complex").otherwise("simple"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tips, "; ").alias("tips"))


@query(f"WITH {_CODE_SQL} SELECT file_path, array_to_string(list_filter(['**/*.ts', 'src/**', CASE WHEN count(*) > 10 THEN file_path END], lambda x: x IS NOT NULL), ' ') AS globs FROM c GROUP BY file_path")
def recommended_globs(spark, sf_dir):
    """SCALAR-42: a file's score is its number of chunks."""
    files = code(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("score"))
    return files.select("file_path", F.array_join(q.recommended_globs(F.col("file_path"), F.col("score")), " ").alias("globs"))


@query("SELECT doc_id, printf('%.1f', round(n / pow(1024.0, s), 1)) || ' ' || (['B', 'KB', 'MB', 'GB'])[s + 1] AS size, CASE WHEN n // 86400 > 0 THEN (n // 86400) || 'd ' || (n // 3600 % 24) || 'h' WHEN n // 3600 > 0 THEN (n // 3600) || 'h ' || (n // 60 % 60) || 'm' WHEN n // 60 > 0 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS uptime FROM (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS s FROM (SELECT doc_id, CAST(doc_id * doc_id * 37 + n_chars AS BIGINT) AS n FROM documents))")
def formatted_numbers(spark, sf_dir):
    """SCALAR-43."""
    n = (F.col("doc_id") * F.col("doc_id") * 37 + F.col("n_chars")).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", q.bytes_text(n).alias("size"), q.duration_text(n).alias("uptime"))
