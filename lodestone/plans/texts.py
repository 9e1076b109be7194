"""Chunking, extraction and content analysis of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import chunking
from lodestone.operators.delta import latest
from lodestone.plans.registry import query
from lodestone.session import load

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')"


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(len(l) / 5.0) AS BIGINT))) AS chunk FROM l) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 5 + 1 AS INTEGER) AS start_line, CAST(least(len(l), (chunk + 1) * 5) AS INTEGER) AS end_line, sha256(array_to_string(l[chunk * 5 + 1 : chunk * 5 + 5], chr(10))) AS content_hash FROM c")
def chunk_generic(spark, sf_dir):
    """GEN-4, GEN-7, SCALAR-2: windows of five lines with their hashes."""
    c = chunking.window_chunks(load(spark, sf_dir, "documents"), "doc_id", "text", 5)
    return c.select("doc_id", "chunk", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(r"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS chunk, length(l[i + 1]) AS n_chars FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM p)")
def chunk_paragraph(spark, sf_dir):
    """GEN-5, WIN-9."""
    return chunking.paragraph_chunks(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk", F.length("content").cast("long").alias("n_chars"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, i, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM l)), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM e) SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(i) + 1 AS BIGINT) AS start_line, CAST(max(i) + 1 AS BIGINT) AS end_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section HAVING max(length(trim(line))) > 0")
def chunk_sections(spark, sf_dir):
    """GEN-6, WIN-8: sections begin at header lines (here: lines that begin with a capitalised ASCII word)."""
    c = chunking.section_chunks(load(spark, sf_dir, "documents"), "doc_id", "text", "^[A-Z][a-z]+ ")
    return c.select("doc_id", "section", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "n_chars")


@query("SELECT substr(h, 1, 16) AS content_hash, n, first_doc FROM (SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1) WHERE n > 1")
def content_hash_dedup(spark, sf_dir):
    """SCALAR-2, AGG-15, IDX-13: groups of equal content and the row that stays."""
    g = load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return g.where("n > 1").select(F.substring("h", 1, 16).alias("content_hash"), "n", "first_doc")


@query("SELECT substr(sha256(line), 1, 16) AS line_hash, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) > 50 GROUP BY 1 HAVING count(*) >= 3")
def duplicate_lines(spark, sf_dir):
    """AGG-16: trimmed lines of over 50 characters that occur three times or more."""
    line = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where(F.length("line") > 50)
    return line.groupBy(F.substring(F.sha2("line", 256), 1, 16).alias("line_hash")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 3")


@query(r"WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z0-9_]+)\s*\(', 1)) AS callee FROM pages) SELECT callee, count(*) AS n, count(DISTINCT page_id) AS pages FROM c GROUP BY callee")
def extract_calls(spark, sf_dir):
    """SCALAR-5."""
    c = load(spark, sf_dir, "pages").select("page_id", F.explode(t.calls(F.col("html"))).alias("callee"))
    return c.groupBy("callee").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]*)', 1)) AS module FROM pages) SELECT module, count(*) AS n, min(page_id) AS first_page FROM c WHERE module <> '' GROUP BY module""")
def extract_imports(spark, sf_dir):
    """SCALAR-6 on pages: the modules of a page are its links."""
    c = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"#?]*)'), F.lit(1))).alias("module")).where("module <> ''")
    return c.groupBy("module").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\\b(?:if|else|elif|while|for|switch|case|try|catch|except)\\b')) + (length(text) - length(replace(text, '&&', ''))) // 2 + (length(text) - length(replace(text, '||', ''))) // 2 + (length(text) - length(replace(text, '?', ''))) AS INTEGER) AS complexity FROM documents")
def complexity_score(spark, sf_dir):
    """SCALAR-4."""
    return load(spark, sf_dir, "documents").select("doc_id", t.complexity(F.col("text")).alias("complexity"))


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), ' +'), lambda x: length(x) > 2))) AS INTEGER) AS unique_tokens FROM documents")
def unique_tokens(spark, sf_dir):
    """SCALAR-17."""
    return load(spark, sf_dir, "documents").select("doc_id", t.unique_tokens(F.col("text")).alias("unique_tokens"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS by_length, CAST(ceil(ceil(length(text) / 3.5::DOUBLE) + len(string_split(text, chr(10))) * 0.1::DOUBLE + ((length(text) - length(replace(text, '```', ''))) // 3) * 5.0::DOUBLE + 2 * ((length(text) - length(replace(text, 'function', ''))) // 8 + (length(text) - length(replace(text, '=>', ''))) // 2 + (length(text) - length(replace(text, '{', '')))) + 20) AS BIGINT) AS by_structure, CAST(len(string_split(text, chr(10))) * 15 + 2 * 5 * 15 AS INTEGER) AS by_span FROM documents")
def token_estimates(spark, sf_dir):
    """SCALAR-14, 15, 16."""
    x = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", t.tokens_by_length(x).alias("by_length"), t.tokens_by_structure(x).alias("by_structure"), t.tokens_by_span(F.lit(1), F.size(F.split(x, "\n")), 5).alias("by_span"))


_QUERY_LABELS = r"""
SELECT conv_id, turn,
  round(least(1.0, least(1.0, length(text) / 200.0) + least(0.3, n / 20.0) + CASE WHEN regexp_matches(low, '\b(class|function|import|export|async|await|error|bug|fix)\b') THEN 0.2 ELSE 0 END), 6)::DOUBLE AS score,
  CASE WHEN n > 10 OR regexp_matches(low, '\b(implement|understand|analyze|debug|refactor|architecture)\b') THEN 'complex' WHEN n > 5 THEN 'medium' ELSE 'simple' END AS label,
  CASE WHEN regexp_matches(low, '\b(debug|error|fix|bug|issue)\b') THEN 'high-relevance' WHEN regexp_matches(low, '\b(understand|learn|explore|architecture|overview)\b') THEN 'high-diversity' ELSE 'balanced' END AS preset
FROM (SELECT *, lower(text) AS low, len(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS n FROM conversations WHERE role = 'user')
"""


@query(_QUERY_LABELS)
def query_labels(spark, sf_dir):
    """SCALAR-25, 26, 27 on user turns."""
    x = F.col("text")
    c = load(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.round(t.query_complexity(x), 6).alias("score"), t.query_label(x).alias("label"), t.preset_for(x).alias("preset"))


@query("SELECT doc_id, CAST(p AS INTEGER) AS page, length(substr(text, p * 1000 + 1, 1000)) AS n_chars FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS p FROM documents)")
def paged_text(spark, sf_dir):
    """SRC-24, SCALAR-37: fixed-width pages."""
    p = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.pages(F.col("text"), 1000)).alias("page", "part"))
    return p.select("doc_id", "page", F.length("part").cast("long").alias("n_chars"))


#: Paths of pages: the url's, with an extension by page number, and some in folders that are skipped.
_PATH_SQL = "CASE page_id % 11 WHEN 3 THEN 'node_modules/' WHEN 7 THEN 'x/coverage/' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') || list_value('.ts', '.md', '.HTML', '.exe', '.scss', '.rb', '.py')[page_id % 7 + 1]"


def _paths(df):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".ts", ".md", ".HTML", ".exe", ".scss", ".rb", ".py"))), (F.col("page_id") % 7 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 11 == 3, "node_modules/").when(F.col("page_id") % 11 == 7, "x/coverage/").otherwise("")
    return df.withColumn("path", F.concat(folder, F.regexp_replace("url", "^[a-z]+://", ""), ext))


@query(f"SELECT page_id, ext, ext IN ('.js', '.jsx', '.ts', '.tsx', '.py', '.go', '.rs', '.java', '.cpp', '.c', '.h') AS is_code, substr(sha256(path), 1, 12) AS path_hash FROM (SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)) WHERE NOT regexp_matches(path, 'node_modules|\\.git|dist|build|coverage|\\.next|\\.cache') AND ext IN ('.js', '.jsx', '.ts', '.tsx', '.py', '.go', '.rs', '.java', '.cpp', '.c', '.h', '.hpp', '.md', '.rst', '.txt', '.json', '.yaml', '.yml', '.toml', '.html', '.css', '.scss')")
def relevant_files(spark, sf_dir):
    """FILT-1, FILT-2, SCALAR-29 over the paths of pages."""
    p = _paths(load(spark, sf_dir, "pages").select("page_id", "url")).where(t.is_relevant(F.col("path")))
    return p.select("page_id", t.extension(F.col("path")).alias("ext"), t.is_code(F.col("path")).alias("is_code"), t.path_hash(F.col("path")).alias("path_hash"))


@query("SELECT doc_id, concat_ws(' ', 'doc_' || doc_id, 'documentation', substr(text, 1, 80), source) AS embedding_text, sha256(concat_ws(' ', 'doc_' || doc_id, 'documentation', text, source)) AS digest FROM documents")
def embedding_texts(spark, sf_dir):
    """PROJ-3: the text that is embedded, and its digest as cache key."""
    d = load(spark, sf_dir, "documents")
    full = lambda body: t.embedding_text(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.lit("documentation"), body, F.array("source"))
    return d.select("doc_id", full(F.substring("text", 1, 80)).alias("embedding_text"), F.sha2(full(F.col("text")), 256).alias("digest"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    """SRC-4, WIN-4: the latest event of every user by aggregate."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    """JSON-1."""
    return load(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT s AS source, to_json(map_from_entries(list_sort(list((l, n))))) AS counts FROM (SELECT source AS s, lang AS l, count(*) AS n FROM documents GROUP BY ALL) GROUP BY s")
def canonical_json_counts(spark, sf_dir):
    """JSON-2, MAP-1: maps as JSON with sorted keys."""
    c = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(t.canonical_json(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).alias("counts"))
