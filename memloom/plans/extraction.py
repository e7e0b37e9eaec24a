from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, search
from ..sources import code
from .registry import Tables, query


@query("""
WITH f AS (SELECT source || '/' || CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' ELSE '.txt' END AS path, text FROM documents)
SELECT path, strlen(text) AS size, sha256(text) AS sha256 FROM f WHERE (ends_with(lower(path), '.py') OR ends_with(lower(path), '.ts')) AND NOT contains(path, '/node_modules/')""")
def s1_source_files(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat("source", F.lit("/"), F.when(i % 11 == 0, "node_modules/").otherwise(""), i, F.when(i % 3 == 0, ".py").when(i % 3 == 1, ".TS").otherwise(".txt"))
    return code.source_files(t.documents.select(path.alias("path"), F.col("text").alias("content")), "path", "content")


PATTERNS = [("pipe", r"^(\w+) \|"), ("license", r"(?i)^\s*(copyright|licen[sc]e)"), ("heading", r"^([A-Z]\w+) [a-z]+\.$"), ("the", r"The ([a-z]+)")]


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^(\w+) \|') THEN 'pipe' WHEN regexp_matches(line, '(?i)^\s*(copyright|licen[sc]e)') THEN 'license' WHEN regexp_matches(line, '^([A-Z]\w+) [a-z]+\.$') THEN 'heading' WHEN regexp_matches(line, 'The ([a-z]+)') THEN 'the' END AS kind FROM l)
SELECT doc_id, line_no, kind, regexp_extract(line, CASE kind WHEN 'pipe' THEN '^(\w+) \|' WHEN 'license' THEN '(?i)^\s*(copyright|licen[sc]e)' WHEN 'heading' THEN '^([A-Z]\w+) [a-z]+\.$' ELSE 'The ([a-z]+)' END, 1) AS name FROM k WHERE kind IS NOT NULL""")
def s3_classify_lines(t: Tables) -> DataFrame:
    return code.classify_lines(t.documents, ["doc_id"], "text", PATTERNS)


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS target FROM pages)
SELECT page_id, target, 'import' AS kind, 0.5 AS confidence FROM l""")
def s5_link_edges(t: Tables) -> DataFrame:
    links = t.pages.select(F.col("page_id").cast("string").alias("file"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'))).alias("name")).withColumn("k", F.lit("import"))
    e = code.lexical_relations(links, "file", "name", "k")
    return e.select(F.col("file").cast("long").alias("page_id"), F.col("destination").alias("target"), "kind", F.col("confidence").cast("decimal(2,1)").alias("confidence"))


@query("""
WITH n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 15 = 1), m AS (SELECT id, count(*) AS n FROM n GROUP BY 1),
e AS (SELECT o_orderkey % 1500 AS source, o_custkey AS target, CASE o_orderstatus WHEN 'F' THEN 'calls' WHEN 'O' THEN 'imports' ELSE 'owns' END AS relation FROM orders)
SELECT CASE WHEN relation = 'owns' THEN 'relation_unsupported' WHEN a.id IS NULL OR b.id IS NULL THEN 'endpoint_unresolved' WHEN a.n > 1 OR b.n > 1 THEN 'node_id_duplicate' ELSE 'ok' END AS reason, count(*) AS n
FROM e LEFT JOIN m a ON source = a.id LEFT JOIN m b ON target = b.id GROUP BY 1""")
def s7_translate_graph(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"))
    nodes = c.where("id % 10 <> 0").union(c.where("id % 15 = 1"))
    relation = F.when(F.col("o_orderstatus") == "F", "calls").when(F.col("o_orderstatus") == "O", "imports").otherwise("owns")
    edges = t.orders.select((F.col("o_orderkey") % 1500).alias("source"), F.col("o_custkey").alias("target"), relation.alias("relation"))
    good, skipped = code.translate_edges(nodes, edges)
    return skipped.groupBy("reason").agg(F.count("*").alias("n")).unionByName(good.groupBy(F.lit("ok").alias("reason")).agg(F.count("*").alias("n")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)")
def s8_orphan_edges(t: Tables) -> DataFrame:
    return graph.orphans(t.lineitem, "l_orderkey", t.orders.where("o_orderkey % 97 <> 0"), "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT source, lang, doc_id, count(*) OVER (PARTITION BY source, lang) AS size, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS position FROM documents")
def s12_grouped(t: Tables) -> DataFrame:
    return search.grouped(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("SELECT doc_id, substring(text, 11, 40) AS part FROM documents")
def s14_read_range(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", search.page(F.col("text"), 10, 40)[0].alias("part"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'available' WHEN 3 THEN 'unavailable' ELSE 'fallback' END AS support FROM documents")
def z1_negotiate(t: Tables) -> DataFrame:
    i = F.col("doc_id") % 4
    path = F.concat(F.lit("a/b"), F.when(i == 0, ".py").when(i == 1, ".tsx").when(i == 2, ".RS").otherwise(".go"))
    return t.documents.select("doc_id", code.support(code.language(path)).alias("support"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x1_window_counts(t: Tables) -> DataFrame:
    """Tumbling hourly counts; the same function serves a stream."""
    from ..streaming.changelog import window_counts

    return window_counts(t.events, "ts", "event_type", "1 hour", "10 minutes")
