from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search as s
from .registry import Tables, query

EDGES = "SELECT l_orderkey, l_linenumber, 'supplier-' || l_suppkey AS origin, 'part-' || l_partkey AS destination, l_suppkey AS origin_id, l_partkey AS destination_id, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'reference' ELSE 'import' END AS kind, 1 - l_discount AS confidence FROM lineitem"


def edges(t: Tables) -> DataFrame:
    """Lineitems as typed relations from suppliers to parts."""
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "reference").otherwise("import")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("supplier-"), "l_suppkey").alias("origin"), F.concat(F.lit("part-"), "l_partkey").alias("destination"),
        F.col("l_suppkey").alias("origin_id"), F.col("l_partkey").alias("destination_id"), kind.alias("kind"), (1 - F.col("l_discount")).alias("confidence"),
    )


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) = 'red widget'")
def q1_find_exact(t: Tables) -> DataFrame:
    return s.find_exact(t.part, "p_name", "RED widget").select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget')) AND p_brand = 'Brand#17'")
def q2_search(t: Tables) -> DataFrame:
    return s.search(t.part, "Widget", "p_name", "p_type", path=("p_brand", "Brand#17")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(lower(p_name), 'red') AND p_type = 'ECONOMY'")
def q2_search_prefix(t: Tables) -> DataFrame:
    return s.search(t.part, "red", "p_name", "p_type", prefix=True, kind=("p_type", "ECONOMY")).select("p_partkey", "p_name", "p_type")


@query("""
WITH h AS (SELECT *, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 WHEN contains(lower(p_name), 'red') THEN 2 END AS tier FROM part),
b AS (SELECT *, min(tier) OVER () AS best FROM h WHERE tier IS NOT NULL)
SELECT p_partkey, p_name, tier FROM b WHERE tier = best AND p_size > 10 AND p_partkey > 100 ORDER BY p_partkey LIMIT 40""")
def q3_tiered_search(t: Tables) -> DataFrame:
    return s.tiered_search(t.part, "red", ["p_name"], "p_partkey", where=F.col("p_size") > 10, after=100, limit=40).select("p_partkey", "p_name", "tier")


@query(f"SELECT l_orderkey, l_linenumber, origin, destination, kind, confidence FROM ({EDGES}) WHERE (origin = 'supplier-7' OR destination = 'supplier-7' OR origin_id::VARCHAR = 'supplier-7' OR destination_id::VARCHAR = 'supplier-7') AND kind = 'call' ORDER BY l_orderkey, l_linenumber LIMIT 50")
def q4_edges_of(t: Tables) -> DataFrame:
    e = edges(t).withColumns({"oid": F.col("origin_id").cast("string"), "did": F.col("destination_id").cast("string")})
    return s.edges_of(e, ["origin", "destination", "oid", "did"], "supplier-7", ("kind", "call"), ["l_orderkey", "l_linenumber"], 50).select("l_orderkey", "l_linenumber", "origin", "destination", "kind", "confidence")


@query(f"""
WITH e AS ({EDGES}), sym AS (SELECT 'part-' || p_partkey AS id, p_name AS name FROM part WHERE contains(lower('part-' || p_partkey), 'hot gear') OR contains(lower(p_name), 'hot gear'))
SELECT l_orderkey, l_linenumber, origin, destination FROM e WHERE contains(lower(origin), 'hot gear') OR contains(lower(destination), 'hot gear')
 OR origin IN (SELECT id FROM sym UNION SELECT name FROM sym) OR destination IN (SELECT id FROM sym UNION SELECT name FROM sym)""")
def q5_impact(t: Tables) -> DataFrame:
    symbols = t.part.select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return s.impact(edges(t), ["origin", "destination"], symbols, ["id", "name"], "hot gear").select("l_orderkey", "l_linenumber", "origin", "destination")


OPERATIONS = "SELECT 'op-' || event_id AS handle, event_type AS kind, CASE WHEN value < 5 THEN 'queued' WHEN value < 15 THEN 'running' ELSE 'complete' END AS status, event_id AS sequence, user_id, value FROM events"


def operations(t: Tables) -> DataFrame:
    status = F.when(F.col("value") < 5, "queued").when(F.col("value") < 15, "running").otherwise("complete")
    return t.events.select(F.concat(F.lit("op-"), "event_id").alias("handle"), F.col("event_type").alias("kind"), status.alias("status"), F.col("event_id").alias("sequence"), "user_id", "value")


@query(f"""
WITH o AS ({OPERATIONS}) SELECT handle, kind, status, sequence FROM o
WHERE kind = 'click' AND sequence <= 3000 AND NOT (status = 'complete' AND sequence % 7 = 0) ORDER BY sequence DESC, handle DESC LIMIT 100""")
def q8_latest_operations(t: Tables) -> DataFrame:
    ops = operations(t)
    gaps = ops.where(F.col("sequence") % 7 == 0).select("handle")  # as if their parents were missing
    return s.latest_operations(ops, kind="click", as_of=3000, gaps=gaps).select("handle", "kind", "status", "sequence")


@query(f"WITH o AS ({OPERATIONS}) SELECT handle, kind, status, sequence FROM o WHERE kind IN ('click', 'view') AND status = 'running' ORDER BY sequence DESC, handle DESC LIMIT 200")
def q9_slots(t: Tables) -> DataFrame:
    slots = operations(t).where(F.col("kind").isin("click", "view"))
    return s.latest_operations(slots, status="running", limit=200).select("handle", "kind", "status", "sequence")


@query("SELECT event_id, user_id, (TIMESTAMP '2024-01-05 00:00:00' < ts + to_seconds(CAST(value * 3600 AS BIGINT))) AS active FROM events")
def q10_leases(t: Tables) -> DataFrame:
    expires = F.expr("ts + make_dt_interval(0, 0, 0, cast(cast(round(value * 3600) AS bigint) AS decimal(18,6)))")
    return t.events.select("event_id", "user_id", (F.lit("2024-01-05 00:00:00").cast("timestamp") < expires).alias("active"))


@query("""
WITH c AS (SELECT left(sha256(doc_id::VARCHAR), 20) AS handle, source AS namespace, doc_id % 3 AS generation, CASE WHEN doc_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END AS state,
  CASE WHEN doc_id % 13 = 0 THEN 'bad' ELSE sha256(text) END AS digest, text FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT doc_id, left(sha256(doc_id::VARCHAR), 20) AS handle, CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE source END AS namespace, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE doc_id % 3 END AS generation FROM documents)
SELECT r.doc_id, r.handle, CASE WHEN c.namespace IS NULL THEN 'handle_unknown' WHEN r.namespace <> c.namespace THEN 'namespace_mismatch' WHEN r.generation <> c.generation THEN 'generation_stale'
 WHEN c.state <> 'active' THEN 'entry_inactive' WHEN sha256(c.text) <> c.digest THEN 'digest_mismatch' ELSE 'ok' END AS reason FROM r LEFT JOIN c USING (handle)""")
def q11_resolve_handles(t: Tables) -> DataFrame:
    handle = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20).alias("handle")
    d = t.documents.select("doc_id", "source", "text", handle)
    i = F.col("doc_id")
    catalog = d.where(i % 2 == 0).select(
        "handle", F.col("source").alias("namespace"), (i % 3).alias("generation"), F.when(i % 11 == 0, "tombstoned").otherwise("active").alias("state"),
        F.when(i % 13 == 0, "bad").otherwise(F.sha2("text", 256)).alias("digest"), F.col("text").alias("payload"),
    )
    requests = d.select("doc_id", "handle", F.when(i % 17 == 0, "other").otherwise(F.col("source")).alias("namespace"), F.when(i % 5 == 0, 9).otherwise(i % 3).alias("generation"))
    return s.resolve_handles(requests, catalog).select("doc_id", "handle", "reason")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 42")
def q12_key_lookup(t: Tables) -> DataFrame:
    return t.documents.where(F.col("doc_id") == 42).select("doc_id", "lang", "source")


@query("SELECT event_id, event_type FROM events WHERE event_id > 900")
def q13_events_since(t: Tables) -> DataFrame:
    return s.events_since(t.events, "event_id", 900, 100_000_000).select("event_id", "event_type")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND role = 'user'")
def q14_attempts(t: Tables) -> DataFrame:
    return t.conversations.where("conv_id = 3 AND role = 'user'").orderBy("turn").select("conv_id", "turn", "role")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages)
SELECT page_id, NOT (starts_with(path, '/') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') OR regexp_matches(path, '^[A-Za-z]:')) AND (path IN ('en', 'fr') OR starts_with(path, 'en/') OR starts_with(path, 'fr/')) AS permitted FROM p""")
def q15_permitted(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    return t.pages.select("page_id", s.permitted(path, ["en", "fr"]).alias("permitted"))


@query("SELECT conv_id, turn, (role <> 'system' AND CASE WHEN role = 'assistant' THEN 'implementer' ELSE 'shared' END <> 'implementer') AS shown FROM conversations")
def q16_visible(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "system", "implementer_prompt").otherwise("fact")
    visibility = F.when(F.col("role") == "assistant", "implementer").otherwise("shared")
    return t.conversations.select("conv_id", "turn", s.visible("reviewer", kind, visibility).alias("shown"))


@query("SELECT doc_id, substring(text, 101, 200) AS part, 100 + length(substring(text, 101, 200)) AS next_offset, 100 + length(substring(text, 101, 200)) >= length(text) AS eof FROM documents")
def s16_page_text(t: Tables) -> DataFrame:
    part, following, eof = s.page(F.col("text"), 100, 200)
    return t.documents.select("doc_id", part.alias("part"), following.alias("next_offset"), eof.alias("eof"))


@query("SELECT doc_id, (n_chars - 1) // 64 AS last_page, substring(text, 65, 128) AS bytes FROM documents")
def z6_segment_pages(t: Tables) -> DataFrame:
    first, last = s.page_span(64, 128, 64)
    return t.documents.select("doc_id", F.expr("(n_chars - 1) div 64").alias("last_page"), F.substring("text", first * 64 + 1, (last - first + 1) * 64).alias("bytes"))


@query("""
SELECT doc_id, left(sha256(coalesce(source,'') || chr(0) || coalesce(lang,'') || chr(0) || coalesce(text,'')), 20) AS handle, dup.n > 1 AS reused
FROM documents JOIN (SELECT source AS s2, lang AS l2, count(DISTINCT sha256(text)) AS n FROM documents GROUP BY ALL) dup ON source = s2 AND lang = l2""")
def z4_register(t: Tables) -> DataFrame:
    """Handles of catalog entries, and identities that stand for different payloads."""
    conflicts = t.documents.groupBy("source", "lang").agg((F.count_distinct(F.sha2("text", 256)) > 1).alias("reused"))
    handle = F.substring(text.digest(F.col("source"), F.col("lang"), F.col("text")), 1, 20)
    return t.documents.join(conflicts, ["source", "lang"]).select("doc_id", handle.alias("handle"), "reused")
