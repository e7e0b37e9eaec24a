from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context as c
from .registry import Tables, query


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT *, strlen(line) AS bytes, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY n) AS cum_bytes FROM l)
SELECT doc_id, n AS line_no, bytes, cum_bytes, least(bytes, greatest(0, 400 - (cum_bytes - bytes))) AS kept_bytes, CAST(ceil(least(bytes, greatest(0, 400 - (cum_bytes - bytes))) / 4.0) AS BIGINT) AS tokens FROM s WHERE cum_bytes - bytes < 400""")
def c1_line_context(t: Tables) -> DataFrame:
    """The lines of each document in a byte budget; the last one is cut to what is left."""
    lines = t.documents.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), F.octet_length("line").alias("bytes"))
    return c.line_budget(lines, "doc_id", "line_no", 400).withColumn("tokens", text.estimated_tokens(F.col("kept_bytes")))


B2 = """
WITH RECURSIVE c AS ({items}), f AS (
  SELECT {key}, rank, id, size, CASE WHEN size <= {budget} THEN size ELSE 0 END AS used, size <= {budget} AS taken, CASE WHEN size <= {budget} THEN 1 ELSE 0 END AS n FROM c WHERE rank = 1
  UNION ALL
  SELECT c.{key}, c.rank, c.id, c.size, CASE WHEN f.used + c.size <= {budget} AND f.n < {max} THEN f.used + c.size ELSE f.used END, f.used + c.size <= {budget} AND f.n < {max}, CASE WHEN f.used + c.size <= {budget} AND f.n < {max} THEN f.n + 1 ELSE f.n END
  FROM f JOIN c ON c.{key} = f.{key} AND c.rank = f.rank + 1)
SELECT {key}, rank, id, size, n AS accepted_rank FROM f WHERE taken"""


@query(B2.format(key="conv_id", budget=900, max=1000, items="SELECT conv_id, turn AS id, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, strlen(text), turn) AS rank FROM conversations"))
def c4_select_view(t: Tables) -> DataFrame:
    """Turns of each conversation by priority, skipping those that don't fit."""
    priority = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    turns = t.conversations.select("conv_id", F.col("turn").alias("id"), F.octet_length("text").alias("bytes"), priority.alias("p"))
    return c.skip_and_continue(turns, ["conv_id"], [F.col("p"), F.col("bytes"), F.col("id")], "bytes", 900, ["id"], 1000)


@query("""
WITH i AS (SELECT lang AS type, left(sha256(doc_id::VARCHAR), 16) AS handle, doc_id, n_chars, 1 AS items FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) + 1 >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY type, handle) AS d FROM i),
r AS (SELECT *, sum(n_chars) OVER (ORDER BY type, handle) AS cum_n_chars, sum(items) OVER (ORDER BY type, handle) AS cum_items, row_number() OVER (ORDER BY type, handle) AS rank FROM k WHERE d <= 20)
SELECT type, handle, doc_id, rank, cum_n_chars, cum_items FROM r WHERE cum_n_chars <= 60000 AND cum_items <= 50""")
def c6_compile_context(t: Tables) -> DataFrame:
    docs = t.documents.join(t.labels, "doc_id", "left")
    items = docs.select(F.col("lang").alias("type"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("handle"), F.sha2("text", 256).alias("digest"), (F.coalesce("quality", F.lit(0)) + 1).alias("trust"), "doc_id", "n_chars", F.lit(1).alias("items"))
    return c.compile_context(items, 2, 20, {"n_chars": 60000, "items": 50}, 1000).select("type", "handle", "doc_id", "rank", "cum_n_chars", "cum_items")


@query(B2.format(key="g", budget=2000, max=8, items="SELECT * FROM (SELECT lang AS g, doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS size, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN contains(lower(text), 'the') THEN 0 ELSE 1 END, doc_id) AS rank FROM documents) WHERE rank <= 128"))
def c8_select_scored(t: Tables) -> DataFrame:
    """Up to 8 documents of each language in a token budget."""
    hit = F.when(F.lower("text").contains("the"), 0).otherwise(1)
    docs = t.documents.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), text.estimated_tokens(F.col("n_chars")).alias("tokens"), hit.alias("miss"))
    return c.skip_and_continue(docs, ["g"], [F.col("miss"), F.col("id")], "tokens", 2000, ["id"], 128, 8)


@query("""
WITH s AS (SELECT conv_id AS source, turn AS handle, turn * 10 % 70 AS s, turn * 10 % 70 + strlen(text) % 90 AS e FROM conversations)
SELECT source, handle, s AS start, e AS "end" FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.source = a.source AND b.s <= a.s AND b.e >= a.e AND (b.e - b.s > a.e - a.s OR (b.s = a.s AND b.e = a.e AND b.handle < a.handle)))""")
def c9_drop_contained(t: Tables) -> DataFrame:
    start = F.col("turn") * 10 % 70
    spans = t.conversations.select(F.col("conv_id").alias("source"), F.col("turn").alias("handle"), start.alias("start"), (start + F.octet_length("text") % 90).alias("end"))
    return c.drop_contained_spans(spans, "source", "handle", "start", "end")


@query("""
WITH s AS (SELECT conv_id, turn, length(text) / 1000.0 AS score FROM conversations), f AS (SELECT *, greatest(0.12, 0.75 * max(score) OVER (PARTITION BY conv_id)) AS floor FROM s)
SELECT conv_id, turn, round(score, 6) AS score FROM f WHERE score >= floor""")
def c10_score_floor(t: Tables) -> DataFrame:
    """Items that reach the floor and three quarters of their group's top score."""
    s = t.conversations.select("conv_id", "turn", (F.length("text") / F.lit(1000.0)).alias("score"))
    return c.score_floor(s, "conv_id", "score", 0.12, 0.75).select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("""
WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'metadata' WHEN 1 THEN 'summary' ELSE 'exact' END AS level, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN left(text, 160) ELSE text END AS body FROM documents),
r AS (SELECT doc_id, level, length(body) AS size, sum(length(body)) OVER (ORDER BY doc_id) AS cum_size FROM b) SELECT doc_id, level, size, cum_size FROM r WHERE cum_size <= 20000""")
def c11_fidelity(t: Tables) -> DataFrame:
    i = F.col("doc_id") % 3
    level = F.when(i == 0, "metadata").when(i == 1, "summary").otherwise("exact")
    spans = t.documents.select("doc_id", level.alias("level"), F.length(c.fidelity(F.col("text"), level)).alias("size"))
    return c.prefix_stop(spans, [F.col("doc_id")], {"size": 20000}, candidates=10000).select("doc_id", "level", "size", "cum_size")


@query("SELECT id, type, n FROM (SELECT doc_id AS id, 'code' AS type, n_chars AS n FROM documents UNION ALL SELECT page_id, 'knowledge', length(html) FROM pages UNION ALL SELECT event_id, 'operations', length(props) FROM events)")
def c13_union_sources(t: Tables) -> DataFrame:
    long = lambda c: F.length(c).cast("long").alias("n")
    sources = {
        "code": t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("n")), "knowledge": t.pages.select(F.col("page_id").alias("id"), long("html")),
        "operations": t.events.select(F.col("event_id").alias("id"), long("props")),
    }
    return c.union_sources(sources, ["id", "n"])


@query("""
SELECT doc_id, list_filter([CASE WHEN doc_id % 5 = 0 THEN 'authority_not_facts' END, CASE WHEN contains(text, 'token') THEN 'private_field' END, CASE WHEN (n_chars > 2000) <> (n_chars > 4000) THEN 'truncation_reason_mismatch' END, CASE WHEN n_chars > 10000 THEN 'packet_too_large' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def c15_packet_checks(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    reasons = c.packet_reasons(F.when(F.col("doc_id") % 5 == 0, "orders").otherwise("facts"), F.col("text").contains("token"), n > 2000, F.when(n > 4000, F.array(F.lit("budget"))).otherwise(F.array().cast("array<string>")), n, 10000)
    return t.documents.select("doc_id", reasons.alias("reasons"))


@query(f"""
WITH r AS (SELECT doc_id, text, regexp_replace(text, '{text.ASSIGNMENT}', '\\1\\2<redacted>', 'g') AS once FROM documents)
SELECT doc_id, sha256(regexp_replace(once, '{text.BEARER}', 'Bearer <redacted>', 'g')) AS digest, regexp_matches(text, '{text.ASSIGNMENT}') OR regexp_matches(once, '{text.BEARER}') AS redacted FROM r""")
def c16_redact(t: Tables) -> DataFrame:
    value, flag = text.redact(F.col("text"))
    return t.documents.select("doc_id", F.sha2(value, 256).alias("digest"), flag.alias("redacted"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'changed text ' || doc_id ELSE text END AS text FROM documents WHERE NOT (doc_id % 6 = 3)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d), s AS (SELECT doc_id, line_no, strlen(line) AS bytes, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS cum_bytes FROM l)
SELECT * FROM s WHERE cum_bytes <= 500""")
def c3_overlay_context(t: Tables) -> DataFrame:
    """Lines in a byte budget over a base with an overlay: changed texts replace, tombstones remove."""
    from ..operators.temporal import overlay

    base = t.documents.select("doc_id", "text")
    changed = base.where("doc_id % 3 = 0").select("doc_id")
    rows = base.where("doc_id % 6 = 0").select("doc_id", F.concat(F.lit("changed text "), "doc_id").alias("text"))
    merged = overlay(base, changed, rows, "doc_id")
    lines = merged.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"), F.octet_length("line").alias("bytes"))
    return c.prefix_stop(lines, [F.col("line_no")], {"bytes": 500}, ["doc_id"]).select("doc_id", "line_no", "bytes", "cum_bytes")


@query("""
WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*')) AS t, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents), r AS (SELECT doc_id, tokens, len(list_intersect(['the', 'of', 'que'], t)) AS relevance FROM f),
k AS (SELECT * FROM r WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 30), b AS (SELECT doc_id, relevance, sum(tokens) OVER (ORDER BY relevance DESC, doc_id) AS cum_tokens FROM k) SELECT * FROM b WHERE cum_tokens <= 9000""")
def c7_knowledge_context(t: Tables) -> DataFrame:
    """The most relevant facts, at most 30, then a token budget that stops."""
    from ..operators.lexical import knowledge_query

    i = F.col("doc_id")
    facts = t.documents.select(i, i.alias("handle"), F.lit(1).alias("version"), "text", F.lit(1).alias("trust"), F.lit("active").alias("state"), F.lit("doc").alias("source_type"), F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_until"), F.lit(False).alias("conflicted"), text.estimated_tokens(F.col("n_chars")).alias("tokens"))
    best = knowledge_query(facts, "the of que", floor=0, as_of=1, limit=30)
    return c.prefix_stop(best, [F.desc("relevance"), i], {"tokens": 9000}, candidates=30).select("doc_id", "relevance", "cum_tokens")


@query("""
WITH e AS (SELECT doc_id, n_chars AS bytes, row_number() OVER (ORDER BY doc_id) AS rank, sum(n_chars) OVER (ORDER BY doc_id) AS cum_bytes FROM documents) SELECT doc_id, cum_bytes FROM e WHERE rank <= 25 AND cum_bytes <= 40000""")
def c12_bounded_resolve(t: Tables) -> DataFrame:
    """Handles in request order until entries or bytes run out."""
    asked = t.documents.select("doc_id", F.col("n_chars").alias("bytes"), F.lit(1).alias("entries"))
    return c.prefix_stop(asked, [F.col("doc_id")], {"bytes": 40000, "entries": 25}, candidates=1000).select("doc_id", "cum_bytes")
