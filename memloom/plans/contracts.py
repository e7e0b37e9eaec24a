from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as d
from ..operators import contracts as x
from ..operators import integrity, lexical
from ..session import checkpoints
from ..sources import segments, stores
from .registry import Tables, query

PLANTED = "CASE WHEN doc_id % 11 = 0 THEN '../up/' WHEN doc_id % 13 = 0 THEN '/abs/' ELSE 'src/' END || CASE WHEN doc_id % 17 = 0 THEN 'same' ELSE CAST(doc_id AS VARCHAR(20)) END"
DIGEST = "CASE WHEN doc_id % 7 = 0 THEN {0}(text || '!') WHEN doc_id % 19 = 0 THEN 'short' ELSE {0}(text) END"
ESCAPES = "(starts_with(path, '/') OR list_contains(string_split(path, '/'), '..'))"


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR(20)", "STRING")


@query(f"""
WITH f AS (SELECT {PLANTED} AS path, text, {DIGEST.format("sha256")} AS sha FROM documents), n AS (SELECT path, count(*) AS n FROM f GROUP BY 1),
s AS (SELECT 'src/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS name, doc_id % 9 AS line, doc_id % 4 + 3 AS end_line FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'src/same', 'n' || doc_id, 1, 2 FROM labels),
m AS (SELECT path, count(*) AS m FROM s GROUP BY 1), r AS (
SELECT 'file' AS record, path AS key, CASE WHEN {ESCAPES} THEN 'path_escapes' WHEN n > 1 THEN 'path_repeated' WHEN strlen(text) > 9000 THEN 'content_too_large' WHEN sha256(text) <> sha THEN 'digest_mismatch' END AS reason FROM f JOIN n USING (path)
UNION ALL SELECT 'symbol', path || '#' || line || '#' || name, CASE WHEN path NOT IN (SELECT path FROM f) THEN 'file_unknown' WHEN name = '' THEN 'name_missing' WHEN line < 1 OR end_line < line THEN 'lines_inverted' WHEN m > 10 THEN 'too_many_symbols' END FROM s JOIN m USING (path))
SELECT * FROM r WHERE reason IS NOT NULL""")
def s8_validate_payload(t: Tables) -> DataFrame:
    files = t.documents.selectExpr(f"{_spark(PLANTED)} AS path", "text AS content", f"{DIGEST.format('sha')} AS sha256".replace("sha(text || '!')", "sha2(text || '!', 256)").replace("sha(text)", "sha2(text, 256)"))
    named = t.labels.join(t.documents, "doc_id").selectExpr("'src/' || doc_id AS path", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS name", "doc_id % 9 AS line", "doc_id % 4 + 3 AS end_line")
    symbols = named.unionByName(t.labels.selectExpr("'src/same' AS path", "'n' || doc_id AS name", "1L AS line", "2L AS end_line"))
    return x.payload_faults(files, symbols, 10, 9000)


@query(f"""
WITH e AS (SELECT doc_id AS id, CASE WHEN doc_id % 23 = 0 THEN 'v0' ELSE 'v1' END AS schema, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'h' END AS head, {PLANTED} AS path, text, {DIGEST.format("sha256")} AS sha FROM documents)
SELECT id, CASE WHEN schema <> 'v1' THEN 'schema_unsupported' WHEN head IS DISTINCT FROM 'h' THEN 'head_mismatch' WHEN {ESCAPES} THEN 'path_escapes' WHEN strlen(sha) <> 64 THEN 'digest_malformed' WHEN sha <> sha256(text) THEN 'digest_mismatch' END AS reason FROM e""")
def s10_validate_handoff(t: Tables) -> DataFrame:
    e = t.documents.selectExpr("doc_id AS id", "CASE WHEN doc_id % 23 = 0 THEN 'v0' ELSE 'v1' END AS schema", "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'h' END AS head", f"{_spark(PLANTED)} AS path", "text AS content", f"{DIGEST.format('sha')} AS sha256".replace("sha(text || '!')", "sha2(text || '!', 256)").replace("sha(text)", "sha2(text, 256)"))
    return x.handoff_faults(e, "h", "v1").select("id", "reason")


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'dimensions_invalid' WHEN p_brand LIKE '%3' THEN 'metric_unknown' WHEN p_size % 4 NOT IN (1, 2) THEN 'lane_unknown' WHEN p_partkey % 10 = 0 THEN 'empty' WHEN p_partkey % 21 = 0 THEN 'generation_missing' END AS reason FROM part""")
def v14_validate_manifest(t: Tables) -> DataFrame:
    m = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 9 == 0, 0).otherwise(F.col("p_size")).alias("dimensions"), F.when(F.col("p_brand").endswith("3"), "other").otherwise("cosine").alias("metric"), (F.col("p_size") % 4).alias("bits"),
        (F.col("p_partkey") % 10).alias("rows"), F.when(F.col("p_partkey") % 21 == 0, None).otherwise(1).alias("generation"),
    )
    return x.manifest_faults(m, ["cosine", "l2"], [1, 2]).select("id", "reason")


@query("SELECT concat('code:', c_custkey) AS handle, c_nationkey AS generation, sha256(concat('code:', c_custkey, '|', c_nationkey, '|c_mktsegment=', c_mktsegment, '|c_name=', c_name)) AS digest FROM customer")
def z2_envelopes(t: Tables) -> DataFrame:
    return x.envelope(t.customer, "code", F.col("c_custkey"), ["c_name", "c_mktsegment"], F.col("c_nationkey")).select("handle", "generation", "digest")


@query("SELECT o_orderkey, month(o_orderdate) = 3 AS valid FROM orders")
def z15_current_generation(t: Tables) -> DataFrame:
    return t.orders.withColumn("generation", F.month("o_orderdate")).select("o_orderkey", x.current_generation("generation", 3).alias("valid"))


@query("SELECT l_orderkey AS view FROM lineitem GROUP BY 1 HAVING NOT list_has_any(list(l_suppkey), (SELECT list(s_suppkey) FROM supplier WHERE s_suppkey % 10 = 1))")
def z8_surviving_views(t: Tables) -> DataFrame:
    views = t.lineitem.groupBy(F.col("l_orderkey").alias("view")).agg(F.collect_set("l_suppkey").alias("paths"))
    return x.surviving_views(views, t.supplier.where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("path"))).select("view")


SETTINGS = "CASE p_partkey % 6 WHEN 0 THEN 'max_lines=10; max_bytes=200' WHEN 1 THEN 'max_lines=-1' WHEN 2 THEN 'bogus=1' WHEN 3 THEN 'max_lines' WHEN 4 THEN 'max_lines=1;max_lines=2' ELSE '' END"


@query(f"""
WITH s AS (SELECT p_partkey, {SETTINGS} AS s FROM part), p AS (SELECT *, list_filter(list_transform(string_split(s, ';'), lambda v: trim(v)), lambda v: v <> '') AS parts FROM s), q AS (SELECT *, list_transform(parts, lambda v: split_part(v, '=', 1)) AS names FROM p),
r AS (SELECT *, CASE WHEN len(list_filter(parts, lambda v: NOT regexp_full_match(v, '\\w+\\s*=\\s*-?[0-9]+'))) > 0 THEN 'malformed' WHEN len(list_filter(names, lambda v: v NOT IN ('max_lines', 'max_bytes'))) > 0 THEN 'unknown_setting' WHEN len(list_distinct(names)) < len(names) THEN 'repeated' WHEN contains(s, '=-') THEN 'negative' END AS fault FROM q)
SELECT p_partkey, fault, CASE WHEN fault IS NULL THEN TRY_CAST(regexp_extract(s, 'max_lines=([0-9]+)', 1) AS BIGINT) END AS max_lines FROM r""")
def z30_settings(t: Tables) -> DataFrame:
    values, fault = x.settings(F.expr(SETTINGS), ["max_lines", "max_bytes"])
    return t.part.select("p_partkey", fault.alias("fault"), F.try_element_at(values, F.lit("max_lines")).alias("max_lines"))


@query("""
WITH e AS (SELECT event_id, event_type AS cache, user_id % 12 AS k FROM events), p AS (SELECT *, lag(event_id) OVER (PARTITION BY cache, k ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY cache, k ORDER BY event_id) = 1 AS new FROM e),
q AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY cache ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
b AS (SELECT p.event_id, count(DISTINCT x.k) AS n FROM p JOIN e x ON x.cache = p.cache AND x.event_id > p.prev AND x.event_id < p.event_id GROUP BY 1)
SELECT q.event_id, CASE WHEN prev IS NOT NULL AND coalesce(n, 0) < 6 THEN 'hit' WHEN coalesce(seen, 0) >= 6 THEN 'evicting_miss' ELSE 'miss' END AS outcome FROM q LEFT JOIN b ON q.event_id = b.event_id""")
def m1_lru_outcomes(t: Tables) -> DataFrame:
    """Requests to a pager of six pages for each kind of event: the log of the cache, replayed."""
    r = t.events.select("event_id", F.col("event_type").alias("cache"), (F.col("user_id") % 12).alias("k"))
    return x.lru_outcomes(r, "cache", "event_id", "k", 6).select("event_id", "outcome")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id % 50 AS k, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
f AS (SELECT event_id, k, n, event_id AS flight FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.k, e.n, CASE WHEN e.event_id >= f.flight + 100 THEN e.event_id ELSE f.flight END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT event_id, flight FROM f""")
def m2_single_flight(t: Tables) -> DataFrame:
    return x.flights(t.events.select((F.col("user_id") % 50).alias("k"), "event_id"), "k", "event_id", 100).select("event_id", "flight")


@query("""
WITH p AS (SELECT o_custkey AS k, month(o_orderdate) AS g, min(o_orderstatus) AS r, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'quarantined' ELSE 'reusable' END AS state FROM orders GROUP BY 1, 2)
SELECT c_custkey AS k, CASE WHEN state = 'quarantined' THEN state WHEN c_custkey % 9 = 0 AND c_custkey IN (SELECT k FROM p) THEN 'drifted' WHEN state = 'reusable' THEN 'hit' WHEN c_custkey IN (SELECT k FROM p) THEN 'stale' ELSE 'miss' END AS outcome,
 CASE WHEN state = 'reusable' AND c_custkey % 9 <> 0 THEN r END AS result FROM customer LEFT JOIN p ON c_custkey = p.k AND g = 3""")
def m5_decision_cache(t: Tables) -> DataFrame:
    puts = t.orders.select(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("g"), F.col("o_orderstatus").alias("result"))
    cache = x.decisions(puts, ["k"], "g", "result")
    wanted = t.customer.select(F.col("c_custkey").alias("k"), F.lit(3).alias("g"))
    drifted = cache.where("k % 9 = 0").select("k")
    return x.decision_lookups(wanted, cache, ["k"], "g", "result", drifted).select("k", "outcome", "result")


@query("SELECT l_partkey, min(l_returnflag) AS l_returnflag, count(*) AS runs FROM lineitem GROUP BY l_partkey, l_suppkey % 3 HAVING count(DISTINCT l_returnflag) = 1")
def m7_reusable_validations(t: Tables) -> DataFrame:
    r = t.lineitem.select("l_partkey", (F.col("l_suppkey") % 3).alias("s"), "l_returnflag")
    return x.reusable_validations(r, ["l_partkey", "s"], "l_returnflag").select("l_partkey", "l_returnflag", "runs")


@query("""
SELECT k AS check, p AS passed, count(*) AS n FROM (SELECT 'priced' AS k, o_totalprice > 1000 AS p FROM orders UNION ALL SELECT 'closed', o_orderstatus = 'F' FROM orders UNION ALL SELECT 'dated', o_orderdate IS NOT NULL FROM orders) GROUP BY 1, 2""")
def i11_conformance(t: Tables) -> DataFrame:
    checks = {"priced": F.col("o_totalprice") > 1000, "closed": F.col("o_orderstatus") == "F", "dated": F.col("o_orderdate").isNotNull()}
    return x.conformance(t.orders.withColumnRenamed("o_orderkey", "case"), checks).groupBy("check", "passed").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def k5_sealed_store(t: Tables) -> DataFrame:
    """A table written with its seal, and read back verified."""
    checkpoints(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    stores.save(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return stores.load(t.spark, path)


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT conv_id, turn, n, text, '' AS prev_hash, sha256(text) AS record_hash FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, c.text, h.record_hash, sha256(h.record_hash || c.text) FROM h JOIN c ON c.conv_id = h.conv_id AND c.n = h.n + 1),
k AS (SELECT conv_id, turn AS sequence, CASE WHEN conv_id % 5 = 1 AND turn = 1 THEN text || '!' ELSE text END AS payload, prev_hash, record_hash FROM h WHERE NOT (conv_id % 7 = 2 AND turn = 1)),
l AS (SELECT *, lag(sequence) OVER w AS ps, lag(record_hash) OVER w AS ph FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY sequence)),
b AS (SELECT conv_id, min(sequence) AS bad FROM l WHERE (ps IS NOT NULL AND sequence <> ps + 1) OR prev_hash <> coalesce(ph, '') OR sha256(prev_hash || payload) <> record_hash GROUP BY 1)
SELECT l.conv_id, sequence, record_hash FROM l LEFT JOIN b ON l.conv_id = b.conv_id WHERE bad IS NULL OR sequence < bad""")
def k8_recover_tail(t: Tables) -> DataFrame:
    chain = integrity.build_chain(t.conversations, "conv_id", "turn", "text").where("NOT (conv_id % 7 = 2 AND sequence = 1)")
    tampered = chain.withColumn("payload", F.when((F.col("conv_id") % 5 == 1) & (F.col("sequence") == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return stores.valid_prefix(tampered, "conv_id").select("conv_id", "sequence", "record_hash")


@query("""
WITH o AS (SELECT doc_id % 64 AS segment, count(*) AS n, string_agg(text, '|' ORDER BY doc_id) AS d FROM documents GROUP BY 1),
n AS (SELECT doc_id % 64 AS segment, count(*) AS n, string_agg(CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END, '|' ORDER BY doc_id) AS d FROM documents WHERE doc_id % 64 <> 5 GROUP BY 1)
SELECT coalesce(o.segment, n.segment) AS segment, coalesce(n.n, o.n) AS rows, CASE WHEN n.d IS NULL THEN 'dropped' WHEN n.d = o.d THEN 'reused' ELSE 'written' END AS action FROM o FULL JOIN n ON o.segment = n.segment""")
def k3_segment_changes(t: Tables) -> DataFrame:
    """What an incremental publication writes when a few files change."""
    old = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    new = t.documents.where("doc_id % 64 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return segments.segment_changes(old, new, F.col("doc_id") % 64, "digest")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'hot') AND list_contains(string_split(p_name, ' '), 'gear')")
def k1_index_lookup(t: Tables) -> DataFrame:
    return segments.look_up(segments.term_index(t.part, "p_partkey", F.split("p_name", " ")), ["hot", "gear"], "p_partkey")


@query("SELECT concat('skill-', s_suppkey) AS handle, s_suppkey % 4 AS version, s_acctbal > 0 AS available, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 50 END AS cost, 2 AS n_capabilities FROM supplier")
def l12_candidates(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    one = F.struct(F.concat(F.lit("skill-"), k).alias("handle"), (k % 4).alias("version"), F.array(F.lit("a"), F.lit("b")).alias("capabilities"), (F.col("s_acctbal") > 0).alias("available"), F.when(k % 3 == 0, None).otherwise(k % 50).alias("cost"))
    manifests = t.supplier.select(F.to_json(F.struct(F.array(one).alias("candidates"))).alias("manifest"))
    return lexical.candidates_from_manifest(manifests, "manifest").select("handle", "version", "available", "cost", F.size("capabilities").alias("n_capabilities"))


@query("""
WITH e AS (SELECT doc_id, sha256(lower(trim(source))) AS h FROM documents)
SELECT doc_id, round((strpos('0123456789abcdef', substr(h, 1, 1)) - 8.5) / 7.5, 6) AS first, round((strpos('0123456789abcdef', substr(h, 16, 1)) - 8.5) / 7.5, 6) AS last FROM e""")
def l13_digest_embedding(t: Tables) -> DataFrame:
    v = d.digest_embedding(F.col("source"), 16)
    return t.documents.select("doc_id", F.round(v[0], 6).alias("first"), F.round(v[15], 6).alias("last"))


@query("SELECT o_orderkey, rtrim(translate(to_base64(encode(concat(o_orderpriority, '|', o_orderkey))), '+/', '-_'), '=') AS cursor, CAST(o_orderkey AS VARCHAR) AS back FROM orders")
def f5_cursor(t: Tables) -> DataFrame:
    c = d.cursor(F.col("o_orderpriority"), F.col("o_orderkey"))
    return t.orders.select("o_orderkey", c.alias("cursor")).withColumn("back", d.from_cursor(F.col("cursor"))[1])


@query("""SELECT c_custkey, concat('{"a":"', c_mktsegment, '","b":"two"', CASE WHEN c_custkey % 2 = 0 THEN concat(',"z":"', c_nationkey, '"') ELSE '' END, '}') AS json FROM customer""")
def f10_merge_and_canonical(t: Tables) -> DataFrame:
    first = F.create_map(F.lit("z"), F.col("c_nationkey").cast("string"), F.lit("b"), F.lit("one"), F.lit("gone"), F.lit("x"))
    second = F.create_map(F.lit("b"), F.lit("two"), F.lit("a"), F.col("c_mktsegment"))
    m = F.when(F.col("c_custkey") % 2 == 0, d.merged(first, second, ["gone"])).otherwise(d.merged(first, second, ["gone", "z"]))
    return t.customer.select("c_custkey", d.canonical(m).alias("json"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS depth FROM events""")
def f11_depth(t: Tables) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"a]\\"}": ['), "props", F.lit(", []]}")))
    return t.events.select("event_id", d.depth(wrapped).alias("depth"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents")
def u1_token_counter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", d.token_counter(lambda s: len(s.encode().split()))(F.col("text")).alias("tokens"))


@query("SELECT item_id, strlen(text) % 7 / 7 AS first, 1.0::DOUBLE AS second FROM benchmark")
def u2_embedding_hook(t: Tables) -> DataFrame:
    v = d.embedder(lambda texts: [[len(x.encode()) % 7 / 7, 1.0] for x in texts])(F.col("text"))
    return t.benchmark.select("item_id", v.alias("v")).select("item_id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))
