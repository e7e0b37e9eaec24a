"""Look-ups, stores, views and small contracts that the other modules leave without a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import documents as d
from ..functions import text, vector
from ..operators import contracts, integrity, search, temporal, vectors
from ..operators import views as x
from ..session import checkpoints
from ..sources import code, segments, snapshots, stores
from ..streaming import changelog
from .registry import Tables, query


def folder(t: Tables, name: str) -> str:
    checkpoints(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


CHANGED = "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'hot ' || p_name ELSE p_name END AS p_name, p_type FROM part WHERE p_partkey % 11 <> 0"


@query(f"SELECT * FROM ({CHANGED}) WHERE contains(lower(p_name), 'hot') ORDER BY p_name, p_partkey LIMIT 20")
def q6_effective_find(t: Tables) -> DataFrame:
    """A base with its overlay, searched; ordered by the name as it is written."""
    base = t.part.select("p_partkey", "p_name", "p_type")
    changed = base.where("p_partkey % 7 = 0 OR p_partkey % 11 = 0").select("p_partkey")
    rows = base.where("p_partkey % 7 = 0 AND p_partkey % 11 <> 0").withColumn("p_name", F.concat(F.lit("hot "), "p_name"))
    return search.search(temporal.overlay(base, changed, rows, "p_partkey"), "hot", "p_name", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query("SELECT p_brand, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1")
def q7_effective_view(t: Tables) -> DataFrame:
    """The same composition opened as a view for SQL."""
    base = t.part.select("p_partkey", "p_brand", "p_size")
    gone = base.where("p_partkey % 11 = 0").select("p_partkey")
    merged = temporal.overlay(base, gone, base.limit(0), "p_partkey")
    return t.spark.sql("SELECT p_brand, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM {parts} GROUP BY p_brand", parts=merged)


@query("SELECT doc_id, substring(text, 101, 64) AS part, 100 + length(substring(text, 101, 64)) AS following, 100 + length(substring(text, 101, 64)) >= length(text) AS last FROM documents")
def q17_page(t: Tables) -> DataFrame:
    part, following, last = search.page(F.col("text"), 100, 64)
    return t.documents.select("doc_id", part.alias("part"), following.cast("long").alias("following"), last.alias("last"))


@query("""
WITH s AS (SELECT doc_id, source || '::m' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'n' || doc_id END AS name, ['method', 'Record', 'widget', 'trait', NULL][1 + doc_id % 5] AS kind, source || '/src/' || doc_id AS file, doc_id % 6 AS line FROM documents)
SELECT sha256('mapper:' || id) AS symbol_id, CASE WHEN name = '' THEN 'm' || doc_id ELSE name END AS name, CASE doc_id % 5 WHEN 1 THEN 'class' WHEN 3 THEN 'trait' ELSE 'function' END AS kind, file, line, id AS signature FROM s WHERE line >= 1""")
def s9_mapped_symbols(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("method", "Record", "widget", "trait", None)])
    file = F.concat_ws("\\", "source", F.lit("src"), i)
    s = t.documents.select(F.concat("source", F.lit("::m"), i).alias("id"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("n"), i)).alias("name"), F.get(kinds, (i % 5).cast("int")).alias("kind"), file.alias("file"), (i % 6).alias("line"))
    return x.mapped_symbols(s.withColumn("end_line", F.col("line") + 2)).select("symbol_id", "name", "kind", "file", "line", "signature")


@query("SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1")
def s13_snapshot_stats(t: Tables) -> DataFrame:
    """A published generation, read back through its pointer and verified row by row."""
    root = folder(t, "snapshot")
    rows = t.documents.select("doc_id", "source", "text", F.sha2("text", 256).alias("digest"))
    snapshots.publish(rows, root, "doc_id", "digest")
    back = snapshots.current(t.spark, root)
    whole = back.join(snapshots.verify(back, "doc_id", "text", "digest"), "doc_id", "left_anti")
    return whole.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_distinct("digest").alias("contents"))


@query("SELECT doc_id, substring(text, 6, 20) AS part FROM documents WHERE doc_id % 32 IN (1, 5)")
def s15_segment_range(t: Tables) -> DataFrame:
    """Parts of rows of two segments of the generation before the latest one."""
    root = folder(t, "segments")
    rows = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    segments.publish_segments(rows, root, F.col("doc_id") % 32, "digest")
    segments.publish_segments(rows.where("doc_id % 32 <> 5"), root, F.col("doc_id") % 32, "digest")
    return segments.open_segments(t.spark, root, 1).where("doc_id % 32 IN (1, 5)").select("doc_id", F.substring("text", 6, 20).alias("part"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
s AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT 'src/' || doc_id || ':' || line AS handle, line, CAST(start AS BIGINT) AS start, CAST(start + length(body) AS BIGINT) AS "end" FROM s""")
def s17_span_index(t: Tables) -> DataFrame:
    files = t.documents.select(F.concat(F.lit("src/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return x.line_spans(files).select("handle", "line", "start", "end")


@query("""
WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'updated' ELSE 'reused' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id) GROUP BY 1""")
def k2_incremental_refresh(t: Tables) -> DataFrame:
    root = folder(t, "refresh")
    edited = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    first = t.documents.where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("digest"))
    second = t.documents.where("doc_id % 10 <> 2").select("doc_id", F.sha2(edited, 256).alias("digest"))
    snapshots.refresh(t.spark, root, first, "doc_id", "digest")
    counts = snapshots.refresh(t.spark, root, second, "doc_id", "digest")
    return t.spark.createDataFrame(list(counts.items()), "action string, n long").where("n > 0")


@query("""
WITH b AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 256.0) AS BIGINT)))) AS block FROM documents WHERE length(text) = strlen(text))
SELECT doc_id, block, block * 256 AS "offset", sha256(substring(text, block * 256 + 1, 256)) AS sha256 FROM b""")
def k4_blocks(t: Tables) -> DataFrame:
    """Texts of one byte a character as blocks: DuckDB cannot cut bytes."""
    files = t.documents.where("length(text) = octet_length(text)").select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    return changelog.blocks(files, 256).select(F.col("path").alias("doc_id"), F.col("block").cast("long").alias("block"), F.col("offset").cast("long").alias("offset"), "sha256")


@query("SELECT concat('code:', c_custkey) AS handle, c_nationkey AS generation FROM customer WHERE c_custkey % 5 = 0")
def k6_catalog_store(t: Tables) -> DataFrame:
    path = folder(t, "catalog")
    stores.save(contracts.envelope(t.customer, "code", F.col("c_custkey"), ["c_name"], F.col("c_nationkey")).select("handle", "generation", "digest"), path)
    back = stores.load(t.spark, path)
    return back.where(F.substring_index("handle", ":", -1).cast("long") % 5 == 0).select("handle", "generation")


@query("""
WITH v AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderkey <= 3000)
SELECT id, version, state FROM v WHERE n = 1""")
def k7_bitemporal_store(t: Tables) -> DataFrame:
    """Versions saved with their seal, read back, and the latest of each as of a point."""
    path = folder(t, "bitemporal")
    stores.save(t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state")), path)
    return temporal.latest(stores.load(t.spark, path).where("version <= 3000"), ["id"], "version").select("id", "version", "state")


@query("SELECT l_partkey, l_suppkey, min(l_returnflag) AS l_returnflag, count(*) AS runs FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = 1")
def k12_validation_store(t: Tables) -> DataFrame:
    path = folder(t, "validations")
    stores.save(contracts.reusable_validations(t.lineitem, ["l_partkey", "l_suppkey"], "l_returnflag").select("l_partkey", "l_suppkey", "l_returnflag", "runs"), path)
    return stores.load(t.spark, path)


@query("""
SELECT o_orderkey, concat('result|', o_orderkey, '|', translate(to_base64(encode(concat(o_orderstatus, ':', o_orderpriority))), '+/', '-_')) AS row, concat(o_orderstatus, ':', o_orderpriority) AS payload,
 sha256(concat('result|', o_orderkey, '|', o_orderstatus, ':', o_orderpriority)) AS sealed FROM orders""")
def k9_sealed_rows(t: Tables) -> DataFrame:
    """A record as a delimited row whose payload is url-safe base64, read back, and its seal."""
    payload = F.concat_ws(":", "o_orderstatus", "o_orderpriority")
    rows = t.orders.select("o_orderkey", F.concat_ws("|", F.lit("result"), "o_orderkey", text.url_safe(payload.cast("binary"))).alias("row"))
    read = F.decode(F.unbase64(F.translate(F.element_at(F.split("row", r"\|"), 3), "-_", "+/")), "utf-8")
    return rows.withColumn("payload", read).withColumn("sealed", integrity.seal(F.lit("result"), F.col("o_orderkey"), F.col("payload")))


@query("""
WITH h AS (SELECT doc_id, doc_id % 60 AS path, doc_id % 7 AS line, doc_id % 7 + 2 AS end_line FROM documents), f AS (SELECT doc_id AS path, string_split(text, chr(10)) AS l FROM documents WHERE doc_id < 55),
j AS (SELECT h.*, l, CASE WHEN l IS NULL THEN 'file_unknown' WHEN line < 1 OR line > len(l) THEN 'lines_out_of_range' END AS reason FROM h LEFT JOIN f ON h.path = f.path),
s AS (SELECT *, CASE WHEN reason IS NULL THEN strlen(array_to_string(l[line:least(end_line, line + 1)], chr(10))) ELSE 0 END AS bytes FROM j),
r AS (SELECT *, sum(bytes) OVER (PARTITION BY path ORDER BY line, doc_id ROWS UNBOUNDED PRECEDING) AS cum_bytes FROM s)
SELECT doc_id, path, line, reason, bytes, CAST(cum_bytes AS BIGINT) AS cum_bytes, CASE WHEN reason IS NULL THEN greatest(1, CAST(ceil(bytes / 4.0) AS BIGINT)) ELSE 0 END AS tokens FROM r WHERE cum_bytes <= 300 OR reason IS NOT NULL""")
def c2_context_receipt(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    hits = t.documents.select("doc_id", (i % 60).alias("path"), (i % 7).cast("int").alias("line"), (i % 7 + 2).cast("int").alias("end_line"))
    files = t.documents.where("doc_id < 55").select(i.alias("path"), F.col("text").alias("content"))
    out = x.receipt(hits, files, "doc_id", "path", "line", "end_line", 2, 300)
    return out.select("doc_id", "path", F.col("line").cast("long").alias("line"), "reason", "bytes", "cum_bytes", F.col("tokens").cast("long").alias("tokens"))


ITEMS = """SELECT doc_id, lang, 'h' || CASE WHEN doc_id % 31 = 0 THEN 31 ELSE doc_id END AS handle, CASE WHEN doc_id % 17 = 0 THEN '../x' WHEN doc_id % 13 = 0 THEN 'other/y' ELSE 'src/' || source END AS path,
 CASE WHEN doc_id % 19 = 0 THEN 'g0' ELSE 'g1' END AS generation, CASE WHEN doc_id % 23 = 0 THEN 'bad' ELSE sha256(text) END AS sha256, text, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents"""
JUDGED = f"""i AS ({ITEMS}), n AS (SELECT handle, count(DISTINCT concat('span|', path, '|', sha256, '|', generation)) AS n FROM i GROUP BY 1),
j AS (SELECT i.*, CASE WHEN path = '../x' THEN 'path_escape' WHEN path = 'other/y' THEN 'root_forbidden' WHEN generation <> 'g1' THEN 'generation_stale' WHEN sha256(text) <> sha256 THEN 'item_tampered' WHEN n > 1 THEN 'item_handle_collision' END AS reason FROM i JOIN n ON i.handle = n.handle)"""


def _items(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    return t.documents.select(
        "doc_id", "lang", F.concat(F.lit("h"), F.when(i % 31 == 0, 31).otherwise(i)).alias("handle"), F.lit("span").alias("kind"),
        F.when(i % 17 == 0, "../x").when(i % 13 == 0, "other/y").otherwise(F.concat(F.lit("src/"), "source")).alias("path"), F.when(i % 19 == 0, "g0").otherwise("g1").alias("generation"),
        F.when(i % 23 == 0, "bad").otherwise(F.sha2("text", 256)).alias("sha256"), F.col("text").alias("content"), text.estimated_tokens(F.col("n_chars")).alias("tokens"),
    )


@query(f"""
WITH RECURSIVE {JUDGED}, c AS (SELECT lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY handle, sha256) AS rank FROM j WHERE reason IS NULL),
f AS (SELECT lang, rank, CASE WHEN tokens <= 1500 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 1500 THEN 1 ELSE 0 END AS n FROM c WHERE rank = 1
 UNION ALL SELECT c.lang, c.rank, CASE WHEN used + tokens <= 1500 AND n < 12 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 1500 AND n < 12 THEN n + 1 ELSE n END FROM f JOIN c ON c.lang = f.lang AND c.rank = f.rank + 1),
e AS (SELECT lang, max(used) AS tokens, max(n) AS taken FROM f GROUP BY 1), o AS (SELECT lang, count(*) AS offered, count(reason) AS refused FROM j GROUP BY 1)
SELECT o.lang, offered, refused, coalesce(taken, 0) AS taken, coalesce(tokens, 0) AS tokens FROM o LEFT JOIN e ON o.lang = e.lang""")
def c5_materialise(t: Tables) -> DataFrame:
    """One view of each language: authorised, checked, each handle once, greedy under tokens and a number of items."""
    views = x.materialise(_items(t), ["lang"], ["src"], "g1", 1500, 12, 100_000)
    return views.select("lang", "offered", "refused", F.col("taken").cast("long").alias("taken"), "tokens")


@query(f"WITH {JUDGED} SELECT doc_id, reason FROM j")
def z27_item_faults(t: Tables) -> DataFrame:
    return x.item_faults(_items(t), ["src"], "g1").select("doc_id", "reason")


SEAL = "sha256(concat(strlen({0}), ':', {0}, strlen({1}), ':', {1}, strlen({2}), ':', {2}))"


@query(f"""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN 'X-' ELSE 'CTX-' END || o_orderkey AS handle, o_orderstatus AS stage, CASE WHEN o_orderkey % 6 = 0 THEN 'f2' ELSE 'f1' END AS fence FROM orders),
s AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'no' ELSE {SEAL.format("handle", "stage", "fence")} END AS view_hash FROM v)
SELECT o_orderkey, CASE WHEN view_hash <> {SEAL.format("handle", "stage", "fence")} THEN 'view_tampered' WHEN fence <> 'f1' THEN 'view_fence_mismatch' WHEN NOT starts_with(handle, 'CTX-') THEN 'view_handle_invalid' END AS reason, view_hash FROM s""")
def c14_verify_views(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = t.orders.select("o_orderkey", F.concat(F.when(k % 41 == 0, "X-").otherwise("CTX-"), k).alias("handle"), F.col("o_orderstatus").alias("stage"), F.when(k % 6 == 0, "f2").otherwise("f1").alias("fence"))
    fields = ["handle", "stage", "fence"]
    v = v.withColumn("view_hash", F.when(k % 9 == 0, "no").otherwise(x.view_seal(*[F.col(f) for f in fields])))
    return x.view_faults(v, {"fence": F.lit("f1")}, fields).select("o_orderkey", "reason", "view_hash")


@query("""
WITH o AS (SELECT doc_id, sha256(text) AS digest FROM documents), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 8 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 12 <> 5)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.digest IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.digest IS DISTINCT FROM n.digest""")
def t17_watch_once(t: Tables) -> DataFrame:
    """One look at the files: what differs from the hashes seen before, which is nothing if none does."""
    seen = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    now = t.documents.where("doc_id % 12 <> 5").select("doc_id", F.sha2(F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return temporal.diff(seen, now, "doc_id", ["digest"]).select("doc_id", "change")


@query("""
WITH c AS (SELECT s_suppkey, 'repo' || s_suppkey % 7 AS name, s_suppkey % 5 = 0 AS optional FROM supplier), k AS (SELECT 'c' || p_size AS schema, 'repo' || p_partkey % 9 AS owner FROM part WHERE p_partkey % 4 = 0)
SELECT 'member' AS kind, name AS key, 'duplicate_member_repository' AS reason FROM c WHERE NOT optional GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'contract', schema, 'duplicate_contract_schema' FROM k GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'contract', schema, 'contract_member_missing' FROM (SELECT schema, owner AS p FROM k UNION ALL SELECT schema, 'repo1' FROM k) WHERE p NOT IN (SELECT name FROM c)
UNION ALL SELECT 'lock', r, 'required_contract_missing' FROM (SELECT unnest(['c1', 'c999']) AS r) WHERE r NOT IN (SELECT schema FROM k)""")
def h7_locked_stack(t: Tables) -> DataFrame:
    members = t.supplier.select(F.concat(F.lit("repo"), F.col("s_suppkey") % 7).alias("name"), (F.col("s_suppkey") % 5 == 0).alias("optional"))
    agreed = t.part.where("p_partkey % 4 = 0").select(F.concat(F.lit("c"), "p_size").alias("schema"), F.concat(F.lit("repo"), F.col("p_partkey") % 9).alias("owner"), F.array(F.lit("repo1")).alias("consumers"))
    return x.lock_faults(members, agreed, ["c1", "c999"])


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS name, 'v' || s_suppkey % 3 AS version, 'team' || s_nationkey AS origin, CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'repo' END AS scope, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name || s_suppkey END AS content FROM supplier),
r AS (SELECT *, sha256(coalesce(content, '')) AS content_sha256, CASE WHEN name = '' THEN 'identity_missing' WHEN scope <> 'repo' THEN 'scope_mismatch' WHEN content IS NULL THEN 'content_missing' END AS reason FROM s)
SELECT s_suppkey, reason, content_sha256, CASE WHEN reason IS NULL THEN 'skill-' || substr(sha256(concat(name, '|', version, '|', origin, '|', content_sha256)), 1, 32) END AS handle FROM r""")
def z5_register_skills(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    skills = t.supplier.select(
        "s_suppkey", F.when(k % 6 == 0, "").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("v"), k % 3).alias("version"), F.concat(F.lit("team"), "s_nationkey").alias("origin"),
        F.when(k % 5 == 0, "other").otherwise("repo").alias("scope"), F.when(k % 7 == 0, None).otherwise(F.concat("s_name", k)).alias("content"),
    )
    return x.register_skills(skills, "repo").select("s_suppkey", "reason", "content_sha256", "handle")


@query("SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0")
def z7_recover_previous(t: Tables) -> DataFrame:
    """The generation before the latest one made the latest again, after all of its rows are verified."""
    root = folder(t, "recover")
    rows = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    snapshots.publish(rows.where("doc_id % 2 = 0"), root, "doc_id", "digest")
    snapshots.publish(rows, root, "doc_id", "digest")
    return snapshots.recover_previous(t.spark, root, "text").select("doc_id", "text")


@query("""
WITH a AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS major, CAST(event_id % 5 - 1 AS INTEGER) AS minor FROM events)
SELECT event_id, CASE WHEN major = 1 AND minor >= 0 THEN 1 END AS major, CASE WHEN major = 1 AND minor >= 0 THEN CASE WHEN minor = 0 THEN 2 ELSE least(minor, 2) END END AS minor FROM a""")
def z9_negotiated_interface(t: Tables) -> DataFrame:
    a = x.negotiated((F.col("event_id") % 3).cast("int"), (F.col("event_id") % 5 - 1).cast("int"), (1, 2))
    return t.events.select("event_id", a.alias("a")).select("event_id", "a.major", "a.minor")


@query("""
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 20 WHEN p_partkey % 3 = 1 THEN p_size * 200 ELSE p_size - 3 END AS n FROM part)
SELECT p_partkey, CASE WHEN n >= 1 THEN least(n, 4096) END AS nodes, CASE WHEN n >= 1 THEN 8192 END AS bytes, CASE WHEN n < 1 THEN 'invalid_budget' END AS fault FROM s""")
def z10_navigation_budget(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    values = F.when(k == 0, F.create_map(F.lit("depth"), F.lit(2))).when(k == 1, F.create_map(F.lit("nodes"), F.col("p_size") * 200)).otherwise(F.create_map(F.lit("nodes"), F.col("p_size") - 3))
    budget, fault = x.navigation_budget(values)
    return t.part.select("p_partkey", budget["nodes"].alias("nodes"), budget["bytes"].alias("bytes"), fault.alias("fault"))


SPELLINGS = "CASE c_custkey % 6 WHEN 0 THEN ' Dense ' WHEN 1 THEN 'dense-quant' WHEN 2 THEN 'SQTN quant' WHEN 3 THEN 'mixed' WHEN 4 THEN 'none' END"


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'dense_quant' WHEN 1 THEN 'dense_quant' WHEN 2 THEN 'sqtn' WHEN 3 THEN 'mixed' END AS family FROM customer")
def z16_representation(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", x.representation(F.expr(SPELLINGS)).alias("family"))


@query("SELECT source, count(*) AS files FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def z19_corpus_receipt(t: Tables) -> DataFrame:
    """Files and a digest of each corpus; the digest doesn't depend on order, so two orders must agree."""
    files = t.documents.where(F.col("lang").isin("en", "fr")).select("source", F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("digest"))
    receipt = files.groupBy("source").agg(F.count("*").alias("files"))
    one = integrity.group_digest(files, ["source"], F.col("digest"))
    two = integrity.group_digest(files.orderBy(F.desc("digest")), ["source"], F.col("digest")).withColumnRenamed("digest", "again")
    return receipt.join(one, "source").join(two, "source").where("digest = again").select("source", "files")


@query("SELECT conv_id, count(*) AS records, max(turn) AS last FROM conversations GROUP BY 1")
def z22_change_journal(t: Tables) -> DataFrame:
    """Two batches appended to a journal of hash chains, read back as far as the chains hold."""
    path = folder(t, "journal")
    first = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("least"))
    rows = t.conversations.join(first, "conv_id").select("conv_id", (F.col("turn") - F.col("least")).alias("sequence"), F.col("text").alias("payload"), "least")
    stores.append(t.spark, path, rows.where("sequence < 2").select("conv_id", "sequence", "payload"), "conv_id")
    stores.append(t.spark, path, rows.where("sequence >= 2").select("conv_id", "sequence", "payload"), "conv_id")
    back = stores.valid_prefix(t.spark.read.parquet(path), "conv_id").join(first, "conv_id")
    return back.groupBy("conv_id").agg(F.count("*").alias("records"), F.max(F.col("sequence") + F.col("least")).alias("last"))


@query("SELECT s_suppkey, s_name, s_acctbal, s_acctbal < 0 AS overdrawn FROM supplier")
def z23_workspace(t: Tables) -> DataFrame:
    """A base and its overlay, both sealed stores, loaded and composed."""
    path = folder(t, "workspace")
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    stores.save(rows.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.0)).otherwise(F.col("s_acctbal"))), f"{path}/base")
    stores.save(rows.where("s_suppkey % 2 = 0"), f"{path}/overlay")
    base, over = stores.load(t.spark, f"{path}/base"), stores.load(t.spark, f"{path}/overlay")
    return temporal.overlay(base, over.select("s_suppkey"), over, "s_suppkey").withColumn("overdrawn", F.col("s_acctbal") < 0)


@query(r"SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w)) AS terms FROM documents")
def f2_identifier_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.identifier_terms(F.col("text")).alias("terms"))


@query(r"SELECT doc_id, len(string_split_regex(x, '\r\n|\n|\r')) AS n, string_split_regex(x, '\r\n|\n|\r')[2] AS second FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, chr(10), chr(13)) END AS x FROM documents)")
def f3_lines(t: Tables) -> DataFrame:
    ends = F.when(F.col("doc_id") % 3 == 0, F.lit("\n")).when(F.col("doc_id") % 3 == 1, F.lit("\r\n")).otherwise(F.lit("\r"))
    cut = text.lines(F.replace("text", F.lit("\n"), ends))
    return t.documents.select("doc_id", F.size(cut).alias("n"), F.get(cut, F.lit(1)).alias("second"))


@query("""
WITH p AS (SELECT doc_id, text, unnest(range(0, 41)) AS n FROM documents)
SELECT doc_id, max_by(left(text, n), n) AS prefix FROM p WHERE strlen(left(text, n)) <= 40 GROUP BY 1""")
def f4_utf8_prefix(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.utf8_prefix(F.col("text"), F.lit(40)).alias("prefix"))


@query("SELECT p_partkey, sha256(concat(p_name, chr(0), p_size, chr(0), coalesce(p_brand, ''))) AS digest FROM part")
def f6_digest(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.digest(F.col("p_name"), F.col("p_size"), F.col("p_brand")).alias("digest"))


@query("SELECT event_id, round(log2(1 + event_id), 6) AS l, round(sqrt(event_id), 6) AS s, greatest(0, least(1, value / 50)) AS c FROM events")
def f7_math(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.select("event_id", F.round(F.log2(1 + i), 6).alias("l"), F.round(F.sqrt(i), 6).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 50)).alias("c"))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS squares, len(list_intersect([1, 2, 3], [label])) AS shared FROM embeddings")
def f9_arrays(t: Tables) -> DataFrame:
    v = vector.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(vector.dot(v, v), 5).alias("squares"), F.size(F.array_intersect(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array("label"))).alias("shared"))


@query(r"""
WITH p AS (SELECT doc_id, ['src\a\' || doc_id, '/etc/' || doc_id, 'a/../b', 'C:\x', 'src/..x/' || doc_id][1 + doc_id % 5] AS path FROM documents)
SELECT doc_id, doc_id % 5 IN (1, 2, 3) AS escapes FROM p""")
def f12_paths(t: Tables) -> DataFrame:
    paths = F.array(F.concat(F.lit("src\\a\\"), "doc_id"), F.concat(F.lit("/etc/"), "doc_id"), F.lit("a/../b"), F.lit("C:\\x"), F.concat(F.lit("src/..x/"), "doc_id"))
    return t.documents.select("doc_id", contracts.escapes(F.get(paths, (F.col("doc_id") % 5).cast("int"))).alias("escapes"))


@query("SELECT item_id, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of'])) AS DOUBLE) AS score FROM benchmark")
def u3_reranker(t: Tables) -> DataFrame:
    score = d.reranker(lambda q, texts: [float(len(set(q.split()) & set(s.lower().split(" ")))) for s in texts], "the of")
    return t.benchmark.select("item_id", score(F.col("text")).alias("score"))


def _lru(t: Tables, key: str, cache: str, capacity: int) -> DataFrame:
    r = t.events.selectExpr("event_id", f"{cache} AS cache", f"{key} AS k")
    return contracts.lru_outcomes(r, "cache", "event_id", "k", capacity).groupBy("cache", "outcome").agg(F.count("*").alias("n"))


def _lru_sql(key: str, cache: str, capacity: int) -> str:
    return f"""
WITH e AS (SELECT event_id, {cache} AS cache, {key} AS k FROM events), p AS (SELECT *, lag(event_id) OVER (PARTITION BY cache, k ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY cache, k ORDER BY event_id) = 1 AS new FROM e),
q AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY cache ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
b AS (SELECT p.event_id, count(DISTINCT x.k) AS n FROM p JOIN e x ON x.cache = p.cache AND x.event_id > p.prev AND x.event_id < p.event_id GROUP BY 1)
SELECT cache, CASE WHEN prev IS NOT NULL AND coalesce(n, 0) < {capacity} THEN 'hit' WHEN coalesce(seen, 0) >= {capacity} THEN 'evicting_miss' ELSE 'miss' END AS outcome, count(*) AS n FROM q LEFT JOIN b ON q.event_id = b.event_id GROUP BY 1, 2"""


@query(_lru_sql("user_id % 9", "user_id % 4", 3))
def m3_slot_pager(t: Tables) -> DataFrame:
    """A pager with a budget for each slot."""
    return _lru(t, "user_id % 9", "user_id % 4", 3)


@query(_lru_sql("event_type || '/' || user_id % 3", "event_id // 400", 4))
def m4_plan_cache(t: Tables) -> DataFrame:
    """Plans by generation and digest: a new generation is a new cache."""
    return _lru(t, "event_type || '/' || user_id % 3", "event_id div 400", 4)


@query("""
SELECT event_id, prev IS NOT NULL AND event_id - prev <= 40 AS hit FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS prev FROM events)""")
def m6_view_cache(t: Tables) -> DataFrame:
    """Views that live for 40 ticks after their last use."""
    return contracts.live_hits(t.events.select((F.col("user_id") % 20).alias("k"), "event_id"), "k", "event_id", 40).select("event_id", "hit")


@query()
def v5_approximate_candidates(t: Tables) -> DataFrame:
    """Candidates by the score of their codes alone; rotation and rounding have no plain SQL."""
    from .vectors import QUERY

    return vectors.approximate(t.embeddings, QUERY, "vec_id", "embedding", "dot", 40).select("vec_id", F.round("approx", 5).alias("approx"))


@query("""
SELECT i AS vec_id, list_transform(range(0, 16), lambda j: round((strpos('0123456789abcdef', substr(sha256(concat('11|', i, '|', j)), 1, 1)) - 8.5) / 7.5, 6)) AS embedding FROM (SELECT unnest(range(0, 500)) AS i)""")
def v13_fixture(t: Tables) -> DataFrame:
    return vectors.fixture(t.spark, 500, 16, 11).select("vec_id", F.transform("embedding", lambda y: F.round(y, 6)).alias("embedding"))


@query("SELECT suffix, language, CASE language WHEN 'python' THEN 'available' ELSE 'fallback' END AS support FROM (VALUES ('.py', 'python'), ('.ts', 'typescript'), ('.tsx', 'typescript'), ('.rs', 'rust'), ('.cs', 'csharp')) AS v(suffix, language)")
def z3_capabilities(t: Tables) -> DataFrame:
    """What the sources can read, as a table."""
    return code.capabilities(t.spark).select("suffix", "language", "support")
