from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as x
from .registry import Tables, query


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT conv_id, turn, n, '' AS prev_hash, sha256(text) AS record_hash FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, h.record_hash, sha256(h.record_hash || c.text) FROM h JOIN c ON c.conv_id = h.conv_id AND c.n = h.n + 1)
SELECT conv_id, turn AS sequence, prev_hash, record_hash FROM h""")
def h1_build_chain(t: Tables) -> DataFrame:
    return x.build_chain(t.conversations, "conv_id", "turn", "text").drop("payload")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT conv_id, turn, n, text, '' AS prev_hash, sha256(text) AS record_hash FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, c.text, h.record_hash, sha256(h.record_hash || c.text) FROM h JOIN c ON c.conv_id = h.conv_id AND c.n = h.n + 1),
k AS (SELECT conv_id, turn AS sequence, CASE WHEN conv_id % 5 = 1 AND turn = 1 THEN text || '!' ELSE text END AS payload, prev_hash, record_hash FROM h WHERE NOT (conv_id % 7 = 2 AND turn = 1)),
l AS (SELECT *, lag(sequence) OVER w AS ps, lag(record_hash) OVER w AS ph FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY sequence))
SELECT conv_id, sequence, CASE WHEN ps IS NOT NULL AND sequence <> ps + 1 THEN 'sequence_gap' WHEN prev_hash <> coalesce(ph, '') THEN 'previous_mismatch' ELSE 'record_mismatch' END AS reason FROM l
WHERE (ps IS NOT NULL AND sequence <> ps + 1) OR prev_hash <> coalesce(ph, '') OR sha256(prev_hash || payload) <> record_hash""")
def h1_verify_chain(t: Tables) -> DataFrame:
    chain = x.build_chain(t.conversations, "conv_id", "turn", "text").where("NOT (conv_id % 7 = 2 AND sequence = 1)")
    tampered = chain.withColumn("payload", F.when((F.col("conv_id") % 5 == 1) & (F.col("sequence") == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return x.chain_faults(tampered, "conv_id").select("conv_id", "sequence", "reason")


@query("SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS seal FROM events")
def h2_receipts(t: Tables) -> DataFrame:
    return t.events.select("event_id", x.seal(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("seal"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS winners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def h3_contested(t: Tables) -> DataFrame:
    return x.contested(t.lineitem, ["l_orderkey"], "l_suppkey")


@query("SELECT doc_id, regexp_matches(lower(source), '(secret|token|password|api_?key|bearer )') OR regexp_matches(lower(text), '(secret|token|password|api_?key|bearer )') AS leaked FROM documents")
def h4_secret_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.secret_keys(F.create_map(F.lit("source"), F.col("source"), F.lit("body"), F.col("text"))).alias("leaked"))


@query("SELECT event_id, CASE WHEN value < 1 AND event_type = 'error' THEN 'value_without_reason' WHEN props IS NULL THEN 'props_missing' ELSE 'ok' END AS check_result FROM events")
def h6_receipt_fields(t: Tables) -> DataFrame:
    check = F.when((F.col("value") < 1) & (F.col("event_type") == "error"), "value_without_reason").when(F.col("props").isNull(), "props_missing").otherwise("ok")
    return t.events.select("event_id", check.alias("check_result"))


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS results FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def m7_nondeterministic(t: Tables) -> DataFrame:
    return x.nondeterministic(t.lineitem, ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT event_type, CAST(NULL AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, user_id % 5, count(*) FROM events GROUP BY 2")
def a1_grouping_sets(t: Tables) -> DataFrame:
    events = t.events.select("event_type", (F.col("user_id") % 5).alias("bucket"))
    return events.groupingSets([["event_type"], ["bucket"]], "event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT d.lang, count(doc_id) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('pt')) d(lang) LEFT JOIN documents USING (lang) GROUP BY 1")
def a2_counts_with_zeros(t: Tables) -> DataFrame:
    return x.counts_with_zeros(t.documents, "lang", ["en", "de", "fr", "es", "pt"])


@query("SELECT user_id, max(event_id) AS latest, greatest(0, 10000 - max(event_id)) AS lag FROM events GROUP BY 1")
def a3_producer_lag(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("latest")).withColumn("lag", F.greatest(F.lit(0), 10000 - F.col("latest")))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_disc(l_extendedprice, 0.95), 4) AS p95, round(quantile_disc(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1")
def a4_summary(t: Tables) -> DataFrame:
    s = x.summary(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99")])


@query("SELECT l_suppkey, round(min(1 - l_discount), 6) AS confidence, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS coverage FROM lineitem GROUP BY 1")
def a5_confidence(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.min(1 - F.col("l_discount")), 6).alias("confidence"), F.round(F.count_if(F.col("l_returnflag") == "N") / F.count("*"), 6).alias("coverage"))


@query("SELECT source, list_sort(list_distinct(list(lang))) AS langs, count(DISTINCT lang) AS n FROM documents GROUP BY 1")
def a6_generations(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.count_distinct("lang").alias("n"))


@query("SELECT count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS reused, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 5 <> 0) AS added, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS deleted, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0) AS parsed FROM documents")
def a7_build_metrics(t: Tables) -> DataFrame:
    from ..operators.temporal import diff
    from .temporal import _sides

    base, current = _sides(t)
    changes = diff(base, current, "doc_id", ["digest"]).groupBy().agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("add", "added"), ("delete", "deleted"), ("update", "parsed"))])
    kept = base.join(current, ["doc_id", "digest"], "left_semi").agg(F.count("*").alias("reused"))
    return kept.crossJoin(F.broadcast(changes))  # one row each


@query("SELECT lang, count(*) AS n, sum(n_chars) AS bytes FROM documents GROUP BY 1")
def a8_totals(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("WITH b AS (SELECT source, left(sha256(text), 3) AS p, sha256(array_to_string(list_sort(list(sha256(text))), '')) AS b FROM documents GROUP BY 1, 2) SELECT source, sha256(string_agg(b, '' ORDER BY p)) AS digest FROM b GROUP BY 1")
def s11_group_digest(t: Tables) -> DataFrame:
    return x.group_digest(t.documents, ["source"], F.sha2("text", 256))


@query("SELECT count(*) FILTER (doc_id % 4 = 1) AS embedded, count(*) FILTER (doc_id % 4 IN (2, 3)) AS reused, count(*) FILTER (doc_id % 4 = 0) AS removed FROM documents")
def k13_derived_refresh(t: Tables) -> DataFrame:
    """Rows to embed again, to keep and to drop, by content hash."""
    from ..operators.temporal import diff

    d = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    old = d.where("doc_id % 4 <> 1")
    new = d.where("doc_id % 4 <> 0")
    c = diff(old, new, "doc_id", ["digest"]).groupBy().agg(F.count_if(F.col("change") != "delete").alias("embedded"), F.count_if(F.col("change") == "delete").alias("removed"))
    return old.join(new, ["doc_id", "digest"], "left_semi").agg(F.count("*").alias("reused")).crossJoin(F.broadcast(c))


@query("SELECT user_id, event_type, count(DISTINCT value) AS results FROM events GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def z20_idempotency_collisions(t: Tables) -> DataFrame:
    """Keys that stand for different contents; equal repeats are replays and fine."""
    return x.nondeterministic(t.events, ["user_id", "event_type"], "value")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def z21_duplicate_content(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT sha256(source || chr(0) || lang || chr(0) || doc_id) AS cache_key, doc_id FROM documents")
def z28_cache_keys(t: Tables) -> DataFrame:
    from ..functions.text import digest

    return t.documents.select(digest(F.col("source"), F.col("lang"), F.col("doc_id")).alias("cache_key"), "doc_id")


@query("SELECT c_custkey, c_acctbal = s_acctbal AS same, CASE WHEN s_suppkey IS NULL THEN 'side_missing' END AS reason FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def z29_parity(t: Tables) -> DataFrame:
    """Equal, different or unknown with a reason."""
    j = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return j.select("c_custkey", (F.col("c_acctbal") == F.col("s_acctbal")).alias("same"), F.when(F.col("s_suppkey").isNull(), "side_missing").alias("reason"))


@query("SELECT event_type, count(*) FILTER (value > 20) AS promoted, count(*) FILTER (value <= 20) AS held, count(*) AS n FROM events GROUP BY 1")
def a9_promotions(t: Tables) -> DataFrame:
    up = F.col("value") > 20
    return t.events.groupBy("event_type").agg(F.count_if(up).alias("promoted"), F.count_if(~up).alias("held"), F.count("*").alias("n"))


@query("""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 19 = 0 THEN 'bad' ELSE sha256(text) END AS digest FROM documents UNION ALL SELECT doc_id, text, sha256(text) FROM documents WHERE doc_id % 23 = 0)
SELECT doc_id, 'key_repeated' AS reason FROM d GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT doc_id, 'digest_mismatch' FROM d WHERE digest IS DISTINCT FROM sha256(text)""")
def h5_verify_snapshot(t: Tables) -> DataFrame:
    from ..sources.snapshots import verify

    d = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    d = d.withColumn("digest", F.when(F.col("doc_id") % 19 == 0, "bad").otherwise(F.col("digest")))
    twice = t.documents.where("doc_id % 23 = 0").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    return verify(d.unionByName(twice), "doc_id", "text", "digest")
