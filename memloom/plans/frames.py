from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as c
from ..operators import frames as x
from .registry import Tables, query

PAYLOADS = "SELECT l_orderkey, list(l_linenumber || '|' || l_partkey || '|' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY 1"


def changesets(t: Tables) -> DataFrame:
    """The lines of each order, a handful, as frames."""
    line = F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))))
    return t.lineitem.groupBy("l_orderkey").agg(x.encode(ordered["line"]).alias("data"))


@query(f"""
WITH c AS ({PAYLOADS}), h AS (SELECT l_orderkey, upper(array_to_string(list_transform(p, lambda s: printf('%08x', strlen(s)) || hex(s) || sha256(s)), '')) AS h FROM c)
SELECT l_orderkey, len(h) // 2 AS bytes, sha256(h) AS digest FROM h""")
def k10_encode_changesets(t: Tables) -> DataFrame:
    return changesets(t).select("l_orderkey", F.octet_length("data").alias("bytes"), F.sha2(F.hex("data"), 256).alias("digest"))


@query(f"""
WITH c AS ({PAYLOADS}), f AS (SELECT l_orderkey, CASE l_orderkey % 5 WHEN 1 THEN p[:least(len(p) - 1, 5)] WHEN 2 THEN [] ELSE p[:5] END AS f, len(p) AS n FROM c)
SELECT l_orderkey, len(f) AS frames, array_to_string(f, ',') AS read, CASE WHEN l_orderkey % 5 = 2 THEN 'checksum_mismatch' WHEN n > 5 THEN 'too_many_frames' WHEN l_orderkey % 5 = 1 THEN 'frame_truncated' END AS reason FROM f""")
def k11_decode_frames(t: Tables) -> DataFrame:
    """What a reader of at most five frames gets of changesets, some cut short by a byte, some with a payload that was changed."""
    data, k = F.col("data"), F.col("l_orderkey") % 5
    size = F.octet_length("data")
    bad = F.when(k == 1, F.substring(data, F.lit(1), size - 1)).when(k == 2, F.concat(F.substring(data, F.lit(1), F.lit(4)), F.lit(b"!"), F.substring(data, F.lit(6), size))).otherwise(data)
    got = changesets(t).select("l_orderkey", x.decode(bad, 5, 1 << 20).alias("d"))
    return got.select("l_orderkey", F.size("d.frames").alias("frames"), "d.reason", F.array_join(F.transform("d.frames", lambda f: f.cast("string")), ",").alias("read"))


@query("""
WITH i AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 3 * 4 + 4 AS bits FROM part), e AS (SELECT *, n * ((48 * bits + 7) // 8 + 4) AS expected_bytes FROM i)
SELECT id, expected_bytes, CASE WHEN id % 11 = 0 THEN 'generation_missing' WHEN id % 7 < 3 THEN 'generation_stale' WHEN id % 7 > 3 THEN 'generation_ahead' WHEN id % 5 = 0 THEN 'backend_mismatch' WHEN id % 4 = 0 THEN 'size_mismatch' END AS reason FROM e""")
def z18_index_faults(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    bits = k % 3 * 4 + 4
    i = t.part.select(
        k.alias("id"), F.col("p_size").alias("rows"), F.lit(48).alias("dimensions"), bits.alias("bits"), (F.col("p_size") * (48 * bits / 8 + 4) - F.when(k % 4 == 0, 1).otherwise(0)).cast("long").alias("bytes"),
        F.when(k % 11 == 0, None).otherwise(k % 7).alias("generation"), F.when(k % 5 == 0, "other").otherwise("here").alias("backend"),
    )
    return c.index_faults(i, 3, "here").select("id", "expected_bytes", "reason")


@query("""
SELECT user_id, bool_or(lower(event_type) IN ('write', 'purchase') AND value > 5) AS write, bool_or(lower(event_type) IN ('read', 'view', 'click') AND value > 5) AS read, bool_or(lower(event_type) IN ('fail', 'error') AND value > 5) AS fail FROM events GROUP BY 1""")
def z14_capabilities(t: Tables) -> DataFrame:
    spelled = t.events.withColumn("event_type", F.concat(F.lit(" "), F.upper("event_type")))
    return c.capabilities(spelled, "user_id", "event_type", F.col("value") > 5, {"write": ["Purchase"], "read": ["view", "click"], "fail": ["ERROR"]})


@query("""
WITH h AS (SELECT l_partkey, max(l_linenumber) AS held FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), q AS (SELECT l_partkey, l_linenumber AS fence, count(*) AS claims FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1, 2)
SELECT l_partkey, fence, claims, CASE WHEN fence <= held THEN 'fence_stale' WHEN claims > 1 THEN 'fence_conflict' ELSE 'accepted' END AS outcome FROM q LEFT JOIN h USING (l_partkey)""")
def z24_fenced_generations(t: Tables) -> DataFrame:
    claims = t.lineitem.select("l_partkey", F.col("l_linenumber").alias("fence"), "l_suppkey")
    return c.fenced(claims.where("l_suppkey % 2 = 1"), claims.where("l_suppkey % 2 = 0"), "l_partkey")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 10 = 0 OR o_orderdate > DATE '1997-06-01'))""")
def z25_unleased(t: Tables) -> DataFrame:
    """Customers that no open order keeps; every tenth order has no end."""
    leases = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("expires"), (F.col("o_orderstatus") == "F").alias("released"))
    return c.unleased(t.customer, leases, "c_custkey", F.to_date(F.lit("1997-06-01"))).select("c_custkey")


@query("""
WITH d AS (SELECT p_brand, sha256(p_partkey || '=' || p_name || '|' || p_type) AS d FROM part), b AS (SELECT p_brand, left(d, 3) AS p, sha256(array_to_string(list_sort(list(d)), '')) AS b FROM d GROUP BY 1, 2)
SELECT p_brand, sha256(string_agg(b, '' ORDER BY p)) AS digest FROM b GROUP BY 1""")
def z26_metadata_digest(t: Tables) -> DataFrame:
    """One digest for the sorted metadata of each brand's parts."""
    from ..operators.integrity import group_digest

    return group_digest(t.part, ["p_brand"], F.sha2(F.concat(F.col("p_partkey"), F.lit("="), F.concat_ws("|", "p_name", "p_type")), 256))


@query("SELECT o_orderkey, sha256(sha256(o_orderkey || '|' || o_orderstatus) || '|' || sha256(o_custkey || '|' || o_orderpriority)) AS binding FROM orders")
def z17_bindings(t: Tables) -> DataFrame:
    """A decision bound to its plan by the digests of both."""
    from ..operators.integrity import seal

    return t.orders.select("o_orderkey", seal(seal(F.col("o_orderkey"), F.col("o_orderstatus")), seal(F.col("o_custkey"), F.col("o_orderpriority"))).alias("binding"))
