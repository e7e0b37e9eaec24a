from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import Tables, query


def supply(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("destination"), (1 - F.col("l_discount")).alias("confidence"))


@query("""
WITH n AS (SELECT l_partkey AS id, max(1 - l_discount) AS confidence FROM lineitem WHERE l_suppkey = 3 GROUP BY 1),
r AS (SELECT id, p_name AS name, confidence, row_number() OVER w AS rank, sum(1) OVER w AS cum_nodes, sum(strlen(p_name)) OVER w AS cum_size FROM n JOIN part ON id = p_partkey WINDOW w AS (ORDER BY confidence DESC, p_name, id))
SELECT id, name, round(confidence, 6) AS confidence, rank, cum_nodes, cum_size FROM r WHERE cum_nodes <= 20 AND cum_size <= 200""")
def g1_navigate(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.octet_length("p_name").alias("size"))
    return g.navigate(supply(t), nodes, 3, "out", {"nodes": 20, "size": 200}).select("id", "name", F.round("confidence", 6).alias("confidence"), "rank", "cum_nodes", "cum_size")


@query("""
WITH n AS (SELECT n_nationkey AS id, n_name || '/' || n_regionkey AS qualified, n_name AS name FROM nation),
q AS (SELECT qualified, min(id) AS id FROM n GROUP BY 1 HAVING count(DISTINCT id) = 1), m AS (SELECT name, min(id) AS id FROM n GROUP BY 1 HAVING count(DISTINCT id) = 1),
r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE 'x' || s_suppkey END AS identifier, n_name || CASE WHEN s_suppkey % 3 = 0 THEN '/' || n_regionkey ELSE '' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, coalesce((SELECT id FROM n WHERE n.id::VARCHAR = r.identifier), q.id, m.id) AS resolved FROM r LEFT JOIN q ON q.qualified = r.name LEFT JOIN m ON m.name = r.name""")
def g2_resolve(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.concat_ws("/", "n_name", "n_regionkey").alias("qualified"), F.col("n_name").alias("name"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    identifier = F.when(k % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(F.concat(F.lit("x"), k))
    name = F.when(k % 3 == 0, F.concat_ws("/", "n_name", "n_regionkey")).otherwise(F.col("n_name"))
    return g.resolve(s.select("s_suppkey", identifier.alias("identifier"), name.alias("name")), nodes).select("s_suppkey", "resolved")


@query("SELECT l_partkey, l_suppkey, round(1 - l_discount, 6) AS confidence FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY 1 - l_discount DESC, l_suppkey, l_orderkey, l_linenumber) = 1")
def g3_best_hop(t: Tables) -> DataFrame:
    e = t.lineitem.withColumn("confidence", 1 - F.col("l_discount"))
    best = g.best_hop(e, "l_partkey", [F.desc("confidence"), "l_suppkey", "l_orderkey", "l_linenumber"])
    return best.select("l_partkey", "l_suppkey", F.round("confidence", 6).alias("confidence"))


TREE = """SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON r_regionkey = n_regionkey
 UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


def tree(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    return (
        t.nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
        .union(t.customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
        .union(t.orders.select(name("c", "o_custkey"), name("o", "o_orderkey")))
        .distinct()
    )


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
w AS (SELECT 'p5' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON w.id = e.source WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def g4_closure(t: Tables) -> DataFrame:
    """What depends on a part within three steps, over both directions of the supply edges."""
    l = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return g.closure(t.spark.createDataFrame([("p5",)], "id string"), l.union(l.select("target", "source")), 3)


@query("""
WITH d AS (SELECT o_orderkey AS id, max(strlen(o_orderpriority)) AS bytes FROM orders WHERE o_custkey = 17 GROUP BY 1), c AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS b FROM d WINDOW w AS (ORDER BY id)),
k AS (SELECT list_sort(list_concat(CASE WHEN max(n) > 9 THEN ['max_edges'] ELSE [] END, CASE WHEN max(b) FILTER (n <= 10) > 60 THEN ['max_bytes'] ELSE [] END)) AS r FROM c)
SELECT id, bytes, len(r) = 0 AS complete, array_to_string(r, ',') AS truncation_reasons FROM c, k WHERE n <= 9 AND b <= 60""")
def g5_consumers(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.octet_length("o_orderpriority").alias("bytes"))
    return g.one_hop(edges, 17, "out", {"edges": 9, "bytes": 60}).withColumn("truncation_reasons", F.array_join("truncation_reasons", ","))


@query(f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON w.id = e.source WHERE depth < 3),
d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), c AS (SELECT *, row_number() OVER v AS n, sum(strlen(id)) OVER v AS b FROM d WHERE depth <= 2 WINDOW v AS (ORDER BY depth, id)),
k AS (SELECT list_sort(list_concat(list_concat(CASE WHEN max(n) > 40 THEN ['max_nodes'] ELSE [] END, CASE WHEN max(b) FILTER (n <= 41) > 120 THEN ['max_bytes'] ELSE [] END), CASE WHEN (SELECT count(*) FROM d WHERE depth > 2) > 0 THEN ['max_depth'] ELSE [] END)) AS r FROM c)
SELECT id, depth, len(r) = 0 AS complete, array_to_string(r, ',') AS truncation_reasons FROM c, k WHERE n <= 40 AND b <= 120""")
def g6_traverse_budgeted(t: Tables) -> DataFrame:
    found = g.closure(t.spark.createDataFrame([("r1",)], "id string"), tree(t), 3).withColumn("bytes", F.octet_length("id"))
    return g.budgeted(found, tree(t), 2, {"nodes": 40, "bytes": 120}).select("id", "depth", "complete", F.array_join("truncation_reasons", ",").alias("truncation_reasons"))


@query(f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT unnest(['n1', 'n2']) AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON w.id = e.source WHERE depth < 3),
d AS (SELECT id, min(depth) AS depth, right(id, 1) AS file FROM w GROUP BY id), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY file ORDER BY depth, id) = 1 THEN 1 ELSE 0 END AS files FROM d),
c AS (SELECT *, row_number() OVER v AS n, sum(files) OVER v AS fs FROM f WHERE depth <= 2 WINDOW v AS (ORDER BY depth, id)),
k AS (SELECT list_sort(list_concat(list_concat(CASE WHEN max(n) > 30 THEN ['max_nodes'] ELSE [] END, CASE WHEN max(fs) FILTER (n <= 31) > 8 THEN ['max_files'] ELSE [] END), CASE WHEN (SELECT count(*) FROM f WHERE depth > 2) > 0 THEN ['max_depth'] ELSE [] END)) AS r FROM c)
SELECT id, file, depth, len(r) = 0 AS complete, array_to_string(r, ',') AS truncation_reasons FROM c, k WHERE n <= 30 AND fs <= 8""")
def g4_invalidation(t: Tables) -> DataFrame:
    files = tree(t).select(F.col("target").alias("id")).union(tree(t).select("source")).distinct().withColumn("file", F.right("id", F.lit(1)))
    found = g.invalidation(t.spark.createDataFrame([("n1",), ("n2",)], "id string"), tree(t), files, 30, 8, 2)
    return found.withColumn("truncation_reasons", F.array_join("truncation_reasons", ","))


@query(f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT 'r1' AS id, 0 AS depth, ['r1'] AS path UNION ALL SELECT target, depth + 1, list_append(path, target) FROM w JOIN e ON w.id = e.source WHERE depth < 3)
SELECT id, depth, array_to_string(path, '>') AS path FROM w""")
def g6_traverse(t: Tables) -> DataFrame:
    found = g.closure(t.spark.createDataFrame([("r1",)], "id string"), tree(t), 3, keep_path=True)
    return found.select("id", "depth", F.array_join("path", ">").alias("path"))


@query("SELECT 'order' AS kind, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def g7_validate(t: Tables) -> DataFrame:
    a = g.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey").agg(F.lit("order").alias("kind"), F.count("*").alias("orphans"))
    return a.union(g.orphans(t.orders, "o_custkey", t.customer.where("c_custkey % 10 <> 0"), "c_custkey").agg(F.lit("customer"), F.count("*")))


@query(f"WITH e AS ({TREE}) SELECT source, target FROM e WHERE source NOT IN ('n3', 'n7') AND target NOT IN ('n3', 'n7') UNION SELECT 'n1', 'c5' UNION SELECT 'x1', 'n2'")
def g8_apply_delta(t: Tables) -> DataFrame:
    gone = t.spark.createDataFrame([("n3",), ("n7",)], "id string")
    added = t.spark.createDataFrame([("n1", "c5"), ("x1", "n2"), ("n3", "c1")], "source string, target string")
    return g.apply_delta(tree(t), gone, added, ("source", "target"))


@query(f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT 'n4' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON w.id = e.source WHERE depth < 2), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT left(id, 1) AS repository, count(*) AS symbols, min(depth) AS depth FROM d GROUP BY 1""")
def g10_federated_impact(t: Tables) -> DataFrame:
    """What a change reaches in each repository of a federation."""
    found = g.closure(t.spark.createDataFrame([("n4",)], "id string"), tree(t), 2)
    return g.by_repository(found, F.left("id", F.lit(1)))


@query(f"""
WITH RECURSIVE e AS ({TREE}), w AS (SELECT unnest(['n1', 'n2']) AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON w.id = e.source WHERE depth < 2)
SELECT id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'direct_change' ELSE 'dependency_closure' END AS reason FROM w GROUP BY id""")
def g9_diff_impact(t: Tables) -> DataFrame:
    found = g.closure(t.spark.createDataFrame([("n1",), ("n2",)], "id string"), tree(t), 2)
    return found.withColumn("reason", F.when(F.col("depth") == 0, "direct_change").otherwise("dependency_closure"))


@query("""
WITH o AS (SELECT l_suppkey AS node, count(*) AS n FROM lineitem GROUP BY 1), i AS (SELECT l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM o FULL JOIN i ON o.node = i.node""")
def g11_degrees(t: Tables) -> DataFrame:
    return g.degrees(t.lineitem, "l_suppkey", "l_partkey")


@query("""
WITH d AS (SELECT l_partkey, p_name, max(1 - l_discount) AS c FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2)
SELECT l_partkey, p_name, round(c, 6) AS confidence FROM d ORDER BY c DESC, p_name, l_partkey LIMIT 8""")
def g12_prefetch(t: Tables) -> DataFrame:
    near = supply(t).where(F.col("origin").isin(1, 2, 3)).groupBy(F.col("destination").alias("l_partkey")).agg(F.max("confidence").alias("c"))
    top = near.join(t.part, F.col("l_partkey") == F.col("p_partkey")).orderBy(F.desc("c"), "p_name", "l_partkey").limit(8)
    return top.select("l_partkey", "p_name", F.round("c", 6).alias("confidence"))


@query("SELECT l_partkey AS part, min(l_suppkey) AS handle FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1 ORDER BY 1 LIMIT 50")
def g13_affected(t: Tables) -> DataFrame:
    tests = t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set("l_suppkey").alias("handles"))
    changed = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("handle"))
    return g.affected(changed, tests, "handle", "part", 50).withColumnRenamed("cause", "handle")


@query("WITH c AS (SELECT * FROM conversations WHERE (conv_id + turn) % 7 <> 0) SELECT conv_id, turn FROM c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def g14_causal_gaps(t: Tables) -> DataFrame:
    return g.causal_gaps(t.conversations.where("(conv_id + turn) % 7 <> 0"), ["conv_id"], "turn").select("conv_id", "turn")
