from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import lexical as x
from ..operators.context import prefix_stop
from .registry import Tables, query

TOKENS = "list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda t: lower(t)))"


@query(f"""
WITH b AS (SELECT item_id, {TOKENS.format("text")} AS q FROM benchmark), d AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS score FROM b, d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(len(list_intersect(q, t)) / len(q), 9) DESC, doc_id) <= 10""")
def l1_lexical_score(t: Tables) -> DataFrame:
    """The ten best documents for each item: the items are the stated query set."""
    items = t.benchmark.select("item_id", text.lexical_tokens(F.col("text")).alias("tokens"))
    docs = t.documents.select("doc_id", text.lexical_tokens(F.col("text")).alias("tokens"))
    return x.best_by_tokens(items, docs, "item_id", "doc_id", 10).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS t, coalesce(quality, 0) AS st FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT doc_id, 0.80 * (len(list_intersect(['the', 'of', 'and', 'tion'], t)) / 4.0) + 0.20 * st AS score FROM d)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 12) DESC, doc_id LIMIT 50""")
def l2_semantic_score(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(w) for w in ("the", "of", "and", "tion")])
    docs = t.documents.join(t.labels, "doc_id", "left")
    score = x.combined_score(x.lexical_score(q, text.lexical_tokens(F.col("text"))), F.coalesce("quality", F.lit(0)))
    return docs.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id, round(least(1, greatest(0, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def l3_scaled_cosine(t: Tables) -> DataFrame:
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("e0"))
    both = t.embeddings.crossJoin(F.broadcast(one))  # one row
    return both.select("vec_id", F.round(vector.scaled_cosine(vector.doubles(F.col("embedding")), vector.doubles(F.col("e0"))), 5).alias("score"))


@query("""
WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*')) AS t, doc_id % 100 AS vf, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 100 + 30 END AS vu FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 5 >= 2 AND doc_id % 13 <> 0),
r AS (SELECT doc_id, len(list_intersect(['the', 'idiot', 'of', 'que', 'und'], t)) AS relevance FROM f WHERE vf <= 50 AND (vu IS NULL OR vu >= 50))
SELECT doc_id, relevance FROM r WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 40""")
def l4_knowledge_query(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    facts = t.documents.select(
        i, i.alias("handle"), F.lit(1).alias("version"), "text", (i % 5).alias("trust"), F.when(i % 9 == 0, "revoked").otherwise("active").alias("state"), F.lit("doc").alias("source_type"),
        (i % 100).alias("valid_from"), F.when(i % 4 == 0, None).otherwise(i % 100 + 30).alias("valid_until"), (i % 13 == 0).alias("conflicted"),
    )
    return x.knowledge_query(facts, "the idiot of que und", floor=2, as_of=50, limit=40).select("doc_id", "relevance")


@query("SELECT p_partkey, 4 * len(list_intersect(['red', 'gear', 'economy'], string_split(lower(p_name), ' '))) + len(list_intersect(['red', 'gear', 'economy'], [lower(p_type)])) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 30")
def l5_skill_resolve(t: Tables) -> DataFrame:
    task = F.array(F.lit("red"), F.lit("gear"), F.lit("economy"))
    score = x.skill_score(task, F.split(F.lower("p_name"), " "), F.array(F.lower("p_type")))
    return t.part.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(30)


STRUCTURAL = """SELECT p_partkey, p_name, CASE WHEN len(list_intersect({terms}, n || b)) = 0 THEN 0 ELSE least(1, 0.35 + 0.30 * least(1, len(list_intersect({terms}, n || b)) / greatest(1, least(4, len({terms})))) + 0.20 * least(1, len(list_intersect({terms}, n)) / greatest(1, len(list_intersect({terms}, n || b)))) + 0.15 * CAST(p_type = 'ECONOMY' AS INT)) END AS score
 FROM (SELECT *, list_distinct(regexp_extract_all(lower(p_name), '[a-z][a-z0-9]*')) AS n, list_distinct(regexp_extract_all(lower(p_brand), '[a-z][a-z0-9]*')) AS b FROM part)"""


@query(f"WITH s AS ({STRUCTURAL.format(terms=chr(91) + repr('red') + ', ' + repr('widget') + chr(93))}) SELECT p_partkey, round(score, 6) AS score FROM s")
def l6_structural_score(t: Tables) -> DataFrame:
    return _structural(t, ["red", "widget"]).select("p_partkey", F.round("score", 6).alias("score"))


def _structural(t: Tables, terms: list[str]) -> DataFrame:
    name, brand = text.identifier_terms(F.col("p_name")), text.identifier_terms(F.col("p_brand"))
    score = x.structural_score(F.array(*[F.lit(w) for w in terms]), F.array_distinct(name), F.array_distinct(F.concat(name, brand)), F.col("p_type") == "ECONOMY")
    return t.part.withColumn("score", score)


@query("""
SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]{2,}')), lambda w: NOT list_contains(['and', 'build', 'change', 'create', 'for', 'from', 'implement', 'into', 'the', 'update', 'with', 'criar', 'implementar', 'para', 'por', 'uma'], w)).list_sort() AS terms FROM benchmark""")
def l7_task_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_sort(text.task_terms(F.col("text"))).alias("terms"))


@query(f"""
WITH s AS ({STRUCTURAL.format(terms=chr(91) + repr('red') + ', ' + repr('widget') + chr(93))}), c AS (SELECT * FROM s WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'widget') ORDER BY round(score, 12) DESC, p_name, p_partkey LIMIT 50),
r AS (SELECT p_partkey, p_name, round(score, 6) AS score, row_number() OVER w AS rank, sum(strlen(p_name)) OVER w AS cum_bytes FROM c WINDOW w AS (ORDER BY round(score, 12) DESC, p_name, p_partkey)) SELECT * FROM r WHERE cum_bytes <= 256""")
def l8_semantic_context(t: Tables) -> DataFrame:
    """Search, score, keep the top 50, then stop at a byte budget."""
    low = F.lower("p_name")
    scored = _structural(t, ["red", "widget"]).where(low.contains("red") | low.contains("widget")).select("p_partkey", "p_name", F.round("score", 12).alias("s"), F.octet_length("p_name").alias("bytes"))
    out = prefix_stop(scored, [F.desc("s"), F.col("p_name"), F.col("p_partkey")], {"bytes": 256}, candidates=50)
    return out.select("p_partkey", "p_name", F.round("s", 6).alias("score"), "rank", "cum_bytes")


@query("""
WITH h AS (SELECT term, ord, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS n FROM part, (VALUES ('gear', 1), ('red', 2)) v(term, ord) WHERE contains(lower(p_name), term))
SELECT p_partkey, term FROM h WHERE n = 1 ORDER BY ord, p_name, p_partkey LIMIT 30""")
def l9_ordered_union(t: Tables) -> DataFrame:
    """Hits of each term in turn, a part once, under its first term."""
    first = F.when(F.lower("p_name").contains("gear"), 1).when(F.lower("p_name").contains("red"), 2)
    hits = t.part.select("p_partkey", "p_name", first.alias("ord")).where("ord IS NOT NULL").orderBy("ord", "p_name", "p_partkey").limit(30)
    return hits.select("p_partkey", F.when(F.col("ord") == 1, "gear").otherwise("red").alias("term"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1), v AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], q.e) AS d, CASE WHEN label = 3 THEN 1 ELSE 0 END AS lex FROM embeddings, q),
s AS (SELECT *, round(d, 2) + lex AS coarse FROM v ORDER BY round(d, 2) + lex DESC, lex DESC, vec_id LIMIT 20)
SELECT vec_id, lex, round(d + lex, 5) AS score FROM s ORDER BY d + lex DESC, vec_id LIMIT 10""")
def l10_hybrid_search(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 1").select(vector.doubles(F.col("embedding")).alias("q"))
    d = t.embeddings.crossJoin(F.broadcast(q)).withColumn("d", vector.dot(vector.doubles(F.col("embedding")), F.col("q")))
    lex = F.when(F.col("label") == 3, 1).otherwise(0)
    return x.hybrid_search(d, lex, F.round("d", 2), F.col("d"), "vec_id", 10).select("vec_id", "lex", F.round("score", 5).alias("score"))


@query("""
WITH c AS (SELECT s_suppkey, list_distinct(list(p_type)) AS caps, s_acctbal > 0 AS available, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 5 <> 0 END AS pol, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 50 END AS cost, s_suppkey % 20 AS lat
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey, s_acctbal),
s AS (SELECT s_suppkey, len(list_intersect(['ECONOMY', 'SMALL'], caps)) AS m, 2 - len(list_intersect(['ECONOMY', 'SMALL'], caps)) AS mi, available, CASE WHEN pol THEN 'eligible' WHEN pol IS NULL THEN 'unknown' ELSE 'rejected' END AS p, cost, lat FROM c)
SELECT s_suppkey, 100 * m - 1000 * mi - coalesce(cost, 0) - coalesce(lat, 0) + CASE WHEN available THEN 0 ELSE -10000 END + CASE p WHEN 'eligible' THEN 0 WHEN 'unknown' THEN -5000 ELSE -10000 END AS score,
 CASE WHEN mi > 0 THEN 'missing_required_capabilities' WHEN NOT available THEN 'unavailable' WHEN p <> 'eligible' THEN 'policy_' || p ELSE 'eligible' END AS reason FROM s""")
def l11_rank_capabilities(t: Tables) -> DataFrame:
    caps = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_type").alias("capabilities"))
    k = F.col("s_suppkey")
    c = t.supplier.join(caps, k == F.col("l_suppkey")).select(
        "s_suppkey", k.alias("handle"), F.lit(1).alias("version"), "capabilities", (F.col("s_acctbal") > 0).alias("available"), F.when(k % 7 == 0, None).otherwise(k % 5 != 0).alias("policy_eligible"), F.when(k % 3 == 0, None).otherwise(k % 50).alias("cost"), (k % 20).alias("latency")
    )
    return x.rank_capabilities(c, ["ECONOMY", "SMALL"]).select("s_suppkey", "score", "reason")
