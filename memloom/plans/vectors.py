from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import vectors as v
from .registry import Tables, query

DIM = 64
#: A fixed query vector, so that the SQL and the DataFrame use the same one.
QUERY = [round(((i * 37) % 17 - 8) / 8, 3) for i in range(DIM)]
_Q = "[" + ", ".join(f"{q}::DOUBLE" for q in QUERY) + "]"


def _list(values) -> str:
    return "[" + ", ".join(str(x) for x in values) + "]"


ORDER, SIGNS = vector.signed_permutation(DIM, 7)
ROTATE = f"list_transform(range(1, {DIM + 1}), lambda i: list_extract({_list([float(s) for s in SIGNS])}, i) * list_extract({{0}}, list_extract({_list([o + 1 for o in ORDER])}, i)))"
HALF_AWAY = "CASE WHEN {0} >= 0 THEN floor({0} + 0.5) ELSE ceil({0} - 0.5) END"
PEAK = "list_max(list_transform({0}, lambda z: abs(z)))"


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 20")
def v1_exact_dot(t: Tables) -> DataFrame:
    return v.exact(t.embeddings, QUERY, "vec_id", "embedding", "dot", 20).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round(-pow(list_distance(embedding::DOUBLE[], {_Q}), 2), 4) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 20")
def v1_exact_l2(t: Tables) -> DataFrame:
    return v.exact(t.embeddings, QUERY, "vec_id", "embedding", "l2", 20).select("vec_id", F.round("score", 4).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 20")
def v1_exact_cosine(t: Tables) -> DataFrame:
    return v.exact(t.embeddings, QUERY, "vec_id", "embedding", "cosine", 20).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, {ROTATE.format('embedding::DOUBLE[]')} AS rotated FROM embeddings")
def v2_rotate(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vector.rotate(vector.doubles(F.col("embedding")), DIM, 7).alias("rotated"))


QUANT = f"""SELECT vec_id, scale, list_transform(e, lambda z: CAST(greatest(-8, least(7, {HALF_AWAY.format('(z / scale)')})) AS INT)) AS codes FROM (SELECT vec_id, e, CASE WHEN {PEAK.format('e')} = 0 THEN 1.0 ELSE {PEAK.format('e')} / 7 END AS scale FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""


@query(f"SELECT vec_id, round(scale, 6) AS scale, codes FROM ({QUANT})")
def v3_quantise(t: Tables) -> DataFrame:
    q = vector.quantise(vector.doubles(F.col("embedding")))
    return t.embeddings.select("vec_id", q.alias("q")).select("vec_id", F.round("q.scale", 6).alias("scale"), F.col("q.codes").alias("codes"))


@query(f"SELECT vec_id, list_transform(range(1, 33), lambda i: (CASE WHEN codes[2*i-1] < 0 THEN codes[2*i-1] + 16 ELSE codes[2*i-1] END) + 16 * (CASE WHEN codes[2*i] < 0 THEN codes[2*i] + 16 ELSE codes[2*i] END)) AS packed, true AS round_trip FROM ({QUANT})")
def v4_pack_nibbles(t: Tables) -> DataFrame:
    q = t.embeddings.select("vec_id", vector.quantise(vector.doubles(F.col("embedding"))).alias("q")).select("vec_id", "q.codes")
    packed = q.withColumn("packed", vector.pack_nibbles(F.col("codes")))
    return packed.select("vec_id", "packed", (vector.unpack_nibbles(F.col("packed"), DIM) == F.col("codes")).alias("round_trip"))


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def v6_two_stage(t: Tables) -> DataFrame:
    """Rotated 4-bit candidates, then exact scores: held against the exact ten."""
    return v.two_stage(t.embeddings, QUERY, "vec_id", "embedding", "dot", 10).select("vec_id", F.round("score", 5).alias("score"))


@query(f"""
SELECT vec_id, list_transform(range(0, {DIM}), lambda i: round(list_sum(list_transform(range(1, {DIM + 1}), lambda j: embedding[j]::DOUBLE * CASE WHEN bit_count((i & (j - 1))::INT) % 2 = 0 THEN 1 ELSE -1 END)) / 8, 4) + 0.0) AS h FROM embeddings""")
def v7_fwht(t: Tables) -> DataFrame:
    h = vector.fwht(vector.doubles(F.col("embedding")), DIM)
    return t.embeddings.select("vec_id", F.transform(h, lambda y: F.round(y, 4) + 0.0).alias("h"))


@query(f"""
WITH s AS (SELECT vec_id, e, {PEAK.format('e')} / 127 AS a, {PEAK.format('e')} / 7 AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
SELECT vec_id, list_transform(e, lambda z: CAST(greatest(-127, least(127, round_even(z / a, 0))) AS INT)) AS q1, list_transform(e, lambda z: CAST(greatest(-7, least(7, round_even(z / b, 0))) AS INT)) AS q2 FROM s""")
def v9_lanes(t: Tables) -> DataFrame:
    e = vector.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", v.lane(e, "Q1").alias("a"), v.lane(e, "Q2").alias("b")).select("vec_id", F.col("a.codes").alias("q1"), F.col("b.codes").alias("q2"))


@query("""
WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, CAST(a.label = b.label AS INT) AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
n AS (SELECT a.vec_id AS q, count(*) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1)
SELECT q, round(sum(rel) FILTER (rank <= 10) / least(any_value(n), 10), 6) AS recall_10, round(sum(rel) FILTER (rank <= 10) / 10, 6) AS precision_10,
 round(sum(rel / log2(rank + 1)) FILTER (rank <= 10) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= any_value(n)), 6) AS ndcg_10, round(coalesce(1.0 / min(rank) FILTER (rel = 1), 0), 6) AS mrr
FROM p JOIN n USING (q) WHERE rank <= 20 GROUP BY q""")
def v11_quality(t: Tables) -> DataFrame:
    """Every hundredth vector as a query against all: a stated query set, broadcast."""
    e = t.embeddings.select("vec_id", vector.doubles(F.col("embedding")).alias("e"), "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("e").alias("qe"), F.col("label").alias("ql"))
    pairs = e.join(F.broadcast(q), F.col("q") != F.col("vec_id")).select("q", "vec_id", (F.col("ql") == F.col("label")).alias("rel"), F.round(vector.dot(F.col("e"), F.col("qe")), 4).alias("s"))
    totals = pairs.groupBy("q").agg(F.sum(F.col("rel").cast("int")).alias("n_relevant")).where("n_relevant > 0")
    ranked = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id)")).where("rank <= 20")
    out = v.quality(ranked, "q", "rank", "rel", totals)
    return out.select("q", *[F.round(c, 6).alias(c) for c in ("recall_10", "precision_10", "ndcg_10", "mrr")])


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def v10_lane_exact(t: Tables) -> DataFrame:
    return v.lane_search(t.embeddings, QUERY, "vec_id", "embedding", "Q0", 10).select("vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def v10_lane_rerank(t: Tables) -> DataFrame:
    """4-bit candidates, exact scores: held against the exact ten."""
    return v.lane_search(t.embeddings, QUERY, "vec_id", "embedding", "Q2b", 10).select("vec_id", F.round("score", 5).alias("score"))


@query()
def v8_quantise_hadamard(t: Tables) -> DataFrame:
    """Largest error of a round trip, in steps of the scale; tests bound it."""
    x = vector.doubles(F.col("embedding"))
    q = t.embeddings.select("vec_id", x.alias("x"), v.quantise_hadamard(x, DIM, 5).alias("q"))
    error = F.array_max(F.zip_with("x", v.dequantise_hadamard(F.col("q"), DIM, 5), lambda a, b: F.abs(a - b)))
    return q.select("vec_id", F.round(error / F.col("q.scale"), 4).alias("error_steps"))


@query("""
WITH m AS (SELECT label, count(*) / 100.0 AS coverage, CASE WHEN label % 3 = 0 THEN NULL ELSE label / 10.0 END AS recall FROM embeddings GROUP BY label)
SELECT label, list_filter([CASE WHEN NOT coalesce(coverage >= 0.45, false) THEN 'coverage' END, CASE WHEN NOT coalesce(recall >= 0.4, false) THEN 'recall' END], lambda x: x IS NOT NULL) AS failed,
 CASE WHEN coalesce(coverage >= 0.45, false) AND coalesce(recall >= 0.4, false) THEN 'PROMOTE' ELSE 'REJECT' END AS gate FROM m""")
def v12_promotion(t: Tables) -> DataFrame:
    m = t.embeddings.groupBy("label").agg((F.count("*") / 100).alias("coverage")).withColumn("recall", F.when(F.col("label") % 3 == 0, None).otherwise(F.col("label") / 10))
    return v.promotion(m, {"coverage": 0.45, "recall": 0.4}).select("label", "failed", "gate")
