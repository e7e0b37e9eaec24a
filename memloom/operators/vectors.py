"""Vector search: exact and two-stage, quantised lanes, and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector


def exact(df: DataFrame, query: list[float], key: str, column: str, metric: str, k: int) -> DataFrame:
    q = F.array(*[F.lit(float(v)) for v in query])
    return df.withColumn("score", vector.metric(metric, vector.doubles(F.col(column)), q)).orderBy(F.desc("score"), key).limit(k)


def approximate(df: DataFrame, query: list[float], key: str, column: str, metric: str, k: int, seed: int = 7) -> DataFrame:
    """The k best by the score of rotated 4-bit codes (``approx``): the vectors themselves are not compared."""
    n = len(query)
    q = F.array(*[F.lit(float(v)) for v in query])
    code = lambda v: vector.dequantise(vector.quantise(vector.rotate(v, n, seed)))
    v = vector.doubles(F.col(column))
    return df.withColumn("approx", vector.metric(metric, code(v), code(q))).orderBy(F.desc("approx"), key).limit(k)


def two_stage(df: DataFrame, query: list[float], key: str, column: str, metric: str, k: int, candidates: int | None = None, seed: int = 7) -> DataFrame:
    """Candidates by the score of rotated 4-bit codes, then the exact score: two top-k passes, nothing else is sorted."""
    first = approximate(df, query, key, column, metric, candidates or 4 * k, seed)
    return exact(first, query, key, column, metric, k)


def lane(x: Column, name: str) -> Column:
    """struct(scale, codes) of a lane: int8 or int4, symmetric, half to even."""
    levels = {"Q1": 127, "Q2": 7}[name]
    return vector.quantise(x, levels, -levels, even=True)


def quality(ranked: DataFrame, query: str, rank: str, relevant: str, totals: DataFrame, ks=(1, 5, 10, 20)) -> DataFrame:
    """Per query: recall@k (over min(relevant, k)), precision@k, nDCG@10 and MRR.  ``totals``: query -> n_relevant."""
    hit = F.col(relevant).cast("int")
    aggregates = [F.sum(F.when(F.col(rank) <= k, hit).otherwise(0)).alias(f"hits_{k}") for k in ks]
    gain = F.sum(F.when(F.col(rank) <= 10, hit / F.log2(F.col(rank) + 1)).otherwise(0.0)).alias("dcg")
    first = F.min(F.when(hit == 1, F.col(rank))).alias("first")
    out = ranked.groupBy(query).agg(*aggregates, gain, first).join(totals, query)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    n = F.col("n_relevant")
    columns = [(F.col(f"hits_{k}") / F.greatest(F.lit(1), F.least(n, F.lit(k)))).alias(f"recall_{k}") for k in ks] + [(F.col(f"hits_{k}") / k).alias(f"precision_{k}") for k in ks]
    return out.select(query, *columns, F.when(n > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def quantise_hadamard(x: Column, n: int, seed: int) -> Column:
    """Random signs, Walsh-Hadamard over a zero-padded power of two, then 4-bit codes."""
    size = 1 << (n - 1).bit_length()
    _, signs = vector.signed_permutation(size, seed)
    padded = F.concat(x, F.array_repeat(F.lit(0.0), size - n))
    signed = F.zip_with(padded, F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b)
    return vector.let(signed, lambda v: vector.quantise(vector.fwht(v, size)))


def dequantise_hadamard(q: Column, n: int, seed: int) -> Column:
    size = 1 << (n - 1).bit_length()
    _, signs = vector.signed_permutation(size, seed)
    back = vector.let(vector.dequantise(q), lambda v: vector.fwht(v, size))  # the transform is its own inverse
    return F.slice(F.zip_with(back, F.array(*[F.lit(float(s)) for s in signs]), lambda a, b: a * b), 1, n)


def lane_search(df: DataFrame, query: list[float], key: str, column: str, name: str, k: int, candidates: int | None = None) -> DataFrame:
    """Q0 exact cosine; Q1 int8 cosine; Q2a 4-bit only; Q2b 4-bit candidates with exact scores."""
    if name == "Q0":
        return exact(df, query, key, column, "cosine", k)
    q = F.array(*[F.lit(float(v)) for v in query])
    levels = "Q1" if name == "Q1" else "Q2"
    approx = vector.cosine(vector.dequantise(lane(vector.doubles(F.col(column)), levels)), vector.dequantise(lane(q, levels)))
    first = df.withColumn("score", approx).orderBy(F.desc("score"), key)
    if name != "Q2b":
        return first.limit(k)
    return exact(first.limit(candidates or 4 * k).drop("score"), query, key, column, "cosine", k)


def promotion(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metrics with the names of the floors that aren't reached (an unknown metric reaches none) and PROMOTE or REJECT."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(m) >= floor, F.lit(False)), F.lit(m)) for m, floor in floors.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("failed", failed).withColumn("gate", F.when(F.size("failed") == 0, "PROMOTE").otherwise("REJECT"))


def fixture(spark: SparkSession, rows: int, dimensions: int, seed: int) -> DataFrame:
    """vec_id, embedding: vectors that depend on the seed alone, whatever the number of rows or tasks; values are -1 to 1 by 15ths."""
    digit = lambda j: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "id", j), 256), 1, 1), 16, 10).cast("double")
    return spark.range(rows).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda j: (digit(j) - 7.5) / 7.5).alias("embedding"))
