"""Generations in segments: a publication writes only the segments whose rows have changed.

A segment is the rows of one number (a hash of the key, or any column given); its identity is the digest
of its rows' digests.  Segments are partitions of one table, named by identity, and a generation is the
list of the segments that it is made of; equal segments are shared by all generations.  Inverted indexes
are tables of (term, key), bucketed by the term's hash, so that a look-up reads one bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import group_digest
from .snapshots import _children, _exists, point


def segment_ids(df: DataFrame, segment: Column, digest: str) -> DataFrame:
    """segment, rows, id."""
    rows = df.select(segment.alias("segment"), digest)
    return rows.groupBy("segment").agg(F.count("*").alias("rows")).join(group_digest(rows, ["segment"], F.col(digest)).withColumnRenamed("digest", "id"), "segment")


def segment_changes(old: DataFrame, new: DataFrame, segment: Column, digest: str) -> DataFrame:
    """segment, rows, action: written, reused or dropped."""
    a = segment_ids(old, segment, digest).select("segment", F.col("id").alias("old_id"), F.col("rows").alias("old_rows"))
    both = segment_ids(new, segment, digest).join(a, "segment", "full_outer")
    action = F.when(F.col("id").isNull(), "dropped").when(F.col("id").eqNullSafe(F.col("old_id")), "reused").otherwise("written")
    return both.select("segment", F.coalesce("rows", "old_rows").alias("rows"), action.alias("action"))


def publish_segments(df: DataFrame, root: str, segment: Column, digest: str) -> dict[str, int]:
    """Write what no generation has yet, then the pointer; how many segments were written and reused."""
    spark = df.sparkSession
    wanted = segment_ids(df, segment, digest).collect()  # one row for each segment: their number is chosen, not the rows'
    there = {n.removeprefix("segment_id=") for n in _children(spark, f"{root}/segments") if _exists(spark, f"{root}/done/{n.removeprefix('segment_id=')}/_SUCCESS")}
    new = [(r.segment, r.id) for r in wanted if r.id not in there]
    if new:
        names = spark.createDataFrame(new, spark.createDataFrame(wanted).select("segment", "id").schema).withColumnsRenamed({"segment": "_segment", "id": "segment_id"})
        rows = df.withColumn("_number", segment).join(names, F.col("_number") == F.col("_segment")).drop("_number", "_segment")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id").parquet(f"{root}/segments")
        for _, name in new:
            spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/done/{name}")
    point(spark, root, [(r.id, r.rows) for r in wanted], "segment_id string, rows long")
    return {"written": len(new), "reused": len(wanted) - len(new)}


def open_segments(spark: SparkSession, root: str, back: int = 0) -> DataFrame | None:
    """The rows of the latest generation, or of one before it; only its partitions are read."""
    names = sorted(_children(spark, f"{root}/pointers"))
    if len(names) <= back:
        return None
    ids = [r.segment_id for r in spark.read.schema("segment_id string, rows long").json(f"{root}/pointers/{names[-1 - back]}").collect()]
    return spark.read.parquet(f"{root}/segments").where(F.col("segment_id").isin(ids)).drop("segment_id")


def term_index(df: DataFrame, key: str, terms: Column, buckets: int = 64) -> DataFrame:
    """term, key, bucket: write it partitioned by bucket."""
    rows = df.select(F.explode(F.array_distinct(terms)).alias("term"), key).distinct()
    return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def look_up(index: DataFrame, terms: list[str], key: str, buckets: int = 64) -> DataFrame:
    """Keys that have all terms; only the terms' buckets are read."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    numbers = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    hits = index.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms))
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms))).select(key)
