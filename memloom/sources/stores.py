"""Tables that are verified when they are read: projections, catalogs, temporal overlays, ledgers and caches.

A store is a folder of rows with a seal beside it: the number of rows and a digest that doesn't depend on
their order.  ``load`` raises where rows and seal disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.integrity import group_digest


def row_digest(df: DataFrame) -> Column:
    """sha256 of a row's values by column name; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def seal(df: DataFrame) -> tuple[int, str]:
    row = group_digest(df.withColumn("_all", F.lit(1)), ["_all"], row_digest(df)).first()
    return df.count(), row.digest if row else "empty"


def save(df: DataFrame, path: str, max_rows: int | None = None) -> tuple[int, str]:
    """Write rows and then their seal, as read back; an unsealed store can't be loaded."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    n, digest = seal(spark.read.parquet(f"{path}/rows"))
    if max_rows is not None and n > max_rows:
        raise ValueError("store_too_large")
    spark.createDataFrame([(n, digest)], "rows long, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/seal")
    return n, digest


def load(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    wanted = spark.read.schema("rows long, digest string").json(f"{path}/seal").first()
    if wanted is None or seal(rows) != (wanted.rows, wanted.digest):
        raise ValueError("store_digest_mismatch")
    return rows


def valid_prefix(chain: DataFrame, key: str) -> DataFrame:
    """The records of each hash chain (sequence, payload, prev_hash, record_hash) before its first fault: what a recovery keeps."""
    order = Window.partitionBy(key).orderBy("sequence")
    before, last = F.lag("sequence").over(order), F.lag("record_hash").over(order)
    fault = (before.isNotNull() & (F.col("sequence") != before + 1)) | (F.col("prev_hash") != F.coalesce(last, F.lit(""))) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("record_hash"))
    faults = chain.withColumn("_fault", fault.cast("int")).withColumn("_before", F.sum("_fault").over(order))
    return faults.where("_before = 0").drop("_fault", "_before")


def append(spark: SparkSession, path: str, records: DataFrame, key: str) -> int:
    """Append records (key, sequence, payload) that follow each chain's last one; how many chains were refused.

    A chain is refused whole if its first record isn't the next one."""
    from ..operators.integrity import build_chain
    from .snapshots import _exists

    stored = spark.read.parquet(path) if _exists(spark, f"{path}/_SUCCESS") else None
    first = records.groupBy(key).agg(F.min("sequence").alias("_first"))
    if stored is None:
        fresh = first.where("_first = 0").select(key, F.lit("").alias("_last"))
    else:
        ends = stored.groupBy(key).agg(F.max("sequence").alias("_end"), F.max_by("record_hash", "sequence").alias("_last"))
        fresh = first.join(ends, key, "left").where("_first = coalesce(_end + 1, 0)").select(key, F.coalesce("_last", F.lit("")).alias("_last"))
    fresh = fresh.persist()
    refused = first.count() - fresh.count()
    linked = records.join(fresh, key)
    heads = stored.join(fresh.where("_last <> ''"), key, "left_semi").groupBy(key).agg(F.max("sequence").alias("sequence")) if stored is not None else None
    whole = records.join(fresh, key, "left_semi").select(key, "sequence", "payload")
    if heads is not None:
        whole = whole.unionByName(stored.join(fresh, key, "left_semi").select(key, "sequence", "payload"))
    chain = build_chain(whole, key, "sequence", "payload").join(linked.select(key, "sequence"), [key, "sequence"], "left_semi")
    chain.write.mode("append").parquet(path)
    fresh.unpersist()
    return refused
