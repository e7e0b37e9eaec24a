"""Immutable generations of a table: content-addressed publishing, incremental refresh and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import group_digest
from ..operators.temporal import diff


def generation_id(df: DataFrame, digest: str) -> str:
    """An identity of the rows that doesn't depend on their order: the digest of their (hex) digests in order."""
    row = group_digest(df.withColumn("_all", F.lit(1)), ["_all"], F.col(digest)).first()
    return row.digest if row else "empty"


def publish(df: DataFrame, root: str, key: str, digest: str, partition_by: list[str] | None = None) -> str:
    """Write a generation and then the pointer to it; readers see the old one until the pointer is there.

    An equal generation is not written again.  Returns the path."""
    spark = df.sparkSession
    path = f"{root}/generation={generation_id(df, digest)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    point(spark, root, [(path, key, digest)], "path string, key string, digest string")
    return path


def point(spark: SparkSession, root: str, rows: list[tuple], schema: str) -> None:
    """Write the next pointer.  Its number is claimed first, by a file that only one publisher can create; the other raises."""
    number = _sequence(spark, root)
    fs, claim = _fs(spark, f"{root}/claims/{number:012d}")
    if not fs.createNewFile(claim):
        raise ValueError("generation_conflict")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{root}/pointers/{number:012d}")


def current(spark: SparkSession, root: str, back: int = 0) -> DataFrame | None:
    """The latest generation, or one before it."""
    names = sorted(_children(spark, f"{root}/pointers"))
    if len(names) <= back:
        return None
    return spark.read.parquet(spark.read.schema("path string, key string, digest string").json(f"{root}/pointers/{names[-1 - back]}").first().path)


def recover_previous(spark: SparkSession, root: str, content: str) -> DataFrame:
    """Make the generation before the latest one the latest again, after its rows are verified; raises where there is none or it is broken.

    The latest pointer stays where it is: a new one goes after it."""
    names = sorted(_children(spark, f"{root}/pointers"))
    if len(names) < 2:
        raise ValueError("generation_missing")
    row = spark.read.schema("path string, key string, digest string").json(f"{root}/pointers/{names[-2]}").first()
    rows = spark.read.parquet(row.path)
    if not verify(rows, row.key, content, row.digest).isEmpty():
        raise ValueError("generation_tampered")
    point(spark, root, [tuple(row)], "path string, key string, digest string")
    return current(spark, root)


def refresh(spark: SparkSession, root: str, df: DataFrame, key: str, digest: str) -> dict[str, int]:
    """Publish ``df`` if it differs; how many rows were added, deleted, updated and reused."""
    old = current(spark, root)
    if old is None:
        n = df.count()
        publish(df, root, key, digest)
        return {"added": n, "deleted": 0, "updated": 0, "reused": 0}
    changes = {r.change: r.n for r in diff(old.select(key, digest), df.select(key, digest), key, [digest]).groupBy("change").agg(F.count("*").alias("n")).collect()}
    counts = {name: changes.get(change, 0) for change, name in (("add", "added"), ("delete", "deleted"), ("update", "updated"))}
    counts["reused"] = old.join(df.select(key, digest), [key, digest], "left_semi").count()
    if changes:
        publish(df, root, key, digest)
    return counts


def verify(df: DataFrame, key: str, content: str, digest: str) -> DataFrame:
    """Rows that break a generation: repeated keys, and digests that aren't those of the content."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("key_repeated").alias("reason"))
    return repeated.unionByName(df.where(~F.sha2(content, 256).eqNullSafe(F.col(digest))).select(key, F.lit("digest_mismatch").alias("reason")))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _sequence(spark: SparkSession, root: str) -> int:
    return max((int(n) for n in _children(spark, f"{root}/pointers")), default=0) + 1
