"""Hash chains, receipts, fencing, secrets in metadata, and summary counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoints


def build_chain(df: DataFrame, key: str, sequence: str, payload: str) -> DataFrame:
    """Rows of each chain with prev_hash and record_hash = sha256(prev_hash + payload).

    Sequential within a chain: one pass over its sorted rows that holds one hash; chains are parallel."""
    rows = df.select(key, F.col(sequence).cast("long").alias("sequence"), F.col(payload).cast("string").alias("payload"))
    dealt = rows.repartition(key).sortWithinPartitions(key, "sequence", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = object(), ""
        for batch in batches:
            before, after = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column("payload").to_pylist(), strict=True):
                last = last if k == chain else ""
                chain = k
                before.append(last)
                last = hashlib.sha256((last + (p or "")).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "prev_hash", "record_hash"])

    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("record_hash", T.StringType())]))


def chain_faults(df: DataFrame, key: str) -> DataFrame:
    """Where a chain breaks: parallel, as each row only needs the one before."""
    w = Window.partitionBy(key).orderBy("sequence")
    d = df.withColumn("_s", F.lag("sequence").over(w)).withColumn("_h", F.lag("record_hash").over(w))
    reason = (
        F.when(F.col("_s").isNotNull() & (F.col("sequence") != F.col("_s") + 1), "sequence_gap")
        .when(F.col("prev_hash") != F.coalesce("_h", F.lit("")), "previous_mismatch")
        .when(F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("record_hash"), "record_mismatch")
    )
    return d.withColumn("reason", reason).where("reason IS NOT NULL").drop("_s", "_h")


def seal(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def contested(df: DataFrame, attempt: list[str], winner: str) -> DataFrame:
    return df.groupBy(*attempt).agg(F.count_distinct(winner).alias("winners")).where("winners > 1")


def secret_keys(metadata: Column) -> Column:
    """Whether a map has a key or value that looks like a credential."""
    bad = lambda v: F.regexp_like(F.lower(v), F.lit("(secret|token|password|api_?key|bearer )"))
    return F.exists(F.map_keys(metadata), bad) | F.exists(F.map_values(metadata), bad)


def nondeterministic(df: DataFrame, key: list[str], result: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count_distinct(result).alias("results")).where("results > 1")


def counts_with_zeros(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(d,) for d in domain], f"{column} string").join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, interpolated median, and nearest-rank p95 and p99, exact: no task holds a whole group.

    Distinct values with their counts are dealt by range; sums before each range tell which ranges hold the wanted
    ranks, and only those are ranked value by value.  Null values are not counted; a group of them alone has nulls."""
    checkpoints(df.sparkSession)
    counts = df.groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = counts.repartitionByRange(*group, "_v").select("*", F.spark_partition_id().alias("_part")).checkpoint()  # ranges must not move between its uses
    real = dealt.where("_v IS NOT NULL")
    of_group = Window.partitionBy(*group)
    parts = real.groupBy(*group, "_part").agg(F.sum("_n").alias("_m"), F.sum(F.col("_v") * F.col("_n")).alias("_s"))
    before = F.coalesce(F.sum("_m").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_part", "_m", before.alias("_before"), F.sum("_m").over(of_group).alias("_all"), F.sum("_s").over(of_group).alias("_sum"))
    nearest = lambda percent: F.expr(f"({percent} * _all + 99) div 100")
    ranks = {"_low": F.expr("(_all + 1) div 2"), "_high": F.expr("_all div 2 + 1"), "p95": nearest(95), "p99": nearest(99)}
    wanted = F.array(*ranks.values())
    parts = parts.where(F.exists(wanted, lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_m"))))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_part"]]
    inside = real.alias("a").join(parts.alias("b"), same).select("a.*", "_before", "_all", "_sum")
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_end", end)
    at = lambda r: F.max(F.when((r <= F.col("_end")) & (r > F.col("_end") - F.col("_n")), F.col("_v")))
    found = ranked.groupBy(*group).agg(F.max(F.col("_sum") / F.col("_all")).alias("mean"), *[at(r).alias(name) for name, r in ranks.items()])
    found = found.select(*group, "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95", "p99")
    empty = dealt.groupBy(*group).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_n")).where("_n IS NULL").select(*group)
    return found.unionByName(empty, allowMissingColumns=True)


def group_digest(df: DataFrame, group: list[str], digest: Column, prefix: int = 3) -> DataFrame:
    """A digest of each group (of hex digests) that doesn't depend on row order: of its buckets' digests, in order.

    A bucket holds the digests with one prefix, so a group of any size is dealt over 16 ** prefix tasks."""
    rows = df.select(*group, digest.alias("_d")).withColumn("_p", F.substring("_d", 1, prefix))
    buckets = rows.groupBy(*group, "_p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_b"))), lambda x: x["_b"])
    return buckets.groupBy(*group).agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
