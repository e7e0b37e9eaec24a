"""Bitemporal versions, overlays, diffs and change logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """SCD-2 rows: valid_from counts versions of a key, valid_to is the next one's; older ones are superseded unless the next isn't active."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("valid_from", F.row_number().over(w)).withColumn("valid_to", F.lead(F.lit(1)).over(w) + F.col("valid_from"))
    following = F.lead(state).over(w)
    return out.withColumn("version_state", F.when(following.isNull(), F.col(state)).when(following == "active", "superseded").otherwise(F.col(state)))


def as_of(df: DataFrame, key: list[str], world: int, include_tombstones: bool = False) -> DataFrame:
    """The version of each key with valid_from <= world < valid_to, the last if there are several."""
    alive = df.where((F.col("valid_from") <= world) & (F.col("valid_to").isNull() | (F.col("valid_to") > world)))
    last = alive.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("valid_from")))).where("_n = 1").drop("_n")
    return last if include_tombstones else last.where("version_state <> 'tombstoned'")


def rename(df: DataFrame, key: str, renames: DataFrame, at: int) -> DataFrame:
    """renames (old, new): the old key gets a tombstone and the new one the old's rows, both from ``at`` on."""
    old = df.join(renames, F.col(key) == F.col("old"), "left_semi")
    moved = df.join(renames, F.col(key) == F.col("old")).withColumn(key, F.col("new")).drop("old", "new").withColumn("valid_from", F.lit(at))
    return df.unionByName(old.withColumn("valid_from", F.lit(at)).withColumn("version_state", F.lit("tombstoned"))).unionByName(moved)


def hold_dependents(facts: DataFrame, changed: list[str], state: str = "state", dependencies: str = "dependencies") -> DataFrame:
    hit = F.arrays_overlap(F.col(dependencies), F.array(*[F.lit(c) for c in changed]))
    return facts.withColumn(state, F.when((F.col(state) == "active") & hit, "held").otherwise(F.col(state)))


def interval_faults(df: DataFrame, key: list[str]) -> DataFrame:
    """Versions that don't begin where the one before ended, or that end before they begin."""
    w = Window.partitionBy(*key).orderBy("valid_from")
    before = df.withColumn("previous_to", F.lag("valid_to").over(w))
    reason = F.when(F.col("valid_to") <= F.col("valid_from"), "interval_empty").when(F.col("previous_to").isNotNull() & (F.col("previous_to") != F.col("valid_from")), "interval_gap")
    return before.withColumn("reason", reason).where("reason IS NOT NULL")


def diff(base: DataFrame, current: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """add, update or delete by key; equal rows are left out.  NULLs are equal to each other."""
    b = base.select(F.col(key).alias("_b"), *[F.col(c).alias(f"before_{c}") for c in payload])
    c = current.select(F.col(key).alias("_c"), *[F.col(c).alias(f"after_{c}") for c in payload])
    change = F.when(F.col("_b").isNull(), "add").when(F.col("_c").isNull(), "delete").when(reduce(or_, [~F.col(f"before_{p}").eqNullSafe(F.col(f"after_{p}")) for p in payload]), "update")
    return b.join(c, F.col("_b") == F.col("_c"), "full_outer").withColumn(key, F.coalesce("_b", "_c")).withColumn("change", change).where("change IS NOT NULL").drop("_b", "_c")


def overlay(base: DataFrame, changed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Base rows whose key isn't changed, with the overlay's rows; a changed key without rows is a tombstone."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows)


def apply_facts(old: DataFrame, new: DataFrame, tombstones: DataFrame) -> DataFrame:
    """handle, version, digest, state: an equal digest and version takes the new state; another digest for the same
    version is a conflict, where the old row stays and is marked; tombstones come last."""
    o = old.select("handle", *[F.col(c).alias(f"o_{c}") for c in ("version", "digest", "state")])
    n = new.select("handle", *[F.col(c).alias(f"n_{c}") for c in ("version", "digest", "state")])
    j = o.join(n, "handle", "full_outer")
    conflict = F.col("o_version").isNotNull() & F.col("n_version").isNotNull() & (F.col("o_version") == F.col("n_version")) & (F.col("o_digest") != F.col("n_digest"))
    keep = F.col("n_version").isNull() | conflict
    pick = lambda c: F.when(keep, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c)
    merged = j.select("handle", pick("version"), pick("digest"), pick("state"), F.coalesce(conflict, F.lit(False)).alias("conflicted"))
    dead = tombstones.select("handle").distinct().withColumn("_dead", F.lit(True))
    return merged.join(dead, "handle", "left").withColumn("state", F.when(F.col("_dead"), "tombstoned").otherwise(F.col("state"))).drop("_dead")


def latest(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row with the largest sequence of each key: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key and c != sequence]
    return df.groupBy(*key).agg(F.max(F.struct(sequence, *rest)).alias("_r")).select(*key, "_r.*")


def forks(df: DataFrame, key: list[str], sequence: str, digest: str) -> DataFrame:
    return df.groupBy(*key, sequence).agg(F.count_distinct(digest).alias("contents")).where("contents > 1")


def changed_paths_since(log: DataFrame, sequence: str, after: int, path: str) -> DataFrame:
    return log.where(F.col(sequence) > after).select(path).distinct()


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def collectable(generations: DataFrame, leases: DataFrame, key: str, now: Column) -> DataFrame:
    return generations.join(leases.where(F.col("expires_at") > now).select(key).distinct(), key, "left_anti")


def replace_range(text: Column, start: int, end: int, replacement: Column, before_digest: Column) -> Column:
    """The text with characters [start, end) replaced, or NULL if it isn't what the digest says."""
    return F.when(F.sha2(text, 256) == before_digest, F.concat(F.substring(text, 1, start), replacement, F.substring(text, end + 1, 2**31 - 1)))
