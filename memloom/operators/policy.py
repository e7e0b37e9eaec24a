"""Multi-objective selection and policies.  A NULL metric is unknown, never zero."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each profile weighs.
PROFILE_WEIGHTS = {
    "quality": {"quality": 0.70, "tokens_per_second": 0.15, "ttft_ms": 0.10, "energy_joules": 0.05},
    "balanced": {"quality": 0.35, "tokens_per_second": 0.20, "ttft_ms": 0.15, "resident_bytes": 0.08, "peak_bytes": 0.08, "transfer_ms": 0.04, "disk_ms": 0.04, "energy_joules": 0.06},
    "memory": {"resident_bytes": 0.30, "peak_bytes": 0.30, "bytes_per_token": 0.12, "kv_bytes_per_token": 0.12, "quality": 0.10, "tokens_per_second": 0.06},
    "minimal": {"resident_bytes": 0.25, "peak_bytes": 0.25, "bytes_per_token": 0.15, "kv_bytes_per_token": 0.15, "transfer_bytes": 0.05, "disk_bytes": 0.05, "energy_joules": 0.05, "quality": 0.05},
}
MAXIMISED = ("quality", "tokens_per_second")


def dominates(a: str, b: str, objectives: dict[str, bool]) -> Column:
    """Row alias a is no worse and somewhere better than b; objectives (column -> maximise) that are NULL on a side don't count."""
    no_worse, better, comparable = [], [], []
    for name, up in objectives.items():
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        known = x.isNotNull() & y.isNotNull()
        comparable.append(known)
        no_worse.append(~known | (x >= y if up else x <= y))
        better.append(known & (x > y if up else x < y))
    return reduce(or_, comparable) & reduce(and_, no_worse) & reduce(or_, better)


def _own_frontiers(batches: Iterator[pa.RecordBatch], up: list[bool]) -> Iterator[pa.RecordBatch]:
    """What no vector with the same NULLs dominates, of the batches of a task."""
    table = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if table is None else pa.concat_tables([table, pa.Table.from_batches([batch])])
        x = np.column_stack([table.column(i).to_numpy(zero_copy_only=False).astype(float) * (1 if high else -1) for i, high in enumerate(up)])
        known, kept = ~np.isnan(x), []
        for mask in np.unique(known, axis=0):
            rows = np.flatnonzero((known == mask).all(axis=1))
            y = x[rows][:, mask]
            best = np.zeros((0, y.shape[1]))
            for i in np.lexsort((*y.T[::-1], y.sum(axis=1)))[::-1]:  # whatever dominates a vector has a larger sum
                if not ((best >= y[i]).all(axis=1) & (best > y[i]).any(axis=1)).any():
                    best = np.vstack((best, y[i]))
                    kept.append(rows[i])
        table = table.take(pa.array(np.sort(kept)))
    if table is not None:
        yield from table.combine_chunks().to_batches()


def frontier(df: DataFrame, objectives: dict[str, bool]) -> DataFrame:
    """Rows that no other row dominates.

    Equal objective vectors share a verdict, so distinct ones are compared.  Skipped NULLs make dominance intransitive,
    but not among vectors with the same NULLs: what one of them dominates, in any group, is dominated by what dominates
    it in its own.  So each group is first reduced to its own frontier, in parallel, and the theta join sees those only."""
    vectors = df.select(*objectives).distinct()
    if all(isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)) for c in objectives):
        vectors = vectors.mapInArrow(lambda batches: _own_frontiers(batches, list(objectives.values())), vectors.schema)
    best = vectors.alias("v").join(vectors.alias("w"), dominates("w", "v", objectives), "left_anti")
    same = reduce(and_, [df[c].eqNullSafe(best[c]) for c in objectives])
    return df.join(best, same, "left_semi")


def filter_reason(threshold: float, budgets: dict[str, float | None], fingerprints: dict[str, str]) -> Column:
    """The first hard filter that fails, or NULL.  A budget fails an unknown metric; a fingerprint passes an unknown one."""
    out = F.when(F.col("quality") < threshold, "quality_below_threshold").when(~F.col("available"), "candidate_unavailable")
    for column, budget in budgets.items():
        if budget is not None:
            out = out.when(F.col(column).isNull(), f"{column}_budget_unknown").when(F.col(column) > budget, f"{column}_budget_exceeded")
    for column, wanted in fingerprints.items():
        if wanted != "unknown":
            out = out.when(F.col(column) != wanted, f"{column}_mismatch")
    return out


def benefits(df: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """df with benefit_<metric>: min-max over all rows (1 where all are equal), NULL stays unknown.  One row of bounds is broadcast."""
    bounds = df.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for m, up in metrics.items():
        lo, hi, x = F.col(f"lo_{m}"), F.col(f"hi_{m}"), F.col(m)
        scaled = (x - lo if up else hi - x) / F.nullif(hi - lo, F.lit(0))
        out = out.withColumn(f"benefit_{m}", F.when(x.isNotNull() & (lo == hi), 1.0).otherwise(scaled))
    return out.drop(*[f"{n}_{m}" for m in metrics for n in ("lo", "hi")])


def profile_score(weights: dict[str, float]) -> Column:
    """Weighted benefits over the weights of the known ones."""
    total = reduce(add, [F.coalesce(F.col(f"benefit_{m}"), F.lit(0.0)) * w for m, w in weights.items()])
    known = reduce(add, [F.when(F.col(f"benefit_{m}").isNotNull(), w).otherwise(0.0) for m, w in weights.items()])
    return F.when(known == 0, 0.0).otherwise(total / known)


def decide(df: DataFrame, name: str, objectives: dict[str, bool], weights: dict[str, float], reason: Column, ties: list[Column]) -> DataFrame:
    """The winner: filters, frontier, profile score, ties."""
    scored = benefits(frontier(df.withColumn("reason", reason).where("reason IS NULL"), objectives), {m: objectives.get(m, m in MAXIMISED) for m in weights})
    return scored.withColumn("score", profile_score(weights)).orderBy(F.desc(F.round("score", 9)), *ties, name).limit(1)


def pressure(metrics: DataFrame, group: list[str], baseline: float = 0.5) -> DataFrame:
    """Rows (group, weight, confidence, pressure, usable): the weighted pressure of the usable ones in per cent, and how sure it is."""
    w, c, p, ok = (F.col(x) for x in ("weight", "confidence", "pressure", "usable"))
    mass = F.sum(F.when(ok, w * c))
    out = metrics.groupBy(*group).agg(
        F.sum(F.when(ok, w * c * p)).alias("_x"), mass.alias("_m"), (F.coalesce(F.sum(F.when(ok, w)), F.lit(0.0)) / F.sum(w)).alias("coverage"), (mass / F.sum(F.when(ok, w))).alias("_c"))
    reason = F.when(F.col("_m").isNull() | (F.col("_m") == 0), "no_usable_metric").when(F.col("coverage") < baseline, "coverage_low")
    score = F.when(reason.isNull(), F.round(100 * F.col("_x") / F.col("_m"), 6))
    return out.select(*group, score.alias("score"), F.round(F.col("coverage") * F.coalesce("_c", F.lit(0.0)), 6).alias("confidence"), reason.alias("reason"))


def placement_score(base: Column, transfer: Column, headroom: Column, bandwidth: Column) -> Column:
    return base + 35 * transfer + 25 * headroom + 10 * bandwidth


def usable(available: Column, value: Column, confidence: Column, gate: Column) -> Column:
    return available & value.isNotNull() & (confidence > 0) & gate


def headroom_pressure(*known: Column) -> Column:
    """The largest of 1 - headroom over the known ones."""
    return F.greatest(*[1 - k for k in known])


def strategy_usable(supported: Column, speedup: Column) -> Column:
    return supported & F.coalesce(speedup > 1, F.lit(True))


def best_strategy(df: DataFrame, group: list[str]) -> DataFrame:
    """Per group the usable strategy with a known speed-up first, then the larger one, then the lower preference."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.col("speedup").isNotNull()), F.desc("speedup"), "preference")
    return df.where(strategy_usable(F.col("supported"), F.col("speedup"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def guardrail(throughput: Column, ttft: Column, memory_mb: Column, min_throughput: float = 0.95, max_ttft: float = 1.10, max_memory: float = 512) -> Column:
    """regressed, held or passed; an unknown ratio holds."""
    bad = (throughput < min_throughput) | (ttft > max_ttft) | (memory_mb > max_memory)
    return F.when(F.coalesce(throughput < min_throughput, F.lit(False)) | F.coalesce(ttft > max_ttft, F.lit(False)) | F.coalesce(memory_mb > max_memory, F.lit(False)), "regressed").when(bad.isNull(), "held").otherwise("passed")


def tuned(value: Column, direction: Column, step: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value + direction * step))


def replay(df: DataFrame, recorded: str, recomputed: str, group: list[str]) -> DataFrame:
    same = F.col(recorded) == F.col(recomputed)
    return df.groupBy(*group).agg(F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"), F.count_if(same.isNull()).alias("unrecorded"))


def promoted(rank: Column, previous: Column) -> Column:
    return F.greatest(rank, F.coalesce(previous, rank))


def drift(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields that differ, in the given order."""
    return F.filter(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()]), lambda x: x.isNotNull())


def policy_decision(df: DataFrame, guards: list[tuple[str, Column, str]], default: str, sealed: list[str], cached: Column | None = None) -> DataFrame:
    """``df`` with decision, reason and receipt.  Guards (reason, condition, decision) are asked in order and the first that holds
    decides; else a cached decision that isn't null; else the default.  The receipt is a digest of the decision and what it rests on."""
    reason, decision = F.lit("default"), F.lit(default)
    if cached is not None:
        reason, decision = F.when(cached.isNotNull(), "cached").otherwise(reason), F.coalesce(cached, decision)
    for name, condition, verdict in reversed(guards):
        holds = F.coalesce(condition, F.lit(False))
        reason, decision = F.when(holds, name).otherwise(reason), F.when(holds, verdict).otherwise(decision)
    out = df.withColumn("decision", decision).withColumn("reason", reason)
    return out.withColumn("receipt", F.sha2(F.concat_ws("|", "decision", "reason", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sealed]), 256))
