"""Context selection under budgets, with two greedy rules that differ on purpose.

``prefix_stop`` ends at the first item that would overflow; ``skip_and_continue`` leaves such an item out
and tries the next ones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_stop(df: DataFrame, order: list[Column], budgets: dict[str, int], partition: list[str] | None = None, candidates: int | None = None) -> DataFrame:
    """Items in order until one overflows a budget (column -> limit).  Sizes are never negative, so a running sum says it.

    Without a partition the order is global: ``candidates`` is then required and bounds what one task sorts."""
    if partition is None:
        if candidates is None:
            raise ValueError("candidate_limit_required")
        df = df.orderBy(*order).limit(candidates)
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(*order)
    running = {f"cum_{c}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in budgets}
    return df.withColumn("rank", F.row_number().over(w)).withColumns(running).where(reduce(and_, [F.col(f"cum_{c}") <= limit for c, limit in budgets.items()]))


def skip_and_continue(df: DataFrame, key: list[str], order: list[Column], size: str, budget: int, payload: list[str], candidates: int, max_items: int = 2**31 - 1) -> DataFrame:
    """Per group: items in order, each taken if it still fits.  One row an accepted item, with its rank and the sum so far.

    What fits depends on what was taken, so it is a fold; ``candidates`` bounds the items of a group."""
    w = Window.partitionBy(*key).orderBy(*order)
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidates)
    item = F.struct("rank", F.col(size).cast("long").alias("size"), *payload)
    grouped = top.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    taken = "filter(items, x -> false)"
    fold = f"aggregate(items, named_struct('used', 0L, 'taken', {taken}), (s, x) -> if(s.used + x.size <= {budget}L AND size(s.taken) < {max_items}, named_struct('used', s.used + x.size, 'taken', concat(s.taken, array(x))), s)).taken"
    out = grouped.select(*key, F.posexplode(F.expr(fold)).alias("at", "x"))
    return out.select(*key, "x.*", (F.col("at") + 1).alias("accepted_rank"))


def line_budget(lines: DataFrame, key: str, line_no: str, budget: int) -> DataFrame:
    """Lines (with ``bytes``) of each key, in order, up to a byte budget: cum_bytes, and kept_bytes, less than bytes for the line that is cut."""
    order = Window.partitionBy(key).orderBy(line_no)
    out = lines.withColumn("cum_bytes", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.greatest(F.lit(0), budget - (F.col("cum_bytes") - F.col("bytes")))
    return out.withColumn("kept_bytes", F.least("bytes", left)).where(F.col("cum_bytes") - F.col("bytes") < budget)


def score_floor(items: DataFrame, group: str, score: str, floor: float, share: float) -> DataFrame:
    """Items that reach the floor and a share of their group's top score."""
    top = items.groupBy(group).agg(F.max(score).alias("_top"))
    return items.join(top, group).where(F.col(score) >= F.greatest(F.lit(floor), share * F.col("_top"))).drop("_top")


def cap_per_domain(df: DataFrame, domain: str, order: list[Column], cap: int) -> DataFrame:
    return df.withColumn("domain_rank", F.row_number().over(Window.partitionBy(domain).orderBy(*order))).where(F.col("domain_rank") <= cap)


def compile_context(items: DataFrame, floor: int, caps: int, budgets: dict[str, int], candidates: int) -> DataFrame:
    """items (type, handle, digest, trust, and the budget columns): equal duplicates collapse, trust and domain caps
    skip, budgets stop.  A handle with two digests is an error row elsewhere: see ``conflicting_handles``."""
    single = items.dropDuplicates(["type", "handle", "digest"]).where(F.col("trust") >= floor)
    order = [F.col("type"), F.col("handle")]
    return prefix_stop(cap_per_domain(single, "type", order, caps), order, budgets, candidates=candidates)


def conflicting_handles(items: DataFrame, handle: str, digest: str) -> DataFrame:
    return items.groupBy(handle).agg(F.count_distinct(digest).alias("digests")).where("digests > 1")


def drop_contained_spans(spans: DataFrame, source: str, handle: str, start: str, end: str) -> DataFrame:
    """Spans that no other span of their source contains; of equal ones the least handle stays."""
    a, b = spans.alias("a"), spans.select(*[F.col(c).alias(f"o_{c}") for c in (source, handle, start, end)])
    longer = F.col("o_" + end) - F.col("o_" + start) > F.col(end) - F.col(start)
    same = (F.col("o_" + start) == F.col(start)) & (F.col("o_" + end) == F.col(end)) & (F.col("o_" + handle) < F.col(handle))
    inside = (F.col("o_" + start) <= F.col(start)) & (F.col("o_" + end) >= F.col(end))
    return a.join(b, (F.col(source) == F.col("o_" + source)) & inside & (longer | same), "left_anti")


def union_sources(sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The named columns of all sources, with ``type``: the name of the source that a row comes from."""
    if not sources:
        raise ValueError("sources_missing")
    return reduce(DataFrame.unionByName, [df.select(*columns, F.lit(name).alias("type")) for name, df in sources.items()])


def fidelity(content: Column, level: Column, summary_bytes: int = 160) -> Column:
    return F.when(level == "metadata", F.lit("")).when(level == "summary", F.substring(content, 1, summary_bytes)).otherwise(content)


def packet_reasons(authority: Column, private: Column, truncated: Column, reasons: Column, n_bytes: Column, max_bytes: int = 8 << 20) -> Column:
    """Names of the packet invariants that fail."""
    checks = {"authority_not_facts": authority != "facts", "private_field": private, "truncation_reason_mismatch": truncated != (F.size(reasons) > 0), "packet_too_large": n_bytes > max_bytes}
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
