"""Look-ups: exact, substring and tiered search, edge queries, bounded reads and visibility."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_exact(df: DataFrame, column: str, term: str) -> DataFrame:
    return df.where(F.lower(column) == term.lower())


def search(df: DataFrame, term: str, name: str, qualified: str, *, prefix: bool = False, path: tuple[str, str] | None = None, kind: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose name or qualified name contains the term (or whose name begins with it), with the given path and kind."""
    low = F.lit(term.lower())
    hit = F.lower(name).startswith(low) if prefix else F.lower(name).contains(low) | F.lower(qualified).contains(low)
    for pair in (path, kind):
        if pair:
            hit = hit & (F.col(pair[0]) == pair[1])
    return df.where(hit)


def tier(term: str, *names: str) -> Column:
    """0 exact, 1 prefix, 2 substring, NULL no match, over any of the names."""
    low = term.lower()
    any_of = lambda test: reduce(or_, [test(F.lower(n)) for n in names])
    return F.when(any_of(lambda c: c == low), 0).when(any_of(lambda c: c.startswith(low)), 1).when(any_of(lambda c: c.contains(low)), 2)


def tiered_search(df: DataFrame, term: str, names: list[str], key: str, *, where: Column | None = None, after: int | None = None, limit: int = 50) -> DataFrame:
    """Rows of the best tier that has any, then filters, then a page by key.

    The best tier is found before the filters: a hit that they remove never lets the next tier in.  It is one
    row, so it is broadcast; a global window would bring all rows to one task."""
    hits = df.withColumn("tier", tier(term, *names)).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best_tier"))
    page = hits.crossJoin(F.broadcast(best)).where("tier = best_tier").drop("best_tier")
    page = page if where is None else page.where(where)
    page = page if after is None else page.where(F.col(key) > after)
    return page.orderBy(key).limit(limit)


def edges_of(edges: DataFrame, endpoints: list[str], handle, kind: tuple[str, str] | None, order: list[str], limit: int) -> DataFrame:
    """Edges with the handle at any endpoint, exactly, in stored order."""
    hit = reduce(or_, [F.col(c) == handle for c in endpoints])
    if kind:
        hit = hit & (F.col(kind[0]) == kind[1])
    return edges.where(hit).orderBy(*order).limit(limit)


def impact(edges: DataFrame, endpoints: list[str], symbols: DataFrame, names: list[str], term: str) -> DataFrame:
    """Edges that have the term in an endpoint, or an endpoint that is a name of a symbol found by the term."""
    low = term.lower()
    contains = lambda c: F.lower(F.col(c).cast("string")).contains(low)
    found = symbols.where(reduce(or_, [contains(c) for c in names])).select(F.explode(F.array(*[F.col(c).cast("string") for c in names])).alias("_endpoint")).distinct()
    hit = reduce(or_, [contains(c) for c in endpoints])
    out = edges
    for i, c in enumerate(endpoints):  # the names are distinct, so a join adds no rows
        out = out.join(found.withColumnRenamed("_endpoint", f"_end{i}"), F.col(c).cast("string") == F.col(f"_end{i}"), "left")
        hit = hit | F.col(f"_end{i}").isNotNull()
    return out.where(hit).select(*edges.columns)


def latest_operations(df: DataFrame, *, status: str | None = None, kind: str | None = None, as_of: int | None = None, limit: int = 100, gaps: DataFrame | None = None) -> DataFrame:
    """Operations (handle, kind, status, sequence), newest first; complete ones with a causal gap are hidden."""
    out = df
    if status is not None:
        out = out.where(F.col("status") == status)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if as_of is not None:
        out = out.where(F.col("sequence") <= as_of)
    if gaps is not None:
        hidden = gaps.select("handle").distinct().withColumn("_gap", F.lit(True))
        out = out.join(hidden, "handle", "left").where(~((F.col("status") == "complete") & F.coalesce("_gap", F.lit(False)))).drop("_gap")
    return out.orderBy(F.desc("sequence"), F.desc("handle")).limit(limit)


def resolve_handles(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests (handle, namespace, generation) against catalog (handle, namespace, generation, state, digest, payload): the first failing guard."""
    c = catalog.select("handle", F.col("namespace").alias("c_namespace"), F.col("generation").alias("c_generation"), "state", "digest", "payload")
    reason = (
        F.when(F.col("c_namespace").isNull(), "handle_unknown")
        .when(F.col("namespace") != F.col("c_namespace"), "namespace_mismatch")
        .when(F.col("generation") != F.col("c_generation"), "generation_stale")
        .when(F.col("state") != "active", "entry_inactive")
        .when(F.sha2("payload", 256) != F.col("digest"), "digest_mismatch")
        .otherwise("ok")
    )
    return requests.join(c, "handle", "left").withColumn("reason", reason)


def events_since(df: DataFrame, sequence: str, after: int, max_events: int) -> DataFrame:
    """Events with a larger sequence; more than ``max_events`` is an error, never a truncation."""
    out = df.where(F.col(sequence) > after)
    if out.limit(max_events + 1).count() > max_events:
        raise ValueError("event_limit_exceeded")
    return out.orderBy(sequence)


def permitted(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is relative, without parent steps or drives, and below one of the prefixes."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = clean.startswith("/") | F.regexp_like(clean, F.lit(r"(^|/)\.\.(/|$)")) | F.regexp_like(clean, F.lit(r"^[A-Za-z]:"))
    below = reduce(or_, [(clean == p) | clean.startswith(p.rstrip("/") + "/") for p in prefixes], F.lit(False))
    return ~bad & below


def visible(stage: str, kind: Column, visibility: Column) -> Column:
    if stage.lower() == "reviewer":
        return (kind != "implementer_prompt") & (visibility != "implementer")
    return visibility != "reviewer"


def page(content: Column, offset: int, limit: int) -> tuple[Column, Column, Column]:
    """A slice of the text, where the next one begins, and whether the text ends with it."""
    part = F.substring(content, offset + 1, limit)
    following = F.lit(offset) + F.length(part)
    return part, following, following >= F.length(content)


def grouped(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with their ``position`` in their group and the group's ``size``: one shuffle that spills, and no list of a group."""
    same = Window.partitionBy(*group)
    return df.withColumns({"size": F.count(F.lit(1)).over(same), "position": F.row_number().over(same.orderBy(*order))})


def page_span(offset: int, length: int, page_size: int) -> tuple[int, int]:
    """First and last page that a byte range touches."""
    return offset // page_size, max(offset, offset + length - 1) // page_size
