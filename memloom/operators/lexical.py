"""Lexical and semantic ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def lexical_score(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for an empty query."""
    return F.when(F.size(query_tokens) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query_tokens, text_tokens)) / F.size(query_tokens))


def best_by_tokens(items: DataFrame, docs: DataFrame, item: str, doc: str, k: int) -> DataFrame:
    """items (item, tokens) against docs (doc, tokens): the ``k`` best documents of each item by the share of its tokens, ties by doc.

    Tokens are an inverted index: only pairs that share a token meet.  Where fewer than ``k`` do, the least documents follow with 0."""
    ids = [r[0] for r in docs.select(doc).distinct().orderBy(doc).limit(k).collect()]  # k of them
    size = F.size(F.array_distinct("tokens"))
    wanted = items.select(item, size.alias("_n"), F.explode(F.array_distinct("tokens")).alias("_token"))
    held = docs.select(doc, F.explode(F.array_distinct("tokens")).alias("_token"))
    hits = held.join(wanted, "_token").select(item, doc, "_n", F.lit(1).alias("_hit"))
    least = items.select(item, F.explode(F.array(*[F.lit(i) for i in ids])).alias(doc), size.alias("_n"), F.lit(0).alias("_hit"))
    score = F.when(F.max("_n") > 0, F.sum("_hit") / F.max("_n")).otherwise(0.0)
    scored = hits.unionByName(least).groupBy(item, doc).agg(score.alias("score"))
    order = Window.partitionBy(item).orderBy(F.desc(F.round("score", 9)), doc)
    return scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def combined_score(lexical: Column, structural: Column, auxiliary: Column | None = None) -> Column:
    if auxiliary is None:
        return F.round(0.80 * lexical + 0.20 * structural, 12)
    return F.round(0.45 * lexical + 0.15 * structural + 0.40 * auxiliary, 12)


def structural_score(terms: Column, name_terms: Column, all_terms: Column, is_callable: Column) -> Column:
    """0 without a matched term, else a base plus coverage, share in the name, and kind, at most 1."""
    matched = F.size(F.array_intersect(terms, all_terms))
    coverage = F.least(F.lit(1.0), matched / F.greatest(F.lit(1), F.least(F.lit(4), F.size(terms))))
    in_name = F.least(F.lit(1.0), F.size(F.array_intersect(terms, name_terms)) / F.greatest(F.lit(1), matched))
    return F.when(matched == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.35 + 0.30 * coverage + 0.20 * in_name + 0.15 * is_callable.cast("int")))


def knowledge_query(facts: DataFrame, task: str, *, floor: int, as_of: int, sources: list[str] | None = None, limit: int) -> DataFrame:
    """facts (handle, version, text, trust, state, source_type, valid_from, valid_until, conflicted): shared tokens,
    active and trusted ones only, valid in the closed interval."""
    terms = F.array(*[F.lit(w) for w in dict.fromkeys(_tokens(task))]) if _tokens(task) else F.array().cast("array<string>")
    relevance = F.size(F.array_intersect(terms, text.knowledge_tokens(F.col("text"))))
    ok = (F.col("state") == "active") & ~F.col("conflicted") & (F.col("trust") >= floor) & (F.col("valid_from") <= as_of) & (F.col("valid_until").isNull() | (F.col("valid_until") >= as_of))
    if sources:
        ok = ok & F.col("source_type").isin(*sources)
    return facts.where(ok).withColumn("relevance", relevance).where("relevance > 0").orderBy(F.desc("relevance"), "handle", "version").limit(limit)


def _tokens(task: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9][a-z0-9_-]*", task.lower())


def skill_score(task: Column, triggers: Column, metadata: Column) -> Column:
    return 4 * F.size(F.array_intersect(task, triggers)) + F.size(F.array_intersect(task, metadata))


def hybrid_search(df: DataFrame, lexical: Column, coarse: Column, exact: Column, key: str, k: int) -> DataFrame:
    """Two stages: 2k rows by coarse + lexical, then k by exact + lexical."""
    scored = df.withColumn("lex", lexical).withColumn("coarse", coarse + F.col("lex"))
    first = scored.orderBy(F.desc("coarse"), F.desc("lex"), key).limit(2 * k)
    return first.withColumn("score", exact + F.col("lex")).orderBy(F.desc("score"), key).limit(k)


def rank_capabilities(candidates: DataFrame, required: list[str], scope: str | None = None, trust: int | None = None, max_freshness: int | None = None) -> DataFrame:
    """candidates (handle, version, capabilities, available, policy_eligible, cost, latency): score, eligibility and first reason.

    Unknown cost or latency costs nothing; an unknown policy is not eligible.  ``ranked`` puts them in order.  Optional
    columns scope, trust and freshness are held against ``scope``, ``trust`` and ``max_freshness``; an unknown one fails."""
    need = F.array(*[F.lit(c) for c in required])
    matched, missing = F.size(F.array_intersect(need, "capabilities")), F.size(F.array_except(need, "capabilities"))
    policy = F.when(F.col("policy_eligible"), "eligible").when(F.col("policy_eligible").isNull(), "unknown").otherwise("rejected")
    score = 100 * matched - 1000 * missing - F.coalesce("cost", F.lit(0)) - F.coalesce("latency", F.lit(0)) + F.when(F.col("available"), 0).otherwise(-10000) + F.when(policy == "eligible", 0).when(policy == "unknown", -5000).otherwise(-10000)
    reason = F.when(missing > 0, "missing_required_capabilities").when(~F.col("available"), "unavailable").when(policy != "eligible", F.concat(F.lit("policy_"), policy)).otherwise("eligible")
    if scope is not None:
        reason = F.when((reason == "eligible") & ~F.col("scope").eqNullSafe(F.lit(scope)), "scope_mismatch").otherwise(reason)
    if trust is not None:
        reason = F.when((reason == "eligible") & ~F.coalesce(F.col("trust") >= trust, F.lit(False)), "trust_too_low").otherwise(reason)
    if max_freshness is not None:
        reason = F.when((reason == "eligible") & ~F.coalesce(F.col("freshness") <= max_freshness, F.lit(False)), "stale").otherwise(reason)
    out = candidates.withColumn("score", score).withColumn("reason", reason).withColumn("eligible", reason == "eligible")
    return out


MANIFEST = "candidates array<struct<handle:string,version:int,capabilities:array<string>,available:boolean,policy_eligible:boolean,cost:long,latency:long,scope:string,trust:int,freshness:long>>"


def candidates_from_manifest(manifests: DataFrame, column: str) -> DataFrame:
    """Candidates for ``rank_capabilities``, one row each, from JSON manifests; what a manifest doesn't say is null."""
    return manifests.select(F.explode(F.from_json(column, MANIFEST)["candidates"]).alias("c")).select("c.*")


def ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
