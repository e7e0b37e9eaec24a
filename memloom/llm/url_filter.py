"""URL filter: host and path rules, and association rules that Spark's FP-growth mines from what they label.

A url becomes a set of tokens (parts of its host, path and query).  Urls that a rule judges are the
labelled ones; FP-growth finds token combinations that often go with a verdict.  Combinations below the
support or confidence, or no better than one of their own parts, are pruned.  The rest is an inverted
index: each is filed under one of its tokens, a url looks up its tokens, and containment is checked.
The most confident fitting combination judges a url that no rule judges; without one it is allowed.

FP-growth counts every subset of what often stands together, so tokens that can't change the rules leave
first, none of them by a cap: those too rare for any rule; those that always go with one verdict (a rule
of their own, which no combination betters); and of tokens that always stand together, all but one (its
rules are given to the others afterwards).  Where a url still has more than ``WIDE`` tokens, combinations
of up to ``MAX_TOKENS`` are counted instead, which gives the same rules in polynomial time.

DataFrame functions only.  Defined results: a null url, or one without ``://``, has empty host and path
and is allowed; each row is judged by its url, so repeated rows and null page_ids change nothing;
without any labelled url nothing is mined; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .line_dedup import fold

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.9, 3
#: FP-growth gets sets of this many tokens at most: 2 ** WIDE subsets of each.
WIDE = 12
_LABEL = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return fold(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and ruled (the verdict): the longest fitting rule."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def tokens() -> Column:
    """Sorted distinct tokens: labels of the host, its last two together, path segments (numbers alike), query keys."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    tail = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), tail,
        F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0"))),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    )))


def _reduced(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """What is known of each frequent token (token, twin, verdict, n), and the sets (tokens, ruled, n, items) with the twins of their mixed tokens.

    ``verdict`` is set for tokens that always go with one; ``twin`` is the least token that stands wherever this one does."""
    sets = saved(labelled.groupBy("tokens", "ruled").agg(F.count("*").alias("n")), "sets")
    each = sets.select("tokens", "ruled", "n", F.explode(F.array_distinct("tokens")).alias("token"))
    by_verdict = each.groupBy("token", "ruled").agg(
        F.sum("n").alias("n"), F.count("*").alias("sets"), *(F.sum(F.xxhash64(F.lit(k), "tokens").cast("decimal(38,0)")).alias(f"print{k}") for k in (1, 2))
    )
    known = by_verdict.groupBy("token").agg(
        F.sum("n").alias("all"), F.max("n").alias("n"), F.count("*").alias("verdicts"), F.max("ruled").alias("ruled"), F.sum("sets").alias("sets"), F.sum("print1").alias("print1"), F.sum("print2").alias("print2")
    )
    known = saved(known.where(F.col("n") >= least), "tokens")
    twins = known.groupBy("sets", "print1", "print2").agg(F.min("token").alias("twin"))
    known = saved(known.join(twins, ["sets", "print1", "print2"]).select("token", "twin", "n", F.when(F.col("verdicts") == 1, F.col("ruled")).alias("verdict")), "known-tokens")
    mixed = each.select("tokens", "ruled", "token").join(known.where("verdict IS NULL AND token = twin").select("token"), "token")
    # A set is a url's tokens, so its list is bounded.
    items = saved(mixed.groupBy("tokens", "ruled").agg(F.array_sort(F.collect_list("token")).alias("items")), "items")
    return known, saved(sets.join(items, ["tokens", "ruled"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), "reduced")


def _grown(labelled: DataFrame, sets: DataFrame, min_support: float, min_confidence: float, max_tokens: int) -> DataFrame:
    rows = labelled.join(sets.select("tokens", F.col("ruled").alias("r"), "items"), "tokens").where("ruled = r").select(F.array_append("items", F.concat(F.lit(_LABEL), "ruled")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows).associationRules
    return found.where(F.col("consequent")[0].startswith(_LABEL) & (F.size("antecedent") <= max_tokens)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 1000).alias("learned"), "confidence", "support"
    )


def _counted(sets: DataFrame, total: int, least: int, min_confidence: float, max_tokens: int) -> DataFrame:
    """The same rules by counting the combinations of up to ``max_tokens`` items."""
    weighed = sets.groupBy("items", "ruled").agg(F.sum("n").alias("n"))
    level = "transform(items, (x, i) -> struct(array(x) AS c, i AS i))"
    combos = [level]
    for _ in range(max_tokens - 1):
        level = f"flatten(transform({level}, s -> transform(slice(items, s.i + 2, size(items)), (y, k) -> struct(array_append(s.c, y) AS c, s.i + 1 + k AS i))))"
        combos.append(level)
    each = weighed.selectExpr("ruled", "n", f"explode(concat({', '.join(combos)})) AS s").select("ruled", "n", F.col("s.c").alias("antecedent"))
    counts = each.groupBy("antecedent", "ruled").agg(F.sum("n").alias("n"))
    both = counts.groupBy("antecedent").agg(F.sum("n").alias("all"), F.collect_list(F.struct("ruled", "n")).alias("by"))  # one for each verdict
    rules = both.select("antecedent", "all", F.explode("by").alias("b")).where(F.col("b.n") >= least)
    return rules.select("antecedent", F.col("b.ruled").alias("learned"), (F.col("b.n") / F.col("all")).alias("confidence"), (F.col("b.n") / F.lit(total)).alias("support")).where(F.col("confidence") >= min_confidence)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """antecedent (sorted, at most ``max_tokens``), learned (verdict), confidence, support from rows (tokens, ruled).

    The result is bounded by the support, not by the rows: at most (tokens of a url over) / min_support
    tokens are frequent, and rules are combinations of ``max_tokens`` of them."""
    labelled = labelled.select("tokens", "ruled")
    total = labelled.count()
    least = max(1, math.ceil(min_support * total))
    known, sets = _reduced(labelled, least)
    widest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    rules = _grown(labelled, sets, min_support, min_confidence, max_tokens) if widest <= WIDE else _counted(sets, total, least, min_confidence, max_tokens)
    rules = saved(rules, "rules")
    # A rule goes if dropping one token leaves a rule that is as confident; what is left are the short ones.
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("learned").alias("l"), F.round("confidence", 9).alias("c"))
    parts = rules.select("*", F.posexplode("antecedent").alias("i", "_t")).withColumn("part", F.expr("filter(antecedent, (x, k) -> k <> i)"))
    worse = parts.join(shorter, (parts.part == shorter.part) & (parts.learned == F.col("l")) & (F.col("c") >= F.round("confidence", 9))).select("antecedent", "learned").distinct()
    rules = rules.join(worse, ["antecedent", "learned"], "left_anti")
    # Twins get the rules of the token that stood for them.
    for k in range(max_tokens):
        twins = known.select(F.col("twin").alias(f"twin{k}"), F.col("token").alias(f"t{k}"))
        rules = rules.join(twins, F.get("antecedent", F.lit(k)) == twins[f"twin{k}"], "left")
    names = [F.col(f"t{k}") for k in range(max_tokens)]
    rules = rules.select(F.array_sort(F.array_compact(F.array(*names))).alias("antecedent"), "learned", "confidence", "support")
    sure = known.where("verdict IS NOT NULL").select(F.array("token").alias("antecedent"), F.col("verdict").alias("learned"), F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(max(total, 1))).alias("support"))
    rules = rules.unionByName(sure)
    return rules.select("antecedent", "learned", F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))


def best_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, learned, confidence, learned_from: the best mined rule that fits each distinct set of ``sets`` (tokens).

    The most confident one; then the best supported, the longest, and the last by verdict and tokens."""
    index = rules.withColumn("token", F.col("antecedent")[F.size("antecedent") - 1])
    hits = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("antecedent").alias("n"), F.col("learned"), F.col("antecedent"))
    return hits.groupBy("tokens").agg(F.max(order).alias("b")).select("tokens", "b.learned", "b.confidence", F.col("b.antecedent").alias("learned_from"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, learned_from (tokens of the combination that judged, else null), confidence."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    matched = saved(match_rules(slim, rules).withColumn("tokens", tokens()).drop("url"), "urls")
    labelled = matched.where("ruled IS NOT NULL")
    best = matched.where("false").selectExpr("tokens", "ruled AS learned", "0D AS confidence", "tokens AS learned_from")
    if not labelled.isEmpty():
        # Stored before it is joined: adaptive execution splits a hot token set only between two plain exchanges.
        best = saved(best_rules(matched.where("ruled IS NULL"), mine(labelled, min_support, min_confidence)), "best")
    judged = matched.where("ruled IS NULL").join(best, "tokens", "left")
    by_rule = labelled.select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("array<string>").alias("learned_from"), F.lit(None).cast("double").alias("confidence"))
    return by_rule.unionByName(judged.select("page_id", "host", "path", "rule", F.coalesce("learned", F.lit("allow")).alias("verdict"), "learned_from", "confidence"))


def held_out(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """ruled, learned (null: no rule fits), n: what rules mined from three quarters of the ruled urls say of the others.

    Equal urls are in one part."""
    matched = match_rules(pages.select("page_id", F.col("url").cast("string").alias("url")), rules).where("ruled IS NOT NULL")
    matched = saved(matched.select(tokens().alias("tokens"), "ruled", (F.pmod(F.xxhash64("url"), F.lit(4)) == 0).alias("test")), "ruled")
    best = saved(best_rules(matched.where("test"), mine(matched.where("NOT test"), min_support, min_confidence)), "best")
    return matched.where("test").join(best, "tokens", "left").groupBy("ruled", "learned").agg(F.count("*").alias("n"))
