from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy as p
from .registry import Tables, query

CANDIDATES = """SELECT p_partkey AS id, p_partkey % 100 / 100.0 AS quality, p_partkey % 9 <> 0 AS available, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 10 END AS resident_bytes, p_size % 7 * 5 AS peak_bytes,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS tokens_per_second, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS hardware FROM part"""


def _candidates(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("id"), (k % 100 / 100).alias("quality"), (k % 9 != 0).alias("available"), F.when(k % 5 == 0, None).otherwise(size * 10).alias("resident_bytes"), (size % 7 * 5).alias("peak_bytes"),
        F.when(k % 4 == 0, None).otherwise(k % 50).alias("tokens_per_second"), F.when(k % 6 == 0, None).otherwise(F.col("p_brand")).alias("hardware"),
    )


OBJECTIVES = {"quality": True, "tokens_per_second": True, "resident_bytes": False, "peak_bytes": False}


def _worse(a: str, b: str) -> str:
    """SQL for: row a dominates row b."""
    known = [f"({a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL)" for c in OBJECTIVES]
    ops = [(">=", ">") if up else ("<=", "<") for up in OBJECTIVES.values()]
    no_worse = " AND ".join(f"({b}.{c} IS NULL OR {a}.{c} IS NULL OR {a}.{c} {o[0]} {b}.{c})" for c, o in zip(OBJECTIVES, ops, strict=True))
    better = " OR ".join(f"coalesce({a}.{c} {o[1]} {b}.{c}, false)" for c, o in zip(OBJECTIVES, ops, strict=True))
    return f"({' OR '.join(known)}) AND {no_worse} AND ({better})"


FRONTIER = f"WITH c AS ({CANDIDATES}) SELECT * FROM c v WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT quality, tokens_per_second, resident_bytes, peak_bytes FROM c) w WHERE {_worse('w', 'v')})"


@query(f"SELECT id FROM ({FRONTIER})")
def i1_frontier(t: Tables) -> DataFrame:
    return p.frontier(_candidates(t), OBJECTIVES).select("id")


REASON = "CASE WHEN quality < 0.3 THEN 'quality_below_threshold' WHEN NOT available THEN 'candidate_unavailable' WHEN resident_bytes IS NULL THEN 'resident_bytes_budget_unknown' WHEN resident_bytes > 300 THEN 'resident_bytes_budget_exceeded' WHEN peak_bytes IS NULL THEN 'peak_bytes_budget_unknown' WHEN peak_bytes > 25 THEN 'peak_bytes_budget_exceeded' WHEN hardware <> 'Brand#7' THEN 'hardware_mismatch' END"


def _reason():
    return p.filter_reason(0.3, {"resident_bytes": 300, "peak_bytes": 25, "bytes_per_token": None}, {"hardware": "Brand#7", "workload": "unknown"})


@query(f"SELECT id, {REASON} AS reason FROM ({CANDIDATES})")
def i2_hard_filters(t: Tables) -> DataFrame:
    return _candidates(t).select("id", _reason().alias("reason"))


WEIGHTS = {"quality": 0.6, "tokens_per_second": 0.3, "resident_bytes": 0.1}
BENEFITS = """SELECT *, CASE WHEN quality IS NULL THEN NULL WHEN max(quality) OVER () = min(quality) OVER () THEN 1 ELSE (quality - min(quality) OVER ()) / (max(quality) OVER () - min(quality) OVER ()) END AS bq,
 CASE WHEN tokens_per_second IS NULL THEN NULL WHEN max(tokens_per_second) OVER () = min(tokens_per_second) OVER () THEN 1 ELSE (tokens_per_second - min(tokens_per_second) OVER ()) / (max(tokens_per_second) OVER () - min(tokens_per_second) OVER ()) END AS bt,
 CASE WHEN resident_bytes IS NULL THEN NULL WHEN max(resident_bytes) OVER () = min(resident_bytes) OVER () THEN 1 ELSE (max(resident_bytes) OVER () - resident_bytes) / (max(resident_bytes) OVER () - min(resident_bytes) OVER ()) END AS br FROM {0}"""
SCORE = "(coalesce(bq, 0) * 0.6 + coalesce(bt, 0) * 0.3 + coalesce(br, 0) * 0.1) / nullif(CASE WHEN bq IS NULL THEN 0 ELSE 0.6 END + CASE WHEN bt IS NULL THEN 0 ELSE 0.3 END + CASE WHEN br IS NULL THEN 0 ELSE 0.1 END, 0)"


@query(f"SELECT id, round({SCORE}, 6) AS score FROM ({BENEFITS.format('(' + CANDIDATES + ')')})")
def i3_profile_score(t: Tables) -> DataFrame:
    scored = p.benefits(_candidates(t), {"quality": True, "tokens_per_second": True, "resident_bytes": False})
    return scored.select("id", F.round(p.profile_score(WEIGHTS), 6).alias("score"))


@query(f"""
WITH e AS (SELECT * FROM ({CANDIDATES}) WHERE ({REASON}) IS NULL), f AS (SELECT * FROM e v WHERE NOT EXISTS (SELECT 1 FROM e w WHERE {_worse('w', 'v')})), b AS ({BENEFITS.format('f')})
SELECT id, round({SCORE}, 6) AS score FROM b ORDER BY round({SCORE}, 9) DESC, quality DESC, id LIMIT 1""")
def i4_decide(t: Tables) -> DataFrame:
    return p.decide(_candidates(t), "id", OBJECTIVES, WEIGHTS, _reason(), [F.desc("quality")]).select("id", F.round("score", 6).alias("score"))


METRICS = "SELECT user_id, 1 + event_id % 3 AS weight, (event_id % 10) / 10.7 AS confidence, least(1, value / 49) AS pressure, event_type <> 'error' AND event_id % 10 > 0 AS usable FROM events"


@query(f"""
WITH a AS (SELECT user_id, sum(weight * confidence * pressure) FILTER (usable) AS x, sum(weight * confidence) FILTER (usable) AS m, coalesce(sum(weight) FILTER (usable), 0) / sum(weight) AS coverage, sum(weight * confidence) FILTER (usable) / sum(weight) FILTER (usable) AS c FROM ({METRICS}) GROUP BY 1)
SELECT user_id, CASE WHEN m > 0 AND coverage >= 0.5 THEN round(100 * x / m, 6) END AS score, round(coverage * coalesce(c, 0), 6) AS confidence, CASE WHEN m IS NULL OR m = 0 THEN 'no_usable_metric' WHEN coverage < 0.5 THEN 'coverage_low' END AS reason FROM a""")
def i5_pressure(t: Tables) -> DataFrame:
    i = F.col("event_id")
    m = t.events.select("user_id", (1 + i % 3).alias("weight"), (i % 10 / F.lit(10.7)).alias("confidence"), F.least(F.lit(1.0), F.col("value") / 49).alias("pressure"), ((F.col("event_type") != "error") & (i % 10 > 0)).alias("usable"))
    return p.pressure(m, ["user_id"])


@query("SELECT s_suppkey, round(s_suppkey % 10 + 35 * (s_suppkey % 7) / 7.0 + 25 * (s_suppkey % 5) / 5.0 + 10 * (s_suppkey % 3) / 3.0, 6) AS score FROM supplier ORDER BY s_suppkey % 10 + 35 * (s_suppkey % 7) / 7.0 + 25 * (s_suppkey % 5) / 5.0 + 10 * (s_suppkey % 3) / 3.0, s_suppkey")
def i6_placement(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k, F.round(p.placement_score(k % 10, k % 7 / 7, k % 5 / 5, k % 3 / 3), 6).alias("score")).orderBy("score", "s_suppkey")


STRATEGIES = "SELECT l_orderkey, l_linenumber AS preference, l_returnflag <> 'R' AS supported, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 0.5 + l_quantity / 20 END AS speedup FROM lineitem"


@query(f"SELECT l_orderkey, preference, round(speedup, 6) AS speedup FROM ({STRATEGIES}) WHERE supported AND coalesce(speedup > 1, true) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY speedup IS NOT NULL DESC, speedup DESC NULLS LAST, preference) = 1")
def i7_best_strategy(t: Tables) -> DataFrame:
    s = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("preference"), (F.col("l_returnflag") != "R").alias("supported"), F.when(F.col("l_linestatus") == "O", None).otherwise(0.5 + F.col("l_quantity") / 20).alias("speedup"))
    return p.best_strategy(s, ["l_orderkey"]).select("l_orderkey", "preference", F.round("speedup", 6).alias("speedup"))


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 0.9 + (event_id % 10) / 50.0 END AS th, 1 + (event_id % 7) / 40.0 AS tt, event_id % 600 AS mb FROM events)
SELECT event_id, CASE WHEN coalesce(th < 0.95, false) OR tt > 1.10 OR mb > 512 THEN 'regressed' WHEN th IS NULL THEN 'held' ELSE 'passed' END AS verdict, greatest(1, least(16, event_id % 20 + (event_id % 3 - 1) * 2)) AS tuned FROM r""")
def i8_guardrail(t: Tables) -> DataFrame:
    i = F.col("event_id")
    th = F.when(i % 6 == 0, None).otherwise(0.9 + i % 10 / 50)
    return t.events.select(i, p.guardrail(th, 1 + i % 7 / 40, i % 600).alias("verdict"), p.tuned(i % 20, i % 3 - 1, 2, 1, 16).alias("tuned"))


@query("SELECT event_type, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a IS NULL) AS unrecorded FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS a, event_id % 2 AS b FROM events) GROUP BY 1")
def i10_replay(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return p.replay(t.events.withColumns({"a": F.when(i % 5 == 0, None).otherwise(i % 3), "b": i % 2}), "a", "b", ["event_type"])


@query("SELECT page_id, greatest(CASE WHEN regexp_matches(url, '/(en|fr)/') THEN 2 ELSE 1 END, CASE WHEN page_id % 4 = 0 THEN 3 WHEN page_id % 4 = 1 THEN NULL ELSE 0 END, 1) AS rank FROM pages")
def i12_route_promotion(t: Tables) -> DataFrame:
    rank = F.when(F.regexp_like("url", F.lit("/(en|fr)/")), 2).otherwise(1)
    previous = F.when(F.col("page_id") % 4 == 0, 3).when(F.col("page_id") % 4 == 1, None).otherwise(0)
    return t.pages.select("page_id", p.promoted(rank, previous).alias("rank"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def i13_latest_tuning(t: Tables) -> DataFrame:
    from ..operators.temporal import latest

    return latest(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT c_custkey, list_filter([CASE WHEN c_nationkey IS DISTINCT FROM s_nationkey THEN 'nation' END, CASE WHEN (c_acctbal > 0) IS DISTINCT FROM (s_acctbal > 0) THEN 'balance' END], lambda x: x IS NOT NULL) AS drift FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def i14_drift(t: Tables) -> DataFrame:
    j = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    fields = {"nation": (F.col("c_nationkey"), F.col("s_nationkey")), "balance": (F.col("c_acctbal") > 0, F.col("s_acctbal") > 0)}
    return j.select("c_custkey", p.drift(fields).alias("drift"))


@query("SELECT event_id, (event_type <> 'error' AND value IS NOT NULL AND event_id % 10 > 0 AND user_id % 2 = 0) AS usable, round(greatest(1 - value / 100, 1 - (event_id % 10) / 10.0), 6) AS pressure FROM events")
def z11_usable(t: Tables) -> DataFrame:
    i = F.col("event_id")
    ok = p.usable(F.col("event_type") != "error", F.col("value"), i % 10, F.col("user_id") % 2 == 0)
    return t.events.select("event_id", ok.alias("usable"), F.round(p.headroom_pressure(F.col("value") / 100, i % 10 / 10), 6).alias("pressure"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity - 1, 0) AS ratio FROM lineitem")
def z13_ratios(t: Tables) -> DataFrame:
    ratio = F.col("l_extendedprice") / F.nullif(F.col("l_quantity") - 1, F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("ratio"))


@query("""
WITH r AS (SELECT user_id, round(least(1, sum(value) / 4000), 4) AS load, count(*) FILTER (event_type = 'error') / count(*) AS errors, count(*) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1),
d AS (SELECT *, CASE WHEN user_id % 13 = 0 THEN 'generation_drift' WHEN errors > 0.25 THEN 'error_rate' WHEN load > 0.4 THEN 'pressure' WHEN user_id % 3 = 0 THEN 'cached' ELSE 'default' END AS reason FROM r),
v AS (SELECT *, CASE reason WHEN 'generation_drift' THEN 'revalidate' WHEN 'error_rate' THEN 'regressed' WHEN 'pressure' THEN 'throttle' WHEN 'cached' THEN 'hold' ELSE 'proceed' END AS decision FROM d)
SELECT user_id, load, decision, reason, sha256(concat(decision, '|', reason, '|', user_id, '|', bought)) AS receipt FROM v""")
def i9_policy_decision(t: Tables) -> DataFrame:
    """Drift, guardrail, pressure and cached verdicts in one sealed decision for each user."""
    load = F.round(F.least(F.lit(1.0), F.sum("value") / 4000), 4)
    r = t.events.groupBy("user_id").agg(load.alias("load"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    guards = [("generation_drift", F.col("user_id") % 13 == 0, "revalidate"), ("error_rate", F.col("errors") > 0.25, "regressed"), ("pressure", F.col("load") > 0.4, "throttle")]
    out = p.policy_decision(r, guards, "proceed", ["user_id", "bought"], F.when(F.col("user_id") % 3 == 0, "hold"))
    return out.select("user_id", "load", "decision", "reason", "receipt")


@query("SELECT l_orderkey, l_linenumber, (l_returnflag <> 'R' AND coalesce(CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity / 25 END > 1, true)) AS usable FROM lineitem")
def z12_strategy_usable(t: Tables) -> DataFrame:
    speedup = F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_quantity") / 25)
    return t.lineitem.select("l_orderkey", "l_linenumber", p.strategy_usable(F.col("l_returnflag") != "R", speedup).alias("usable"))
