"""Contracts: validation of payloads, handoffs and manifests, sealed envelopes, and caches as tables of requests."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check whose condition holds; null where none does.  A condition that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(checks):
        out = F.when(condition, name).otherwise(out)
    return out


def payload_faults(files: DataFrame, symbols: DataFrame, max_symbols: int, max_bytes: int) -> DataFrame:
    """record, key, reason for files (path, content, sha256) and symbols (path, name, line, end_line) that break the contract."""
    size = F.octet_length("content")
    again = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("again"))
    f = files.join(again, files.path == again.again, "left")
    bad_files = f.select(F.lit("file").alias("record"), F.col("path").alias("key"), first_reason([
        ("path_missing", F.col("path").isNull() | (F.col("path") == "")), ("path_escapes", escapes(F.col("path"))), ("path_repeated", F.col("again").isNotNull()),
        ("content_too_large", size > max_bytes), ("digest_mismatch", ~F.sha2("content", 256).eqNullSafe(F.col("sha256"))),
    ]).alias("reason"))
    known = files.select(F.col("path").alias("file")).distinct()
    many = symbols.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > max_symbols).select(F.col("path").alias("many"))
    s = symbols.join(known, symbols.path == known.file, "left").join(many, symbols.path == many.many, "left")
    bad_symbols = s.select(F.lit("symbol").alias("record"), F.concat_ws("#", "path", "line", "name").alias("key"), first_reason([
        ("file_unknown", F.col("file").isNull()), ("name_missing", F.col("name").isNull() | (F.col("name") == "")),
        ("lines_inverted", (F.col("line") < 1) | (F.col("end_line") < F.col("line"))), ("too_many_symbols", F.col("many").isNotNull()),
    ]).alias("reason"))
    return bad_files.unionByName(bad_symbols).where("reason IS NOT NULL")


def escapes(path: Column) -> Column:
    """Absolute paths, drive letters, and paths with a step upwards."""
    return path.startswith("/") | path.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def handoff_faults(envelopes: DataFrame, head: str, schema: str) -> DataFrame:
    """Envelopes (id, schema, head, path, content, sha256) with the first reason to refuse them; null where they may pass."""
    return envelopes.withColumn("reason", first_reason([
        ("schema_unsupported", ~F.col("schema").eqNullSafe(F.lit(schema))), ("head_mismatch", ~F.col("head").eqNullSafe(F.lit(head))), ("path_escapes", escapes(F.col("path"))),
        ("digest_malformed", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("digest_mismatch", F.sha2("content", 256) != F.col("sha256")),
    ]))


def manifest_faults(manifests: DataFrame, metrics: list[str], lanes: list[int]) -> DataFrame:
    """Vector index manifests (id, dimensions, metric, bits, rows, generation) with the first reason to refuse them."""
    return manifests.withColumn("reason", first_reason([
        ("dimensions_invalid", ~F.coalesce(F.col("dimensions").between(1, 65536), F.lit(False))), ("metric_unknown", ~F.coalesce(F.col("metric").isin(metrics), F.lit(False))),
        ("lane_unknown", ~F.coalesce(F.col("bits").isin(lanes), F.lit(False))), ("empty", F.coalesce(F.col("rows"), F.lit(0)) < 1), ("generation_missing", F.col("generation").isNull()),
    ]))


def envelope(df: DataFrame, domain: str, key: Column, fields: list[str], generation: Column) -> DataFrame:
    """domain, handle, generation, payload (a map of the fields as text, in order), digest: sha256 over all of them."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(fields)]
    body = F.concat_ws("|", *[F.concat(F.lit(c + "="), v) for c, v in zip(sorted(fields), values, strict=True)])
    handle = F.concat(F.lit(domain + ":"), key.cast("string"))
    payload = F.map_from_arrays(F.array(*[F.lit(c) for c in sorted(fields)]), F.array(*values))
    return df.select(F.lit(domain).alias("domain"), handle.alias("handle"), generation.alias("generation"), payload.alias("payload"), F.sha2(F.concat_ws("|", handle, generation.cast("string"), body), 256).alias("digest"))


def current_generation(generation: str, active: int) -> Column:
    """Valid where generations are equal; a null one never is."""
    return F.coalesce(F.col(generation) == active, F.lit(False))


def surviving_views(views: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached views (view, paths array) none of whose paths (path) has changed."""
    hit = views.select("view", F.explode("paths").alias("path")).join(changed.select("path").distinct(), "path", "left_semi").select("view").distinct()
    return views.join(hit, "view", "left_anti")


def settings(text: Column, known: list[str]) -> tuple[Column, Column]:
    """``a=1;b=2`` as a map of numbers, and the first fault: unknown_setting, malformed, repeated or negative."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p) != "")
    names = F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(parts, lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    good = lambda p: F.regexp_like(p, F.lit(r"^\s*\w+\s*=\s*-?[0-9]{1,18}\s*$"))
    fault = first_reason([
        ("malformed", ~F.forall(parts, good)), ("unknown_setting", F.size(F.array_except(names, F.array(*[F.lit(k) for k in known]))) > 0),
        ("repeated", F.size(F.array_distinct(names)) < F.size(names)), ("negative", F.exists(values, lambda v: v.startswith("-"))),
    ])
    return F.when(fault.isNull(), F.map_from_arrays(names, F.transform(values, lambda v: v.try_cast("long")))), fault


def index_faults(indexes: DataFrame, generation: int, backend: str) -> DataFrame:
    """Stored vector indexes (id, rows, dimensions, bits, bytes, generation, backend) with the bytes that their codes and a
    4-byte scale for each row take, and the first reason not to read them."""
    wanted = F.col("rows").cast("long") * (F.floor((F.col("dimensions") * F.col("bits") + 7) / 8) + 4)
    return indexes.withColumn("expected_bytes", wanted).withColumn("reason", first_reason([
        ("generation_missing", F.col("generation").isNull()), ("generation_stale", F.col("generation") < generation), ("generation_ahead", F.col("generation") > generation),
        ("backend_mismatch", ~F.col("backend").eqNullSafe(F.lit(backend))), ("size_mismatch", ~F.col("bytes").eqNullSafe(F.col("expected_bytes"))),
    ]))


def capabilities(snapshot: DataFrame, host: str, name: str, usable: Column, aliases: dict[str, list[str]]) -> DataFrame:
    """A row for each host of a snapshot with a boolean for each capability: any of its aliases, in any case, is usable there."""
    spelled = F.lower(F.trim(F.col(name)))
    flags = [F.coalesce(F.bool_or(spelled.isin([a.lower() for a in (capability, *others)]) & usable), F.lit(False)).alias(capability) for capability, others in aliases.items()]
    return snapshot.groupBy(host).agg(*flags)


def fenced(claims: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Claims (key, fence) against what is held (key, fence): accepted, fence_conflict or fence_stale.

    A claim must name a fence above the held one; of claims with the same fence on one key none is accepted."""
    several = claims.groupBy(key, "fence").agg(F.count("*").alias("_claims"))
    now = held.groupBy(F.col(key).alias("_key")).agg(F.max("fence").alias("_held"))
    judged = several.join(now, F.col(key).eqNullSafe(F.col("_key")), "left")
    outcome = F.when(F.col("fence").isNull() | (F.col("fence") <= F.col("_held")), "fence_stale").when(F.col("_claims") > 1, "fence_conflict").otherwise("accepted")
    return judged.select(key, "fence", F.col("_claims").alias("claims"), outcome.alias("outcome"))


def unleased(rows: DataFrame, leases: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows that no lease (key, expires, released) pins at a time; a lease without an end pins until it is released."""
    live = leases.where(~F.coalesce(F.col("released"), F.lit(False)) & (F.col("expires").isNull() | (F.col("expires") > now)))
    return rows.join(live.select(key).distinct(), key, "left_anti")


# -- caches -------------------------------------------------------------------------------------------


def lru_outcomes(requests: DataFrame, cache: str, order: str, key: str, capacity: int) -> DataFrame:
    """``requests`` with ``outcome`` of a least-recently-used cache of ``capacity`` keys: hit, miss or evicting miss, and ``evicted``.

    A cache's requests are one sorted stream; what is held is its keys, never its requests."""
    dealt = requests.repartition(cache).sortWithinPartitions(cache, order, key)
    at, names = requests.columns.index(cache), requests.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), OrderedDict()
        for batch in batches:
            outcome, evicted = [], []
            for c, k in zip(batch.column(at).to_pylist(), batch.column(names).to_pylist(), strict=True):
                if c != current:
                    current, held = c, OrderedDict()
                gone = None
                if k in held:
                    held.move_to_end(k)
                    outcome.append("hit")
                else:
                    if len(held) >= capacity:
                        gone, _ = held.popitem(last=False)
                    held[k] = True
                    outcome.append("miss" if gone is None else "evicting_miss")
                evicted.append(gone)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcome, pa.string()), pa.array(evicted, batch.column(names).type)], names=[*batch.schema.names, "outcome", "evicted"])

    schema = T.StructType([*requests.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("evicted", requests.schema[key].dataType)])
    return dealt.mapInArrow(run, schema)


def flights(requests: DataFrame, key: str, time: str, duration: int) -> DataFrame:
    """``requests`` with ``flight``, the time of the load that serves them: one that is under way, or one they start.

    ``time`` is a number; a load takes ``duration``."""
    dealt = requests.repartition(key).sortWithinPartitions(key, time)
    at, when = requests.columns.index(key), requests.columns.index(time)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, began = object(), 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(at).to_pylist(), batch.column(when).to_pylist(), strict=True):
                if k != current or t >= began + duration:
                    current, began = k, t
                out.append(began)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "flight"])

    return dealt.mapInArrow(run, T.StructType([*requests.schema.fields, T.StructField("flight", T.LongType())]))


def live_hits(requests: DataFrame, key: str, time: str, ttl: int) -> DataFrame:
    """Requests to a cache whose entries live for ``ttl`` after their last use, with ``hit``."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return requests.withColumn("hit", F.coalesce(F.col(time) - before <= ttl, F.lit(False)))


def decisions(puts: DataFrame, key: list[str], generation: str, result: str) -> DataFrame:
    """What a decision cache holds after all puts: key, generation, result, state (reusable, or quarantined where results contradict)."""
    state = F.when(F.count_distinct(result) > 1, "quarantined").otherwise("reusable")
    return puts.groupBy(*key, generation).agg(F.min(result).alias(result), state.alias("state"))


def decision_lookups(lookups: DataFrame, cache: DataFrame, key: list[str], generation: str, result: str, drifted: DataFrame | None = None) -> DataFrame:
    """``lookups`` (key, generation) with ``outcome`` (hit, miss, stale, quarantined or drifted) and the result of a hit."""
    held = cache.select(*key, F.col(generation).alias("_generation"), F.col(result).alias("_result"), "state")
    exact = lookups.join(held.withColumnRenamed("_generation", generation), [*key, generation], "left")
    any_ = held.select(*key).distinct().withColumn("_known", F.lit(True))
    out = exact.join(any_, key, "left")
    if drifted is not None:
        out = out.join(drifted.select(*key).distinct().withColumn("_drifted", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_drifted", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("state") == "quarantined", "quarantined").when(F.col("_drifted"), "drifted").when(F.col("state") == "reusable", "hit").when(F.col("_known"), "stale").otherwise("miss")
    return out.withColumn("outcome", outcome).withColumn(result, F.when(F.col("outcome") == "hit", F.col("_result"))).drop("_result", "_known", "_drifted", "state")


def reusable_validations(results: DataFrame, key: list[str], result: str) -> DataFrame:
    """key, result, runs of the validations whose runs all agree; others are nondeterministic and never reusable."""
    return results.groupBy(*key).agg(F.min(result).alias(result), F.count("*").alias("runs"), F.count_distinct(result).alias("_n")).where("_n = 1").drop("_n")


def conformance(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """case, check, passed for every case and check, in one pass over the cases."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]))
    return cases.select("case", each.alias("x")).select("case", "x.*")
