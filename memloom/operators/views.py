"""Context views: items that are authorised and checked, selected under budgets, and sealed; and the small contracts around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .context import skip_and_continue
from .contracts import escapes, first_reason
from .integrity import group_digest, seal

# What a budget of a one-hop navigation is without settings, and its ceilings.
NAVIGATION_DEFAULTS = {"nodes": 20, "bytes": 8192, "depth": 1}
NAVIGATION_CEILINGS = {"nodes": 4096, "bytes": 1 << 20}

# Representation families and the other names they go by.
REPRESENTATIONS = ("dense_quant", "sqtn", "mixed")
REPRESENTATION_ALIASES = {"dense": "dense_quant", "dense_quantized": "dense_quant", "dense_quantization": "dense_quant", "sqtn_quant": "sqtn"}

# Kinds of mapped symbols that are stored under another kind.
KIND_ALIASES = {
    "method": "function", "constructor": "function", "field": "property", "constant": "property", "variable": "property",
    "module": "namespace", "package": "namespace", "record": "class", "delegate": "function",
}
KINDS = ("class", "function", "async_function", "import", "namespace", "interface", "struct", "trait", "enum", "test", "property", "attribute", "type", "variable", "constant", "module", "method", "field", "unknown")


def named(value: Column, names: dict[str, str]) -> Column:
    """The other name of a value, or the value."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value)


def line_spans(files: DataFrame) -> DataFrame:
    """handle, path, line, start, end of the lines of files (path, content): character offsets, line ends excluded.

    Null content has one empty line.  Files are dealt as rows of lines; nothing is gathered."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("n", "body"))
    before = F.coalesce(F.sum(F.length("body") + 1).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lines.select("path", (F.col("n") + 1).alias("line"), before.alias("start"), F.length("body").alias("size"))
    return at.select(F.concat_ws(":", "path", "line").alias("handle"), "path", "line", "start", (F.col("start") + F.col("size")).alias("end"))


def mapped_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols of a mapper (id, name, kind, file, line, end_line) as a snapshot stores them: an identity of its own,
    slashes forwards, a kind by another name (an unknown one is a function), and no name but the last part of the id."""
    kind = named(F.lower(F.coalesce("kind", F.lit("function"))), KIND_ALIASES)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.substring_index("id", "::", -1))
    return symbols.where("line >= 1 AND end_line >= line").select(
        F.sha2(F.concat(F.lit("mapper:"), "id"), 256).alias("symbol_id"), name.alias("name"), F.when(kind.isin(*KINDS), kind).otherwise("function").alias("kind"),
        F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), "line", "end_line", F.col("id").alias("signature"),
    )


def item_faults(items: DataFrame, allowed: list[str], generation: str) -> DataFrame:
    """Items (handle, kind, path, content, sha256, generation) with the first reason to refuse them; null where they may pass.

    An item that shares its handle with another record is a collision; an equal record isn't."""
    record = seal(F.col("kind"), F.col("path"), F.col("sha256"), F.col("generation"))
    several = items.groupBy("handle").agg((F.min(record) != F.max(record)).alias("_several"))
    below = F.exists(text.strings(allowed), lambda root: (F.col("path") == root) | F.startswith(F.col("path"), F.concat(root, F.lit("/"))))
    reason = first_reason([
        ("path_escape", F.coalesce(escapes(F.col("path")), F.lit(True))), ("root_forbidden", ~below), ("generation_stale", ~F.col("generation").eqNullSafe(F.lit(generation))),
        ("item_tampered", ~F.sha2("content", 256).eqNullSafe(F.col("sha256"))), ("item_handle_collision", F.col("_several")),
    ])
    return items.join(several, "handle").withColumn("reason", reason).drop("_several")


def materialise(items: DataFrame, group: list[str], allowed: list[str], generation: str, budget: int, max_items: int, candidates: int) -> DataFrame:
    """One view a group: items that pass ``item_faults``, each handle once, in order of kind, handle and digest, taken while
    they fit into ``budget`` tokens; with the number of items offered, refused and taken, the tokens used and the view's digest.

    A group from which nothing is taken abstains: zero items and the digest of nothing."""
    judged = item_faults(items, allowed, generation)
    good = judged.where("reason IS NULL").dropDuplicates([*group, "handle"])
    order = [F.col("kind"), F.col("handle"), F.col("sha256")]
    taken = skip_and_continue(good, group, order, "tokens", budget, ["handle", "kind", "sha256"], candidates, max_items)
    digest = group_digest(taken, group, seal(F.col("accepted_rank"), F.col("kind"), F.col("handle"), F.col("sha256")))
    used = taken.groupBy(*group).agg(F.count("*").alias("taken"), F.sum("size").alias("tokens"))
    offered = judged.groupBy(*group).agg(F.count("*").alias("offered"), F.count("reason").alias("refused"))
    views = offered.join(used, group, "left").join(digest, group, "left").na.fill(0, ["taken", "tokens"])
    return views.withColumn("digest", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)))


def view_seal(*fields: Column) -> Column:
    """The digest of a view's fields, each with its length, so that no two lists of fields read the same."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat_ws("", *[F.concat_ws(":", F.octet_length(p), p) for p in parts]), 256)


def view_faults(views: DataFrame, expected: dict[str, Column], fields: list[str]) -> DataFrame:
    """Views (handle, view_hash and fields) with the first reason to refuse them: tampered, a field that isn't the expected one, or a bad handle."""
    checks = [("view_tampered", ~view_seal(*[F.col(f) for f in fields]).eqNullSafe(F.col("view_hash")))]
    checks += [(f"view_{name}_mismatch", ~F.col(name).eqNullSafe(value)) for name, value in expected.items()]
    return views.withColumn("reason", first_reason([*checks, ("view_handle_invalid", ~F.coalesce(F.startswith("handle", F.lit("CTX-")), F.lit(False)))]))


def receipt(hits: DataFrame, files: DataFrame, key: str, path: str, line: str, end: str, max_lines: int, max_bytes: int) -> DataFrame:
    """Hits (key, path, line, end) with the lines of their file (path, content), a byte budget over all hits of a file,
    and what a receipt says of it: bytes, tokens (one at least, even where the text is empty), and a reason where the lines aren't there."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    last = F.least(F.col(end), F.col(line) + max_lines - 1)
    joined = hits.join(files.select(path, lines.alias("_lines")), path, "left")
    out_of_range = F.col("_lines").isNull() | (F.col(line) < 1) | (F.col(line) > F.size("_lines")) | (last < F.col(line))
    reason = F.when(F.col("_lines").isNull(), "file_unknown").when(out_of_range, "lines_out_of_range")
    body = F.when(~out_of_range, F.array_join(F.slice("_lines", F.greatest(F.col(line), F.lit(1)), F.greatest(F.least(last, F.size("_lines")) - F.col(line) + 1, F.lit(0))), "\n"))
    sized = joined.select(key, path, line, reason.alias("reason"), F.octet_length(F.coalesce(body, F.lit(""))).cast("long").alias("bytes"))
    running = F.sum("bytes").over(Window.partitionBy(path).orderBy(line, key).rowsBetween(Window.unboundedPreceding, 0))
    kept = sized.withColumn("cum_bytes", running).where((F.col("cum_bytes") <= max_bytes) | F.col("reason").isNotNull())
    return kept.withColumn("tokens", F.when(F.col("reason").isNull(), F.greatest(F.lit(1), text.estimated_tokens(F.col("bytes")))).otherwise(F.lit(0)))


def navigation_budget(values: Column) -> tuple[dict[str, Column], Column]:
    """Budgets of a map of settings: defaults where unset, ceilings where too large; and whether any is not positive."""
    asked = {k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(v)).cast("long") for k, v in NAVIGATION_DEFAULTS.items()}
    bad = F.exists(F.array(*asked.values()), lambda v: v < 1)
    return {k: F.when(~bad, F.least(v, F.lit(NAVIGATION_CEILINGS[k]))) if k in NAVIGATION_CEILINGS else F.when(~bad, v) for k, v in asked.items()}, F.when(bad, "invalid_budget")


def representation(value: Column) -> Column:
    """The representation family of a name in any spelling; null where there is none."""
    plain = named(F.translate(F.lower(F.trim(value)), "- ", "__"), REPRESENTATION_ALIASES)
    return F.when(plain.isin(*REPRESENTATIONS), plain)


def negotiated(major: Column, minor: Column, offered: tuple[int, int]) -> Column:
    """struct(major, minor) of an interface both sides speak; null for another major number or a negative minor one."""
    ok = (F.coalesce(major, F.lit(offered[0])) == offered[0]) & (F.coalesce(minor, F.lit(0)) >= 0)
    lowest = F.when(F.coalesce(minor, F.lit(0)) == 0, F.lit(offered[1])).otherwise(F.least(minor, F.lit(offered[1])))
    return F.when(ok, F.struct(F.lit(offered[0]).alias("major"), lowest.alias("minor")))


def register_skills(skills: DataFrame, scope: str) -> DataFrame:
    """Skills (name, version, origin, scope, content) with a handle that depends on all of them, and the reason why one is refused."""
    body = F.sha2(F.coalesce("content", F.lit("")), 256)
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    reason = first_reason([("identity_missing", empty("name") | empty("version") | empty("origin")), ("scope_mismatch", ~F.col("scope").eqNullSafe(F.lit(scope))), ("content_missing", F.col("content").isNull())])
    handle = F.concat(F.lit("skill-"), F.substring(seal(F.col("name"), F.col("version"), F.col("origin"), body), 1, 32))
    return skills.withColumns({"content_sha256": body, "reason": reason}).withColumn("handle", F.when(F.col("reason").isNull(), handle))


def lock_faults(members: DataFrame, contracts: DataFrame, required: list[str]) -> DataFrame:
    """kind, key, reason of a locked set of members (name, optional) and contracts (schema, owner, consumers array):
    repeated members and schemas, participants that are no member, and required contracts that are missing."""
    twice = members.where("NOT optional").groupBy("name").count().where("count > 1").select(F.lit("member").alias("kind"), F.col("name").alias("key"), F.lit("duplicate_member_repository").alias("reason"))
    schemas = contracts.groupBy("schema").count().where("count > 1").select(F.lit("contract"), "schema", F.lit("duplicate_contract_schema"))
    parties = contracts.select("schema", F.explode(F.array_union(F.array("owner"), F.coalesce("consumers", F.array().cast("array<string>")))).alias("name"))
    strangers = parties.join(members.select("name").distinct(), "name", "left_anti").select("schema").distinct().select(F.lit("contract"), "schema", F.lit("contract_member_missing"))
    wanted = contracts.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(required)], "schema string")
    missing = wanted.join(contracts.select("schema").distinct(), "schema", "left_anti").select(F.lit("lock"), "schema", F.lit("required_contract_missing"))
    return twice.union(schemas).union(strangers).union(missing)
