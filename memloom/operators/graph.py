"""Graph operators: one-hop navigation, bounded traversal and closures, degrees, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints
from .context import prefix_stop


def navigate(edges: DataFrame, nodes: DataFrame, handle, direction: str, budgets: dict[str, int], candidates: int = 4096, min_confidence: float = 0.0) -> DataFrame:
    """Neighbours of a handle: edges (origin, destination, confidence) joined to nodes (id, name, size), each node once, best first."""
    mine, other = ("origin", "destination") if direction == "out" else ("destination", "origin")
    near = edges.where((F.col(mine) == handle) & (F.col("confidence") >= min_confidence)).groupBy(F.col(other).alias("id")).agg(F.max("confidence").alias("confidence"))
    found = near.join(nodes, "id").withColumn("nodes", F.lit(1))
    return prefix_stop(found, [F.desc("confidence"), F.col("name"), F.col("id")], budgets, candidates=candidates)


def unique_name(names: DataFrame, column: str, key: str) -> DataFrame:
    """name -> key where the name stands for one key only."""
    return names.groupBy(column).agg(F.count_distinct(key).alias("n"), F.min(key).alias(key)).where("n = 1").drop("n")


def resolve(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests (identifier, name) to nodes (id, qualified, name): by id, else by a unique qualified name, else by a unique name."""
    ids = nodes.select(F.col("id").cast("string").alias("identifier"), F.col("id").alias("by_id")).distinct()
    qualified = unique_name(nodes, "qualified", "id").select(F.col("qualified").alias("name"), F.col("id").alias("by_qualified"))
    plain = unique_name(nodes, "name", "id").select("name", F.col("id").alias("by_name"))
    out = requests.join(ids, "identifier", "left").join(qualified, "name", "left").join(plain, "name", "left")
    return out.withColumn("resolved", F.coalesce("by_id", "by_qualified", "by_name"))


def best_hop(edges: DataFrame, key: str, order: list) -> DataFrame:
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


#: A frontier is broadcast up to this many bytes of ids and paths; beyond, it is joined by a shuffle.
BROADCAST_FRONTIER = 16 << 20


def closure(start: DataFrame, edges: DataFrame, max_depth: int, keep_path: bool = False) -> DataFrame:
    """Nodes (id, depth[, path]) reachable from start (id) over edges (source, target), each by its first discovery.

    Breadth first: each round reads the edges, joins them to the frontier and drops what is known.  A frontier is
    measured and broadcast only while it is small, so edges are not shuffled then.  Rounds are bounded by
    ``max_depth``; a checkpoint of each frontier keeps the plan short and lets lost executors go.  A null id is no node."""
    checkpoints(start.sparkSession)

    def measured(df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` stored, and about how many bytes a copy of it takes."""
        df = df.checkpoint()
        size = F.octet_length(F.col("id").cast("string")) + 64
        return df, df.agg(F.coalesce(F.sum(size * (F.size("path") + 1) if keep_path else size), F.lit(0))).first()[0]

    def small(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= BROADCAST_FRONTIER else df

    path = [F.array("id").alias("path")] if keep_path else []
    frontier, size = measured(start.where("id IS NOT NULL").select("id").distinct().select("id", F.lit(0).alias("depth"), *path))
    seen, known = frontier, size
    for depth in range(1, max_depth + 1):
        if not size:
            break
        step = edges.where("target IS NOT NULL").select("source", "target").join(small(frontier.withColumnRenamed("id", "source"), size), "source")
        way = step.select(F.col("target").alias("id"), *([F.concat("path", F.array("target")).alias("path")] if keep_path else []))
        first = way.groupBy("id").agg(F.min("path").alias("path")) if keep_path else way.distinct()
        frontier, size = measured(first.join(small(seen.select("id"), known), "id", "left_anti").select("id", F.lit(depth).alias("depth"), *(["path"] if keep_path else [])))
        if size:
            seen, known = seen.unionByName(frontier), known + size
    return seen


def budgeted(found: DataFrame, edges: DataFrame, max_depth: int, budgets: dict[str, int]) -> DataFrame:
    """What ``closure`` found to ``max_depth`` + 1 (id, depth, and the budget columns ``bytes``, ``edges`` ... if any) under budgets.

    Nodes are taken by (depth, id) until one would overflow; ``nodes`` counts them.  Every row tells ``complete`` and
    the ``truncation_reasons`` of the whole answer, sorted.  Budgets bound what is kept: a node takes one of ``nodes``."""
    limit = budgets["nodes"] + 1
    inside = found.where(F.col("depth") <= max_depth).withColumn("nodes", F.lit(1))
    top = inside.orderBy("depth", "id").limit(limit)  # bounded by the budget, so one task may order it
    order = Window.orderBy("depth", "id")
    over = [F.when(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) > n, F.lit(f"max_{c}")) for c, n in sorted(budgets.items())]
    judged = top.withColumn("_over", F.array_compact(F.array(*over)))
    deeper = found.where(F.col("depth") > max_depth).limit(1).agg(F.count("*").alias("_deeper"))
    reasons = judged.agg(F.array_distinct(F.flatten(F.collect_list("_over"))).alias("_all")).crossJoin(F.broadcast(deeper))  # one row each
    reasons = reasons.select(F.array_sort(F.concat("_all", F.when(F.col("_deeper") > 0, F.array(F.lit("max_depth"))).otherwise(F.array().cast("array<string>")))).alias("truncation_reasons"))
    kept = judged.where(F.size("_over") == 0).drop("_over", "nodes")
    return kept.crossJoin(F.broadcast(reasons)).withColumn("complete", F.size("truncation_reasons") == 0)


def invalidation(start: DataFrame, edges: DataFrame, files: DataFrame, max_symbols: int, max_files: int, max_depth: int = 32) -> DataFrame:
    """Symbols (id, file, complete, truncation_reasons) that depend on the start, up to both budgets: nearest first, then by id."""
    found = closure(start, edges, max_depth + 1).join(files, "id")
    first = Window.partitionBy("file").orderBy("depth", "id")
    counted = found.withColumn("files", (F.row_number().over(first) == 1).cast("int"))
    return budgeted(counted, edges, max_depth, {"nodes": max_symbols, "files": max_files}).drop("files")


def incident_dropped(edges: DataFrame, gone: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Edges without those at a removed node (id)."""
    a, b = ends
    kept = edges.join(gone.select(F.col("id").alias("_a")), F.col(a) == F.col("_a"), "left_anti")
    return kept.join(gone.select(F.col("id").alias("_b")), F.col(b) == F.col("_b"), "left_anti")


def apply_delta(edges: DataFrame, gone: DataFrame, added: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Edges without those at removed nodes (id), and with the added ones; an added edge at a removed node is not taken."""
    return incident_dropped(edges.unionByName(added.select(*edges.columns)).distinct(), gone, ends)


def one_hop(edges: DataFrame, handle, direction: str, budgets: dict[str, int]) -> DataFrame:
    """Neighbours (id, bytes) of a handle over edges (source, target, bytes) under budgets, by id, with ``complete`` and ``truncation_reasons``."""
    mine, other = ("source", "target") if direction == "out" else ("target", "source")
    near = edges.where(F.col(mine) == handle).groupBy(F.col(other).alias("id")).agg(F.max("bytes").alias("bytes"))
    found = near.select("id", F.lit(1).alias("depth"), "bytes", F.lit(1).alias("edges"))
    return budgeted(found, edges, 1, {"nodes": budgets["edges"], **budgets}).withColumn("truncation_reasons", F.array_remove("truncation_reasons", "max_nodes")).select("id", "bytes", "complete", "truncation_reasons")


def by_repository(found: DataFrame, repository: Column) -> DataFrame:
    """How many symbols a closure (id, depth) reaches in each repository, and how near the nearest is."""
    return found.groupBy(repository.alias("repository")).agg(F.count("*").alias("symbols"), F.min("depth").alias("depth"))


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    out = edges.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col(target).alias("node")).agg(F.count("*").alias("in_degree"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    return both.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def causal_gaps(df: DataFrame, group: list[str], sequence: str) -> DataFrame:
    """Rows whose predecessor in the group isn't there."""
    previous = df.select(*group, (F.col(sequence) + 1).alias(sequence)).distinct()
    return df.where(F.col(sequence) > 0).join(previous, [*group, sequence], "left_anti")


def affected(changed: DataFrame, tests: DataFrame, handle: str, name: str, limit: int) -> DataFrame:
    """Distinct names of tests (name, handles array) that depend on a changed handle, sorted, with the cause."""
    hit = tests.select(name, F.explode("handles").alias(handle)).join(changed.select(handle).distinct(), handle, "left_semi")
    return hit.groupBy(name).agg(F.min(handle).alias("cause")).orderBy(name).limit(limit)
