"""One object over a project's tables: the operators that a caller asks for most, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, graph, lexical, search
from .sources import segments


class Memory:
    """``symbols`` (id, name, path, kind, text) and ``relations`` (source, target, kind) of a project."""

    def __init__(self, symbols: DataFrame, relations: DataFrame):
        self.symbols, self.relations = symbols, relations

    @classmethod
    def open(cls, spark: SparkSession, root: str, back: int = 0) -> Memory:
        """The latest published generation below ``root``, or one before it."""
        tables = [segments.open_segments(spark, f"{root}/{name}", back) for name in ("symbols", "relations")]
        if any(t is None for t in tables):
            raise ValueError("generation_missing")
        return cls(*tables)

    def find(self, term: str, limit: int = 100) -> DataFrame:
        return search.tiered_search(self.symbols, term, ["name"], "id").limit(limit)

    def impact(self, ids: list[str], max_depth: int = 3, max_nodes: int = 1000) -> DataFrame:
        """Symbols that depend on these, with ``complete`` and ``truncation_reasons``."""
        spark = self.symbols.sparkSession
        back = self.relations.select(F.col("target").alias("source"), F.col("source").alias("target"))
        found = graph.closure(spark.createDataFrame([(i,) for i in ids], "id string"), back, max_depth + 1)
        return graph.budgeted(found, back, max_depth, {"nodes": max_nodes})

    def neighbours(self, handle: str, limit: int = 50) -> DataFrame:
        edges = self.relations.select("source", "target", F.lit(0).alias("bytes"))
        return graph.one_hop(edges, handle, "out", {"edges": limit})

    def context(self, task: str, max_bytes: int, candidates: int = 1000) -> DataFrame:
        """The best symbols for a task, in order, up to a byte budget."""
        terms = F.array(*[F.lit(t) for t in dict.fromkeys(task.lower().split())])
        scored = self.symbols.withColumn("score", lexical.lexical_score(terms, F.array_distinct(F.split(F.lower("text"), r"\W+")))).where("score > 0")
        sized = scored.withColumn("bytes", F.octet_length("text"))
        return context.prefix_stop(sized, [F.desc(F.round("score", 9)), F.col("id")], {"bytes": max_bytes}, candidates=candidates)
