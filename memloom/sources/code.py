"""Extraction of symbols and relations from source text."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# What a project scan leaves out, what it reads, and how sure a relation is.
IGNORED_DIRECTORIES = (".git", ".hg", ".venv", "__pycache__", "node_modules", "target")
SUFFIX_LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".cs": "csharp"}
CONFIDENCE = {"import": 1.0, "definition": 1.0, "test": 0.9, "call": 0.8, "reference": 0.5}
LEXICAL_CONFIDENCE = {"definition": 0.75, "test": 0.6, "import": 0.5}
RELATION_ALIASES = {"calls": "call", "imports": "import", "defined_in": "definition", "member_of": "reference"}

SYMBOLS = "file string, name string, qualified_name string, kind string, line int, end_line int"
EDGES = "file string, origin string, destination string, kind string, confidence double, line int"


def source_files(df: DataFrame, path: str, content: str, suffixes=tuple(SUFFIX_LANGUAGES), ignored=IGNORED_DIRECTORIES) -> DataFrame:
    """path, size (bytes) and sha256 of the files with a known suffix outside ignored directories."""
    low = F.lower(path)
    known = F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: low.endswith(s))
    parts = F.split(path, "/")
    hidden = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ignored]))
    return df.where(known & ~hidden).select(F.col(path).alias("path"), F.octet_length(content).alias("size"), F.sha2(content, 256).alias("sha256"))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, name in SUFFIX_LANGUAGES.items():
        out = F.when(F.lower(path).endswith(suffix), name).otherwise(out)
    return out


def support(lang: Column) -> Column:
    return F.when(lang == "python", "available").when(lang.isin("typescript", "rust", "csharp"), "fallback").otherwise("unavailable")


def capabilities(spark: SparkSession) -> DataFrame:
    """suffix, language, support, and the kinds of relations with how sure a lexical reading of them is (null where there is none)."""
    kinds = F.create_map(*[F.lit(x) for kind in CONFIDENCE for x in (kind, LEXICAL_CONFIDENCE.get(kind))])
    return spark.createDataFrame(list(SUFFIX_LANGUAGES.items()), "suffix string, language string").select("suffix", "language", support(F.col("language")).alias("support"), kinds.alias("relations"))


def classify_lines(df: DataFrame, key: list[str], content: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """key, line_no, kind, name: the first pattern (kind, regex with one group) that a line matches."""
    lines = df.select(*key, F.posexplode(text.lines(F.col(content))).alias("_n", "line"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(patterns):
        hit = F.regexp_like("line", F.lit(pattern))
        kind, name = F.when(hit, F.lit(k)).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(name)
    return lines.select(*key, (F.col("_n") + 1).alias("line_no"), kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL")


def lexical_relations(symbols: DataFrame, file: str, name: str, kind: str) -> DataFrame:
    """file, origin, destination, kind, confidence from classified symbols: imports, definitions, and tests by name."""
    s = symbols.select(F.col(file).alias("file"), F.col(name).alias("name"), F.col(kind).alias("_kind"))
    c = LEXICAL_CONFIDENCE
    low = F.lower("name")
    edges = F.array(
        F.when(F.col("_kind") == "import", F.struct(F.col("file").alias("origin"), F.trim("name").alias("destination"), F.lit("import").alias("kind"), F.lit(c["import"]).alias("confidence"))),
        F.when(F.col("_kind") != "import", F.struct(F.col("name").alias("origin"), F.col("name").alias("destination"), F.lit("definition").alias("kind"), F.lit(c["definition"]).alias("confidence"))),
        F.when((F.col("_kind") != "import") & (low.startswith("test") | low.startswith("spec")), F.struct(F.col("file").alias("origin"), F.col("name").alias("destination"), F.lit("test").alias("kind"), F.lit(c["test"]).alias("confidence"))),
    )
    return s.select("file", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("file", "e.*")


def translate_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (source, target, relation) over nodes (id): translated ones, and skipped ones with a reason."""
    kind = F.create_map(*[F.lit(x) for pair in RELATION_ALIASES.items() for x in pair])[F.col("relation")]
    single = nodes.groupBy("id").agg(F.count("*").alias("n"))
    a, b = single.select(F.col("id").alias("_a"), F.col("n").alias("_na")), single.select(F.col("id").alias("_b"), F.col("n").alias("_nb"))
    j = edges.withColumn("kind", kind).join(a, F.col("source") == F.col("_a"), "left").join(b, F.col("target") == F.col("_b"), "left")
    reason = F.when(F.col("kind").isNull(), "relation_unsupported").when(F.col("_a").isNull() | F.col("_b").isNull(), "endpoint_unresolved").when((F.col("_na") > 1) | (F.col("_nb") > 1), "node_id_duplicate")
    j = j.withColumn("reason", reason)
    return j.where("reason IS NULL").select("source", "target", "kind"), j.where("reason IS NOT NULL").select("source", "target", "relation", "reason")


class _Visitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.scope: list[str] = []
        self.symbols: list[tuple[str, str, str, int, int]] = []
        self.edges: list[tuple[str, str, str, int]] = []

    def _owner(self) -> str:
        return ".".join(self.scope)

    def _define(self, node: ast.AST, kind: str) -> None:
        qualified = ".".join([*self.scope, node.name])
        self.symbols.append((node.name, qualified, kind, node.lineno, node.end_lineno or node.lineno))
        self.edges.append((self._owner(), qualified, "definition", node.lineno))
        if node.name.lower().startswith("test"):
            self.edges.append((self._owner(), qualified, "test", node.lineno))
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self._define(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        self._define(node, "function")

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:  # noqa: N802
        self._define(node, "async_function")

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        self.edges += [(self._owner(), a.name, "import", node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        self.edges += [(self._owner(), ".".join(x for x in (node.module, a.name) if x), "import", node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        target = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if target:
            self.edges.append((self._owner(), target, "call", node.lineno))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self.edges.append((self._owner(), node.id, "reference", node.lineno))


def _parse(content: str | None) -> _Visitor:
    v = _Visitor()
    try:
        v.visit(ast.parse(content or ""))
    except (SyntaxError, ValueError, RecursionError):  # a file that doesn't parse has no symbols
        return _Visitor()
    return v


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *s) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for s in _parse(c).symbols]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 4 else pa.int32()) for i, c in enumerate(cols)], names=["file", "name", "qualified_name", "kind", "line", "end_line"])

    return files.select("path", "content").mapInArrow(run, SYMBOLS)


def python_edges(files: DataFrame) -> DataFrame:
    """Relations of Python files (path, content); the file is the origin at module level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, o or p, d, k, CONFIDENCE[k], n) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for o, d, k, n in _parse(c).edges]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "origin", "destination", "kind", "confidence", "line"])

    return files.select("path", "content").mapInArrow(run, EDGES)
