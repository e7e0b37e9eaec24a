"""Symbols, relations, payloads and projects of source files.  The files are written by one expression that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import code, grammars
from .registry import Tables, query


def _content(*lines: str) -> str:
    """SQL of a file of lines; {a} and {b} stand for columns, ~ for a double quote."""
    parts = []
    for line in lines:
        for piece in line.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if piece in ("{a}", "{b}"):
                parts.append({"{a}": "p_partkey", "{b}": "p_size"}[piece])
            elif piece:
                parts += [x for k, s in enumerate(piece.split("~")) for x in (["chr(34)"] if k else []) + ([f"'{s}'"] if s else [])]
        parts.append("chr(10)")
    return f"concat({', '.join(parts[:-1])})"


SOURCES = {
    "typescript": _content("import < A > from ~./m{b}~;", "import ~side/{a}~", "export namespace N{b} <", "export abstract class C{a} <", "  export const f{b} = async (x) => x", "enum E{a} < A >", "plain text of no kind", "type T{b} = string", "  export function g{a}(v: number): void <", "describe(~suite {b}~, run)", "interface I{a} <"),
    "rust": _content("use crate::m{b}::Account;", "pub(crate) mod models{a} <", "    pub struct S{a}", "pub enum E{b} <", "unsafe trait T{a} <", "impl<K> Show for S{a} <", "    pub async fn f{b}(x: u8) <", "let x = {b};", "    #[test]", "macro_rules! m{a} <", "type Alias{b} = u8;"),
    "csharp": _content("using System.Text{b};", "using static M{a}.Helper;", "namespace Golden.N{b};", "public sealed record R{a}(string Id);", "public static partial class C{a}", "    public async Task<int> Run{b}(string s)", "    [Fact]", "internal readonly struct S{b}", "return {a};", "public interface IShow{a}", "enum E{b}"),
}


def _files(t: Tables, language: str) -> DataFrame:
    return t.part.select(F.concat(F.lit("src/"), "p_partkey").alias("path"), F.expr(SOURCES[language]).alias("content"))


def _sql(language: str) -> str:
    rules = [(kind, pattern.replace("'", "''")) for kind, pattern in grammars.GRAMMARS[language]]
    kind = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in rules)
    name = " ".join(f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 1)" for _, p in rules)
    return f"""
WITH f AS (SELECT concat('src/', p_partkey) AS path, string_split({SOURCES[language]}, chr(10)) AS lines FROM part), l AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM f)
SELECT path, line_no, CASE {kind} END AS kind, CASE {name} END AS name FROM l WHERE CASE {kind} END IS NOT NULL"""


@query(_sql("typescript"))
def s3_typescript(t: Tables) -> DataFrame:
    return grammars.symbols(_files(t, "typescript"), "typescript")


@query(_sql("rust"))
def s3_rust(t: Tables) -> DataFrame:
    return grammars.symbols(_files(t, "rust"), "rust")


@query(_sql("csharp"))
def s3_csharp(t: Tables) -> DataFrame:
    return grammars.symbols(_files(t, "csharp"), "csharp")


PYTHON = _content("import os", "class C{a}:", "    async def m{b}(self):", "        return helper({a})", "def test_{b}(): pass")


def _python(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.expr(PYTHON).alias("content"))


@query("""
WITH p AS (SELECT concat('p', p_partkey, '.py') AS file, concat('C', p_partkey) AS c, concat('m', p_size) AS m, concat('test_', p_size) AS t FROM part)
SELECT file, c AS name, c AS qualified_name, 'class' AS kind, 2 AS line, 4 AS end_line FROM p UNION ALL SELECT file, m, concat(c, '.', m), 'async_function', 3, 4 FROM p UNION ALL SELECT file, t, t, 'function', 5, 5 FROM p""")
def s2_python_symbols(t: Tables) -> DataFrame:
    return code.python_symbols(_python(t))


@query("""
WITH p AS (SELECT concat('p', p_partkey, '.py') AS file, concat('C', p_partkey) AS c, concat('C', p_partkey, '.m', p_size) AS m, concat('test_', p_size) AS t FROM part)
SELECT file, file AS origin, 'os' AS destination, 'import' AS kind, 1.0::DOUBLE AS confidence, 1 AS line FROM p UNION ALL SELECT file, file, c, 'definition', 1.0, 2 FROM p UNION ALL SELECT file, c, m, 'definition', 1.0, 3 FROM p
UNION ALL SELECT file, m, 'helper', 'call', 0.8, 4 FROM p UNION ALL SELECT file, m, 'helper', 'reference', 0.5, 4 FROM p UNION ALL SELECT file, file, t, 'definition', 1.0, 5 FROM p UNION ALL SELECT file, file, t, 'test', 0.9, 5 FROM p""")
def s4_python_edges(t: Tables) -> DataFrame:
    return code.python_edges(_python(t))


@query(f"""
WITH s AS ({_sql("rust")}), r AS (SELECT path AS origin, name AS destination, 'import' AS kind FROM s WHERE kind = 'import')
SELECT 'file' AS record, concat('src/', p_partkey) AS key, sha256(concat('src/', p_partkey, '|', sha256({SOURCES["rust"]}))) AS sha256 FROM part
UNION ALL SELECT 'symbol', concat(path, '#', line_no), sha256(concat(path, '|', line_no, '|', kind, '|', name)) FROM s UNION ALL SELECT 'relation', concat(origin, '>', destination), sha256(concat(origin, '|', destination, '|', kind)) FROM r""")
def s6_build_payload(t: Tables) -> DataFrame:
    files = _files(t, "rust")
    found = grammars.symbols(files, "rust")
    relations = found.where("kind = 'import'").select(F.col("path").alias("origin"), F.col("name").alias("destination"), "kind")
    return grammars.payload(files, found, relations)


TREE_PATH = "concat('ws', p_size % 5, CASE WHEN p_partkey % 3 = 0 THEN '/sub' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN '/deep' ELSE '' END, '/', CASE WHEN p_partkey % 20 = 0 THEN 'Cargo.toml' WHEN p_partkey % 33 = 0 THEN concat('p', p_partkey, '.csproj') ELSE concat('f', p_partkey) END)"


@query(f"""
WITH f AS (SELECT DISTINCT {TREE_PATH} AS path, p_partkey FROM part), m AS (SELECT left(path, strlen(path) - strlen(regexp_extract(path, '[^/]*$')) - 1) AS root, CASE WHEN ends_with(path, '/Cargo.toml') THEN 'rust' WHEN ends_with(path, '.csproj') THEN 'csharp' END AS language FROM f),
r AS (SELECT root, min(language) AS language FROM m WHERE language IS NOT NULL GROUP BY 1), o AS (SELECT path, arg_max(root, strlen(root)) AS root FROM (SELECT DISTINCT path FROM f) JOIN r ON starts_with(path, root || '/') GROUP BY path)
SELECT root, language, count(*) AS files FROM o JOIN r USING (root) GROUP BY 1, 2""")
def s11_projects(t: Tables) -> DataFrame:
    return grammars.projects(t.part.select(F.expr(TREE_PATH).alias("path")).distinct(), {"Cargo.toml": "rust", "*.csproj": "csharp"})
