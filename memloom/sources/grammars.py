"""Line grammars of TypeScript, Rust and C#: what a line declares, imports or tests.

Patterns are tried in order and the first that fits gives the line's kind and name.  They use what both
Java's and RE2's regular expressions have, so that SQL engines can run them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .code import classify_lines

_TS_MODS = r"(?:export\s+|default\s+|declare\s+|abstract\s+|async\s+)*"
_RS_MODS = r"(?:pub(?:\([a-z:\s]+\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*"
_CS_MODS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|virtual|override|async|new|extern|unsafe)\s+)*"

GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("import", r"^\s*(?:import|export)\b[^'\"]*\bfrom\s+['\"]([^'\"]+)['\"]"),
        ("import", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
        ("namespace", rf"^\s*{_TS_MODS}(?:namespace|module)\s+([\w.$]+)"),
        ("class", rf"^\s*{_TS_MODS}class\s+([\w$]+)"),
        ("interface", rf"^\s*{_TS_MODS}interface\s+([\w$]+)"),
        ("enum", rf"^\s*{_TS_MODS}(?:const\s+)?enum\s+([\w$]+)"),
        ("type", rf"^\s*{_TS_MODS}type\s+([\w$]+)[^=]*="),
        ("function", rf"^\s*{_TS_MODS}function\s*\*?\s*([\w$]+)"),
        ("function", rf"^\s*{_TS_MODS}(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
        ("test", r"^\s*(?:it|test|describe)(?:\.\w+)?\(\s*['\"]([^'\"]+)['\"]"),
    ],
    "rust": [
        ("import", r"^\s*(?:pub(?:\([a-z:\s]+\))?\s+)?use\s+([\w:]+)"),
        ("import", r"^\s*extern\s+crate\s+(\w+)"),
        ("module", rf"^\s*{_RS_MODS}mod\s+(\w+)"),
        ("struct", rf"^\s*{_RS_MODS}(?:struct|union)\s+(\w+)"),
        ("enum", rf"^\s*{_RS_MODS}enum\s+(\w+)"),
        ("trait", rf"^\s*{_RS_MODS}trait\s+(\w+)"),
        ("type", rf"^\s*{_RS_MODS}type\s+(\w+)"),
        ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"),
        ("macro", r"^\s*macro_rules!\s+(\w+)"),
        ("function", rf"^\s*{_RS_MODS}fn\s+(\w+)"),
        ("test", r"^\s*#\[(?:\w+::)?(test)\]"),
    ],
    "csharp": [
        ("import", r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"),
        ("namespace", r"^\s*namespace\s+([\w.]+)"),
        ("record", rf"^\s*{_CS_MODS}record\s+(?:class\s+|struct\s+)?(\w+)"),
        ("class", rf"^\s*{_CS_MODS}class\s+(\w+)"),
        ("struct", rf"^\s*{_CS_MODS}(?:ref\s+)?struct\s+(\w+)"),
        ("interface", rf"^\s*{_CS_MODS}interface\s+(\w+)"),
        ("enum", rf"^\s*{_CS_MODS}enum\s+(\w+)"),
        ("test", r"^\s*\[(Fact|Theory|Test|TestMethod|TestCase)\b"),
        ("method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|new|extern)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>]*>)?\("),
    ],
}


def symbols(files: DataFrame, language: str) -> DataFrame:
    """path, line_no, kind, name of what the lines of files (path, content) declare, import or test."""
    return classify_lines(files, ["path"], "content", GRAMMARS[language])


def payload(files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """One row for each record of a project: record (file, symbol, relation), key, sha256 of its fields.

    files (path, content), symbols (path, line_no, kind, name), relations (origin, destination, kind)."""
    sealed = lambda record, key, *fields: (F.lit(record).alias("record"), key.cast("string").alias("key"), F.sha2(F.concat_ws("|", *fields), 256).alias("sha256"))
    return (
        files.select(*sealed("file", F.col("path"), F.col("path"), F.sha2(F.encode("content", "utf-8"), 256)))
        .unionByName(symbols.select(*sealed("symbol", F.concat_ws("#", "path", "line_no"), F.col("path"), F.col("line_no"), F.col("kind"), F.col("name"))))
        .unionByName(relations.select(*sealed("relation", F.concat_ws(">", "origin", "destination"), F.col("origin"), F.col("destination"), F.col("kind"))))
    )


def projects(files: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Project roots (root, language, files): folders that hold a marker file, with the files below that no deeper root has.

    ``markers``: the name of a marker file (or its ending, with a leading *) and its language."""
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")
    language = F.lit(None).cast("string")
    for marker, tongue in reversed(markers.items()):
        fits = name.endswith(marker[1:]) if marker.startswith("*") else name == marker
        language = F.when(fits, tongue).otherwise(language)
    roots = files.select(folder.alias("root"), language.alias("language")).where("language IS NOT NULL").groupBy("root").agg(F.min("language").alias("language"))
    # Every folder above a file is a candidate: as many rows as the path is deep.
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("root"))
    owner = above.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return owner.join(roots, "root").groupBy("root", "language").agg(F.count("*").alias("files"))
