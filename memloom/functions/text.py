"""Scalar text functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a task, and those that are noise in an index.
STOP_WORDS = (
    "a", "an", "and", "as", "at", "build", "change", "create", "do", "for", "from", "implement", "in", "into", "of", "on",
    "or", "the", "to", "update", "with", "criar", "de", "da", "e", "em", "implementar", "o", "os", "para", "por", "um", "uma",
)
STRUCTURAL_NOISE = (*STOP_WORDS, "against", "benchmark", "check", "compare", "ensure", "measure", "reference", "run", "through", "validate")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def identifier_terms(x: Column) -> Column:
    """Words of identifiers, camel case split, lower-cased, in order, with repeats."""
    parts = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(parts, F.lit("([A-Za-z][A-Za-z0-9]*)")), F.lower)


def task_terms(x: Column) -> Column:
    """Distinct words of three letters or more, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(x), F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"))
    return F.array_except(F.array_distinct(found), strings(STOP_WORDS))


def index_terms(x: Column) -> Column:
    terms = F.filter(F.array_distinct(identifier_terms(x)), lambda t: F.length(t) >= 2)
    return F.array_except(terms, strings(STRUCTURAL_NOISE))


def lexical_tokens(x: Column) -> Column:
    """Distinct tokens: underscores, camel case, acronyms and digits separate them."""
    found = F.regexp_extract_all(x, F.lit("([A-Z]+(?=[A-Z][a-z]|[^A-Za-z]|$)|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"))
    return F.array_distinct(F.transform(F.array_distinct(found), F.lower))


def knowledge_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9][a-z0-9_-]*)")))


def lines(x: Column) -> Column:
    """Lines by any of the line ends \\n, \\r\\n and \\r."""
    return F.split(F.coalesce(x, F.lit("")), "\r\n|\n|\r", -1)


# What counts as a secret in a context, the same for all who read it.
ASSIGNMENT = r"(?i)\b(api[_-]?key|access[_-]?token|token|secret|password)\b(\s*[:=]\s*)([^\s,;]+)"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"


def redact(x: Column) -> tuple[Column, Column]:
    """The text with secrets replaced, and whether there were any."""
    once = F.regexp_replace(x, ASSIGNMENT, "$1$2<redacted>")
    return F.regexp_replace(once, BEARER, "Bearer <redacted>"), F.regexp_like(x, F.lit(ASSIGNMENT)) | F.regexp_like(once, F.lit(BEARER))


def _utf8_prefix(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode()[: max(0, int(n))].decode("utf-8", "ignore") for t, n in zip(text, limit, strict=True)])


def utf8_prefix(x: Column, limit: Column) -> Column:
    """At most ``limit`` bytes of the text, cut at a character boundary; built-in functions cannot say it."""
    return F.pandas_udf(_utf8_prefix, "string")(x, limit)


def estimated_tokens(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4).cast("long")


def url_safe(x: Column) -> Column:
    return F.translate(F.base64(x), "+/", "-_")


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns, kept apart by NUL; NULL counts as an empty string."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
