"""Maps and JSON documents, cursors, hooks for tokenizers and embeddings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(first: Column, second: Column, drop: list[str] = ()) -> Column:
    """Two maps as one: the second's values win, and dropped keys leave."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_filter(F.map_concat(kept, second), lambda k, _: ~k.isin(list(drop))) if drop else F.map_concat(kept, second)


def canonical(m: Column) -> Column:
    """A map of texts as JSON with sorted keys and no blanks: equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def depth(json: Column) -> Column:
    """How deep brackets nest outside strings."""
    plain = F.regexp_replace(F.regexp_replace(json, r'\\.', ""), r'"[^"]*"', "")
    steps = F.filter(F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(steps, start, step, lambda a: a["most"])


def cursor(*position: Column) -> Column:
    """An opaque place in a result: its order columns in url-safe base64 without padding."""
    text = F.concat_ws("|", *[p.cast("string") for p in position])
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/", "-_"), F.lit("="))


def from_cursor(c: Column) -> Column:
    """The order columns of a cursor, as texts."""
    return F.split(F.decode(F.unbase64(F.translate(c, "-_", "+/")), "utf-8"), r"\|")


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A column function of any tokenizer's count, in Arrow batches; nulls count 0."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return counted


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function of any embedding provider that takes texts by the batch; nulls are embedded as empty texts."""

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed([t or "" for t in texts])])

    return embedded


def reranker(score: Callable[[str, list[str]], list[float]], query: str) -> Callable[[Column], Column]:
    """A column function of any reranker's scores of texts for a query."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(query, [t or "" for t in texts]), dtype="float64")

    return scored


def digest_embedding(text: Column, dimensions: int = 16) -> Column:
    """A vector that depends on the text alone: hex digits of its sha256, scaled to -1 .. 1 (64 dimensions at most)."""
    digits = F.sha2(F.lower(F.trim(text)), 256)
    return F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: (F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("double") - 7.5) / 7.5)
