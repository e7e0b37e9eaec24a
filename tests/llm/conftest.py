import pytest
from pyspark.sql import functions as F

from memloom.llm import tokens

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def path():
    pytest.importorskip("public_tokenizers")
    return tokens.default_path()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and clashing columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "long words here " * 30000), (None, "no id at all"), (None, None), (7, "é x " * 40), (8, "\n" * 50), (8, "another text under the same id")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "key", "n", "place", "tags", "rep", "spans", "matches", "score", "kept", "_n", "task", "part"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
