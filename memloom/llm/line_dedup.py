"""Line dedup: long lines that many documents hold stay in one of them.

Lines are hashed (128 bits) and range-partitioned by hash and slice, where a slice is a range of
doc_ids: a line held by a third of all documents is spread over many tasks.  A secondary sort by
document (largest first) and position lets one streaming window over the ranges, without another
exchange, meet each line's documents in order and mark the first occurrence in each of them.  The marks
alone say how many documents hold a line and which keeps it: the marks of a line's slices are added,
and the largest marked document is the keeper.  Decisions come back as compressed keep bitmaps:
runs of kept line numbers for each document, never text.

DataFrame functions only.  Defined results: a null or empty text is one empty line; rows with the
same doc_id count as one document but are judged by their own text; a null doc_id is the smallest;
an empty table gives empty results; other columns pass through ``apply``, but for n_lines and n_dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, partitions, saved

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5
_OPEN_END = 2**31 - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fold(x: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def _row(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """``lines`` (h1, h2, doc_id, row, pos) with ``slice`` and ``first``: the first line of its document in the stream.

    Slices grow as doc_ids fall, so the order of (h1, h2, slice) and doc_id is that of (h1, h2) and doc_id.
    Null doc_ids are one document and have a slice of their own, the last."""
    n = partitions(lines.sparkSession)
    low, high = lines.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = max((high or 0) - (low or 0), 1)
    slice_ = F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(((F.lit(float(high or 0)) - F.col("doc_id").cast("double")) / (span / n)).cast("int"))
    order = ["h1", "h2", "slice", F.desc_nulls_last("doc_id"), "row", "pos"]
    ordered = lines.withColumn("slice", slice_).repartitionByRange(n, "h1", "h2", "slice").sortWithinPartitions(*order)
    # The ranges keep (h1, h2, slice) together and their rows in this order: the window neither exchanges nor sorts.
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc_id"), "row", "pos")
    return ordered.withColumn("first", (F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream)))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row, n_dropped, kept: runs (first line number, how many) of kept lines; only of documents that lose a line."""
    long_lines = F.filter(
        F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(BLANKS)).alias("key"))),
        lambda s: F.char_length(s.key) >= min_chars,
    )
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .select("doc_id", _row(F.col("text")).alias("row"), F.explode(long_lines).alias("line"))
        .select("doc_id", "row", "line.pos", fold(F.col("line.key")).alias("key"))
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Stored first: the range partitioner samples its input, and would split all texts twice.
    lines = saved(found, "lines")
    stream = saved(first_occurrences(lines), "stream")
    free(lines)
    # Stored before it is joined: adaptive execution splits a hot key only between two plain exchanges.
    marks = stream.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    repeated = saved(marks.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "repeated")
    lost = stream.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "row", "pos")
    gone = lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    runs = F.zip_with(F.array_prepend("gone", F.lit(-1)), F.array_append("gone", F.lit(_OPEN_END)), lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("count")))
    return gone.select("doc_id", "row", F.size("gone").alias("n_dropped"), F.filter(runs, lambda r: r["count"] > 0).alias("kept"))


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept lines alone in ``text``, and n_lines (before) and n_dropped."""
    b = bitmaps.select("doc_id", "row", "n_dropped", "kept")
    text, d = docs["text"].cast("string"), docs["doc_id"].cast("long")
    joined = docs.join(b, d.eqNullSafe(b["doc_id"]) & (_row(text) == b["row"]), "left")
    lines = lines_of(text)
    kept = F.array_join(F.flatten(F.transform(b["kept"], lambda r: F.slice(lines, r.first + 1, r["count"]))), "\n")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    own = [docs[c] if c != "text" else F.when(b["kept"].isNull(), docs[c]).otherwise(kept).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*own, n_lines.alias("n_lines"), F.coalesce(b["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply(docs, keep_bitmaps(docs, min_chars, min_docs))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.line, l.pos, r.key IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
