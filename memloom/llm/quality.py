"""Quality rules: counts within a text, and lines that too many documents of a host share.

Each document is read once; out of the scan come its counts and, for each distinct normalised line
(A-Z folded, white space collapsed), a 128-bit hash with the words it stands for.  Lines are counted
by host; those in more documents than the limits allow are boilerplate.  A document that keeps too
few of its words without them is depleted and rejected.  ``without_common_lines`` gives the texts that
are left.

Both limits must be passed: hosts of up to ``MAX_DOCS`` documents have no boilerplate, as nothing can be
told from so few, and on hosts of more than 1000 * MAX_DOCS / MAX_PER_MILLE (10,000) the share decides.

Defined results: a null or empty text has no words and fails; rows that share a doc_id count as one
document of their host (null doc_ids as one) and get the verdict of their own text; a null host is a
host; an empty table gives an empty result; other columns are ignored, or pass through
``without_common_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import saved

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line is boilerplate when more documents of its host hold it than both limits allow.
MAX_DOCS, MAX_PER_MILLE = 20, 2
#: A document is depleted when less of its words is left, in per cent.
MIN_KEPT = 30

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())])
SCHEMA = "doc_id long, host string, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h1:long,h2:long,words:long>>"


def repeat_words(w: words.Words, width: int = WINDOW) -> np.ndarray:
    """Words of each text that a window standing twice or more in it covers."""
    at, row = words.starts(w.offsets, width)
    n = len(w.counts)
    if not len(at):
        return np.zeros(n, np.int64)
    # Two hashes of the words' codes, which are distinct for distinct words: 128 bits for a window.
    codes = words.mix(w.codes.astype(np.uint64) + np.uint64(1))
    a, b = words.windows(codes, width, 11)[at], words.windows(codes, width, 12)[at]
    order = np.lexsort((b, a, row))
    a, b, r = a[order], b[order], row[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    return np.diff(covered[w.offsets])


def _line_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _lines(text: str) -> tuple[int, list[dict]]:
    """Lines equal to an earlier one, and the distinct normalised lines with their words."""
    seen: set[str] = set()
    dup, found = 0, {}
    for line in text.split("\n"):
        parts = line.encode().split()
        if not parts:
            continue
        dup += line in seen
        seen.add(line)
        key = b" ".join(parts).lower()
        found[key] = found.get(key, 0) + len(parts)
    out = []
    for key, n in found.items():
        h1, h2 = _line_hash(key)
        out.append({"h1": h1, "h2": h2, "words": n})
    return dup, out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text"):
            texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
            w = words.split(texts)
            chars = np.asarray(pc.utf8_length(w.distinct.cast(pa.large_string())), np.int64)[w.codes]
            chars = np.diff(np.concatenate(([0], np.cumsum(chars)))[w.offsets])
            dup, lines, symbols = [], [], []
            for text in texts.to_pylist():
                d, found = _lines(text)
                dup.append(d)
                lines.append(found)
                symbols.append(int(_SYMBOLS[np.frombuffer(text.encode(), np.uint8)].sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), part.column("row"), pa.array(w.counts), pa.array(chars), pa.array(symbols, pa.int64()), pa.array(dup, pa.int64()), pa.array(repeat_words(w)), pa.array(lines, pa.list_(_LINE))],
                names=["doc_id", "host", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    return slim.withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(_measure, SCHEMA)


def common_lines(measured: DataFrame, max_docs: int = MAX_DOCS, max_per_mille: int = MAX_PER_MILLE) -> DataFrame:
    """c_host, c1, c2: the lines that more documents of a host hold than both limits allow."""
    lines = measured.select("doc_id", "host", F.explode("lines").alias("line")).select("doc_id", "host", "line.h1", "line.h2")
    again = saved(measured.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "again")
    rows = measured.select("doc_id", "host")
    if not again.isEmpty():  # only rows that share a doc_id can count a document twice
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        lines = lines.join(again, same, "left_anti").unionByName(lines.join(again, same, "left_semi").distinct())
        rows = rows.distinct()
    size = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    common = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    common = common.join(size, common.host.eqNullSafe(size.host)).where(1000 * F.col("n") > max_per_mille * F.col("host_docs")).select(common.host.alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    return saved(common, "common")  # so that adaptive execution can split a hot line where it is joined


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text"):
            kept = []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                gone = {(g["h1"], g["h2"]) for g in gone}
                kept.append("\n".join(line for line in text.split("\n") if not (parts := line.encode().split()) or _line_hash(b" ".join(parts).lower()) not in gone))
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("row"), pa.array(kept, pa.string())], names=["k_host", "k_row", "kept"])


def without_common_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_per_mille: int = MAX_PER_MILLE) -> DataFrame:
    """``docs`` with ``text`` without its host's common lines; a text that has none stays as it is."""
    measured = saved(measure(docs, host), "measured")
    lines = measured.select("host", "row", F.explode("lines").alias("line")).select("host", "row", "line.h1", "line.h2")
    common = common_lines(measured, max_docs, max_per_mille)
    hit = lines.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("host").eqNullSafe(F.col("c_host")))
    # The lines of one text: bounded by it.
    lists = saved(hit.groupBy(F.col("host").alias("g_host"), F.col("row").alias("g_row")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "gone")
    text, where = docs["text"].cast("string"), docs[host].cast("string")
    row = F.xxhash64(F.coalesce(text, F.lit("")))
    touched = docs.select(text.alias("text"), where.alias("host"), row.alias("row")).join(lists, F.col("host").eqNullSafe(F.col("g_host")) & (F.col("row") == F.col("g_row")))
    cut = touched.select("text", "host", "row", "gone").mapInArrow(_cut, "k_host string, k_row long, kept string").dropDuplicates(["k_host", "k_row"])
    cut = saved(cut, "cut")
    joined = docs.join(cut, where.eqNullSafe(cut["k_host"]) & (row == cut["k_row"]), "left")
    return joined.select(*(F.coalesce(cut["kept"], text).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_per_mille: int = MAX_PER_MILLE, min_kept: int = MIN_KEPT) -> DataFrame:
    """One row for each document: its counts, n_boilerplate (words in lines above the limits), base_failed, kept."""
    measured = saved(measure(docs, host), "measured")
    lines = measured.select("doc_id", "row", "host", F.explode("lines").alias("line")).select("doc_id", "row", "host", "line.*")
    common = common_lines(measured, max_docs, max_per_mille)
    hit = lines.join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("host").eqNullSafe(F.col("c_host")))
    # Rows that are the same in all of doc_id, host and text meet here, each with its lines once: a line counts once for them.
    hit = hit.groupBy("doc_id", "row", "host", "h1", "h2").agg(F.max("words").alias("words"))
    lost = hit.groupBy("doc_id", "row", "host").agg(F.sum("words").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("l_doc"), F.col("row").alias("l_row"), F.col("host").alias("l_host"), "lost")
    out = measured.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("row") == F.col("l_row")) & F.col("host").eqNullSafe(F.col("l_host")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.least(F.coalesce("lost", F.lit(0)), F.col("n_words"))
    return (
        out.withColumn("n_boilerplate", gone)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * (F.col("n_words") - gone) >= min_kept * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate", "base_failed", "kept")
    )


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM places) WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM split)
), dups AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS r FROM lines WHERE len(lw) > 0) WHERE r > 1 GROUP BY doc_id
), norm AS (
  SELECT doc_id, source, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, sum(len(lw)) AS n FROM lines WHERE len(lw) > 0 GROUP BY 1, 2, 3
), common AS (
  SELECT source, k FROM norm JOIN (SELECT source AS s, count(*) AS docs FROM documents GROUP BY 1) ON source = s GROUP BY source, k, docs HAVING count(*) > 20 AND 1000 * count(*) > 2 * docs
), lost AS (
  SELECT doc_id, sum(n) AS n FROM norm JOIN common USING (source, k) GROUP BY doc_id
), base AS (
  SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_boilerplate
  FROM split s LEFT JOIN dups d ON s.doc_id = d.doc_id LEFT JOIN twice t ON s.doc_id = t.doc_id LEFT JOIN lost l ON s.doc_id = l.doc_id
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - n_boilerplate) >= 30 * n_words AS kept FROM base
"""
