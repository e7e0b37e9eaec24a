"""Substring dedup: word windows that stand earlier in the corpus, by de Bruijn compaction.

Windows of ``width`` words are the edges of a de Bruijn graph over the corpus.  Most stand once and
most others lie on long nonbranching paths, so edges are not dealt one by one:

1. Every window is filed under its anchor, its k-mer with the least hash.  Neighbouring windows with
   one anchor form a path (a super-k-mer).  Anchors that stand once are dropped: nothing repeats there.
2. Paths of equal content compact into one by a join; its first source coordinate keeps the words, all
   others are repeated spans, whole.
3. Where an anchor has one content only, the path doesn't branch and is done.  Where it has several,
   paths may share windows; the first path of each content is opened and its windows are joined by hash.
4. Repeated paths that go on in the next anchor's, here and at their source alike, compact into one long
   span with one source coordinate (document, start).
5. Each long span is verified: the words at its source are read there, brought to the document by a
   join, and compared with its own.  Hashes only propose: where words differ, all paths of the anchors
   concerned are opened and their windows joined by the words themselves, and the spans made anew.

A source always precedes its repeat, and windows with equal words have equal hashes; so if every span
is verified, every repeated window has been found.

Order of places is (doc_id, start), null doc_ids first.  Rows that share a doc_id are told apart by
their text and interleave by start; equal rows count once.  Null and empty texts have no windows; an
empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import free, release, saved

WIDTH = 20
#: Words of an anchor: long enough to be rare, short enough to leave many windows to each.
ANCHOR = 8
#: A place is start * 2**24 + tag of the text.
TAG_BITS = 24
_TAG = (1 << TAG_BITS) - 1
#: Spans of one source that a row asks for.
WANTED = 4096
#: Text handled at once in a worker: each word takes some 100 bytes here.
CHUNK = 3 << 20
_U64 = np.uint64


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` consecutive values, how far in the first least one is."""
    n = len(values) - span + 1
    least, where = values[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        less = values[k : k + n] < least
        np.copyto(least, values[k : k + n], where=less)
        where[less] = k
    return where


class _Paths:
    """Windows of some texts and the paths that they form under their anchors."""

    def __init__(self, texts: pa.Array, width: int, anchor: int, bits: int = 64):
        self.mask = _U64((1 << bits) - 1)
        w = words.split(texts)
        h = w.hashes()[w.codes]
        self.at, self.row = words.starts(w.offsets, width)
        self.within = self.at - w.offsets[self.row]
        if not len(self.at):
            self.first = self.size = np.zeros(0, np.int64)
            return
        keys = words.windows(h, anchor, 31) & self.mask
        place = _leftmost_least(keys, width - anchor + 1)[self.at] + self.at
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])))
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(self.at)))
        self.windows = words.windows(h, width, 32)[self.at] & self.mask
        self.anchors = keys[place[self.first]]

    def contents(self) -> np.ndarray:
        """A hash of each path's windows."""
        total = np.concatenate((np.zeros(1, _U64), np.cumsum(self.windows, dtype=_U64)))
        last = self.first + self.size - 1
        a, b, c = words.multipliers(3, 33)
        return words.mix((total[last + 1] - total[self.first]) * a + self.windows[self.first] * b + self.windows[last] * c + self.size.astype(_U64)) & self.mask


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a tag that tells rows that share a doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(_TAG).alias("tag"))


def _of(slim: DataFrame, by_row: DataFrame, how: str = "inner") -> DataFrame:
    """``slim`` joined to what is known of its rows (d, t, ...)."""
    return slim.join(by_row, slim.doc_id.eqNullSafe(by_row.d) & (slim.tag == by_row.t), how).drop("d", "t")


def _path_rows(docs: DataFrame, width: int, anchor: int, bits: int, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK):
                p = _Paths(part.column("text"), width, anchor, bits)
                if not len(p.first):
                    continue
                row = p.row[p.first]
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(p.anchors.view(np.int64))], names=["anchor"])
                    continue
                place = (p.within[p.first] << TAG_BITS) | part.column("tag").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.anchors.view(np.int64)), pa.array(p.contents().view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(place), pa.array(p.size.astype(np.int32))],
                    names=["anchor", "content", "doc_id", "place", "size"],
                )

    if whole:
        return _slim(docs).mapInArrow(run, "anchor long, content long, doc_id long, place long, size int")
    return _slim(docs).select("text").mapInArrow(run, "anchor long")


def _windows_of(docs: DataFrame, opened: DataFrame, width: int, anchor: int, bits: int, exact: bool = False) -> DataFrame:
    """The windows of the opened paths: anchor, window (a hash, or ``exact``: the words), doc_id, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK):
                p = _Paths(part.column("text"), width, anchor, bits)
                if not len(p.first):
                    continue
                tags = part.column("tag").to_numpy()
                lists = part.column("starts").cast(pa.list_(pa.int64()))
                wanted, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                key = p.row[p.first] * (1 << 40) + p.within[p.first]  # ascending
                i = np.searchsorted(key, row * (1 << 40) + wanted)
                at = np.repeat(p.first[i], p.size[i]) + np.arange(p.size[i].sum()) - np.repeat(np.cumsum(p.size[i]) - p.size[i], p.size[i])
                r = p.row[at]
                if exact:
                    texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
                    windows = pa.array([b" ".join(texts[x][k : k + width]) for x, k in zip(r.tolist(), p.within[at].tolist(), strict=True)], pa.binary())
                else:
                    windows = pa.array(p.windows[at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(p.anchors[i], p.size[i]).view(np.int64)), windows, part.column("doc_id").take(pa.array(r)), pa.array((p.within[at] << TAG_BITS) | tags[r])],
                    names=["anchor", "window", "doc_id", "place"],
                )

    # A row's paths are bounded by its words.
    by_row = opened.groupBy(F.col("doc_id").alias("d"), F.col("place").bitwiseAND(_TAG).alias("t")).agg(F.collect_set(F.shiftright("place", TAG_BITS)).alias("starts"))
    return _of(_slim(docs), by_row).mapInArrow(run, f"anchor long, window {'binary' if exact else 'long'}, doc_id long, place long")


def _again(rows: DataFrame, first: DataFrame, keys: list[str], n_words) -> DataFrame:
    """Spans of the rows that are not the first place of their key."""
    later = rows.join(first, keys).where(~(F.struct("doc_id", "place").eqNullSafe(F.col("src"))))
    return later.select("anchor", "doc_id", "place", n_words.cast("int").alias("words"), F.col("src.doc_id").alias("src_doc"), F.col("src.place").alias("src_place"))


def _proposed(docs: DataFrame, width: int, anchor: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Stored spans (anchor, doc_id, place, words, src_doc, src_place) by hashes, and the paths of all repeated anchors."""
    spark = docs.sparkSession
    # Aggregates are stored before they are joined: a join of two plain exchanges is one that adaptive
    # execution can split where an anchor is hot.
    repeated = saved(_path_rows(docs, width, anchor, bits, False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    paths = saved(_path_rows(docs, width, anchor, bits, True).join(repeated, "anchor"), "paths")
    release(spark)
    free(repeated)
    firsts = saved(paths.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "place")).alias("src")), "contents")
    whole = _again(paths, firsts, ["anchor", "content"], F.col("size") + width - 1)
    branching = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    opened = firsts.join(branching, "anchor").select("src.doc_id", "src.place")
    windows = saved(_windows_of(docs, opened, width, anchor, bits), "windows")
    release(spark)
    least = saved(windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "place")).alias("src"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    spans = saved(whole.unionByName(_again(windows, least, ["anchor", "window"], F.lit(width))), "proposed")
    release(spark)
    free(firsts, windows, least)
    return spans, paths


def compact(spans: DataFrame) -> DataFrame:
    """Spans that meet or overlap, at their place and at their source alike, as one: doc_id, tag, start, words, src_doc, src_tag, src_start."""
    s = spans.select(
        "doc_id", F.col("place").bitwiseAND(_TAG).alias("tag"), F.shiftright("place", TAG_BITS).alias("start"), "words",
        "src_doc", F.col("src_place").bitwiseAND(_TAG).alias("src_tag"), (F.shiftright("place", TAG_BITS) - F.shiftright("src_place", TAG_BITS)).alias("shift"),
    )
    keys = ["doc_id", "tag", "src_doc", "src_tag", "shift"]
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.max(F.col("start") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = s.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    long_ = islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("words")).alias("end"))
    return long_.select("doc_id", "tag", "start", (F.col("end") - F.col("start")).cast("int").alias("words"), "src_doc", "src_tag", (F.col("start") - F.col("shift")).alias("src_start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words at wanted places: s_doc, s_tag, s_start, s_words, content."""
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            row, start, size, content = [], [], [], []
            for i, (text, wanted) in enumerate(zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True)):
                w = (text or "").encode().split()
                for x in wanted:
                    row.append(i)
                    start.append(x["start"])
                    size.append(x["words"])
                    content.append(b" ".join(w[x["start"] : x["start"] + x["words"]]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("tag").take(take), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(content, pa.binary())], names=["s_doc", "s_tag", "s_start", "s_words", "content"]
            )


def with_source_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``content``, the words at their sources; each stretch of a source is read once."""
    asked = saved(spans.select(F.col("src_doc").alias("d"), F.col("src_tag").alias("t"), F.col("src_start").alias("start"), "words").distinct(), "asked")
    many = saved(asked.groupBy(F.col("d").alias("d2"), F.col("t").alias("t2")).agg(F.ceil(F.count("*") / WANTED).cast("int").alias("blocks")), "asked-by-row")
    dealt = asked.join(many, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")))
    by_row = dealt.groupBy("d", "t", F.pmod(F.xxhash64("start", "words"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("start", "words")).alias("wanted")).drop("block")
    # Equal rows hold the same words; one of them is enough.
    contents = _of(_slim(docs), by_row).mapInArrow(_read, "s_doc long, s_tag long, s_start long, s_words int, content binary")
    contents = saved(contents.dropDuplicates(["s_doc", "s_tag", "s_start", "s_words"]), "sources")
    free(asked, many)
    same = spans.src_doc.eqNullSafe(contents.s_doc) & (spans.src_tag == contents.s_tag) & (spans.src_start == contents.s_start) & (spans.words == contents.s_words)
    return spans.join(contents, same).drop("s_doc", "s_tag", "s_start", "s_words")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            kept, before, removed, bad = [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                w = (text or "").encode().split()
                edge = np.zeros(len(w) + 1, np.int64)
                bad.append([])
                for s in spans or ():
                    a, b = s["start"], s["start"] + s["words"]
                    if b" ".join(w[a:b]) != s["content"]:
                        bad[-1].append({"start": a, "words": s["words"]})
                        continue
                    edge[a] += 1
                    edge[b] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                before.append(len(w))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if removed[-1] else w).decode())
            columns = [pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64()), pa.array(bad, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), *columns], names=["doc_id", "tag", "kept_text", "n_words", "n_removed", "bad"])


def apply(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, tag, kept_text (kept words joined by one blank), n_words, n_removed, and ``bad``: spans whose words are not their source's, which remove nothing."""
    known = with_source_words(docs, spans)
    by_row = known.groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("start", "words", "content")).alias("spans"))
    return _of(_slim(docs), by_row, "left").mapInArrow(_cut, "doc_id long, tag long, kept_text string, n_words long, n_removed long, bad array<struct<start:long,words:int>>")


def _anchors_of(docs: DataFrame, bad: DataFrame, width: int, anchor: int, bits: int) -> DataFrame:
    """The anchors of the windows in bad spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK):
                p = _Paths(part.column("text"), width, anchor, bits)
                if not len(p.first):
                    continue
                begin, row, hit = p.within[p.first], p.row[p.first], np.zeros(len(p.first), bool)
                for i, spans in enumerate(part.column("bad").to_pylist()):
                    for s in spans:
                        hit |= (row == i) & (begin + p.size > s["start"]) & (begin <= s["start"] + s["words"] - width)
                yield pa.RecordBatch.from_arrays([pa.array(p.anchors[hit].view(np.int64))], names=["anchor"])

    by_row = bad.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "bad").dropDuplicates(["d", "t"])
    return _of(_slim(docs), by_row).mapInArrow(run, "anchor long").distinct()


def _exact(docs: DataFrame, paths: DataFrame, suspects: DataFrame, width: int, anchor: int, bits: int) -> DataFrame:
    """Spans of the windows of some anchors by their words."""
    opened = paths.join(suspects, "anchor", "left_semi").select("doc_id", "place")
    windows = _windows_of(docs, opened, width, anchor, bits, exact=True)
    windows = saved(windows.join(suspects, "anchor", "left_semi"), "exact-windows")
    least = saved(windows.groupBy("window").agg(F.min(F.struct("doc_id", "place")).alias("src"), F.count("*").alias("n")).where("n > 1").drop("n"), "exact-least")
    return _again(windows, least, ["window"], F.lit(width))


def spans_and_texts(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Stored verified spans (see ``compact``) and texts (see ``apply``).  ``bits``: how much of each hash is used."""
    if not 0 < anchor <= width:
        raise ValueError("anchor_exceeds_width")
    spark = docs.sparkSession
    proposed, paths = _proposed(docs, width, anchor, bits)
    while True:
        spans = saved(compact(proposed), "spans")
        texts = saved(apply(docs, spans), "texts")
        release(spark)
        bad = texts.where(F.size("bad") > 0)
        if bad.isEmpty():
            free(proposed, paths)
            return spans, texts
        suspects = saved(_anchors_of(docs, bad, width, anchor, bits), "suspects")
        proposed = saved(proposed.join(suspects, "anchor", "left_anti").unionByName(_exact(docs, paths, suspects, width, anchor, bits)), "proposed")


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """doc_id, tag, start, words, src_doc, src_tag, src_start.  Spans of a document may overlap."""
    return spans_and_texts(docs, width, anchor, bits)[0]


def dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed."""
    return spans_and_texts(docs, width, anchor, bits)[1].drop("tag", "bad")


ORACLE_SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM places
), marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM marked WHERE again
), ws AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split
), kept AS (
  SELECT ws.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY ws.pos) FILTER (gone.pos IS NULL) AS t
  FROM ws LEFT JOIN gone ON ws.doc_id = gone.doc_id AND ws.pos = gone.pos GROUP BY ws.doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
