"""MinHash near-dedup by a multi-index Hamming join.

A document is its set of 5-word shingles.  Its signature has ``SLOTS`` minima of ``BITS`` bits; two sets
with Jaccard similarity s differ in about (1 - s) of the slots.  All pairs of signatures that differ in
at most ``max_errors`` slots are candidates, by pigeonhole: cut into chunks with allowances that add up
(with one for each chunk) to max_errors + 1, some chunk of such a pair has no more errors than its
allowance.  The allowed errors are enumerated: each chunk is indexed once for every choice of slots
that may differ.  With 64 slots, 31 errors and a similarity of 0.75, one pair in 100,000 has more.

* Equal sets are one class, found by a hash of the set; only one document of a class goes on.
* Star round: in each index bucket, all members are paired with the least one, not with each other.
  Pairs that pass are confirmed on full sets and give components.
* Rest round: buckets that still hold two components or more are compared inside, in blocks, only
  across components.  Pairs within the distance are dropped only where the sets' counts by hash bin
  prove an intersection too small (a bound, not an estimate); all others are confirmed on full sets.

A hot class, bucket or component is thus an aggregate, a splittable join or blocks of bounded size.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own
component; rows that share a doc_id are one document with several texts (its links are those of all of
them, its rows have one component_id, and each its own n_shingles); a null doc_id takes part as the
least one and stays null; an empty table gives an empty result; other columns are ignored.  ``dedup``
leaves one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import free, partitions, release, saved
from .components import components

SHINGLE, THRESHOLD = 5, 75
SLOTS, BITS, CHUNKS, MAX_ERRORS = 64, 16, 16, 31
#: Bins of the counts that bound an intersection: twice a set's size, rounded up to a power of two, within these limits.
BINS = (64, 4096)
#: Text handled at once in a worker: a word takes some 100 bytes while it is sorted.
CHUNK = 2 << 20
#: Members of a bucket that are compared in one task at once.
BLOCK = 2048
_NULL = -(2**63)
_U64 = np.uint64

SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"


def shingles(w: words.Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after the other, and where each text begins."""
    h = w.hashes()[w.codes]
    at, row = words.starts(w.offsets, width)
    keys = words.windows(h, width, 41)[at] if len(at) else np.zeros(0, _U64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))  # the whole sequence is the only shingle
    if len(short):
        whole = [words.windows(h[w.offsets[i] : w.offsets[i + 1]], int(w.counts[i]), 42)[0] for i in short]
        keys, row = np.concatenate((keys, np.array(whole, _U64))), np.concatenate((row, short))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], np.searchsorted(row[new], np.arange(len(w.counts) + 1))


def _segment_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, _U64), np.cumsum(x, dtype=_U64)))
    return total[at[1:]] - total[at[:-1]]


def signatures(keys: np.ndarray, at: np.ndarray, slots: int = SLOTS, seed: int = 43) -> np.ndarray:
    """``slots`` minima for each non-empty set."""
    first = at[:-1][np.diff(at) > 0]
    low = (keys >> _U64(32)).astype(np.uint32)
    odd = (words.multipliers(slots, seed) >> _U64(16)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(first), slots), np.uint16)
    for k in range(slots):
        least = np.minimum.reduceat(low * odd[k], first) if len(first) else np.zeros(0, np.uint32)
        out[:, k] = words.mix(least.astype(_U64)).astype(np.uint16)  # b bits of the minimum
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            keys, at = shingles(words.split(part.column("text"), lower=True))
            n = np.diff(at)
            h1 = _segment_sums(words.mix(keys), at)
            h2 = _segment_sums(words.mix(keys ^ _U64(0x5851F42D4C957F2D)), at)
            rows = iter(signatures(keys, at))
            blobs = [next(rows).tobytes() if k else None for k in n.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "signature"])


def index_keys(signature: np.ndarray) -> np.ndarray:
    """One key for every chunk and every choice of its slot that may differ."""
    size, allowed = SLOTS // CHUNKS, (MAX_ERRORS + 1) // CHUNKS - 1
    if allowed != 1 or (MAX_ERRORS + 1) % CHUNKS:
        raise ValueError("chunk_allowance_must_be_one")
    out = np.empty((len(signature), CHUNKS * size), _U64)
    odd = words.multipliers(size, 44)
    for chunk in range(CHUNKS):
        slots = signature[:, chunk * size : (chunk + 1) * size].astype(_U64)
        for free in range(size):
            key = np.full(len(signature), chunk * size + free + 1, _U64)
            for j in range(size):
                if j != free:
                    key = words.mix(key * odd[j] + slots[:, j])
            # The low bits tell chunk and choice.
            out[:, chunk * size + free] = (key & ~_U64(SLOTS - 1)) | _U64(chunk * size + free)
    return out


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chunk and choice (as in the keys' low bits) of the first key that two signatures share, -1 if there is none."""
    size = SLOTS // CHUNKS
    same = (a == b).reshape(len(a), CHUNKS, size)
    enough = same.sum(axis=2) >= size - 1
    chunk = enough.argmax(axis=1)
    differs = ~same[np.arange(len(a)), chunk]
    return np.where(enough.any(axis=1), chunk * size + np.where(differs.any(axis=1), differs.argmax(axis=1), 0), -1)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
            keys = index_keys(signature)
            row = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("rep").take(pa.array(row))], names=["key", "rep"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1) <= MAX_ERRORS


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are near."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(_near(a, b)))


def bin_counts(keys: np.ndarray) -> bytes:
    """How many hashes of a set fall into each bin (of their top bits); empty if a count exceeds a byte: such a set is never ruled out."""
    bins = min(max(BINS[0], 1 << int(2 * len(keys) - 1).bit_length()), BINS[1])
    counts = np.bincount((keys >> _U64(65 - bins.bit_length())).astype(np.int64), minlength=bins)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_overlap(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether bin counts allow pairs of sets the similarity: the bins' smaller counts add up to no less than the intersection."""
    out = np.ones(len(a), bool)
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for bins in np.unique(size.min(axis=1)).tolist():
        at = np.flatnonzero(size.min(axis=1) == bins)
        step = max(1, (8 << 20) // max(bins, 1))
        for part in (at[i : i + step] for i in range(0, len(at) if bins else 0, step)):
            # Neighbouring bins of the finer counts are added up.
            x, y = (np.stack([np.frombuffer(side[i], np.uint8).reshape(bins, -1).sum(axis=1, dtype=np.uint16) for i in part]) for side in (a, b))
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            out[part] = (100 + THRESHOLD) * both >= THRESHOLD * (n_a[part] + n_b[part])
    return out


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            keys, at = shingles(words.split(part.column("text"), lower=True))
            some = np.diff(at) > 0
            rows = [bin_counts(words.mix(keys[a:b])) for a, b in zip(at[:-1][some], at[1:][some], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("rep").filter(pa.array(some)), pa.array(rows, pa.binary())], names=["rep", "fine"])


def _pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal, neighbouring ``group`` numbers, some 100,000 at a time."""
    end = np.searchsorted(group, group, side="right")
    counts = end - np.arange(len(group)) - 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(group):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + 100_000, side="right")))
        n = counts[at:to]
        left = np.repeat(np.arange(at, to), n)
        yield left, left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of sorted (key, i, j) groups: of different components and of sizes that allow the similarity.

    A pair that shares several buckets is found in the first of them alone.
    Only the rows of the last group, which may go on, are held from batch to batch."""
    held: pa.Table | None = None

    def found(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "rep", "comp", "n_shingles")}
        fine = rows.column("fine").to_pylist()
        coarse = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
        new = np.zeros(len(fine), np.int64)
        for c in ("key", "i", "j"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        out = [np.zeros((0, 2), np.int64)]
        for a, b in _pairs_within(np.cumsum(new)):
            n_a, n_b = cols["n_shingles"][a], cols["n_shingles"][b]
            may = (cols["comp"][a] != cols["comp"][b]) & (100 * np.minimum(n_a, n_b) >= THRESHOLD * np.maximum(n_a, n_b))
            may &= (cols["i"][a] == cols["j"][a]) | (cols["block"][a] != cols["block"][b])
            a, b = a[may], b[may]
            for near in (lambda: _near(coarse[a], coarse[b]), lambda: first_key(coarse[a], coarse[b]) == cols["key"][a] & (SLOTS - 1), lambda: may_overlap([fine[x] for x in a], [fine[x] for x in b], cols["n_shingles"][a], cols["n_shingles"][b])):
                kept = near()
                a, b = a[kept], b[kept]
            out.append(np.sort(np.stack((cols["rep"][a], cols["rep"][b]), 1), axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not rows.num_rows:
            continue
        last = np.ones(rows.num_rows, bool)
        for c in ("key", "i", "j"):
            column = rows.column(c).to_numpy()
            last &= column == column[-1]
        begin = rows.num_rows - int(last.sum())
        if begin:
            yield found(rows.slice(0, begin))
        held = rows.slice(begin).combine_chunks()
    if held is not None and held.num_rows:
        yield found(held)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= THRESHOLD * union, on full sets."""
    for batch in batches:
        for part in words.chunks(batch, "text_a", CHUNK // 2):
            n = part.num_rows
            texts = pa.concat_arrays([part.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")])
            keys, at = shingles(words.split(texts, lower=True))
            good = []
            for i in range(n):
                a, b = keys[at[i] : at[i + 1]], keys[at[n + i] : at[n + i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= THRESHOLD * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a, b = (texts.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id = component_id)."""
    spark, slim = docs.sparkSession, _slim(docs)
    sketches = saved(slim.mapInArrow(_sketch, SKETCH), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    classes = saved(classes, "classes")
    # Documents with several texts link their classes.
    several = sketches.where("n_shingles > 0").groupBy("doc_id").agg(F.min("h1").alias("lo1"), F.max("h1").alias("hi1"), F.min("h2").alias("lo2"), F.max("h2").alias("hi2")).where("lo1 < hi1 OR lo2 < hi2").select("doc_id")
    several = saved(sketches.where("n_shingles > 0").join(several, "doc_id").select("h1", "h2", "doc_id").distinct().join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v"), "several")
    index = classes.select("rep", "signature").mapInArrow(_index, "key long, rep long")
    # Aggregates are stored before they are joined: adaptive execution splits a hot key only between two plain exchanges.
    shared = saved(index.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot"), "shared")
    buckets = saved(index.join(shared, "key"), "buckets")
    release(spark)

    sizes = classes.select(F.col("rep").alias("r"), "n_shingles", "signature")
    star = buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(sizes.select(F.col("r").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a")), "a").join(sizes.select(F.col("r").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b")), "b")
    star = saved(star.where(f"100 * least(n_a, n_b) >= {THRESHOLD} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b").mapInArrow(_close, "a long, b long"), "star")
    # The texts of classes that share a bucket, once; both rounds read them from here.
    involved = buckets.select("rep").distinct()
    texts = saved(slim.withColumnRenamed("doc_id", "rep").join(involved, "rep"), "texts")
    release(spark)
    links = saved(_confirmed(star, texts), "star-links")
    release(spark)
    first = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(several))

    member = buckets.select("key", "rep").join(first.select(F.col("u").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    member = saved(member, "members")
    mixed = saved(member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    rest = member.join(mixed, "key").join(sizes.withColumnRenamed("r", "rep"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    fine = saved(texts.join(rest.select("rep").distinct(), "rep").select("rep", "text").mapInArrow(_fine, "rep long, fine binary"), "fine")
    # A block meets itself and every other block of its bucket: one block, one group, in all but hot buckets.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    rest = rest.select("key", "rep", "comp", "n_shingles", "signature", "block", other).join(fine, "rep").withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o")
    dealt = rest.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(_across, "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
    more = saved(_confirmed(saved(pairs, "rest"), texts), "rest-links")
    release(spark)
    roots = components(first.select("u", F.col("root").alias("v")).unionAll(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    free(buckets, shared, member, mixed, fine, texts)
    whole = classes.join(roots, F.col("rep") == F.col("u"), "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    linked = sketches.where("n_shingles > 0").join(whole, ["h1", "h2"]).select("doc_id", "n_shingles", "root")
    # A row without words goes where other rows of its doc_id are.
    if not alone.isEmpty():
        others = linked.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("root").alias("with"))
        alone = alone.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("with", "root").alias("root"))
    back = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return linked.unionAll(alone).select(back("doc_id").alias("doc_id"), "n_shingles", back("root").alias("component_id"), (F.col("doc_id") == F.col("root")).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the document that is kept, the row with the least hash of its text."""
    kept = saved(cluster(docs).where("kept").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("rows")), "kept")
    ours = docs["doc_id"].cast("long").eqNullSafe(kept["k"])
    columns = [docs[f"`{c}`"] for c in docs.columns]
    single = docs.join(kept.where("rows = 1"), ours, "left_semi")
    again = kept.where("rows > 1")
    if again.isEmpty():
        return single
    # Equal rows and rows with one doc_id: an aggregate of hashes finds the row, and one of equal rows goes on.
    row = F.xxhash64(docs["text"].cast("string"))
    several = docs.join(again, ours).select(*columns, row.alias("_row"), F.struct(F.xxhash64(*columns)).alias("_all"))
    least = saved(several.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min(F.struct("_row", "_all")).alias("least")), "least-rows")
    one = several.join(least, several["doc_id"].cast("long").eqNullSafe(least["k"]) & (F.struct(several["_row"], several["_all"]) == least["least"]), "left_semi")
    return single.unionByName(one.drop("_row", "_all").dropDuplicates())


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1
)
SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept FROM least l LEFT JOIN size s ON l.doc_id = s.doc_id
"""
