"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words matches a document when m words can be turned into some stretch of it with at
most ``budget(m)`` word edits.  Cut into budget + 1 pieces, such an item leaves one piece untouched,
so every match shows as an exact piece hit.

1. Pieces are a stored table (hash, item, offset).  A sieve of its hashes, of at most 2 ** ``SIEVE_BITS``
   bits whatever the number of items, is broadcast; windows of documents that pass it are joined to the
   pieces by hash, so that a piece of many items or documents is a join that can be split.
2. A hit points to a diagonal of the item in the document.  Diagonals are handled in bands as wide as
   the item, each once; documents cut the bands' stretches out of their text.
3. Stretches are joined to the items' words and verified with Myers' bit-parallel edit distance; run
   backwards from the best end, it also tells where the match begins.

Words are compared A-Z folded and without surrounding punctuation.  Items of fewer than ``MIN_WORDS``
words are matched exactly (no edits); those of fewer than ``EXACT_WORDS`` say too little to be matched at
all and are listed by ``not_checked``.

Defined results: null or empty texts and items match nothing; equal items count once, items of equal
text or equal id are told apart; rows are judged one by one, so repeated or null doc_ids change nothing;
empty tables give no matches; other columns pass through ``find``, but for a column named as its result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import saved

#: Word edits allowed, as a part of an item's words.
ERROR_RATE = 0.15
MIN_WORDS, EXACT_WORDS = 8, 4
#: Bits of the broadcast sieve at most: 16 MB.
SIEVE_BITS = 27
#: Bands that one row of a document carries: a document with more is cut in several rows.
BANDS = 4096
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¡¿"


def budget(m: int, rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> int:
    return int(m * rate) if m >= min_words else 0


def normal(word: bytes) -> bytes:
    return word.lower().decode("utf-8", "replace").strip(_EDGES).encode()


def item_words(text: str | None) -> list[bytes]:
    return [x for w in (text or "").encode().split() if (x := normal(w))]


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the whole pattern to any stretch of the text, and where that stretch ends.

    ``anchored``: the stretch begins where the text does."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (~(xh | up) & full), up & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ((ph << 1) | anchored) & full, (mh << 1) & full
        up, down = (mh | (~(xv | ph) & full)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """Distance, start and end of the first stretch of the text that is nearest to the pattern."""
    distance, end = myers(pattern, text)
    _, back = myers(pattern[::-1], text[:end][::-1], anchored=True)
    return distance, end - back, end


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


def _normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of some texts, and where each text begins."""
    w = words.split(texts)
    names = [normal(x) for x in w.distinct.to_pylist()]
    real = np.fromiter(map(bool, names), bool, len(names))[w.codes] if names else np.zeros(0, bool)
    return _hashes(names)[w.codes][real], np.concatenate(([0], np.cumsum(real)))[w.offsets]


def prepared(benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Stored (item, item_id, m, k, words) and (hash, item, a, length) of the items that are matched and their pieces."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                seq, at = _normalised(part.column("text"))
                n = np.diff(at)
                fit = n >= min(EXACT_WORDS, min_words)
                blobs = [seq[a:b].tobytes() for a, b in zip(at[:-1][fit], at[1:][fit], strict=True)]
                ks = [budget(m, rate, min_words) for m in n[fit].tolist()]
                yield pa.RecordBatch.from_arrays([part.column("item_id").filter(pa.array(fit)), pa.array(n[fit]), pa.array(ks, pa.int64()), pa.array(blobs, pa.binary())], names=["item_id", "m", "k", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, k, blob in zip(*(batch.column(c).to_pylist() for c in ("item", "k", "words")), strict=True):
                seq = np.frombuffer(blob, np.uint64)
                cuts = [len(seq) * p // (k + 1) for p in range(k + 2)]
                rows += [(int(words.windows(seq[a:b], b - a, 21).view(np.int64)[0]), item, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["hash", "item", "a", "length"])

    numbered = items.mapInArrow(read, "item_id long, m long, k long, words binary").withColumn("item", F.monotonically_increasing_id())
    numbered = saved(numbered, "items")
    return numbered, saved(numbered.select("item", "k", "words").mapInArrow(cut, "hash long, item long, a long, length long"), "pieces")


def not_checked(benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """item_id, n_words of the items that are too short to be matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                n = np.diff(_normalised(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(n)], names=["item_id", "n_words"]).filter(pa.array(n < min(EXACT_WORDS, min_words)))

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, n_words long")


def _sieve(pieces: DataFrame) -> np.ndarray:
    """Which low bits the pieces' hashes have, 64 a word; the number of words is a power of two and bounded."""
    bits = min(max(12, 6 + int(pieces.count()).bit_length()), SIEVE_BITS)
    low = F.col("hash").bitwiseAND((1 << bits) - 1)
    found = pieces.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {(1 << bits) - 1}) & 63 AS int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy()] = found["word"].to_numpy()
    return out.view(np.uint64)


def _hits(docs: DataFrame, sieve: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, row, hash, length, at: windows of the documents that pass the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text"):
                seq, offsets = _normalised(part.column("text"))
                known, mask = shared.value, np.uint64(64 * len(shared.value) - 1)
                found = []
                for length in lengths:
                    h = words.windows(seq, length, 21)
                    low = h & mask
                    at = np.flatnonzero((known[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(offsets, at, "right") - 1
                    inside = at + length <= offsets[row + 1]
                    at, row = at[inside], row[inside]
                    found.append((row, h[at].view(np.int64), np.full(len(at), length), at - offsets[row]))
                row, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("row").take(take), *map(pa.array, rest)], names=["doc_id", "row", "hash", "length", "at"])

    return docs.mapInArrow(run, "doc_id long, row long, hash long, length long, at long")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed words of each wanted (item, low, high) of a document."""
    for batch in batches:
        for part in words.chunks(batch, "text"):
            seq, offsets = _normalised(part.column("text"))
            row, item, low, blob = [], [], [], []
            for i, wanted in enumerate(part.column("wanted").to_pylist()):
                text = seq[offsets[i] : offsets[i + 1]]
                for w in wanted:
                    begin = max(0, w["low"])
                    row.append(i)
                    item.append(w["item"])
                    low.append(begin)
                    blob.append(text[begin : max(begin, w["high"])].tobytes())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("row").take(take), pa.array(item, pa.int64()), pa.array(low, pa.int64()), pa.array(blob, pa.binary())], names=["doc_id", "row", "item", "low", "stretch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, out = [], []
        for i, (k, low, pattern, stretch) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "low", "words", "stretch")), strict=True)):
            distance, start, end = best_match(np.frombuffer(pattern, np.uint64).tolist(), np.frombuffer(stretch, np.uint64).tolist())
            if distance <= k:
                good.append(i)
                out.append((distance, low + start, low + end))
        take = pa.array(good, pa.int64())
        columns = [pa.array([x[i] for x in out], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "row", "item", "item_id")), *columns], names=["doc_id", "row", "item", "item_id", "distance", "start", "end"])


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame | None:
    """doc_id, row (a hash of the text), item_id, distance, start, end (words) of the best match of each item in a document; None without items."""
    items, pieces = prepared(benchmark, rate, min_words)
    lengths = sorted(r.length for r in pieces.select("length").distinct().collect())  # at most 1 / rate + 2 of them, and min_words
    if not lengths:
        return None
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    hits = saved(_hits(slim, _sieve(pieces), lengths), "hits")
    placed = pieces.join(items.select("item", "m", "k"), "item")
    bands = hits.join(saved(placed, "placed"), ["hash", "length"]).select("doc_id", "row", "item", "m", "k", F.floor((F.col("at") - F.col("a")) / F.col("m")).alias("band")).distinct()
    bands = saved(bands.select("doc_id", "row", "item", (F.col("band") * F.col("m") - F.col("k")).alias("low"), ((F.col("band") + 2) * F.col("m") + F.col("k")).alias("high")), "bands")
    many = saved(bands.groupBy("doc_id", "row").agg(F.ceil(F.count("*") / BANDS).cast("int").alias("blocks")), "bands-by-document")
    dealt = bands.join(many.withColumnsRenamed({"doc_id": "d", "row": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    dealt = dealt.groupBy("doc_id", "row", F.pmod(F.xxhash64("item", "low"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("item", "low", "high")).alias("wanted"))
    dealt = saved(dealt.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "wanted"), "wanted")
    once = slim.join(dealt, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("doc_id", "row", "text", "wanted")
    stretches = saved(once.mapInArrow(_stretches, "doc_id long, row long, item long, low long, stretch binary"), "stretches")
    found = stretches.join(items, "item").mapInArrow(_verify, "doc_id long, row long, item long, item_id long, distance int, start int, end int")
    best = found.groupBy("doc_id", "row", "item", "item_id").agg(F.min(F.struct("distance", "end", "start")).alias("b"))
    return best.select("doc_id", "row", "item_id", "b.distance", "b.start", "b.end")


def find(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS, into: str = "matches") -> DataFrame:
    """``docs`` with a column ``into`` (one of that name is replaced): item_id, distance, and first and end word of the stretch, by item_id."""
    found = matches(docs, benchmark, rate, min_words)
    kind = "array<struct<item_id:long,distance:int,start:int,end:int>>"
    kept = [c for c in docs.columns if c != into]
    if found is None:
        return docs.select(*(docs[f"`{c}`"] for c in kept), F.array().cast(kind).alias(into))
    lists = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("item_id", "distance", "start", "end"))).alias("found"))
    lists = saved(lists, "matches")
    joined = docs.join(lists, docs["doc_id"].cast("long").eqNullSafe(lists["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == lists["row"]), "left")
    return joined.select(*(docs[f"`{c}`"] for c in kept), F.coalesce(lists["found"], F.array()).cast(kind).alias(into))


def report(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document: doc_id, contaminated, item_ids (sorted), least distance (null if none)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return find(slim, benchmark, rate, min_words).select("doc_id", (F.size("matches") > 0).alias("contaminated"), ids.alias("item_ids"), F.array_min(F.col("matches.distance")).alias("distance"))
