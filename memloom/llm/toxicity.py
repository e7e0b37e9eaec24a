"""Toxicity by class-conditional Kneser-Ney models.

A class's model is Kneser-Ney's continuation distribution: an expression weighs by the different words
it follows in the class's documents, N(.w), not by how often it stands there, so copies and catch
phrases don't count twice.  Backoff counts are shared: of an expression's N(.w) over both classes, the
first ``POOL`` are taken from the classes and given back as its stem (``STEM`` letters) divides, and of
the stem's, ``STEM_POOL`` as the classes' sizes divide.  What is too rare to tell is thus judged by what
is like it, and in the end alike by both models.  The log-likelihood ratio of an expression is bounded
below (``FLOOR``), as one ordinary word says little.

A document's evidence is the ratio over its length, the part of it that speaks for toxic, and the ratio
of its most toxic window over the window's length; a logistic curve turns the three into a score.  (A
bigram term above the continuation level was tried and made held-out results worse; see README.)

Counts come from all labelled rows that may be learned from, taken in ``ROUNDS`` by words.  The curve is fitted on a bounded sample
(``CURVE_ROWS``) of fold 3 with counts of folds 0 and 1 alone.  The fold is crc32(doc_id as text) mod 4;
fold 2 is never learned from.

Words and stems are told apart by their full 64-bit hashes, and their ratios stand in stored tables that
grow with the corpus.  Texts are cut into chunks of about ``CHUNK`` bytes and stored as codes; a chunk's
distinct words are joined to the tables, and what is found goes back to the chunk.  Only the words with
most continuations, ``HEAD`` at most, are broadcast: they would be the hot keys of that join.  Every other
word is looked up exactly, so ``HEAD`` changes no score.

Defined results: null and empty texts get the score of no evidence; a repeated label counts once (the
larger); rows are scored one by one, also with repeated or null doc_ids (a null one is not held out and
has no label); without labels of both classes every score is the share of toxic labels; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import free, release, saved
from .decontaminate import normal

CURVE_FOLD, HELD_OUT = 3, 2
STEM, POOL, STEM_POOL, FLOOR, WINDOW = 4, 4, 8, -0.5, 24
CURVE_ROWS, CUT = 50_000, 0.3
#: Words are counted in so many rounds, each of the words of its hashes: a round's shuffle files go before the next one's come.
ROUNDS = 2
#: Text handled at once in a worker: a word takes some 150 bytes while it is scored.
CHUNK = 2 << 20
#: Words that are broadcast at most (16 bytes each); the others are joined.
HEAD = 1 << 19
EVIDENCE = ("whole", "positive", "top")
#: Bits of a row of counts: a class has the bigram in a count fold, a class has it at all, ``other`` is the word's stem.
INNER, ANY, IS_STEM = 1, 4, 16
#: Labels and stems are broadcast up to this many rows (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words of the texts, where texts begin, and hashes of each code's word and stem."""
    w = words.split(texts)
    names = [normal(x) for x in w.distinct.to_pylist()]
    real = np.fromiter(map(bool, names), bool, len(names))[w.codes] if names else np.zeros(0, bool)
    hashed = [(xxhash.xxh3_64_intdigest(x), xxhash.xxh3_64_intdigest(x.decode("utf-8", "replace")[:STEM].encode())) for x in names]
    hashes = np.array(hashed, np.uint64).reshape(-1, 2).view(np.int64)
    return w.codes[real], np.concatenate(([0], np.cumsum(real)))[w.offsets], hashes[:, 0], hashes[:, 1]


def _count(batches: Iterator[pa.RecordBatch], k: int = 0, rounds: int = 1) -> Iterator[pa.RecordBatch]:
    """Distinct (word, word before) of each chunk with the bits of who has it, and (word, stem): of the words of round ``k``."""
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            code, at, word, stem = _words(part.column("text"))
            distinct, first, same = np.unique(word, return_index=True, return_inverse=True)
            local = same[code] + 1
            before = np.concatenate(([0], local[:-1])) if len(code) else local
            before[at[:-1][np.diff(at) > 0]] = 0  # nothing stands before a text's first word
            mine = np.concatenate(([False], distinct % rounds == k))[local]
            local, before = local[mine], before[mine]
            toxic = np.repeat(np.asarray(part.column("toxic"), np.int64), np.diff(at))[mine]
            inner = np.repeat(np.asarray(part.column("fold"), np.int64) != CURVE_FOLD, np.diff(at))[mine]
            key = np.unique((((local << 30) | before) << 2) | (toxic << 1) | inner)
            bits = np.where(key & 1, INNER | ANY, ANY) << ((key >> 1) & 1)
            begin = np.flatnonzero(np.concatenate(([True], key[1:] >> 2 != key[:-1] >> 2))) if len(key) else key
            bits, key = np.bitwise_or.reduceat(bits, begin) if len(key) else bits, key[begin] >> 2
            names = np.concatenate(([0], distinct))
            used = np.unique(local) - 1  # a word without letters has no place
            columns = ((names[key >> 30], distinct[used]), (names[key & ((1 << 30) - 1)], stem[first][used]), (bits, np.full(len(used), IS_STEM)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(columns, (np.int64, np.int64, np.int32), strict=True)], names=["word", "other", "bits"])


@dataclass
class Head:
    """The most followed words: hashes in order, the rank of each (0 is followed most), and ratios by rank."""

    hashes: np.ndarray
    ranks: np.ndarray
    ratios: np.ndarray

    def find(self, word: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for those that are not here."""
        if not len(self.hashes):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        return np.where(self.hashes[at] == word, self.ranks[at], -1)


@dataclass
class Model:
    """``words`` (word, ratio) and ``stems`` (stem, ratio: what an unseen word of that stem has) are stored tables."""

    head: Head
    words: DataFrame
    stems: DataFrame
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


def _evidence(ratio: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text: the mean ratio, the mean of its positive part, and the largest mean of a window."""
    n = np.diff(at)
    sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (ratio, np.maximum(ratio, 0))]
    out = np.zeros((len(n), 3))
    some = n > 0
    for k, total in enumerate(sums):
        out[some, k] = (total[at[1:]] - total[at[:-1]])[some] / n[some]
    out[:, 2] = out[:, 0]
    begin, row = words.starts(at, WINDOW)
    if len(begin):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first], 2] = np.maximum.reduceat(sums[0][begin + WINDOW] - sums[0][begin], first) / WINDOW
    return out


def _scores(curve: tuple[float, ...], evidence: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + evidence @ np.array(curve[1:]), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, ...]:
    """Intercept and weights by Newton steps on standardised columns."""
    k = x.shape[1]
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return (float(np.log(share / (1 - share))), *[0.0] * k)
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack((np.ones(len(x)), (x - mean) / sd))
    w, penalty = np.zeros(k + 1), ridge * np.diag([0.0] + [1.0] * k)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty + 1e-9 * np.eye(k + 1)
        step = np.linalg.solve(hessian, z.T @ (p - y) / len(y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / sd
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic (0 or 1), fold of the rows that may be learned from."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold_of(F.col("doc_id")) != HELD_OUT)
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.join(known, "doc_id").withColumn("fold", fold_of(F.col("doc_id")))


def _continuations(rows: DataFrame, k: int = 0, rounds: int = 1) -> DataFrame:
    """word, its stem, and its N(.w) by class, of the count folds (i0, i1) and of all (n0, n1): the words of round ``k``."""
    found = rows.select("text", "toxic", "fold").mapInArrow(partial(_count, k=k, rounds=rounds), "word long, other long, bits int").groupBy("word", "other").agg(F.bit_or("bits").alias("bits"))
    counts = [F.sum(F.when(F.col("bits").bitwiseAND(unit << c) != 0, 1).otherwise(0)).alias(f"{name}{c}") for name, unit in (("i", INNER), ("n", ANY)) for c in (0, 1)]
    return found.groupBy("word").agg(F.max(F.when(F.col("bits") >= IS_STEM, F.col("other"))).alias("stem"), *counts)


def _pooled(name: str, pool: int) -> tuple[str, str, str]:
    """SQL of what the classes keep of their counts, and of the shared count taken from them (with a half for the unseen)."""
    both = f"({name}0 + {name}1)"
    return *(f"{name}{c} * (1D - least({both}, {pool}) / greatest({both}, 1))" for c in (0, 1)), f"(least({both}, {pool}) + 0.5D)"


def _ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (word, n, i, n_ratio, i_ratio) and (stem, n_ratio, i_ratio): bounded log-likelihood ratios by all counts and by the count folds'."""
    names = ("i", "n")
    columns = [f"{x}{c}" for x in names for c in (0, 1)]
    sums = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in columns)).first()
    shares, unseen, seen = [], [], []
    for x in names:
        size = [max(sums[f"{x}{c}"], 1) for c in (0, 1)]
        size = [repr(y / sum(size)) + "D" for y in size]
        own0, own1, shared = _pooled(x, STEM_POOL)
        p = [f"({own} + {shared} * {y})" for own, y in zip((own0, own1), size, strict=True)]
        shares += [f"{p[c]} / ({p[0]} + {p[1]}) AS {x}_share{c}" for c in (0, 1)]
        unseen.append(f"greatest(ln({x}_share1 / {size[1]}) - ln({x}_share0 / {size[0]}), {FLOOR}D) AS {x}_ratio")
        own0, own1, shared = _pooled(x, POOL)
        p = [f"ln(({own} + {shared} * {x}_share{c}) / {size[c]})" for c, own in enumerate((own0, own1))]
        seen.append(f"greatest({p[1]} - {p[0]}, {FLOOR}D) AS {x}_ratio")
    stems = saved(counts.groupBy("stem").agg(*(F.sum(x).alias(x) for x in columns)).selectExpr("stem", *shares), "stems")
    table = saved(counts.join(stems, "stem").selectExpr("word", "n0 + n1 AS n", *seen), "ratios")
    return table, stems.selectExpr("stem", *unseen)


def _head(table: DataFrame) -> tuple[Head, Head]:
    """The words of most continuations with their ratios by all counts and by the count folds'.

    They are cut by classes of size, so that no global order is needed."""
    grade = F.floor(F.log2("n") * 8).cast("int")
    at, least = 0, 1 << 30
    for x in sorted(table.groupBy(grade.alias("grade")).count().collect(), key=lambda x: -x["grade"]):
        at += x["count"]
        if at > HEAD:
            break
        least = x["grade"]
    got = table.where(grade >= least).toArrow()
    word, n = got["word"].to_numpy(), got["n"].to_numpy()
    order = np.lexsort((word, -n))
    by_hash = np.argsort(word[order])
    return tuple(Head(word[order][by_hash], by_hash, got[x].to_numpy()[order]) for x in ("n_ratio", "i_ratio"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels)
    counted = []
    for k in range(ROUNDS):
        counted.append(saved(_continuations(rows, k, ROUNDS), "continuations"))
        release(docs.sparkSession)
    table, stems = _ratios(reduce(DataFrame.unionByName, counted))
    free(*counted)
    release(docs.sparkSession)
    models = [Model(head, table.selectExpr("word", f"{x}_ratio AS ratio"), stems.selectExpr("stem", f"{x}_ratio AS ratio")) for x, head in zip("ni", _head(table), strict=True)]
    sample = rows.where(F.col("fold") == CURVE_FOLD)
    share = CURVE_ROWS / max(1, labels.count())  # of all labels, so that the sample stays below the bound
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = _with_evidence(sample.select("doc_id", "text", "toxic"), models[1], "toxic int").select("toxic", *EVIDENCE).toArrow()
    x, y = np.column_stack([got[x].to_numpy() for x in EVIDENCE]), got["toxic"].to_numpy().astype(float)
    release(docs.sparkSession)
    order = np.lexsort((*x.T, y))  # rows come in any order, and sums of floats depend on it
    return replace(models[0], curve=logistic(x[order], y[order]))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte by byte of their places."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unplanes(x: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _chunked(docs: DataFrame, head: Head, text: bool) -> DataFrame:
    """A stored row for each chunk: its rows (with their texts or without), its words as codes, and its distinct words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(head, ratios=np.zeros(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.chunks(batch, "text", CHUNK):
                code, at, word, stem = _words(part.column("text"))
                rank = shared.value.find(word)
                real = np.zeros(len(word), bool)
                real[code] = True
                rare, first = np.unique(word[real & (rank < 0)], return_index=True)
                stems = stem[real & (rank < 0)][first]
                size = len(shared.value.hashes)
                used, local = np.unique(np.where(rank < 0, size + np.searchsorted(rare, word), rank)[code], return_inverse=True)
                kept = part if text else part.drop_columns(["text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(kept)
                numbers = np.concatenate(([len(at) - 1, len(used)], np.diff(at), np.diff(used, prepend=0), local))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()]), pa.array([len(numbers)], pa.int64()), pa.array([_planes(numbers)]), pa.array([rare], pa.list_(pa.int64())), pa.array([stems], pa.list_(pa.int64()))],
                    names=["chunk", "rows", "n_codes", "codes", "words", "stems"],
                )
                chunk += 1

    return saved(docs.mapInArrow(run, "chunk long, rows binary, n_codes long, codes binary, words array<long>, stems array<long>"), "chunks")


def _looked_up(chunks: DataFrame, model: Model) -> DataFrame:
    """chunk, rows, n_codes, codes, and the ratios of the chunk's words outside the head."""
    rare = chunks.selectExpr("chunk", "posexplode(arrays_zip(words, stems)) AS (place, w)").selectExpr("chunk", "place", "w.words AS word", "w.stems AS stem")
    stems = model.stems.withColumnRenamed("ratio", "unseen")
    if stems.count() <= BROADCAST_LABELS:
        stems = F.broadcast(stems)
    known = rare.join(stems, "stem", "left").select("chunk", "place", "word", "unseen").join(model.words.withColumnRenamed("ratio", "seen"), "word", "left")
    # No chunk has more words than its text, so the lists are bounded.
    lists = known.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("seen", "unseen", F.lit(0.0)).alias("ratio"))))["ratio"].alias("ratios"))
    return chunks.select("chunk", "rows", "n_codes", "codes").join(lists, "chunk", "left")


def _scored(docs: DataFrame, model: Model, text: bool) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]]:
    """Chunks with what was looked up, and what makes rows and their evidence of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model.head.ratios)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for i in range(batch.num_rows):
                ratios = batch.column("ratios").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                numbers = _unplanes(batch.column("codes")[i].as_py(), batch.column("n_codes")[i].as_py()).astype(np.int64)
                n, k = numbers[:2]
                at = np.concatenate(([0], np.cumsum(numbers[2 : 2 + n])))
                ratio = np.concatenate((shared.value, ratios))[np.cumsum(numbers[2 + n : 2 + n + k])][numbers[2 + n + k :]]
                with pa.ipc.open_stream(pa.py_buffer(batch.column("rows")[i].as_py())) as got:
                    yield got.read_next_batch(), _evidence(ratio, at)
            words.trim()

    return _looked_up(_chunked(docs, model.head, text), model), read


def _with_evidence(docs: DataFrame, model: Model, more: str = "") -> DataFrame:
    chunks, read = _scored(docs, model, text=False)
    curve = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, e in read(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(np.ascontiguousarray(x)) for x in e.T], pa.array(_scores(curve, e))], names=[*part.schema.names, *EVIDENCE, "score"])

    return chunks.mapInArrow(run, "doc_id long, " + (more + ", " if more else "") + "".join(f"{x} double, " for x in EVIDENCE) + "score double")


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence."""
    model = train(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _with_evidence(slim, model)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *EVIDENCE)


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``; all columns stay."""
    model = train(docs, labels)
    chunks, read = _scored(docs, model, text=True)
    curve = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, e in read(batches):
            yield part.filter(pa.array(_scores(curve, e) < cut))

    return chunks.mapInArrow(run, docs.schema)
