"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Packing only needs to know how many pieces there are of each length, and a length is at most
``capacity``.  So the cluster tokenises and counts, the driver solves the *counted* instance
(``capacity`` numbers at most, whatever the corpus), and the cluster gives every piece its place by
joining its rank among the pieces of its length with ranges of ranks.

* Reduction: for a length j, a set of up to three pieces containing j *dominates* when every other
  feasible set with j can be exchanged into it without needing more sequences.  Such sets are fixed
  for good and the instance shrinks.
* Best fit: the remainder, longest first, each piece into the fullest open sequence that takes it;
  equal sequences are handled as one with a count.

Defined results: null and empty texts are the end id alone; every row is a document of its own, also
with a repeated or null doc_id; an empty table gives an empty result; columns besides ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens, words
from .common import saved

CAPACITY = 4096
#: Text handled at once in a worker.
CHUNK = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, nth long"
PLAN = "length long, lo long, hi long, sequence_id long, offset long"

Pattern = tuple[int, ...]


# -- the counted instance, on the driver ---------------------------------------------------------


class _Lengths:
    """A multiset of lengths that answers: which is the largest one not above x?"""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.sorted = sorted(self.n)

    def take(self, k: int, times: int) -> None:
        self.n[k] -= times
        if not self.n[k]:
            del self.n[k]
            self.sorted.pop(bisect.bisect_left(self.sorted, k))

    def largest(self, x: int, without: Pattern = ()) -> int | None:
        i = bisect.bisect_right(self.sorted, x) - 1
        while i >= 0 and self.n[self.sorted[i]] <= without.count(self.sorted[i]):
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def smallest(self, how_many: int, without: Pattern = ()) -> list[int]:
        found: list[int] = []
        for k in self.sorted:
            found += [k] * min(how_many - len(found), self.n[k] - without.count(k))
            if len(found) >= how_many:
                break
        return found


def _dominating(j: int, items: _Lengths, capacity: int) -> Pattern | None:
    """A set containing j that dominates all others containing j, if one of up to three pieces does."""
    room = capacity - j
    best = items.largest(room, (j,))
    if best is None:  # nothing fits beside j
        return (j,)
    if best == room:  # a pair that fills the sequence
        return (j, best)
    low = items.smallest(3, (j,))
    if len(low) < 2 or low[0] + low[1] > room:  # one more piece at most: the largest
        return (j, best)
    if len(low) < 3 or sum(low) > room:  # two more at most: dominated by (best, second) if no pair has a larger minor part
        second = items.largest(room - best, (j, best))
        if second is not None:
            i = bisect.bisect_right(items.sorted, second)  # the smallest larger minor part, with the smallest partner not below it
            if i == len(items.sorted):
                return (j, best, second)
            c = items.sorted[i]
            partner = c if items.n[c] - (j, best).count(c) + (best == c) >= 2 else (items.sorted[i + 1] if i + 1 < len(items.sorted) else None)
            if partner is None or c + partner > room:
                return (j, best, second)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed by dominance, each with how often it is used, and the counts that remain."""
    items, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in sorted(items.n, reverse=True):
            while j in items.n and (found := _dominating(j, items, capacity)):
                need = {k: found.count(k) for k in found}
                # The same set stays dominating while its parts last; with the last of a length, look again.
                times = max(1, min(items.n[k] // c for k, c in need.items()) - 1) if len(found) > 1 else items.n[j]
                for k, c in need.items():
                    items.take(k, c * times)
                fixed.append((found, times))
                changed = True
    return fixed, items.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing; open sequences with the same content are one entry with a count."""
    by_room: dict[int, dict[Pattern, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in by_room or not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length  # new sequences: filling one by one is what best fit does with equal pieces
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            pattern, times = next(iter(by_room[room].items()))
            each = min(room // length, left)
            used = min(times, left // each)
            del by_room[room][pattern]
            if times > used:
                by_room[room][pattern] = times - used
            if not by_room[room]:
                rooms.pop(i)
            put(room - each * length, pattern + (length,) * each, used)
            left -= used * each
    return [(p, n) for entries in by_room.values() for p, n in entries.items()]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def plan_rows(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges of ranks: pieces lo <= rank < hi of a length go to sequences from sequence_id on, at offset."""
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return rows


# -- tokenising and placing, on the cluster ------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, task = tokens.encoder(path, end_id), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for part in words.chunks(batch, "text", CHUNK):
            ids, at = encoder.encode(part.column("text"))
            sizes = np.diff(at)
            n = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            order = np.argsort(length, kind="stable")  # rank of each piece among those of its length in this task
            run = length[order]
            first = np.searchsorted(run, run, side="left")
            nth = np.empty(len(order), np.int64)
            nth[order] = seen[run] + np.arange(len(order)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            bounds = np.concatenate((at[row] + start, at[-1:]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), tokens.blobs(ids, bounds), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)],
                names=["doc_id", "piece", "start", "length", "ids", "task", "nth"],
            )


def tokenise(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each with its task and its number among its length there."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _pieces(batches, path, end_id, capacity), PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its ids (little-endian uint32) and its place.

    Returns doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.  Only columns that are
    used later take part in the placing join, so ``ids`` is not shuffled unless asked for."""
    spark: SparkSession = docs.sparkSession
    pieces = saved(tokenise(docs, path or tokens.default_path(), end_id, capacity).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    by_task = saved(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    # The plan has some rows for each length, so its size is bounded by ``capacity`` alone.
    plan = spark.createDataFrame(plan_rows(solve(counts, capacity)), PLAN)
    # Where each task's pieces begin among all of a length: a self-join on the length would square the
    # tasks, a window over (length) holds one row for each task.
    order = "PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    before = by_task.selectExpr("task", "length", f"coalesce(sum(n) OVER ({order}), 0) AS lower_ranks", "n")
    # A task's pieces of one length, cut where the plan's ranges begin: rows grow with tasks and plan, not with pieces.
    cuts = before.join(F.broadcast(plan), "length").where("lo < lower_ranks + n AND hi > lower_ranks").selectExpr("task", "length", "greatest(lo - lower_ranks, 0) AS from_nth", "least(hi - lower_ranks, n) AS to_nth", "sequence_id + greatest(lower_ranks - lo, 0) AS first_sequence", "offset")
    runs = cuts.groupBy("task", "length").agg(F.array_sort(F.collect_list(F.struct("from_nth", "to_nth", "first_sequence", "offset"))).alias("runs"))
    run = F.element_at(F.filter("runs", lambda r: (r.from_nth <= F.col("nth")) & (F.col("nth") < r.to_nth)), 1)
    return (
        pieces.join(runs, ["task", "length"])
        .withColumn("run", run)
        .selectExpr("doc_id", "piece", "start", "length", "ids", "ids_crc32", "run.first_sequence + nth - run.from_nth AS sequence_id", "run.offset AS offset")
    )
