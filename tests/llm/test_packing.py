import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from memloom.llm import packing, tokens


@pytest.mark.parametrize("seed", range(6))
def test_counted_instance_is_packed_whole(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 4096])
    counts = Counter(r.randint(1, r.choice([capacity, capacity // 2])) for _ in range(r.randint(0, 400)))
    patterns = packing.solve(dict(counts), capacity)
    packed = Counter()
    for p, n in patterns:
        assert sum(p) <= capacity and n > 0
        for x in p:
            packed[x] += n
    assert packed == counts
    assert sum(n for _, n in patterns) <= sum(n for _, n in packing.best_fit(dict(counts), capacity)) + 1


def optimum(items, capacity):
    """Fewest sequences, by search."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {rooms[k]: k for k in range(len(rooms))}.values():
            if rooms[k] >= items[i]:
                place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_loses_no_optimum(seed):
    r = random.Random(seed)
    items = [r.randint(2, 16) for _ in range(r.randint(1, 9))]
    fixed, rest = packing.reduce_instance(dict(Counter(items)), 16)
    left = [k for k, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + optimum(left, 16) == optimum(items, 16)


def check(spark, df, path, capacity=64):
    encoder = tokens.WordEncoder(path)
    rows = packing.pack(df, path, capacity=capacity).collect()
    want = Counter()
    for d in df.select("doc_id", "text").collect():
        ids = encoder.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            want[d.doc_id, k // capacity, k, tuple(ids[k : k + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack_documents(spark, docs, path):
    check(spark, docs, path, 4096)


def test_pack_odd_rows(spark, odd, path):
    check(spark, odd, path)


def test_pack_nothing(spark, empty, path):
    assert packing.pack(empty, path).count() == 0
