import numpy as np
import pytest

from memloom.llm import near_dedup as nd
from memloom.llm.components import components


def brute(texts):
    sets = {}
    for d, t in texts.items():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.cluster(df).collect()}


def test_documents(docs, texts):
    assert result(docs) == brute(texts)


def test_chains_and_families(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {100 + k: " ".join(base[: 60 - k] + [f"x{k}_{i}" for i in range(k)]) for k in range(0, 24, 3)}  # each near its neighbours alone
    texts |= {200 + k: " ".join(base[:20] + [f"y{k}_{i}" for i in range(40)]) for k in range(20)}  # share a passage, no more
    texts |= {300 + k: " ".join(base).upper() for k in range(5)}
    assert result(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")) == brute(texts)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    common = [f"w{i}" for i in range(80)]
    texts = {k: " ".join(common + [f"z{k}_{i}" for i in range(12 + k % 3 * 6)]) for k in range(30)}
    assert result(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")) == brute(texts)


def test_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.cluster(odd).collect()]
    assert len(got) == odd.count()
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)}
    assert sorted(g for g in got if g[0] in (4, 5)) == [(4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False)]
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, None, True), (1, None, True)]
    one = nd.dedup(odd)
    assert one.columns == odd.columns
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in one.collect())) == [(False, 0), *((True, d) for d in (1, 2, 3, 4, 6, 7, 8))]


def test_rows_of_one_doc_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (7, a + " more"), (7, b), (7, b), (9, b + " more"), (9, None), (11, "something else entirely"), (11, None), (12, None)]
    df = spark.createDataFrame([(d, t, k % 2) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _row int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.cluster(df).collect())
    assert [(d, c) for d, _, c, _ in got] == [(3, 3), (7, 3), (7, 3), (7, 3), (9, 3), (9, 3), (11, 11), (11, 11), (12, 12)]
    assert sorted(r.doc_id for r in nd.dedup(df.select("doc_id", "text")).collect()) == [3, 11, 12]


@pytest.mark.parametrize("seed", range(4))
def test_bin_counts_never_rule_out_a_similar_pair(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        n = int(r.integers(1, [30, 300, 3000, 9000][seed]))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[r.random(len(a)) < r.choice([0.7, 0.85, 0.9, 1.0])]
        sets.append((a, np.unique(np.concatenate((keep, r.integers(0, 1 << 63, int(r.integers(0, n // 5 + 1))).astype(np.uint64))))))
    sets = [(a, b) for a, b in sets if len(a) and len(b)]
    n_a, n_b = (np.array([len(s[k]) for s in sets]) for k in (0, 1))
    both = np.array([len(np.intersect1d(a, b)) for a, b in sets])
    similar = 100 * both >= nd.THRESHOLD * (n_a + n_b - both)
    may = nd.may_overlap([nd.bin_counts(a) for a, _ in sets], [nd.bin_counts(b) for _, b in sets], n_a, n_b)
    assert may[similar].all() and similar.any()
    assert not nd.may_overlap([nd.bin_counts(sets[0][0])], [nd.bin_counts(sets[0][0] ^ np.uint64(1 << 62))], n_a[:1], n_a[:1]).any() or n_a[0] < 20
    assert nd.bin_counts(np.arange(300, dtype=np.uint64)) == b""  # all in one bin


def test_nothing(empty):
    assert nd.cluster(empty).count() == 0


def test_index_finds_every_pair_within_the_distance():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 16, (300, nd.SLOTS)).astype(np.uint16)
    b = a.copy()
    for i in range(len(b)):
        at = r.choice(nd.SLOTS, nd.MAX_ERRORS, replace=False)
        b[i, at] ^= 1
    shared = nd.index_keys(a) == nd.index_keys(b)
    assert shared.any(axis=1).all()
    first = nd.first_key(a, b)
    assert (first == np.where(shared.any(axis=1), shared.argmax(axis=1), -1)).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in r.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.u: x.root for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
