import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from memloom.llm import line_dedup, quality, substring_dedup
from memloom.llm import queries as q

BLANK = " \t\n\x0b\x0c\r"


def dedup_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add((d is not None, d or 0))
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= min_docs and (d is not None, d or 0) != max(held[key(x)]) for x in lines]
        out[d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)] += 1
    return out


def lines_result(df, **kw):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup(df, **kw).collect())


def test_lines_of_documents(docs, texts):
    assert lines_result(docs) == dedup_lines(list(texts.items()))


def test_lines_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert lines_result(odd.select("doc_id", "text"), min_chars=1, min_docs=2) == dedup_lines(rows, 1, 2)
    assert line_dedup.dedup(odd).columns[: len(odd.columns)] == odd.columns


def test_lines_are_folded_and_trimmed(spark):
    long = "The same LINE, É included, in many documents"
    rows = [(k, f"own {k}\n \t{long.upper() if k % 2 else long}\x0b\nlast") for k in range(7)]
    rows = [(k, t.replace("É", "É")) for k, t in rows]
    assert lines_result(spark.createDataFrame(rows, "doc_id long, text string")) == dedup_lines(rows)


def test_bitmaps_are_runs(spark):
    line = "x" * 45
    df = spark.createDataFrame([(k, f"a\n{line}\n{line}\nb") for k in range(5)], "doc_id long, text string")
    got = {r.doc_id: [(x.first, x["count"]) for x in r.kept] for r in line_dedup.keep_bitmaps(df).collect()}
    assert set(got) == {0, 1, 2, 3} and all(v[0] == (0, 1) and v[1][0] == 3 for v in got.values())


def test_no_lines(empty):
    assert line_dedup.dedup(empty).count() == 0


def without_repeats(docs, width):
    """What the contract of op4 asks for, by a set of windows."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("width,anchor,bits", [(20, 8, 64), (5, 2, 64), (20, 8, 12)])
def test_spans_of_documents(docs, texts, width, anchor, bits):
    """Also with hashes of 12 bits, most of which are equal where words are not."""
    if bits < 64:
        texts = dict(sorted(texts.items())[:120])
        docs = docs.where(F.col("doc_id").isin(*texts))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.dedup(docs, width, anchor, bits).collect()}
    assert got == without_repeats(list(texts.items()), width)


def test_spans_are_long_and_follow_their_sources(spark):
    passage = [f"p{i}" for i in range(200)]
    rows = [(k, " ".join([f"own{k}_{i}" for i in range(30)] + passage + [f"end{k}"])) for k in range(4)]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(s.doc_id, s.start, s.words, s.src_doc, s.src_start) for s in sorted(spans)] == [(k, 30, 200, 0, 30) for k in (1, 2, 3)]


def test_spans_of_odd_rows(odd):
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(odd).collect())
    n = 90000
    assert got[6, n, n - 3] == 1  # periodic text: all windows but the three of the first period repeat
    assert got[1, 0, 0] == got[2, 0, 0] == got[3, 0, 0] == 1 and got[5, 3, 0] == 2 and got[None, 4, 0] == 1
    assert sum(got.values()) == odd.count()


def test_no_spans(empty):
    assert substring_dedup.dedup(empty).count() == 0
    with pytest.raises(ValueError, match="anchor_exceeds_width"):
        substring_dedup.dedup(empty, 4, 5)


def base(text):
    text = text or ""
    w = text.encode().split()
    at, seen, dup, covered = defaultdict(list), set(), 0, set()
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_quality_counts(spark, sf, odd):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (d, odd.withColumn("source", F.lit(None).cast("string"))):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect())
        assert got == Counter((i, *base(t)) for i, t in texts)


def test_boilerplate_is_counted_by_host(spark):
    own = lambda k: " ".join(f"own{k}_{i}" for i in range(12))
    common = " ".join(f"Common{i}" for i in range(60))
    rows = [(k, "a", f"{own(k)}\n{common}") for k in range(4)] + [(10 + k, "b", f"{own(k)}\n {common.lower()}\n{common}") for k in range(2)] + [(20, "a", own(20))]
    got = {r.doc_id: (r.n_boilerplate, r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_docs=3, max_per_mille=500).collect()}
    assert got == {**{k: (60, False) for k in range(4)}, 10: (0, True), 11: (0, True), 20: (0, True)}


def test_rows_of_one_document_count_once_and_common_lines_leave(spark):
    common, rows = "A common  LINE of words", [(k, "a", f"own {k}\n a common line of words \n\nlast") for k in range(3)]
    rows += [(1, "a", f"a common line of words\nother text {k}") for k in range(4)] + [(None, "a", common), (None, "a", common), (9, "b", common), (8, "a", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, gone int")
    lost = lambda most: sorted(r.n_boilerplate for r in quality.judge(df, max_docs=most, max_per_mille=1).collect())
    assert lost(4) == [0] * 11 and sum(x > 0 for x in lost(3)) == 9  # four documents hold it, in nine rows
    got = quality.without_common_lines(df, max_docs=3, max_per_mille=1)
    assert got.columns == df.columns
    want = Counter((d, t if s == "b" or t is None else "\n".join(x for x in t.split("\n") if x.lower().split() != common.lower().split())) for d, s, t in rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_no_quality(empty):
    assert quality.judge(empty.withColumn("source", F.lit("x"))).count() == 0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    got = q.queries()[name](spark, sf)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    relation = c.sql(q.oracle_sql()[name])
    columns = list(relation.columns)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(relation.fetchall())
