"""Semantics on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from memloom.functions import text, vector
from memloom.operators import context, graph, integrity, lexical, policy, search, temporal
from memloom.sources import code, snapshots


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_prefix_stops_where_skip_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 3), ("g", 4, 2)], "g string, i int, size int")
    assert values(context.prefix_stop(df, [F.col("i")], {"size": 10}, ["g"]), "i") == [(1,)]
    taken = context.skip_and_continue(df, ["g"], [F.col("i")], "size", 10, ["i"], 100)
    assert values(taken, "i", "accepted_rank") == [(1, 1), (3, 2), (4, 3)]
    assert values(context.skip_and_continue(df, ["g"], [F.col("i")], "size", 10, ["i"], 100, 2), "i") == [(1,), (3,)]


def test_global_budget_needs_a_candidate_limit(spark):
    df = spark.createDataFrame([(1, 5)], "i int, size int")
    with pytest.raises(ValueError, match="candidate_limit_required"):
        context.prefix_stop(df, [F.col("i")], {"size": 10})


def test_tiers_are_chosen_before_filters(spark):
    df = spark.createDataFrame([(1, "red", "a"), (2, "redder", "b"), (3, "infrared", "b")], "id int, name string, path string")
    assert values(search.tiered_search(df, "RED", ["name"], "id"), "id") == [(1,)]
    assert values(search.tiered_search(df, "red", ["name"], "id", where=F.col("path") == "b"), "id") == []
    assert values(search.tiered_search(df, "redd", ["name"], "id"), "id") == [(2,)]
    assert values(search.tiered_search(df, "zzz", ["name"], "id"), "id") == []


def test_events_since_never_truncates(spark):
    df = spark.range(10).withColumnRenamed("id", "s")
    assert search.events_since(df, "s", 6, 3).count() == 3
    with pytest.raises(ValueError, match="event_limit_exceeded"):
        search.events_since(df, "s", 5, 3)


def test_permitted_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("srcx/a.py",), ("src/../b",), ("/src/a",), ("C:/src",), ("src\\a",), ("src",)], "p string")
    assert [r[0] for r in df.select(search.permitted(F.col("p"), ["src"])).collect()] == [True, False, False, False, False, True, True]


def test_closure_keeps_the_first_discovery(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    start = spark.createDataFrame([("a",)], "id string")
    found = {r.id: (r.depth, list(r.path)) for r in graph.closure(start, edges, 2, keep_path=True).collect()}
    assert found == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"])}


def test_resolve_needs_a_unique_name(spark):
    nodes = spark.createDataFrame([(1, "m.f", "f"), (2, "n.f", "f"), (3, "m.g", "g")], "id int, qualified string, name string")
    requests = spark.createDataFrame([("2", "g"), ("x", "m.f"), ("x", "f"), ("x", "g")], "identifier string, name string")
    assert sorted(values(graph.resolve(requests, nodes), "name", "resolved"), key=str) == [("f", None), ("g", 2), ("g", 3), ("m.f", 1)]


def test_unknown_metrics_make_dominance_intransitive(spark):
    # a dominates b by x, b dominates c by y, a and c share no known objective.
    df = spark.createDataFrame([("a", 2, None), ("b", 1, 2), ("c", None, 1)], "name string, x int, y int")
    assert values(policy.frontier(df, {"x": True, "y": True}), "name") == [("a",)]
    lonely = spark.createDataFrame([("a", None, None), ("b", 1, None)], "name string, x int, y int")
    assert sorted(values(policy.frontier(lonely, {"x": True, "y": True}), "name")) == [("a",), ("b",)]


def test_unknown_fails_a_budget_and_passes_a_fingerprint(spark):
    df = spark.createDataFrame([(0.9, True, None, None), (0.9, True, 5, "h")], "quality double, available boolean, bytes int, hardware string")
    got = df.select(policy.filter_reason(0.5, {"bytes": 10}, {}).alias("a"), policy.filter_reason(0.5, {}, {"hardware": "g"}).alias("b"))
    assert values(got, "a", "b") == [("bytes_budget_unknown", None), (None, "hardware_mismatch")]


def test_versions_and_as_of(spark):
    df = spark.createDataFrame([("k", 1, "active"), ("k", 2, "active"), ("k", 3, "tombstoned")], "key string, seq int, state string")
    v = temporal.versions(df, ["key"], ["seq"], "state")
    assert values(v.orderBy("seq"), "valid_from", "valid_to", "version_state") == [(1, 2, "superseded"), (2, 3, "active"), (3, None, "tombstoned")]
    assert values(temporal.as_of(v, ["key"], 2), "seq") == [(2,)]
    assert values(temporal.as_of(v, ["key"], 3), "seq") == []
    assert values(temporal.as_of(v, ["key"], 3, include_tombstones=True), "seq") == [(3,)]


def test_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "id int, v string")
    assert sorted(values(temporal.diff(a, b, "id", ["v"]), "id", "change")) == [(2, "update"), (3, "delete"), (4, "add")]


def test_conflicting_facts_keep_the_old_row(spark):
    s = "handle string, version int, digest string, state string"
    old = spark.createDataFrame([("a", 1, "d", "active"), ("b", 1, "d", "active")], s)
    new = spark.createDataFrame([("a", 1, "e", "active"), ("b", 1, "d", "expired"), ("c", 1, "d", "active")], s)
    got = temporal.apply_facts(old, new, spark.createDataFrame([("c",)], "handle string"))
    assert sorted(values(got, "handle", "digest", "state", "conflicted")) == [("a", "d", "active", True), ("b", "d", "expired", False), ("c", "d", "tombstoned", False)]


def test_chain_faults(spark):
    chain = integrity.build_chain(spark.createDataFrame([("k", i, f"p{i}") for i in range(4)], "k string, s int, p string"), "k", "s", "p")
    assert integrity.chain_faults(chain, "k").count() == 0
    broken = chain.where("sequence <> 1").withColumn("payload", F.when(F.col("sequence") == 3, "x").otherwise(F.col("payload")))
    assert sorted(values(integrity.chain_faults(broken, "k"), "sequence", "reason")) == [(2, "sequence_gap"), (3, "record_mismatch")]


def test_rounding_away_and_to_even(spark):
    df = spark.createDataFrame([([7.0, 2.5, -2.5, 0.49, 0.0],), ([0.0, 0.0, 0.0, 0.0, 0.0],)], "x array<double>")
    got = df.select(vector.quantise(F.col("x")).alias("a"), vector.quantise(F.col("x"), 7, -7, even=True).alias("b")).collect()
    assert (got[0].a.codes, got[0].b.codes) == ([7, 3, -3, 0, 0], [7, 2, -2, 0, 0])
    assert got[1].a.scale == 1.0


def test_rotation_is_inverted_and_orthogonal(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 4.5],)], "x array<double>")
    turned = vector.rotate(F.col("x"), 4, 9)
    got = df.select(vector.rotate(turned, 4, 9, inverse=True).alias("back"), vector.dot(turned, turned).alias("n"), vector.dot(F.col("x"), F.col("x")).alias("m")).first()
    assert list(got.back) == [1.0, -2.0, 3.0, 4.5] and got.n == got.m


def test_transform_twice_is_the_identity(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    assert [round(v, 9) for v in df.select(vector.fwht(vector.fwht(F.col("x"), 4), 4)).first()[0]] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError, match="length_not_power_of_two"):
        vector.fwht(F.col("x"), 6)


def test_nibbles_with_an_odd_end(spark):
    df = spark.createDataFrame([([-8, 7, -1],)], "c array<int>")
    packed = vector.pack_nibbles(F.col("c"))
    got = df.select(packed.alias("p"), vector.unpack_nibbles(packed, 3).alias("u")).first()
    assert (list(got.p), list(got.u)) == ([0x78, 0x0F], [-8, 7, -1])


def test_text_functions(spark):
    df = spark.createDataFrame([("parseHTTPRequest2 the_name", "é" * 3, "api_key = abc, Bearer abcdefgh1")], "a string, b string, c string")
    value, flag = text.redact(F.col("c"))
    got = df.select(F.array_sort(text.lexical_tokens(F.col("a"))).alias("t"), text.utf8_prefix(F.col("b"), F.lit(3)).alias("b"), value.alias("c"), flag.alias("f"), text.task_terms(F.lit("Update the red Widget and red bolt")).alias("w")).first()
    assert list(got.t) == ["2", "http", "name", "parse", "request", "the"]
    assert (got.b, got.f) == ("é", True)
    assert got.c == "api_key = <redacted>, Bearer <redacted>"
    assert list(got.w) == ["red", "widget", "bolt"]


def test_knowledge_interval_is_closed(spark):
    s = "handle string, version int, text string, trust int, state string, source_type string, valid_from int, valid_until int, conflicted boolean"
    facts = spark.createDataFrame([("a", 1, "red bolt", 3, "active", "doc", 1, 5, False), ("b", 1, "red", 3, "active", "doc", 6, None, False), ("c", 1, "red", 0, "active", "doc", 1, None, False)], s)
    assert values(lexical.knowledge_query(facts, "Red bolt", floor=1, as_of=5, limit=9), "handle", "relevance") == [("a", 2)]


def test_capability_ranking_reasons(spark):
    s = "handle string, version int, capabilities array<string>, available boolean, policy_eligible boolean, cost int, latency int"
    rows = [("a", 1, ["x", "y"], True, True, 5, None), ("b", 1, ["x"], True, True, None, None), ("c", 1, ["x", "y"], True, None, None, 1), ("d", 1, ["x", "y"], False, False, 0, 0)]
    got = lexical.rank_capabilities(spark.createDataFrame(rows, s), ["x", "y"])
    assert sorted(values(got, "handle", "score", "reason")) == [("a", 195, "eligible"), ("b", -900, "missing_required_capabilities"), ("c", -4801, "policy_unknown"), ("d", -19800, "unavailable")]


def test_python_symbols_and_edges(spark):
    source = "import os\nclass A:\n    def test_f(self):\n        return os.path.join(g(1))\nasync def h():\n    pass\n"
    files = spark.createDataFrame([("a.py", source), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    symbols = sorted(values(code.python_symbols(files), "file", "qualified_name", "kind", "line"))
    assert symbols == [("a.py", "A", "class", 2), ("a.py", "A.test_f", "function", 3), ("a.py", "h", "async_function", 5)]
    edges = set(values(code.python_edges(files), "origin", "destination", "kind"))
    assert {("a.py", "os", "import"), ("A", "A.test_f", "test"), ("A.test_f", "g", "call"), ("A.test_f", "join", "call"), ("A.test_f", "os", "reference")} <= edges


def test_lexical_relations(spark):
    df = spark.createDataFrame([("f.ts", " ./a ", "import"), ("f.ts", "testX", "function"), ("f.ts", "B", "class")], "file string, name string, kind string")
    got = sorted(values(code.lexical_relations(df, "file", "name", "kind"), "origin", "destination", "kind", "confidence"))
    assert got == [("B", "B", "definition", 0.75), ("f.ts", "./a", "import", 0.5), ("f.ts", "testX", "test", 0.6), ("testX", "testX", "definition", 0.75)]


def test_snapshots_publish_refresh_and_fall_back(spark, tmp_path):
    root = str(tmp_path / "store")
    row = lambda i, t: (i, t)
    df = lambda rows: spark.createDataFrame(rows, "id int, content string").withColumn("digest", F.sha2("content", 256))
    first, second = df([row(1, "a"), row(2, "b")]), df([row(2, "b"), row(3, "c"), row(1, "z")])
    assert snapshots.current(spark, root) is None
    assert snapshots.refresh(spark, root, first, "id", "digest")["added"] == 2
    assert snapshots.refresh(spark, root, second, "id", "digest") == {"added": 1, "deleted": 0, "updated": 1, "reused": 1}
    assert snapshots.refresh(spark, root, second, "id", "digest") == {"added": 0, "deleted": 0, "updated": 0, "reused": 3}
    assert snapshots.current(spark, root).count() == 3
    assert snapshots.current(spark, root, back=1).count() == 2
    assert snapshots.generation_id(first, "digest") == snapshots.generation_id(first.orderBy(F.desc("id")), "digest")
    bad = second.withColumn("digest", F.lit("x")).unionByName(second.where("id = 1"))
    assert set(values(snapshots.verify(bad, "id", "content", "digest"), "reason")) == {("key_repeated",), ("digest_mismatch",)}


def test_segments_are_written_once_and_shared(spark, tmp_path):
    from memloom.sources import segments

    root, number = str(tmp_path), F.col("id") % 8
    rows = lambda changed: spark.range(64).select("id", F.sha2(F.concat("id", F.when(F.col("id") == changed, "x").otherwise("")), 256).alias("digest"))
    assert segments.publish_segments(rows(-1), root, number, "digest") == {"written": 8, "reused": 0}
    assert segments.publish_segments(rows(13), root, number, "digest") == {"written": 1, "reused": 7}
    assert segments.publish_segments(rows(-1), root, number, "digest") == {"written": 0, "reused": 8}
    for back, changed in ((0, -1), (1, 13), (2, -1)):
        assert sorted(map(tuple, segments.open_segments(spark, root, back).collect())) == sorted(map(tuple, rows(changed).collect()))
    assert segments.open_segments(spark, root, 3) is None


def test_two_publishers_do_not_take_one_number(spark, tmp_path):
    import pytest

    (tmp_path / "claims").mkdir()
    (tmp_path / "claims" / f"{1:012d}").touch()
    with pytest.raises(ValueError, match="generation_conflict"):
        snapshots.publish(spark.createDataFrame([(1, "a" * 64)], "id int, digest string"), str(tmp_path), "id", "digest")


def test_best_by_tokens_pads_with_the_least_documents(spark):
    from memloom.operators import lexical

    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, [])], "item int, tokens array<string>")
    docs = spark.createDataFrame([(9, ["a", "b"]), (8, ["b", "b"]), (1, ["q"]), (2, [])], "doc int, tokens array<string>")
    got = sorted((r.item, r.doc, r.score) for r in lexical.best_by_tokens(items, docs, "item", "doc", 3).collect())
    assert got == [(1, 1, 0.0), (1, 8, 0.5), (1, 9, 1.0), (2, 1, 0.0), (2, 2, 0.0), (2, 8, 0.0), (3, 1, 0.0), (3, 2, 0.0), (3, 8, 0.0)]
    plan = lexical.best_by_tokens(items, docs, "item", "doc", 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sealed_stores_and_ledgers(spark, tmp_path):
    import pytest

    from memloom.sources import stores

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    stores.save(df, str(tmp_path / "s"))
    assert sorted(map(tuple, stores.load(spark, str(tmp_path / "s")).collect())) == [(1, "a"), (2, None)]
    spark.createDataFrame([(1, "a"), (2, "")], df.schema).write.mode("overwrite").parquet(str(tmp_path / "s" / "rows"))
    with pytest.raises(ValueError, match="store_digest_mismatch"):
        stores.load(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="store_too_large"):
        stores.save(df, str(tmp_path / "t"), max_rows=1)
    path, schema = str(tmp_path / "ledger"), "k string, sequence long, payload string"
    assert stores.append(spark, path, spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 1, "late")], schema), "k") == 1
    assert stores.append(spark, path, spark.createDataFrame([("a", 2, "z"), ("b", 0, "w")], schema), "k") == 0
    assert stores.append(spark, path, spark.createDataFrame([("a", 2, "again")], schema), "k") == 1
    ledger = spark.read.parquet(path)
    assert sorted((r.k, r.sequence, r.payload) for r in ledger.collect()) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "w")]
    assert integrity.chain_faults(ledger, "k").count() == 0 and stores.valid_prefix(ledger, "k").count() == 4


def test_memory_facade(spark, tmp_path):
    from memloom.sdk import Memory
    from memloom.sources import segments

    rows = [("s1", "load", "a.py", "function", "load a table"), ("s2", "save", "b.py", "function", "save a table of rows"), ("s3", "other", "c.py", "class", "nothing here")]
    symbols = spark.createDataFrame(rows, "id string, name string, path string, kind string, text string").withColumn("digest", F.sha2("id", 256))
    relations = spark.createDataFrame([("s2", "s1", "call"), ("s3", "s2", "call")], "source string, target string, kind string").withColumn("digest", F.sha2("source", 256))
    segments.publish_segments(symbols, str(tmp_path / "symbols"), F.crc32(F.col("path").cast("binary")) % 4, "digest")
    segments.publish_segments(relations, str(tmp_path / "relations"), F.lit(0), "digest")
    m = Memory.open(spark, str(tmp_path))
    assert [r.id for r in m.find("save").collect()] == ["s2"]
    assert {(r.id, r.depth, r.complete) for r in m.impact(["s1"], max_depth=1).collect()} == {("s1", 0, False), ("s2", 1, False)}
    assert [r.id for r in m.context("Table rows", 100).collect()] == ["s2", "s1"]
    assert [r.id for r in m.neighbours("s3").collect()] == ["s2"]


def test_two_stage_recall(spark, sf):
    """Recall of ten against exact search, over queries of the table itself."""
    from memloom.operators import vectors

    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").cache()
    found = {"two_stage": 0, "lane": 0}
    rows = df.orderBy("vec_id").limit(8).collect()
    for r in rows:
        q = list(r.embedding)
        ids = lambda x: {y.vec_id for y in x.select("vec_id").collect()}
        found["two_stage"] += len(ids(vectors.exact(df, q, "vec_id", "embedding", "dot", 10)) & ids(vectors.two_stage(df, q, "vec_id", "embedding", "dot", 10)))
        found["lane"] += len(ids(vectors.exact(df, q, "vec_id", "embedding", "cosine", 10)) & ids(vectors.lane_search(df, q, "vec_id", "embedding", "Q2b", 10)))
    assert min(found.values()) >= 0.9 * 10 * len(rows), found


def test_frontier_of_groups_equals_all_pairs(spark):
    import random

    from memloom.operators import policy

    r = random.Random(2)
    rows = [(i, *(r.choice([None, 1.0, 2.0, 3.0, 4.0]) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    up = (True, False, True)

    def dominates(x, y):
        pairs = [(p, q) if u else (-p, -q) for p, q, u in zip(x[1:], y[1:], up, strict=True) if p is not None and q is not None]
        return bool(pairs) and all(p >= q for p, q in pairs) and any(p > q for p, q in pairs)

    want = {x[0] for x in rows if not any(dominates(y, x) for y in rows)}
    assert {x.id for x in policy.frontier(df, {"a": True, "b": False, "c": True}).collect()} == want


def test_summary_is_exact_with_ties_nulls_and_empty_groups(spark):
    import math
    import random

    rows = [("a", float(random.Random(i).randrange(40))) for i in range(301)] + [("b", None), ("c", 2.5), ("c", None), (None, 1.0), (None, 4.0)]
    got = {r.g: r for r in integrity.summary(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in ("a", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        want = (sum(v) / n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[math.ceil(95 * n / 100) - 1], v[math.ceil(99 * n / 100) - 1])
        assert (round(got[g]["mean"], 9), got[g]["median"], got[g]["p95"], got[g]["p99"]) == (round(want[0], 9), *want[1:])
    assert got["b"][1:] == (None, None, None, None)
    assert integrity.summary(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_closure_is_the_same_with_and_without_broadcasts(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 7 + k) % 50) for i in range(50) for k in (1, 2)] + [(3, None), (None, 4), (3, 22)], "source int, target int")
    start = spark.createDataFrame([(3,), (3,), (None,)], "id int")
    got = [sorted(map(tuple, graph.closure(start, edges, 4, keep_path).collect())) for keep_path in (False, True)]
    monkeypatch.setattr(graph, "BROADCAST_FRONTIER", 0)
    assert got == [sorted(map(tuple, graph.closure(start, edges, 4, keep_path).collect())) for keep_path in (False, True)]
    seen, frontier = {3: 0}, {3}
    for depth in range(1, 5):
        frontier = {(i * 7 + k) % 50 for i in frontier for k in (1, 2)} - set(seen)
        seen |= dict.fromkeys(frontier, depth)
    assert dict(got[0]) == seen
    assert graph.closure(start.where("id > 9"), edges, 3).count() == 0


def test_frames_round_trip_and_tell_what_is_bad(spark):
    from memloom.operators import frames

    rows = [(["a", "", "é" * 300, None, "z"],), ([],), (None,)]
    d = spark.createDataFrame(rows, "p array<string>").select(frames.encode(F.col("p")).alias("data"))
    got = [r.d for r in d.select(frames.decode(F.col("data"), 8, 1000).alias("d")).collect()]
    assert [bytes(x).decode() for x in got[0].frames] == ["a", "", "é" * 300, "z"]
    assert got[0].reason is None
    assert (got[1].frames, got[1].reason) == ([], None)
    assert got[2] is None
    one = d.limit(1)
    assert one.select(frames.decode(F.col("data"), 8, 500).alias("d")).first().d.reason == "frame_too_large"
    assert one.select(frames.decode(F.col("data"), 2, 1000).alias("d")).first().d.reason == "too_many_frames"
    assert one.select(frames.decode(F.expr("data || X'ff'"), 8, 1000).alias("d")).first().d.reason == "frame_truncated"
    assert one.select(frames.decode(F.expr("X'FFFFFFFF' || data"), 8, 1000).alias("d")).first().d.reason == "frame_too_large"
