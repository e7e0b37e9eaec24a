import pytest
from pyspark.sql import functions as F

from memloom.functions import vector
from memloom.operators import context, contracts, search, vectors, views
from memloom.sources import snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_items_with_nulls_and_equal_records(spark):
    good = "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"
    items = spark.createDataFrame(
        [("a", "k", "src/x", "foo", good, "g"), ("a", "k", "src/x", "foo", good, "g"), ("b", "k", None, "foo", good, "g"), ("c", "k", "src/x", None, good, "g"), ("d", "k", "srcx/y", "foo", good, "g"), ("e", "k", "src", "foo", good, None)],
        "handle string, kind string, path string, content string, sha256 string, generation string",
    )
    got = rows(views.item_faults(items, ["src"], "g").select("handle", "reason"))
    assert got == [("a", None), ("a", None), ("b", "path_escape"), ("c", "item_tampered"), ("d", "root_forbidden"), ("e", "generation_stale")]
    assert views.item_faults(items.limit(0), ["src"], "g").count() == 0


def test_materialise_skips_and_abstains(spark):
    sha = F.sha2("content", 256)
    items = spark.createDataFrame([(1, "a", "x", 5), (1, "b", "y", 9), (1, "c", "z", 4), (2, "d", "w", 99)], "g int, handle string, content string, tokens long")
    items = items.select("*", F.lit("k").alias("kind"), F.lit("src/f").alias("path"), sha.alias("sha256"), F.lit("v").alias("generation"))
    out = {r.g: r for r in views.materialise(items, ["g"], ["src"], "v", 10, 5, 100).collect()}
    assert (out[1].offered, out[1].taken, out[1].tokens) == (3, 2, 9)
    assert (out[2].taken, out[2].tokens) == (0, 0) and out[2].digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_line_spans_cut_the_text(spark):
    files = spark.createDataFrame([("a", "one\n\nthree"), ("b", ""), ("c", None), ("d", "x\n")], "path string, content string")
    spans = views.line_spans(files).join(files, "path")
    cut = spans.select("path", "line", F.expr("substring(coalesce(content, ''), cast(start + 1 AS int), cast(end - start AS int))").alias("s"))
    assert rows(cut) == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "three"), ("b", 1, ""), ("c", 1, ""), ("d", 1, "x"), ("d", 2, "")]


def test_view_seal_keeps_fields_apart(spark):
    one, two = spark.range(1).select(views.view_seal(F.lit("ab"), F.lit("c")), views.view_seal(F.lit("a"), F.lit("bc"))).first()
    assert one != two


def test_navigation_budget_and_names(spark):
    df = spark.createDataFrame([({"nodes": 9999, "depth": 7},), ({"bytes": 0},), (None,)], "m map<string,int>")
    budget, fault = views.navigation_budget(F.col("m"))
    assert [tuple(r) for r in df.select(budget["nodes"], budget["bytes"], budget["depth"], fault).collect()] == [(4096, 8192, 7, None), (None, None, None, "invalid_budget"), (20, 8192, 1, None)]
    names = spark.createDataFrame([(" Dense-Quantized",), ("SQTN quant",), ("other",), (None,)], "s string")
    assert [r[0] for r in names.select(views.representation(F.col("s"))).collect()] == ["dense_quant", "sqtn", None, None]


def test_live_hits(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 4)], "k string, at int")
    assert rows(contracts.live_hits(df, "k", "at", 5).select("k", "at", "hit")) == [("a", 1, False), ("a", 3, True), ("a", 9, False), ("b", 4, False)]


def test_recovery_refuses_what_is_broken(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string").withColumn("digest", F.sha2("text", 256))
    root = str(tmp_path / "store")
    snapshots.publish(df, root, "id", "digest")
    with pytest.raises(ValueError, match="generation_missing"):
        snapshots.recover_previous(spark, root, "text")
    snapshots.publish(df.where("id = 1"), root, "id", "digest")
    assert snapshots.recover_previous(spark, root, "text").count() == 2
    snapshots.publish(df.where("id = 2").withColumn("text", F.lit("z")), root, "id", "digest")
    snapshots.publish(df, root, "id", "digest")
    with pytest.raises(ValueError, match="generation_tampered"):
        snapshots.recover_previous(spark, root, "text")


def test_candidates_by_codes_hold_the_nearest(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    found, wanted = 0, 0
    for q in embeddings.where("vec_id % 100 = 0").collect():
        best = {r.vec_id for r in vectors.exact(embeddings, list(q.embedding), "vec_id", "embedding", "dot", 10).collect()}
        near = {r.vec_id for r in vectors.approximate(embeddings, list(q.embedding), "vec_id", "embedding", "dot", 40).collect()}
        found, wanted = found + len(best & near), wanted + len(best)
    assert found >= 0.9 * wanted


def test_grouped_and_union_of_sources(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "g string, i int")
    assert rows(search.grouped(df, ["g"], ["i"])) == [("a", 1, 2, 1), ("a", 2, 2, 2), (None, 4, 2, 1), (None, 5, 2, 2)]
    assert rows(context.union_sources({"x": df, "y": df.limit(0)}, ["i"])) == [(1, "x"), (2, "x"), (4, "x"), (5, "x")]
    with pytest.raises(ValueError, match="sources_missing"):
        context.union_sources({}, ["i"])


def test_splitmix64_gives_the_published_sequence():
    step = 0x9E3779B97F4A7C15
    assert [vector.splitmix64(i * step % 2**64) for i in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
