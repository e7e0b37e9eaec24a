"""Streams against the batch result over the same files."""

from pyspark.sql import functions as F

from memloom.operators import temporal
from memloom.streaming import changelog

RECORD = "handle string, sequence long, payload string, arrival long"


def test_accepted_records_equal_the_batch_and_late_ones_go_aside(spark, tmp_path):
    source, out, dead = (str(tmp_path / x) for x in ("in", "out", "dead"))
    rows = [("a", 1, "p", 1), ("a", 3, "q", 2), ("a", 2, "late", 3), ("a", 3, "q", 4), ("a", 3, "other", 5), ("b", 7, "r", 6)]
    spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(source)
    stream = changelog.guarded(changelog.parquet_stream(spark, source, RECORD))
    changelog.run_available(stream, str(tmp_path / "c"), changelog.split_by_verdict(out, dead)).awaitTermination()
    spark.createDataFrame([("a", 2, "older", 7), ("a", 9, "new", 8)], RECORD).coalesce(1).write.mode("append").parquet(source)
    changelog.run_available(stream, str(tmp_path / "c"), changelog.split_by_verdict(out, dead)).awaitTermination()
    accepted = spark.read.parquet(out).select("handle", "sequence", "payload")
    assert sorted(map(tuple, temporal.latest(accepted, ["handle"], "sequence").collect())) == [("a", 9, "new"), ("b", 7, "r")]
    assert sorted((r.sequence, r.verdict) for r in spark.read.parquet(dead).collect()) == [(2, "regression"), (2, "regression"), (3, "fork"), (3, "repeated")]


def test_frames_in_any_order_are_judged_by_arrival():
    import pandas as pd

    class State:
        exists, hasTimedOut = False, False

        def update(self, value):
            self.value = value

    frames = [pd.DataFrame({"handle": ["a"], "sequence": [s], "payload": ["p"], "arrival": [s]}) for s in (3, 1, 2)]
    state = State()
    out = pd.concat(changelog._judge(("a",), iter(frames), state))
    assert list(out["verdict"]) == ["accepted"] * 3 and state.value == (3, "p")


def test_blocks_put_together_are_the_file(spark):
    df = spark.createDataFrame([("f", bytearray(b"0123456789")), ("empty", bytearray(b""))], "path string, content binary")
    got = {(r.path, r.block): (r.offset, bytes(r.bytes)) for r in changelog.blocks(df, 4).collect()}
    assert got == {("f", 0): (0, b"0123"), ("f", 1): (4, b"4567"), ("f", 2): (8, b"89"), ("empty", 0): (0, b"")}


def test_overlays_hold_what_a_batch_changes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, digest string")
    base = base.union(spark.createDataFrame([(4, "e")], base.schema))
    spark.createDataFrame([(1, "a"), (2, "c"), (3, "d"), (4, None)], "id int, digest string").coalesce(1).write.parquet(source)
    stream = changelog.parquet_stream(spark, source, "id int, digest string")
    changelog.run_available(stream, str(tmp_path / "c"), changelog.overlay_writer(lambda: base, out, "id", "digest")).awaitTermination()
    assert sorted((r.id, r.change) for r in spark.read.parquet(out).collect()) == [(2, "update"), (3, "add"), (4, "delete")]


def test_window_counts_in_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changelog.window_counts(changelog.parquet_stream(spark, str(tmp_path / "in"), events.schema), "ts", "k", "1 hour", "10 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("window_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = changelog.window_counts(events, "ts", "k", "1 hour", "10 minutes")
    assert sorted(map(tuple, spark.sql("SELECT * FROM window_counts").collect())) == sorted(map(tuple, batch.collect()))
