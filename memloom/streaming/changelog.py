"""Streams of change records: file sources, guarded state per handle, block ingest and overlays.

Late records aren't an error that stops a stream: a sequence that doesn't grow goes to a dead-letter
output, and what is accepted equals the batch result over the same order of arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.temporal import diff

ACCEPTED = "handle string, sequence long, payload string, verdict string"


def parquet_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _judge(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, content = state.get if state.exists else (-1, "")
    # What one handle sends in a batch comes in several frames, in any order; ``files_per_batch`` bounds it.
    given = [f for f in frames if len(f)]
    for frame in [pd.concat(given).sort_values("arrival", kind="stable")] if given else []:
        verdicts = []
        for sequence, payload in zip(frame["sequence"], frame["payload"], strict=True):
            if sequence > last:
                verdicts.append("accepted")
                last, content = int(sequence), payload
            elif sequence == last:
                verdicts.append("repeated" if payload == content else "fork")
            else:
                verdicts.append("regression")
        yield frame.assign(handle=key[0], verdict=verdicts)[["handle", "sequence", "payload", "verdict"]]
    state.update((last, content))


def guarded(stream: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """Records (handle, sequence, payload, arrival) with a verdict: accepted, repeated, fork or regression.

    State is one sequence and payload for each handle, in the state store of the checkpoint; with
    ``forget_after_ms`` a handle that has sent nothing for so long is forgotten."""
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def judge(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        timed_out = state.hasTimedOut
        yield from _judge(key, frames, state)
        if forget_after_ms is not None and not timed_out:
            state.setTimeoutDuration(forget_after_ms)

    return stream.groupBy("handle").applyInPandasWithState(judge, ACCEPTED, "last long, content string", "append", timeout)


def split_by_verdict(output: str, dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes accepted records to one table and all others to another.

    Each batch has a folder of its own, so that a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("verdict = 'accepted'").drop("verdict").write.mode("overwrite").parquet(f"{output}/batch={number}")
        batch.where("verdict <> 'accepted'").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        batch.unpersist()

    return write


def run_available(frame: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there and stop; the checkpoint's offsets let the next run go on after it."""
    return frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def blocks(stream: DataFrame, block_size: int) -> DataFrame:
    """Files (path, content) as blocks of ``block_size`` bytes with number, offset and digest."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / block_size)).cast("int")
    # Cut first, then dealt as rows: a row carries its block, never the whole file.
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("block"), F.substring("content", i * block_size + 1, F.lit(block_size)).alias("bytes")))
    out = stream.select("path", F.explode(cut).alias("x")).select("path", "x.block", "x.bytes")
    return out.select("path", "block", (F.col("block") * block_size).alias("offset"), "bytes", F.sha2("bytes", 256).alias("sha256"))


def window_counts(events: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Tumbling counts with a watermark (an extension: batches and streams alike)."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def overlay_writer(base: Callable[[], DataFrame], output: str, key: str, digest: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes what each batch of rows changes against the base: one overlay for each batch.

    A row whose digest is null, or whose column ``deleted`` is true, says that the key is gone: a deletion in the overlay."""

    def write(batch: DataFrame, number: int) -> None:
        gone = F.col(digest).isNull()
        if "deleted" in batch.columns:
            gone = gone | F.coalesce("deleted", F.lit(False))
        changed = diff(base().join(batch.select(key), key, "left_semi").select(key, digest), batch.where(~gone).select(key, digest), key, [digest])
        changed.write.mode("overwrite").parquet(str(PurePosixPath(output) / f"overlay={number}") if "://" not in output else f"{output}/overlay={number}")

    return write
