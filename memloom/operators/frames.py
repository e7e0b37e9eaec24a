"""Records as frames of bytes: a length of four bytes, the payload, and its sha256.

All of it is Column expressions, so that frames are written and read where the rows are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vector import let

HEAD, SEAL = 4, 32
#: What ``decode`` gives: the frames that are whole, and why the rest isn't (null where nothing is left).
DECODED = "struct<at: int, frames: array<binary>, reason: string>"


def frame(payload: Column) -> Column:
    """A payload (text or binary) as one frame; null stays null."""
    body = payload.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 2 * HEAD, "0")), body, F.unhex(F.sha2(body, 256)))


def encode(payloads: Column) -> Column:
    """An array of payloads as the bytes of their frames, in order; null payloads have no frame."""
    present = F.filter(payloads, lambda p: p.isNotNull())
    return F.aggregate(present, F.lit(b""), lambda whole, p: F.concat(whole, frame(p)))


def decode(data: Column, max_frames: int, max_bytes: int) -> Column:
    """Bytes back to ``DECODED``, up to the first frame that is bad: frame_truncated, frame_too_large, checksum_mismatch or too_many_frames.

    ``max_frames`` and ``max_bytes`` (of one payload) bound the work; what lies beyond is told by the reason.  Null stays null."""
    empty = F.from_json(F.lit('{"at": 0, "frames": []}'), DECODED)

    def step(state: Column, _: Column) -> Column:
        at, left = state["at"], F.octet_length(data) - state["at"]
        size = F.conv(F.hex(F.substring(data, at + 1, F.lit(HEAD))), 16, 10).cast("long")
        body = F.substring(data, at + 1 + HEAD, size.cast("int"))
        seal = F.substring(data, at + 1 + HEAD + size.cast("int"), F.lit(SEAL))
        reason = (
            F.when(left < HEAD + SEAL, "frame_truncated").when(size > max_bytes, "frame_too_large").when(left < HEAD + SEAL + size, "frame_truncated")
            .when(F.unhex(F.sha2(body, 256)) != seal, "checksum_mismatch")
        )
        new = let(reason, lambda r: F.struct(
            F.when(r.isNull(), (at + HEAD + SEAL + size).cast("int")).otherwise(at).alias("at"),
            F.when(r.isNull(), F.concat(state["frames"], F.array(body))).otherwise(state["frames"]).alias("frames"), r.alias("reason"),
        ))
        return F.when(state["reason"].isNotNull() | (left <= 0), state).otherwise(new)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(max_frames)), empty, step)
    beyond = lambda s: F.when(s["reason"].isNull() & (s["at"] < F.octet_length(data)), "too_many_frames").otherwise(s["reason"])
    return F.when(data.isNotNull(), let(last, lambda s: F.struct(s["at"].alias("at"), s["frames"].alias("frames"), beyond(s).alias("reason"))))
