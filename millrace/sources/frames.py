"""Framed messages: an id byte, a length that is fixed or has 8 or 16 bits, then the payload."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lengths that stand for "the next byte" and "the next two bytes".
U8, U16 = -1, -2


def frame(kind: int, payload: bytes, lengths: dict[int, int]) -> bytes:
    size = lengths[kind]
    head = struct.pack(">B", kind) + (struct.pack(">B", len(payload)) if size == U8 else struct.pack(">H", len(payload)) if size == U16 else b"")
    return head + payload


def parse(raw: bytes, lengths: dict[int, int]) -> tuple[list[tuple[int, bytes]], bytes]:
    """The whole frames of a block, and the bytes of one that isn't there in full yet."""
    out, at = [], 0
    while at < len(raw):
        kind, begin = raw[at], at + 1
        if kind not in lengths:
            raise ValueError(f"unknown message {kind} after {[k for k, _ in out[-3:]]}")
        size = lengths[kind]
        if size < 0:
            wide = -size
            if begin + wide > len(raw):
                break
            size, begin = int.from_bytes(raw[begin : begin + wide]), begin + wide
        if begin + size > len(raw):
            break
        out.append((kind, raw[begin : begin + size]))
        at = begin + size
    return out, raw[at:]


def split_frames(blocks: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """``(seq, place, kind, payload)`` of ``blocks (seq, raw)``, each block holding whole frames."""

    def run(batches):
        for batch in batches:
            rows = []
            for seq, raw in zip(batch.column("seq").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                found, rest = parse(raw or b"", lengths)
                if rest:
                    raise ValueError(f"block {seq} ends within a frame")
                rows += [(seq, k, kind, payload) for k, (kind, payload) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["seq", "place", "kind", "payload"])

    return blocks.mapInArrow(run, "seq long, place int, kind int, payload binary")
