"""Packed groups: the files of a group lie in chunks, each chunk with a run of delta-coded sizes at the end."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_group(files: list[bytes], chunks: int = 1) -> bytes:
    """Several files as one block: data by chunk, then big-endian size deltas by chunk, then the chunk count."""
    if len(files) == 1:
        return files[0]
    cut = [[f[len(f) * c // chunks : len(f) * (c + 1) // chunks] for f in files] for c in range(chunks)]
    sizes = b"".join(struct.pack(">i", len(p) - (len(parts[k - 1]) if k else 0)) for parts in cut for k, p in enumerate(parts))
    return b"".join(p for parts in cut for p in parts) + sizes + bytes([chunks])


def unpack_group(block: bytes, count: int) -> list[bytes]:
    """The inverse of ``pack_group``."""
    if count == 1:
        return [block]
    chunks = block[-1]
    deltas = struct.unpack(f">{chunks * count}i", block[-1 - 4 * chunks * count : -1])
    out, at = [b""] * count, 0
    for c in range(chunks):
        size = 0
        for k in range(count):
            size += deltas[c * count + k]
            out[k] += block[at : at + size]
            at += size
    return out


def container(data: bytes, kind: int = 0) -> bytes:
    """A container: kind (0 plain, 1 bzip2, 2 deflated with gzip framing), length, then for kinds but 0 the full length."""
    if kind == 0:
        return struct.pack(">BI", 0, len(data)) + data
    if kind == 1:
        import bz2

        body = bz2.compress(data, 1)[4:]
        return struct.pack(">BII", 1, len(body), len(data)) + body
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    body = packer.compress(data) + packer.flush()
    return struct.pack(">BII", kind, len(body), len(data)) + body


def open_container(raw: bytes) -> bytes:
    """The data of a container; kind 1 is a bzip2 stream without its four-byte signature."""
    kind, size = struct.unpack(">BI", raw[:5])
    if kind == 0:
        return raw[5 : 5 + size]
    body = raw[9 : 9 + size]
    if kind == 1:
        import bz2

        return bz2.decompress(b"BZh1" + body)
    return zlib.decompress(body, 31)


def split_groups(groups: DataFrame) -> DataFrame:
    """``(grp, file, data)`` of ``groups (grp, count, raw)``, raw being a container of a packed group."""

    def run(batches):
        for batch in batches:
            rows = [(g, k, f) for g, n, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "count", "raw")), strict=True) for k, f in enumerate(unpack_group(open_container(raw), n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["grp", "file", "data"])

    return groups.mapInArrow(run, "grp int, file int, data binary")


def read_flat(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, data)`` of the wanted ``ids (id)`` in ``groups (grp, raw)`` of an archive whose groups hold one file each, or which is one group."""
    wanted = groups.join(ids.select(F.col("id").alias("grp")).distinct(), "grp", "left_semi")
    return split_groups(wanted.select("grp", F.lit(1).alias("count"), "raw")).select(F.col("grp").alias("id"), "data")
