"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .store import cut


def _running(batches):
    """Adds the partition, and the bytes and rows before each row within it."""
    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(sizes)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, "int32")), pa.array((ends - sizes).astype("int64")), pa.array(np.arange(rows, rows + n, dtype="int64"))],
            names=[*batch.schema.names, "part", "bytes_before", "rows_before"],
        )
        total, rows = int(ends[-1]) if n else total, rows + n


def shard_documents(docs: DataFrame, n_shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Put ``docs (doc_id, text)`` into ``n_shards`` contiguous runs of ascending doc_id with near-equal bytes.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1, CRC of no bytes). Rows are sorted
    by (doc_id, size, CRC); one pass keeps each partition's running sums, the totals of the
    partitions (one row each) give global offsets, and a row goes to shard
    ``offset * n_shards // total``: each shard's bytes differ from the target by less than the two
    documents at its ends. Null doc_ids come first. Repeated rows are rows like any other. An
    empty table gives none. Columns besides doc_id, text and those in ``carry`` aren't read,
    whatever their names; columns named in ``carry`` are returned inside the struct ``row``.
    Equal texts are not kept together: the law is ``bytes``.
    """
    ship(docs.sparkSession)
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ("doc_id", "size", "text_crc32")
    placed = sized.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema) + ", part int, bytes_before long, rows_before long"
    placed = cut(placed.mapInArrow(_running, schema), "shards")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
    bases, all_bytes, all_rows = [], 0, 0
    for t in totals:
        bases.append((t.part, all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + t.bytes, all_rows + t.rows
    # one row for each partition, so small by construction
    base = F.broadcast(spark.createDataFrame(bases, "part int, bytes_base long, rows_base long"))
    offset = F.col("bytes_base") + F.col("bytes_before")
    shard = F.least(F.lit(n_shards - 1), F.floor((offset / F.lit(float(max(1, all_bytes)))) * n_shards)).cast("int")
    placed = placed.join(base, "part").select("*", shard.alias("shard"), (F.col("rows_base") + F.col("rows_before")).alias("at"))
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv]), F.col("shard")) if firsts else F.lit(0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else [])
    )
