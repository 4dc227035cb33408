"""Streams: windowed rates, latest values and dedupe by the last accepted ids."""

from __future__ import annotations

import json
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cutting import shared_dir
from ..operators.state import accept_ids

_PARTITIONS = "spark.sql.shuffle.partitions"


def windowed_rates(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Rows in each tumbling window; windows close when the watermark passes them."""
    kind = events.schema[ts].dataType
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # a watermark takes no other type
    return timed.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast(kind).alias("start"), "n")


def latest_values(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key's last values: a running maximum, for complete or update mode."""
    last = F.max(F.struct(*order, *[F.col(v).alias(f"__{v}") for v in values])).alias("__l")
    return events.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__l.__{v}").alias(v) for v in values])


def dedupe_recent(events: DataFrame, key: str, order: list[str], ident: str, size: int = 100, idle_ms: int | None = None) -> DataFrame:
    """Rows whose id isn't among the last ``size`` accepted for their key; a ring idle for ``idle_ms`` is dropped (None: never).

    Within a batch a key's rows are taken in order; the ring is the key's state.
    """
    columns = events.columns

    def run(_, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        ring = deque(json.loads(state.get[0]) if state.exists else [], maxlen=size)
        rows = pd.concat(list(batches)).sort_values(order)
        keep = accept_ids([None if pd.isna(i) else i for i in rows["__id"]], ring, set(ring))
        state.update((json.dumps(list(ring)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows[pd.Series(keep, index=rows.index, dtype=bool)][columns]

    marked = events.withColumn("__id", F.col(ident).cast("string"))  # whole, whatever nulls are beside it
    return marked.groupBy(key).applyInPandasWithState(run, events.schema, "ring string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def drain(stream: DataFrame, mode: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream over what is there now, its rows written as Parquet in the shared folder.

    In append mode a file sink takes the rows; else each batch writes the whole result and the last counts. A state with few keys
    needs but few ``partitions``, the session's at most.
    """
    spark = stream.sparkSession
    parts = int(spark.conf.get(_PARTITIONS))
    spark.conf.set(_PARTITIONS, str(min(parts, partitions or parts)))
    try:
        return _drain(stream, mode)
    finally:
        spark.conf.set(_PARTITIONS, str(parts))


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        done.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows-{max(done)}") if done else spark.createDataFrame([], stream.schema)
