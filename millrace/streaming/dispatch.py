"""One stream of messages of many types, written to a typed table each in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files

_KIND = "__kind"


class Dispatcher:
    """Routes messages by type: ``routes`` has for each type the columns of its table, by name.

    A batch is written by one job: its rows are dealt to a folder for each type, with that type's columns in a
    struct and nulls for the others, which take no room. A type that no route has is told by the
    same job; then the batch raises with the last three types up to it by ``order``, and nothing of it is seen. A
    batch counts from when its mark is there, which is written last, so one that comes again changes nothing. Null
    types are unknown ones.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str, order: list[str], routes: dict[str, dict[str, Column]]):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.kind, self.order, self.routes = kind, order, routes
        self.fields = {t: f"t{k}" for k, t in enumerate(routes)}

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("done") if n.isdigit())

    def apply(self, batch: DataFrame, number: int) -> None:
        """Writes a batch; fit for ``foreachBatch``."""
        if number in self.batches():
            return
        kind = F.col(self.kind)
        known = F.coalesce(kind.isin(*self.routes), F.lit(False))
        arms = [F.when(kind == t, F.struct(*[c.alias(n) for n, c in columns.items()])).alias(self.fields[t]) for t, columns in self.routes.items()]
        seen = Observation()
        first = F.min(F.when(~known, F.struct(*self.order, kind.alias(_KIND))))
        to = F.element_at(F.create_map(*[F.lit(x) for t in self.fields.items() for x in t]), F.when(known, kind)).alias(_KIND)
        batch.observe(seen, first.alias("unknown")).where(known).select(*arms, to).write.mode("overwrite").partitionBy(_KIND).parquet(f"{self.folder}/batch-{number}")
        unknown = seen.get["unknown"]
        if unknown is not None:
            self.files.delete(f"batch-{number}")
            place = F.struct(*[F.col(o) for o in self.order])
            upto = batch.where(place <= F.struct(*[F.lit(unknown[o]).cast(batch.schema[o].dataType) for o in self.order]))
            last = [r[0] for r in upto.orderBy(*[F.desc(o) for o in self.order]).select(kind).limit(3).collect()]
            raise ValueError(f"unknown message type {unknown[_KIND]!r} in batch {number}; the last types, newest first: {', '.join(map(repr, last))}")
        self.files.put(f"done/{number}", "")

    def _parts(self, kind: str) -> list[str]:
        parts = [f"batch-{n}/{_KIND}={self.fields[kind]}" for n in self.batches()]
        return [p for p in parts if self.files.names(p)]

    def has(self, kind: str) -> bool:
        """Whether a message of a type has come."""
        return bool(self._parts(kind))

    def table(self, kind: str) -> DataFrame:
        """All rows of a type so far; an error where none has come."""
        field, there = self.fields[kind], self._parts(kind)
        if not there:
            raise LookupError(f"no message of type {kind!r} yet")
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in there]).select(f"{field}.*")

    def union(self, value: dict[str, str], ident: str, name: str) -> DataFrame:
        """``(kind, ident, name)`` of the tables there are: of each type one column besides its ident."""
        rows = [self.table(t).select(F.lit(t).alias("kind"), ident, F.col(c).cast("long").alias(name)) for t, c in value.items() if self.has(t)]
        return reduce(DataFrame.unionByName, rows)


def dispatch_stream(stream: DataFrame, to: Dispatcher) -> None:
    """Dispatches what is there of a stream; a later call goes on where this one ended."""
    writer = stream.writeStream.foreachBatch(to.apply).option("checkpointLocation", f"{to.folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
