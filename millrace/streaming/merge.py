"""A keyed table that a stream of upserts and deletes is merged into, one version for each batch."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest
from ..sources.files import Files

_GONE = "__gone"


class MergedTable:
    """Rows by key, in a folder that driver and executors share.

    A batch becomes a delta: its last row of each key, a deletion as a tombstone. The log's entry ``n``
    names the snapshot and the deltas that make version ``n``, and is written last and whole: a batch that broke
    off leaves no trace, and one that comes again after its entry changes nothing. After ``every`` deltas the table is written
    anew as a snapshot. Tombstones stay in it, since an older row may still come; ``forget`` tells those that may go.

    The row with the largest ``order`` counts for a key, in whatever batch it comes; ``order`` must be total among a
    key's rows, and a null in it is the smallest. A null key is a key like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], values: list[str], deleted: Column, every: int = 16, forget: Column | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.keys, self.order, self.values, self.deleted, self.every, self.forget = keys, order, values, deleted, every, forget

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("log") if n.isdigit())

    def _entry(self, version: int) -> dict:
        return json.loads(self.files.get(f"log/{version}"))

    def _last(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, self.order, [*(o for o in self.order if o not in self.values), *self.values, _GONE])

    def _stored(self, entry: dict) -> DataFrame:
        parts = [*([f"snapshot-{entry['snapshot']}"] if entry["snapshot"] is not None else []), *[f"delta-{n}" for n in entry["deltas"]]]
        return self._last(reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{p}") for p in parts]))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merges a batch as version ``number``; fit for ``foreachBatch``."""
        done = self.versions()
        if done and number <= done[-1]:
            return
        before = self._entry(done[-1]) if done else {"snapshot": None, "deltas": []}
        columns = list(dict.fromkeys([*self.keys, *self.order, *self.values]))
        rows = batch.select(*columns, F.coalesce(self.deleted, F.lit(False)).alias(_GONE))
        self._last(rows).write.mode("overwrite").parquet(f"{self.folder}/delta-{number}")
        entry = {"snapshot": before["snapshot"], "deltas": [*before["deltas"], number]}
        if len(entry["deltas"]) > self.every:
            whole = self._stored(entry)
            if self.forget is not None:
                whole = whole.where(~(F.col(_GONE) & F.coalesce(self.forget, F.lit(False))))
            whole.write.mode("overwrite").parquet(f"{self.folder}/snapshot-{number}")
            entry = {"snapshot": number, "deltas": []}
        self.files.put(f"log/{number}", json.dumps(entry))

    def read(self, version: int | None = None) -> DataFrame:
        """``(*keys, *values)`` of the table as of a version, the last by default."""
        done = self.versions()
        if version is None and not done:
            raise ValueError("nothing was merged yet")
        if version is not None and version not in done:
            raise ValueError(f"no version {version}")
        return self._stored(self._entry(done[-1] if version is None else version)).where(f"NOT {_GONE}").select(*self.keys, *self.values)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last ``keep``, and what only they need."""
        done = self.versions()
        stay = done[-keep:]
        entries = [self._entry(n) for n in stay]
        needed = {f"snapshot-{e['snapshot']}" for e in entries} | {f"delta-{n}" for e in entries for n in e["deltas"]}
        for n in done[:-keep]:
            self.files.delete(f"log/{n}")
        for name in self.files.names():
            if name.startswith(("snapshot-", "delta-")) and name not in needed and int(name.split("-")[1]) <= done[-1]:
                self.files.delete(name)


def merge_stream(stream: DataFrame, table: MergedTable) -> None:
    """Merges what is there of a stream; a later call goes on where this one ended."""
    writer = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{table.folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
