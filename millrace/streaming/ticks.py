"""A stream of messages in ticks of bounded size, of which a trigger takes many, and totals by kind as of each tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files


class TickTotals:
    """``(tick, kind, n, last)``: for the kinds that a tick has, the count and the largest value so far, that tick included.

    Ticks are whole within a batch and batches come in order of ticks. A batch's rows are counted by tick and kind, and these few are
    summed along the ticks from where the batch before ended: its totals, a row for each kind, are kept for each batch. A
    batch counts from when its mark is there, which is written last, so one that breaks off or comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, tick: Column, kind: str, value: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        self.tick, self.kind, self.value = tick, kind, value

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("done") if n.isdigit())

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; fit for ``foreachBatch``."""
        done = self.batches()
        if number in done:
            return
        each = batch.groupBy(self.tick.alias("tick"), F.col(self.kind).alias("kind")).agg(F.count("*").alias("n"), F.max(self.value).alias("last"))
        if done:  # the totals so far come before all ticks
            each = each.unionByName(self.spark.read.parquet(f"{self.folder}/totals-{done[-1]}").withColumn("tick", F.lit(None).cast(each.schema["tick"].dataType)))
        w = Window.partitionBy("kind").orderBy(F.col("tick").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        run = each.select("tick", "kind", F.sum("n").over(w).alias("n"), F.max("last").over(w).alias("last"))
        run.where("tick IS NOT NULL").write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        each.groupBy("kind").agg(F.sum("n").alias("n"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{self.folder}/totals-{number}")
        self.files.put(f"done/{number}", "")

    def read(self) -> DataFrame:
        """The totals after each tick so far."""
        done = self.batches()
        if not done:
            raise ValueError("no tick yet")
        return self.spark.read.parquet(*[f"{self.folder}/batch-{n}" for n in done])


def tick_stream(stream: DataFrame, to: TickTotals) -> None:
    """Takes what is there of a stream; a later call goes on where this one ended."""
    writer = stream.writeStream.foreachBatch(to.apply).option("checkpointLocation", f"{to.folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
