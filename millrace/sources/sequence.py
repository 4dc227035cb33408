"""A table as a sequence of bounded, ordered files, and the stream that takes them one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cutting import shared_dir
from ..operators.sorting import place
from .files import Files

#: A stream takes files by their times; these are a second apart.
STEP_MS = 1_000


def write_sequence(rows: DataFrame, order: list[str | Column], size: int = 100, folder: str | None = None, rank: str | None = None) -> str:
    """Writes ``rows`` in order, ``size`` to a file (the last may have fewer), and returns the folder.

    Ranks come from ranges of the order, so no task sorts all rows; each file is written by the one task
    that has its rows. ``order`` must be total. The driver handles names only: a name for each trigger to come. A column ``rank``
    keeps the rows' ranks, from 0.
    """
    if size < 1:
        raise ValueError("a file has one row at least")
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/sequence-{spark._jvm.java.util.UUID.randomUUID().toString()}"
    numbered = place(rows, *order).withColumn("__file", F.floor((F.col("place") - 1) / size))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = numbered.withColumn(rank, F.col("place") - 1) if rank else numbered
    numbered.drop("place").repartition(parts, "__file").sortWithinPartitions("__file", *order).write.partitionBy("__file").parquet(f"{folder}/_parts")
    files = Files(spark, folder)
    for part in files.names("_parts"):
        if part.startswith("__file="):
            k = int(part.removeprefix("__file="))
            (name,) = [n for n in files.names(f"_parts/{part}") if n.endswith(".parquet")]
            files.move(f"_parts/{part}/{name}", f"{k:09d}.parquet")
            files.stamp(f"{k:09d}.parquet", STEP_MS * (k + 1))
    files.delete("_parts")
    return folder


def batch_size(n: int, least: int, most: int, batches: int, unit: int = 1) -> int:
    """Rows of a file, a multiple of ``unit``, for ``n`` rows in ``batches`` files.

    A trigger costs the same whatever it brings, so the number of files must not grow with the rows; only from ``batches * most``
    rows on, files stay at ``most`` and become more. Files have ``least`` rows at least.
    """
    units = max(-(-min(max(-(-n // batches), least), most) // unit), 1)
    return units * unit


def read_sequence(spark: SparkSession, folder: str, schema, files_each: int = 1) -> DataFrame:
    """The files as a stream, in their order, ``files_each`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.parquet").parquet(folder)
