"""Tables of a data folder, as batches or as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, name: str, files_each: int = 100) -> DataFrame:
    """The table's files as a stream, at most ``files_each`` a batch."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
