"""The shared folder: where lineage is cut and where operators keep their files.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
on a local master (tests) is a temporary folder made.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_KEY} must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(_KEY, made)
    return made


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def discard(*written: DataFrame) -> None:
    """Removes the files of frames that ``cut`` returned; nothing that is still to be read may come from them."""
    for df in written:
        if path := _PATHS.pop(df, None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def rows_below(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for files that tasks write and read themselves."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def map_file(fs: pafs.FileSystem, path: str):
    """A file's bytes as a buffer: memory-mapped where the folder is mounted, else read."""
    import mmap

    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            f.seek(0, 2)
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
    with fs.open_input_file(path) as f:
        return f.read()


@contextmanager
def open_array(fs: pafs.FileSystem, path: str, kind: str):
    """A function that returns a file's numbers from one place to another: of a memory map where the folder is mounted, else fetched by each call."""
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.frombuffer(map_file(fs, path), kind)
        yield lambda start, stop: whole[start:stop]
        return
    size = np.dtype(kind).itemsize
    with fs.open_input_file(path) as f:
        yield lambda start, stop: np.frombuffer(f.read_at((stop - start) * size, start * size), kind)
