"""Readies an application for this package's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Bytes of the batches that go to Python workers, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once, and bounds its batches by bytes: rows may be long."""
    sc = spark.sparkContext
    if spark.conf.get(_LIMIT) == _DEFAULT:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    if sc.applicationId in _DONE:
        return
    _DONE.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(made))
