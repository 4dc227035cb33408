"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the vertex, all with map-side combining; hubs are
split by adaptive skew joins. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .store import cut, discard

_EDGE = "a long, b long"


def _forest(batches):
    """Each batch of edges as a spanning forest of stars: the same components, fewer rows."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(a):
            continue
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = flat[: len(a)], flat[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, label[left], low)
            np.minimum.at(new, label[right], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            new = new[label]
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    joined = both.join(least, both.a == least.v)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a long, b long)``; component is the smallest node.

    Loops and repeated edges count for nothing; a node with loops only is not returned, nor is
    anything for an empty table. Null ends are ignored.
    """
    ship(edges.sparkSession)
    now = cut(edges.where("a <> b").mapInArrow(_forest, _EDGE), "cc")
    seen = None
    while True:
        before, now = now, cut(_star(_star(now, True), False), "cc")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = state
