"""Near-duplicate vectors by tiles of int8 products with rigorous error bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .components import connected_components
from .store import cut

#: Vectors in a tile, about: a cell holds two tiles, so its memory is bounded whatever a label's size.
TILE = 4096
#: Pairs recomputed at once.
CHUNK = 1 << 16
#: Slack for rounding in the bounds, which are themselves computed in double precision.
SLACK = 1e-9
SALTS = 8


def _prepared(batches):
    """Each vector's bytes as doubles and a digest of them; null where it can't link."""
    for batch in batches:
        keys, raw, dims = [], [], []
        labels = batch.column("label").to_pylist()
        for label, v in zip(labels, batch.column("embedding"), strict=True):
            good = label is not None and v.is_valid and v.values.null_count == 0 and len(v.values)
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if good else None
            good = good and bool(np.isfinite(x).all()) and bool(x.any())
            raw.append(x.tobytes() if good else None)
            dims.append(len(x) if good else None)
            keys.append(hashlib.blake2b(x.tobytes() + repr(label).encode(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "key", "raw"])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 rows q with scales s; the norms of s q and of the errors x - s q."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    near = q * s[:, None]
    return q.astype(np.int8), s, np.sqrt((near * near).sum(axis=1)), np.sqrt(((u - near) ** 2).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))  # so that squares neither overflow nor vanish
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) of linked rows of two tiles, in chunks; i < j within one tile.

    Products of int8 rows are integers below 2**24 up to dimension 1040, so single-precision matrix
    products are exact there; beyond, double precision is used. The true cosine differs from
    s q . s' q' by |s q| e' + |s' q'| e + e e' at most.
    """
    (q, s, n, e), (r, t, m, d) = quantise(x), quantise(y)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    for at in range(0, len(x), 256):
        rows = slice(at, at + 256)
        product = (q[rows].astype(kind) @ r.astype(kind).T).astype(np.float64) * s[rows, None] * t
        likely = product + (n[rows, None] * d + e[rows, None] * m + e[rows, None] * d) >= threshold - SLACK
        i, j = np.nonzero(likely)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), CHUNK):
            a, b = i[k : k + CHUNK], j[k : k + CHUNK]
            good = cosines(x[a], y[b]) >= threshold
            yield a[good], b[good]


def _cell(threshold: float):
    """Links of one cell, two tiles of a label: sums for each class and a spanning forest, never all pairs."""

    def run(key, table):
        side = table.column("side").to_numpy()
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        keys = table.column("key").to_pylist()
        dim = key[1].as_py()
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(-1, dim)
        same = key[2].as_py() == key[3].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        edges = []
        for i, j in tile_links(x[left], x[right], threshold, same) if len(left) and len(right) else ():
            a, b = left[i], right[j]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while len(a):  # joins in bulk; pairs already connected drop out
                fresh = np.array([find(k) for k in np.unique(np.concatenate([a, b]))])
                flat = dict(zip(np.unique(np.concatenate([a, b])).tolist(), fresh.tolist(), strict=True))
                p = np.fromiter(map(flat.__getitem__, a.tolist()), np.int64, len(a))
                q = np.fromiter(map(flat.__getitem__, b.tolist()), np.int64, len(b))
                apart = p != q
                a, b, p, q = a[apart], b[apart], p[apart], q[apart]
                low, high = np.minimum(p, q), np.maximum(p, q)
                _, one = np.unique(high, return_index=True)
                root[high[one]] = low[one]
                edges += zip(ids[a[one]].tolist(), ids[b[one]].tolist(), strict=True)
        out = np.flatnonzero(links)
        none = [None] * len(edges)
        return pa.table({
            "key": pa.array([keys[k] for k in out] + none, pa.binary()), "links": pa.array(links[out].tolist() + none, pa.int64()),
            "a": pa.array([None] * len(out) + [e[0] for e in edges], pa.int64()), "b": pa.array([None] * len(out) + [e[1] for e in edges], pa.int64()),
        })

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors (vec_id, embedding, label)``.

    Two vectors link when their labels are equal and not null, their lengths are equal and the cosine
    of their whole vectors in double precision is at least ``threshold``. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing. Equal vectors of a label are one class,
    which is compared once and stands for any number of copies. component_id is the smallest vec_id
    reachable by links, itself included; kept says whether that is the vector's own. A null vec_id
    links like any other; its component_id is null if no vec_id is reachable, and it isn't kept. Rows that repeat a vec_id are
    vectors of their own, but one node of a component. An empty table gives no rows. Other columns
    aren't read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, dim int, key binary, raw binary"
    rows = cut(rows.mapInArrow(_prepared, schema), "vectors")
    linked = rows.where("key is not null")
    classes = linked.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = cut(classes.withColumn("node", F.xxhash64("key")), "vectors")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    tiled = classes.join(F.broadcast(counts) if counts.limit(10_001).count() <= 10_000 else counts, ["label", "dim"]).withColumn("tile", tile)
    # a vector goes to every cell of its tile: cells are pairs (i <= j) of tiles
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = tiled.withColumn("other", other).select(
        "label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "node", "copies", "key", "raw"
    )
    found = cut(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_cell(threshold), "key binary, links long, a long, b long"), "vectors")
    sums = found.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("a is not null").select("a", "b"))
    named = cut(
        classes.select("key", "node", "rep", "copies").join(sums, "key", "left").join(groups, "node", "left")
        .select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vectors",
    )
    # classes whose vec_ids are all null are nodes like any other; a component is named by the ids that it has
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "component").select("key", "n_links", "component_id"), "vectors")
    salted = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.select("vec_id", "key", F.pmod(F.coalesce("vec_id", F.lit(0)), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["key", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
