"""Vectors against brute force; archives by an exact round trip."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import components, embeddings, warc


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}


def vectors(spark):
    rnd = random.Random(9)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for k in range(150):
        v = [x + rnd.gauss(0, 0.12) for x in rnd.choice(base)]
        rows.append((k, v, k % 3))
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [math.nan] * 16, 0), (203, rows[0][1], None), (204, rows[0][1], 0), (205, rows[0][1], 0), (206, [x * 1e-30 for x in rows[0][1]], 0)]
    rows += [(207, [], 0), (208, [1.0, None] * 8, 0), (209, [math.inf] + [0.0] * 15, 0), (210, [1.0] * 8, 0), (211, [1.0] * 8, 0), (212, rows[5][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n_links", "2 AS key", "3 AS tile").repartition(3)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rows, d = vectors(spark)

    def good(r):
        v = r[1]
        return r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(x) for x in v)

    use = [(r[0], np.array(r[1], np.float32).astype(float), r[2]) for r in rows if good(r)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x, la) in enumerate(use):
        for b, y, lb in use[:i]:
            if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = sorted((r[0], links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows)
    assert sorted(map(tuple, embeddings.near_vectors(d).collect())) == want
    assert any(n > 2 for n in links.values())
    assert embeddings.near_vectors(d.limit(0)).count() == 0


def test_vectors_without_id_link(spark):
    rows = [(1, [1.0, 0.0, 0.01], 0), (None, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.0, -0.01], 0), (None, [0.0, 1.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 1), (None, [0.0, 0.0, 1.0], 1)]
    rows += [(10, [0.0, 1.0, 0.3], 0), (11, [0.0, 0.3, 1.0], 0), (None, [0.0, 1.0, 0.98], 0)]  # the last joins the two before
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.87).collect()
    assert Counter(map(tuple, got)) == Counter(
        {(1, 2, 1, True): 1, (2, 2, 1, False): 1, (None, 2, 1, False): 1, (None, 1, 10, False): 1, (3, 0, 3, True): 1, (None, 0, None, False): 1, (10, 2, 10, True): 1, (11, 1, 10, False): 1, (None, 2, 10, False): 1}
    )


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(40, 64)), rnd.normal(size=(40, 64))
    (q, s, n, e), (r, t, m, d) = embeddings.quantise(x), embeddings.quantise(y)
    near = (q.astype(float) * s[:, None]) @ (r.astype(float) * t[:, None]).T
    true = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert (np.abs(near - true) <= n[:, None] * d + e[:, None] * m + e[:, None] * d + 1e-12).all()


def pages(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n"
    rows = [(k, f"http://x/{k}?é=1 2", "page %d " % (k % 40) * (k % 40)) for k in range(120)]
    rows += [(500, None, None), (501, "u", ""), (502, "u", trap * 3), (503, "u", trap * 3), (504, "u", "ü" * 5000), (505, "u\r\nX: y", trap), (None, "u", "page 3 " * 3), (None, "v", "only here"), (506, "w", "same"), (506, "w", "same")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first", "2 AS salt").repartition(3)


def test_warc_round_trip(spark):
    import base64
    import hashlib

    rows, d = pages(spark)
    for least, file_bytes, block in ((0, 4000, 300), (20, 1 << 20, 1 << 12)):
        folder, files = warc.write_warc(d, least, file_bytes)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(folder, files, block).collect())
        want, first = Counter(), {}
        for p, _, h in rows:
            b = (h or "").encode()
            if len(b) >= least and p is not None:
                first[b] = min(p, first.get(b, p))
        for p, _, h in rows:
            b = (h or "").encode()
            to = first.get(b) if first.get(b) != p else None
            want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to] += 1
        assert got == want


def test_warc_of_long_urls(spark):
    """Headers of over 64 KB, between other records and beside payloads full of magics."""
    trap = "WARC/1.0\r\n" * 2000
    rows = [(1, "u", "first"), (2, "a" * 70_000, "ascii"), (3, "\U0001f600" * 6000, "four bytes"), (4, "v", trap), (5, "b" * 200_000, trap + "Content-Length: 1\r\n\r\n"), (6, "w", "last")]
    folder, files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    for block in (1 << 14, 4 << 20):
        got = warc.read_warc(folder, files, block).collect()
        assert sorted((r.page_id, r.payload_bytes) for r in got) == [(p, len(h)) for p, _, h in rows]


def test_warc_of_a_broken_chain(spark):
    """Records lost behind a damaged header aren't passed over."""
    folder, files = warc.write_warc(spark.createDataFrame([(k, "u", f"page {k}") for k in range(9)], "page_id long, url string, html string").coalesce(1))
    path = f"{folder.removeprefix('file://')}/{files.first().file}"
    with open(path, "r+b") as f:
        f.seek(f.read().index(b"Content-Length", 900))
        f.write(b"X")
    with pytest.raises(ValueError, match="of its"):
        warc.read_warc(folder, files).collect()


def test_warc_of_no_pages(spark):
    folder, files = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(folder, files).count() == 0
