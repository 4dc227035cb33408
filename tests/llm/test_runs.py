"""Periodic runs against every period of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def all_runs(codes, least_words=24, least_periods=3):
    """Stretches of equal codes a period apart, for every period; the smallest period of each stretch stays."""
    codes, out = np.asarray(codes), {}
    for q in range(1, len(codes) // least_periods + 1):
        same = np.diff(np.r_[0, codes[q:] == codes[:-q], 0].astype("int8"))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), (np.flatnonzero(same == -1) + q).tolist(), strict=True):
            if e - s >= max(least_words, least_periods * q):
                out.setdefault((s, e), q)
    return sorted((s, e, q) for (s, e), q in out.items())


def row_of(ident, words, *least):
    """What the operator returns of a text."""
    codes = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else []
    found = all_runs(codes, *least)
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    told = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (ident, len(found), *told, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def changed(ident, words):
    h, n = zlib.crc32(str(ident).encode()) if ident is not None else 1, len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_against_every_period(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [row_of(r.doc_id, changed(r.doc_id, WORD.findall(r.text or ""))) for r in docs]
    assert sum(r[1] > 0 for r in want) >= 10
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, sf_dir).collect())) == sorted(want)


@pytest.mark.parametrize("least", [(24, 3), (2, 2), (5, 3), (4, 2), (30, 5)])
def test_runs_of_made_sequences(least):
    rnd = random.Random(sum(least))
    for _ in range(400):
        n = rnd.randrange(1, 160)
        codes = [rnd.randrange(rnd.choice([1, 2, 3, 5, 50])) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            begin, period, size = rnd.randrange(n), rnd.randrange(1, 30), rnd.randrange(200)
            for j in range(begin + period, min(n, begin + size)):
                codes[j] = codes[j - period]
        if rnd.random() < 0.5:  # what is copied holds whole runs
            codes += codes[: rnd.randrange(n)] + [99] + codes[n // 2 :]
        assert runs.find_runs(np.array(codes), *least) == all_runs(codes, *least)


def test_previous_factors():
    rnd = random.Random(4)
    for _ in range(200):
        codes = [rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randrange(1, 40))]
        n = len(codes)
        longest = lambda i: max((next((k for k in range(n - i) if codes[i + k] != codes[j + k]), n - i) for j in range(i)), default=0)
        sa, _ = runs.suffix_array(np.array(codes))
        assert sa.tolist() == sorted(range(n), key=lambda i: codes[i:])
        length, source = runs.previous_factors(np.array(codes), sa)
        assert length.tolist() == [longest(i) for i in range(n)]
        assert all(j < i and codes[i : i + k] == codes[j : j + k] for i, (k, j) in enumerate(zip(length.tolist(), source.tolist(), strict=True)) if k)


def test_a_long_text_of_one_word_and_of_two(spark):
    rows = [(1, "a " * 200_000), (2, "a b " * 100_000), (3, " ".join(map(str, range(50_000))) + " x"), (4, " ".join([*map(str, range(40_000))] * 3))]
    got = {r.k: r for r in runs.repeated_runs(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert [(got[k].n_runs, got[k].start, got[k].length, got[k].period) for k in (1, 2, 3, 4)] == [(1, 0, 200_000, 1), (1, 0, 200_000, 2), (0, None, None, None), (1, 0, 120_000, 40_000)]
    assert got[1].collapsed_sha256 == hashlib.sha256(b"a").hexdigest()


def test_odd_rows(spark, odd_docs, no_docs, rows_of):
    more = odd_docs.unionByName(odd_docs.where("doc_id < 8 OR doc_id IS NULL").withColumn("text", F.repeat("text", 30)))
    want = [row_of(r.doc_id, WORD.findall(r.text or "")) for r in more.collect()]
    got = runs.repeated_runs(more)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [r.n_runs for r in got.where("doc_id IS NULL").collect()][:1] == [0]
    assert runs.repeated_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        runs.repeated_runs(no_docs, least_periods=1)


def test_small_batches_give_equal_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 7)
    rnd = random.Random(9)
    codes = np.array([rnd.randrange(400) for _ in range(900)] * 2 + [5] * 300 + [rnd.randrange(400) for _ in range(500)])
    assert runs.find_runs(codes) == all_runs(codes)
