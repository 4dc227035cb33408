"""Operators on documents against brute force, over the odd rows, an empty table and the smallest documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import fs as pafs

from millrace.llm import decontaminate, langid, licenses, long_repeats, mixing, ngram_join, queries, sharding, store, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


# ---- n-gram join


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def linked(rows, n, percent):
    sets, root = [shingles(r[1], n) for r in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)), key=key)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_ngram_join(odd_docs, rows_of, n, percent):
    got = sorted((tuple(r) for r in ngram_join.ngram_components(odd_docs, n, percent).collect()), key=key)
    assert got == linked(rows_of, n, percent)


@pytest.mark.parametrize("short", [0, 32])
def test_ngram_join_of_frequent_tokens(spark, monkeypatch, short):
    """With every token frequent, all signatures are combinations; links stay whole."""
    import random

    rnd = random.Random(5)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(1000)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(base[: 40 + k])) for k in range(0, 60, 3)]
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 16)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.ngram_components(d, 3, 80).collect())
    assert got == linked(rows, 3, 80)


def test_ngram_join_of_null_and_clashing_ids(spark):
    """Near copies link where all rows of their classes have null or the same doc_ids."""
    import random

    rnd = random.Random(3)
    rows = []
    for k in range(40):
        w = [f"u{rnd.randrange(10_000)}" for _ in range(60)]
        rows += [(None, " ".join(w)), (k if k % 2 else 1000, " ".join([*w, "end"])), (2000 + k % 5, " ".join(["begin", *w]))]
        rows += [(None, " ".join(["x", *w[:50]])), (None, " ".join(["y", *w[:50]]))]
    got = sorted((tuple(r) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=key)
    assert got == linked(rows, 3, 90)


def test_signatures_are_shared_by_linked_sets():
    """Sets that share just enough tokens, with counts around the frequent ones' bound and tokens that no other document holds."""
    rnd = np.random.default_rng(3)
    checked = 0
    for most in (3, 100, 5000):
        for n in (9, 10, 11, 40, 300, 2000):
            for percent in (80, 90):
                tokens = np.unique(rnd.integers(0, 1 << 48, 2 * n).astype(np.uint64))
                count = rnd.integers(2, most, len(tokens))
                take = rnd.permutation(len(tokens))
                change = (n * (100 - percent) // 100) // 2
                a, b = take[:n], np.concatenate([take[: n - change], take[n : n + change]])
                both = n - change
                if not change or 100 * both < percent * (2 * n - both):
                    continue
                got = []
                for own, other in ((a, b), (b, a)):
                    alone = np.setdiff1d(own, other)[: rnd.integers(0, change + 1)]  # these no other document holds
                    held = np.setdiff1d(own, alone)
                    level = ngram_join.level_of(count[held])
                    order = np.lexsort((tokens[held], level))
                    got.append(ngram_join.signatures(tokens[held][order], level[order], n, percent))
                assert len(np.intersect1d(*got))
                checked += 1
    assert checked > 20


def test_tokens_pack():
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert np.array_equal(ngram_join.unpack(ngram_join.pack(tokens)), tokens) and len(ngram_join.unpack(ngram_join.pack(tokens[:0]))) == 0


def test_tokens_are_counted_in_all_documents(odd_docs, rows_of):
    """Chunks of few documents: each candidate's shared tokens are those that at least two documents hold."""
    join = ngram_join._Join(odd_docs, 1, 50)
    sets = {s for r in rows_of if (s := shingles(r[1], 1))}
    held = Counter(t for s in sets for t in s)
    alone = Counter((len(s), sum(held[t] == 1 for t in s)) for s in sets)
    got = {(r.cls, r.n, r.alone) for r in join.candidates.collect()}
    # copies in several chunks count as others, so such a set has no token of its own
    assert all(alone[n, own] or own == 0 for _, n, own in got)
    want = sum(k for (n, own), k in alone.items() if 100 * (n - own) >= 50 * n and n > 1)
    assert len({g[0] for g in got}) >= want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_lists_stream_in_batches_of_any_size(size):
    import pyarrow as pa

    rnd = np.random.default_rng(8)
    rows = sorted((int(a), int(b)) for a, b in zip(rnd.integers(0, 25, 90), rnd.integers(0, 9, 90), strict=True))
    batches = [pa.RecordBatch.from_pydict({"sig": [r[0] for r in part], "cls": [r[1] for r in part], "n": pa.array([5] * len(part), pa.int64())}) for k in range(0, len(rows), size) for part in [rows[k : k + size]]]
    got = [tuple(r.values()) for b in ngram_join._lists(batches) for r in b.to_pylist()]
    members = defaultdict(list)
    for sig, cls in sorted(set(rows)):
        members[sig].append(cls)
    assert got == [(s, c, 5, m[0], m[k - 1] if k else c, k) for s, m in sorted(members.items()) if len(m) > 1 for k, c in enumerate(m)]


def test_bitmaps_bound_the_difference():
    rnd = np.random.default_rng(4)
    for n, m in ((5, 9), (200, 150), (5000, 600)):
        a, b = (np.unique(rnd.integers(0, 1 << 48, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([b, a[: n // 2]]))
        maps = [ngram_join.bitmap(x, len(x) + 7).tobytes() for x in (a, b)]  # seven more tokens aren't in the map
        assert ngram_join.bitmaps_differ(*maps) <= len(np.setxor1d(a, b))


# ---- long repeats


def without_repeats(rows, length):
    starts = Counter(b[i : i + length] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [4096, 4, 1])
def test_long_repeats(odd_docs, rows_of, monkeypatch, block):
    monkeypatch.setattr(long_repeats, "BLOCK", block)
    got = long_repeats.remove_repeats(odd_docs, 80, texts_too=False).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == without_repeats(rows_of, 80)


def test_long_repeats_of_documents(small, spark, sf_dir):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op8_long_repeats(spark, sf_dir).collect()), key=key) == without_repeats(rows, 400)


def test_any_two_residues_have_a_common_shift():
    shifts = long_repeats.common_shifts()
    for a in range(long_repeats.COVER):
        for b in range(long_repeats.COVER):
            assert {(x + shifts[a, b]) % long_repeats.COVER for x in (a, b)} <= set(long_repeats.RESIDUES)


@pytest.mark.parametrize("length", [64, 80, 87, 400])
def test_suffixes_are_sorted(length):
    """Whole blocks against sorted strings: periodic texts, whose suffixes tie at any residues, among others."""
    rnd = np.random.default_rng(length)
    for kinds in (2, 4, 200):
        spans, leads, buckets = [], [], []
        base = rnd.integers(0, kinds, 2 * length).astype(np.uint8)
        for k in range(40):
            text = bytes(np.tile(base[: rnd.integers(1, 9)], 3 * length)[: rnd.integers(length, 2 * length)]) if k % 3 == 0 else bytes(base[(at := rnd.integers(0, length // 2)) : at + length + rnd.integers(0, length // 2)])
            spans.append(text)
            leads.append(int(rnd.integers(len(text) - length, length)))
            buckets.append(k % 2)
        order, tie = long_repeats.sort_block(spans, np.array(leads), np.array(buckets), length)
        rows = [(buckets[e], spans[e][w : w + length], leads[e] - w) for e in range(len(spans)) for w in range(len(spans[e]) - length + 1)]
        got = [rows[k] for k in order]
        assert [r[:2] for r in got] == sorted(r[:2] for r in rows)
        many = Counter(rows)
        assert all(many[a] > 1 and a[:2] == b[:2] for a, b, t in zip(got[1:], got, tie[1:], strict=False) if t)
        # strings of equal offsets, as all equal ones have in a real bucket
        rows = [r[:2] for r in rows]
        order, tie = long_repeats.sort_block(spans, np.array([len(x) - length for x in spans]), np.array(buckets), length)
        assert [rows[k] for k in order] == sorted(rows)


@pytest.mark.parametrize(("size", "goes"), [(300, False), (399, False), (400, True), (500, True)])
def test_planted_passages(spark, size, goes):
    """A passage of over 50 words goes from two documents if it has 400 bytes, and stays if it has fewer."""
    import random

    rnd = random.Random(size)
    word = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    passage = " ".join(word(rnd.randrange(2, 5)) for _ in range(300))[: size - 1] + "."
    assert len(passage) == size and len(passage.split()) > 50
    rows = [(k, "".join([word(700), "<["[k], passage, ">]"[k], word(300 + k)])) for k in range(2)] + [(k, word(900)) for k in range(2, 20)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in long_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    assert got == {k: (size, 1) if k < 2 and goes else (0, 0) for k in range(20)}


def test_equal_rows_lose_what_repeats(spark):
    rows = [(None, "x" * 500 + str(k % 2)) for k in range(60)]
    got = long_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, texts_too=False).collect()
    assert len(got) == 60 and {(r.n_bytes, r.n_removed) for r in got} == {(501, 501)}


def test_long_repeats_keeps_the_rest(spark):
    same = "0123456789" * 12
    d = spark.createDataFrame([(1, "head " + same + " tail"), (2, same), (3, "unlike")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in long_repeats.remove_repeats(d, 64).collect()}
    assert got == {1: b"head  tail", 2: b"", 3: b"unlike"}


# ---- token files


def test_token_files(odd_docs, rows_of, spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.BYTE_BPE)
    encode = Tokenizer.from_file(path).encode
    got = tokens.read_token_files(spark, *tokens.write_token_files(odd_docs, path)).orderBy("start").collect()
    want = Counter()
    for r in rows_of:
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_token_files_keep_every_id(spark, monkeypatch):
    """Negative ids are ids; null ones are null and come first; readers return slices."""
    monkeypatch.setattr(tokens, "READ_ROWS", 2)
    rows = [(-1, "a b"), (None, "c"), (-(1 << 63), "d"), (0, ""), (None, None), ((1 << 63) - 1, "e"), (-1, "f")]
    got = tokens.read_token_files(spark, *tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary(queries.BYTE_BPE))).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_token_files_are_read_by_ranges(tmp_path, monkeypatch, held):
    """The same from a memory map and from a store that isn't mounted; documents longer than what is held, and empty files."""
    monkeypatch.setattr(tokens, "READ_IDS", held)
    ids, ends = np.random.default_rng(4).integers(0, 60_000, 50).astype("<u2"), np.array([0, 1, 2, 20, 21, 50])
    ids.tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").touch()
    want = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    for fs, where in ((pafs.LocalFileSystem(), f"{tmp_path}/"), (pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), "")):
        asked = []
        with store.open_array(fs, f"{where}a.bin", "<u2") as read, store.open_array(fs, f"{where}empty.bin", "<u2") as nothing:
            assert tokens._crcs(lambda i, j, read=read, asked=asked: asked.append(j - i) or read(i, j), ends) == want
            assert tokens._crcs(lambda i, j, read=read: read(i, j), ends[3:]) == want[3:]
            assert len(nothing(0, 0)) == 0
        assert max(asked) <= held


@pytest.mark.parametrize("text", ["", "  a  b", " x", "x\n\n y", "é—ü 12,000.5, don't. it's, a.b,c", "a\tb", "<|endoftext|> hi", "Ünï, x.", "ab1, 1,", " \n", "a,.", "x.\nY, z.", "漢字 かな"])
def test_encoder_equals_the_library(text):
    encoder = tokens.Encoder(queries.vocabulary(queries.BYTE_BPE))
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert encoder.encode([text, "a b", text]) == [want, encoder.encode(["a b"])[0], want]


# ---- sharding


@pytest.mark.parametrize("n", [1, 16])
def test_shards(odd_docs, rows_of, n):
    got = sharding.shard_documents(odd_docs, n).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_of)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


@pytest.mark.parametrize("n", [1, 3, 16, 500])
def test_shards_cut_the_running_bytes(odd_docs, rows_of, n):
    """The law is ``bytes``: a row's shard follows from the bytes before it alone, so copies of a text can lie in several."""
    rows = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_of), key=key)
    total, at, want, slots = sum(r[1] for r in rows), 0, Counter(), Counter()
    for r in rows:
        shard = at * n // total
        want[*r, "bytes", shard, slots[shard], None] += 1
        slots[shard] += 1
        at += r[1]
    assert Counter(map(tuple, sharding.shard_documents(odd_docs, n).collect())) == want


def test_shards_are_balanced(small):
    sizes = defaultdict(int)
    most = 0
    for r in sharding.shard_documents(small, 4).collect():
        sizes[r.shard] += r["size"]
        most = max(most, r["size"])
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most


# ---- mixing


def targets_of(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rate = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 3 * sizes[s] < weight[s] * rate}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * rate for s in order}
        capped |= over


def test_mix(odd_docs, rows_of):
    got = mixing.mix_sources(odd_docs).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(odd_docs).collect()), key=str)
    sizes = defaultdict(int)
    for r in rows_of:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets_of(sizes)
    taken = defaultdict(int)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows_of)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"]
        assert r["size"] == 0 and r.taken == 0 or r.taken % r["size"] == 0
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def best_sum(counts, budget):
    """The largest sum up to budget, by enumerating all reachable ones."""
    sums = {0}
    for size, n in counts.items():
        sums = {t + size * k for t in sums for k in range(n + 1) if t + size * k <= budget}
    return max(sums)


def test_mix_comes_as_near_its_targets_as_can_be(odd_docs, rows_of):
    """Each source's words against its target: the best subset sum where its budget is small, else within a document."""
    counts = defaultdict(Counter)
    for r in rows_of:
        counts[r[3]][len(WORD.findall(r[1] or ""))] += 1
    want = targets_of({s: sum(n * k for n, k in c.items()) for s, c in counts.items()})
    taken, small = Counter(), 0
    for r in mixing.mix_sources(odd_docs).collect():
        taken[r.source] += r.taken
    for source, c in counts.items():
        whole = sum(n * k for n, k in c.items())
        repeats = int(want[source] // whole) if whole else 0
        budget = round(want[source] - repeats * whole)
        if budget <= mixing.DP_WORDS:
            small += 1
            assert taken[source] == repeats * whole + best_sum({n: k for n, k in c.items() if n}, min(budget, whole))
        else:
            assert 0 <= round(want[source]) - taken[source] <= max(c)
    assert small >= 3


def test_mix_of_the_smallest_documents(small):
    """Whole repeats of a source, and the best subset sum for what is left of its target."""
    rows = mixing.mix_sources(small).collect()
    taken, target, counts = Counter(), {}, defaultdict(Counter)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        counts[r.source][r["size"]] += 1
    for source, c in counts.items():
        whole = sum(n * k for n, k in c.items())
        repeats = int(target[source] // whole)
        assert taken[source] == repeats * whole + best_sum(c, min(whole, round(target[source] - repeats * whole)))


def test_mix_without_words(spark):
    got = mixing.mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None), (3, "  ", "b")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(k, 0, 0, 0.0, 0) for k in (1, 2, 3)]


def test_budget_is_the_best_subset_sum():
    import random

    rnd = random.Random(2)
    for _ in range(100):
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 7))}
        whole = sum(s * n for s, n in counts.items())
        budget = rnd.randrange(0, whole + 10)
        take = mixing.fit_budget(counts, budget)
        assert all(0 <= n <= counts[s] for s, n in take.items())
        assert sum(s * n for s, n in take.items()) == best_sum(counts, budget)
    assert mixing.fit_budget({4: 3, 9: 1}, 9) == {4: 0, 9: 1}


def test_a_large_budget_is_met_within_a_document():
    assert sum(s * n for s, n in mixing.fit_budget({s: 1000 for s in range(1, 500)}, 12_345_678).items()) == 12_345_678
    counts = {100: 1000, 700: 1000}
    assert 0 <= 300_050 - sum(s * n for s, n in mixing.fit_budget(counts, 300_050).items()) < 700


# ---- language ID


def test_language_id(small):
    told = langid.identify_language(small, queries.vocabulary(queries.PIECES)).toPandas()
    true = small.select("doc_id", "lang").toPandas()
    both = told.merge(true, on="doc_id")
    assert len(both) == len(true) and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.97
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()


def test_language_id_of_odd_rows(odd_docs, rows_of):
    got = langid.identify_language(odd_docs, queries.vocabulary(queries.PIECES)).collect()
    assert len(got) == len(rows_of)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (100, 101, 102, 109))


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    prob = np.array([0.2, 0.1, 0.3, 0.15, 0.05, 0, 1e-7])

    def total(w):
        return 1.0 if not w else sum(prob[k] * total(w[len(p) :]) for k, p in enumerate(pieces) if w.startswith(p))

    lattice = langid.Lattice(pieces)
    for w in ("a", "abab", "aababa"):
        assert langid.forward(lattice.edges([w, w]), prob)[-1] == pytest.approx([total(w)] * 2)
        assert langid.log_forward(lattice.edges([w, w]), prob) == pytest.approx([np.log(total(w))] * 2)
        assert langid.log_forward_long(lattice, w, prob[None]) == pytest.approx([np.log(total(w))])


def exact_log(word, pieces, prob):
    """The logarithm of the sum over all segmentations, in exact fractions."""
    from fractions import Fraction

    p = {x: Fraction(float(prob[k])) for k, x in enumerate(pieces)}
    alpha = [Fraction(1)]
    for end in range(1, len(word) + 1):
        unknown = Fraction(float(prob[-1])) if word[end - 1] not in p else 0
        alpha.append(alpha[end - 1] * unknown + sum((alpha[start] * p[word[start:end]] for start in range(max(0, end - 20), end) if word[start:end] in p), Fraction(0)))
    big = alpha[-1]
    return np.log(float(big * 2 ** (shift := max(0, big.denominator.bit_length() - big.numerator.bit_length())))) - shift * np.log(2)


@pytest.mark.parametrize("size", [1, 47, 48, 60, 200, 900])
def test_words_of_any_length_sum_all_segmentations(size):
    """No cut inside a word, and no underflow: sixteen-letter and longer pieces, and letters that no piece has."""
    rnd = np.random.default_rng(size)
    pieces = ["\u2581", "a", "b", "ab", "ba", "aba", "abab" * 4, "b" * 18]
    table = np.array([[*rnd.dirichlet(np.ones(len(pieces))), 0, langid.UNKNOWN] for _ in range(2)])
    for letters in ("ab", "abx", "x"):
        word = "".join(rnd.choice(list(letters), size))
        want = [exact_log("\u2581" + word, pieces, p) for p in table]
        assert langid.Scorer(pieces, table).totals([[word]])[0] == pytest.approx(want, rel=1e-9)
        assert langid.Scorer(pieces, table).totals([[word, "ab", word]])[0] == pytest.approx([2 * w + exact_log("\u2581ab", pieces, p) for w, p in zip(want, table, strict=True)], rel=1e-9)


def test_language_id_against_a_slow_scorer(small, odd_docs):
    """Every document's language and share, word by word."""
    pieces = langid.vocabulary_pieces(queries.vocabulary(queries.PIECES))
    langs, table = langid.fit(small.select("doc_id", "text", "lang"), pieces)
    lattice, known = langid.Lattice(pieces), {}

    def score(word):
        if word not in known:
            known[word] = langid.log_forward_long(lattice, "\u2581" + word, table)
        return known[word]

    rows = small.where("doc_id % 5 = 0").collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(small, queries.vocabulary(queries.PIECES)).collect()}
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total = sum(score(w) for w in r.text.lower().split())
        best = int(np.argmax(total))
        assert got[r.doc_id] == (langs[best], pytest.approx(1 / np.exp(total - total[best]).sum()))


def test_equally_likely_languages_go_by_name(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["b", "a"] * 40)]
    got = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("lang is not null"), queries.vocabulary(queries.PIECES)).collect()
    scores = {r.score for r in got}
    assert len({r.lang_pred for r in got}) == 1 and all(0.5 <= s <= 1 for s in scores)


# ---- decontamination


def test_leaks(spark):
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    items = [(k, " ".join(word() for _ in range(rnd.randrange(20, 50)))) for k in range(20)] + [(50, None), (51, ""), (None, "a b c d e"), (52, "two words")]
    rows, want = [], set()
    for k in range(60):
        host = [word() for _ in range(rnd.randrange(50, 200))]
        if k % 3 == 0:
            item = rnd.randrange(20)
            passage = [word() if rnd.random() < 0.08 else w.upper() + "," if rnd.random() < 0.3 else w for w in items[item][1].split() if rnd.random() > 0.03]
            at = rnd.randrange(len(host))
            host[at:at] = passage
            want.add((k, item))
        rows.append((k, " ".join(host)))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    want.add((None, 0))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = decontaminate.remove_leaking(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}


@pytest.mark.parametrize(("step", "insert"), [(4, False), (3, True)])
def test_edited_copies_leak(spark, step, insert):
    """Copies with every few words replaced, or a word put in after them: the 3-word runs that they keep are the commoner ones, as exact copies hold all."""
    rnd = np.random.default_rng(12)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: [vocabulary[k] for k in rnd.integers(0, 400, n)]
    items = [text(rnd.integers(20, 50)) for _ in range(30)]
    rows = []
    for k, item in enumerate(items):
        edited = [x for i, w in enumerate(item, 1) for x in ([w, "new"] if insert and i % step == 0 else ["new"] if i % step == 0 else [w])]
        rows += [(k, " ".join(text(30) + edited + text(100))), (100 + k, " ".join(item))]
    number = {w: k for k, w in enumerate([*vocabulary, "new"])}
    want = {}
    for d, t in rows:
        body = np.array([number[w] for w in t.split()], np.uint64) * np.uint64(4)
        runs = {tuple(x) for x in zip(t.split(), t.split()[1:], t.split()[2:], strict=False)}
        for k, item in enumerate(items):
            if runs & set(zip(item, item[1:], item[2:], strict=False)):
                score = smith_waterman(np.array([number[w] for w in item], np.uint64) * np.uint64(4), body) / (2 * len(item))
                if score >= 0.5:
                    want[d, k] = score
    assert all((k, k) in want for k in range(30))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == pytest.approx(want)


def test_leaks_against_all_pairs(spark):
    """Every document with every item, without seeds: what scores half of the best and is not found keeps no 3-word run."""
    rnd = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(300)]
    text = lambda n: [vocabulary[k] for k in rnd.integers(0, 300, n)]
    items = [text(rnd.integers(15, 30)) for _ in range(12)]
    rows = []
    for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
        for k, item in enumerate(items):
            edited = [vocabulary[rnd.integers(300)] if rnd.random() < rate else w for w in item]
            rows.append((len(rows), " ".join(text(20) + edited + text(20))))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[1][1]), (1001, " ".join(text(3000) + items[3] + text(3000)).upper())]
    number = {w: k for k, w in enumerate(vocabulary)}
    as_ids = lambda words: np.array([number[w.lower()] for w in words], np.uint64) * np.uint64(4)
    want, kept_none = Counter(), 0
    for d, t in rows:
        words = t.lower().split()
        runs = set(zip(words, words[1:], words[2:], strict=False))
        for k, item in enumerate(items):
            if len(words) > 1000 and k != 3:
                continue
            score = smith_waterman(as_ids(item), as_ids(words)) / (2 * len(item))
            if score >= 0.5:
                if runs & set(zip(item, item[1:], item[2:], strict=False)):
                    want[d, k, round(score, 9)] += 1
                else:
                    kept_none += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS item_id")
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")).collect()
    found = Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in got)
    found = Counter({k: n for k, n in found.items() if k[0] != 1001 or k[1] == 3})
    assert found == want and want[1000, 0, 1.0] == 2 and kept_none <= 1


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment():
    rnd = np.random.default_rng(6)
    pairs = [(rnd.integers(0, 6, rnd.integers(1, 20)).astype(np.uint64) * np.uint64(4), rnd.integers(0, 6, rnd.integers(1, 30)).astype(np.uint64) * np.uint64(4)) for _ in range(50)]
    best, first, last = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), s, i, j in zip(pairs, best, first, last, strict=True):
        assert s == smith_waterman(a, b)
        assert smith_waterman(a, b[i:j]) == s


# ---- licences


def test_licenses(spark):
    rows = [
        (1, "top/LICENSE", "Released under the MIT License."), (2, "top/a.txt", "nothing here"), (3, "top/sub/deep/b.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore text of the file"),
        (4, "top/sub/deep/c.txt", None), (5, "other/d.txt", ""), (6, None, "Released under the MIT License."), (7, "e.txt", "x"), (8, "top/sub/LICENSE", "Licensed under CC BY-NC 4.0."), (8, "top/sub/LICENSE", "Licensed under CC BY-NC 4.0."),
        (None, None, None),
    ]
    got = {(r.doc_id, r.license, r.license_path) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        (1, "MIT", "top/LICENSE"), (2, "MIT", "top/LICENSE"), (3, "Apache-2.0", "top/sub/deep/b.txt"), (4, "CC-BY-NC-4.0", "top/sub/LICENSE"),
        (5, None, None), (6, "MIT", None), (7, None, None), (8, "CC-BY-NC-4.0", "top/sub/LICENSE"), (None, None, None),
    }


def test_whole_licenses_and_heads_of_files(spark):
    """Each licence's whole text as a license file, with a line of its own above; files below inherit it; heads of source files are found among code."""
    texts, heads = dict(licenses.templates()[-len(licenses.WHOLE) :]), licenses.HEADERS
    rows = [(k, f"{name}/COPYING", "Copyright (c) 2020 Some Body\n\n" + text) for k, (name, text) in enumerate(texts.items())]
    rows += [(100 + k, f"{name}/src/deep/{k}.c", f"int x{k};") for k, name in enumerate(texts)]
    commented = lambda t: "\n".join(f" * {x}" for x in t.replace(". ", ".\n").split("\n"))
    rows += [(200 + k, f"MIT/{k}.c", f"/*\n * Copyright 2021\n{commented(text)}\n */\n\n" + "\n".join(f"int f{i}(int a, int b) {{ return a + b; }}" for i in range(60))) for k, (_, text) in enumerate(heads)]
    rows += [(300, "MIT/again", rows[8][2]), (301, "x/long.txt", "plain words of a text " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS key", "2 AS score", "3 AS w", "4 AS part").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert len(got) == len(rows)
    for k, name in enumerate(texts):
        assert (got[k].own_license, got[k].is_license_file, got[k].license_path) == (name, True, f"{name}/COPYING")
        assert (got[100 + k].own_license, got[100 + k].license, got[100 + k].license_path) == (None, name, f"{name}/COPYING")
    for k, (name, _) in enumerate(heads):
        assert got[200 + k].own_license == name, name
    assert got[300].own_license == rows[8][1].split("/")[0] and got[301].license is None


def test_license_ties_go_to_the_first_template(spark):
    two = (("B", "alpha beta gamma"), ("A", "gamma beta alpha"))
    d = spark.createDataFrame([(1, "x/y", "alpha beta gamma"), (2, "x/z", "other")], "doc_id long, path string, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(d, two).collect()} == {(1, "B"), (2, "B")}


@pytest.mark.parametrize("most", [100_000, 0])
def test_licenses_weigh_words_by_the_whole_corpus(spark, monkeypatch, most):
    """A notice beside words that nearly every row holds; weights by the counts of all words; tables joined by shuffles too."""
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
    notice = "Released under the MIT License."
    rows = [(k, f"d{k}/f.txt", f"en la word{k} text") for k in range(200)]
    rows += [(300, "a/x.txt", f"en {notice} la la la\nword1 and more"), (301, "b/x.txt", f"{notice} word1 word2 word3 word4"), (302, None, "en la"), (303, "c/x.txt", None)]
    df = Counter(w for _, _, t in rows for w in set(licenses.words(t or "")))
    idf = lambda w: np.log((1 + len(rows)) / (1 + df[w])) + 1

    def cosine(a, b):
        a, b = ({w: (1 + np.log(n)) * idf(w) for w, n in Counter(licenses.words(x)).items()} for x in (a, b))
        return sum(a[w] * b.get(w, 0) for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    got = {r.doc_id: (r.own_license, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[300] == ("MIT", pytest.approx(cosine(rows[200][2].split("\n")[0], notice), abs=2e-6))
    assert cosine(rows[201][2], notice) < licenses.THRESHOLD and got[301] == (None, None)
    assert all(got[d] == (None, None) for d in [*range(200), 302, 303])


# ---- empty tables


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = queries.vocabulary(queries.BYTE_BPE)
    for d in (
        ngram_join.ngram_components(no_docs), long_repeats.remove_repeats(no_docs), sharding.shard_documents(no_docs), mixing.mix_sources(no_docs), decontaminate.find_leaks(no_docs, bench),
        langid.identify_language(no_docs, queries.vocabulary(queries.PIECES)), tokens.read_token_files(spark, *tokens.write_token_files(no_docs, path)),
        licenses.scan_licenses(no_docs.selectExpr("doc_id", "text AS path", "text")),
    ):
        assert d.count() == 0
