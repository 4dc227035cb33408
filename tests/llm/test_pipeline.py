"""The stages on the smallest documents, each against its predecessor's rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_documents import WORD, best_sum, linked, smith_waterman, targets_of

from millrace.llm import langid, mixing, queries


def kept_language(rows, spark, docs, sf_dir):
    told = {r.doc_id: r for r in langid.identify_language(docs, queries.vocabulary(queries.PIECES)).collect()}
    return [r for r in rows if told[r.doc_id].lang_pred != "und" and told[r.doc_id].score >= 0.5]


def kept_of_groups(rows, *_):
    """All pairs by exact Jaccard of 5-word shingles."""
    component = {d: c for d, _, c in linked([(r.doc_id, r.text) for r in rows], 5, 80)}
    return [r for r in rows if component[r.doc_id] == r.doc_id]


def kept_clean(rows, spark, docs, sf_dir):
    """All documents with all items that share a 3-word run, by Smith-Waterman on the whole texts."""
    words = lambda t: re.sub("[\x00-\x2f:-@\\[-`{-\x7f]", " ", (t or "").lower()).split()
    runs = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    items, number, out = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], {}, []
    as_ids = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.uint64) * np.uint64(4)
    for r in rows:
        own = words(r.text)
        some = [i for i in items if runs(i) & runs(own)]
        if not any(smith_waterman(as_ids(i), as_ids(own)) >= len(i) for i in some):
            out.append(r)
    return out


def test_stages(spark, sf_dir):
    """Each stage on the rows that its predecessor kept, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (kept_language, kept_of_groups, kept_clean), strict=False):
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns, name
        after = Counter(map(tuple, docs.collect()))
        assert after == Counter(map(tuple, brute(before, spark, spark.createDataFrame(before, docs.schema), sf_dir))), name
        assert len(after) < len(before) or name == "language_id"
    before = docs.collect()
    docs = corpus_pipeline.mix(spark, docs, sf_dir).persist()
    assert docs.columns == columns
    # every source's words against its target: at most three times a document, and no nearer sum left out
    sizes, times = defaultdict(Counter), Counter(r.doc_id for r in docs.collect())
    for r in before:
        sizes[r.source][len(WORD.findall(r.text))] += 1
    want = targets_of({s: sum(n * k for n, k in c.items()) for s, c in sizes.items()})
    for source, c in sizes.items():
        whole = sum(n * k for n, k in c.items())
        repeats = int(want[source] // whole)
        taken = sum(times[r.doc_id] * len(WORD.findall(r.text)) for r in before if r.source == source)
        assert taken == repeats * whole + best_sum(c, min(whole, round(want[source] - repeats * whole)))
        assert all(repeats <= times[r.doc_id] <= min(3, repeats + 1) for r in before if r.source == source)
    rows = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    total, at, placed, slots = sum(r[1] for r in rows), 0, [], Counter()
    for r in rows:
        shard = at * 16 // total
        placed.append((*r, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += r[1]
    assert sorted(map(tuple, corpus_pipeline.shards(spark, docs, sf_dir).collect())) == sorted(placed)


def test_an_empty_table_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_odd_rows_pass(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_mix_takes_rows_without_and_with_repeated_ids(spark, sf_dir):
    """Each row as often as the mix takes it; sizes tell the rows apart."""
    rows = [(None if k % 3 == 0 else k // 2, " ".join(["w"] * (k + 1)), f"s{k % 4}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r.doc_id, r.source, r["size"]): r.times for r in mixing.mix_sources(docs).collect() if r.times}
    assert any(d is None for d, _, _ in want) and len(set(want.values())) > 1
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()) == want


def test_one_of_each_group_stays(spark, sf_dir, odd_docs):
    kept = corpus_pipeline.near_duplicates(spark, odd_docs.select("doc_id", "text"), sf_dir).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[106] == 0 and ids[2] == 1 and ids[104] == 0 and ids[1] == 1 and ids[107] == 0 and ids[103] == 1


def test_rows_of_one_doc_id_are_told_apart(spark, sf_dir):
    """A doc_id with several texts, null ids and copies of different source: one row of each group stays, the same in each run."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a, "s", 1), (5, a, "s", 2), (5, b, "t", 3), (9, b, "s", 4), (9, b, "r", 5), (7, c, "s", 6), (None, b, "s", 7), (None, c + " more", "z", 8), (None, c + " more", "y", 9), (8, None, "s", 10), (8, None, "s", 10), (8, " ", "s", 11)]
    alone = [(None, " ".join(f"n{k}" for k in range(40)), x, 12) for x in "vuu"]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string, source string, n long")
    want = sorted([(1, a, "s", 1), (5, b, "t", 3), (7, c, "s", 6), (8, None, "s", 10), (8, None, "s", 10), (8, " ", "s", 11), (None, alone[0][1], "u", 12)], key=repr)
    for parts in (1, 4):
        assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs.repartition(parts), sf_dir).collect()), key=repr) == want


def test_leaking_rows_go_whatever_their_doc_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    clean = " ".join(f"clean{k}" for k in range(50))
    rows = [(1, clean, "s"), (1, f"{clean} {item}", "s"), (None, item, "s"), (None, clean, "t"), (2, None, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text2 string")
    got = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], *rows[3:]], key=repr)
