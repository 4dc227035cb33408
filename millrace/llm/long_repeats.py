"""Removal of long repeats: suffixes sorted one bucket at a time, long ties resolved by cover-sample ranks.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. So the
suffixes that start such strings are to be told apart to that depth, in buckets:

* A suffix's bucket is the minimal hash of all ``GRAM``-byte strings in its first ``length`` bytes (its
  anchor): equal strings have the same anchor at the same offset, and neighbouring suffixes share
  one, so that a bucket's entry is an anchor's place with the run of suffixes that it serves.
* Entries whose anchor hash occurs once in the corpus drop out. For the others a second pass emits
  the bytes around the anchor; entries of equal bytes are one row with a count from here on (one
  that counts two is repeated as a whole, whatever else its bucket holds).
* Buckets are sorted one block at a time, in memory bounded by the block. The places whose distance to the
  anchor has a residue in ``RESIDUES``, a difference cover of the period ``COVER``, are the block's sample.
  Their ranks are computed first, by doubling: a sampled place's successor at a multiple of the period is
  sampled too, so ranks of h bytes give those of 2 h. Suffixes are then sorted by their first
  ``COVER`` bytes; longer ties are resolved by the ranks at the shift that takes both suffixes to
  sampled places, and by the last few bytes, so that no comparison reads ``length`` bytes again.
* A bucket too large for a block is split by a longer prefix, again and again: its entries' runs fall into
  pieces of fewer suffixes at the same distances from the anchor, and all bytes that the suffixes of a piece
  have in common name the new bucket. A piece of one suffix has ``length`` of them, so that its
  bucket holds one entry with a count.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .store import cut, rows_below

GRAM = 48
#: Least length of the strings.
LEAST = 64
#: A difference cover: any two residues modulo COVER have a shift that takes both into RESIDUES.
COVER, RESIDUES = 16, (0, 1, 2, 5, 8)
#: Bytes of a text hashed at once, entries of a sorted block, and bits of the filter of repeated anchors at most.
PIECE, BLOCK, FILTER_BITS = 1 << 20, 2048, 1 << 27
#: A block is sorted when it has so many suffixes, or as many entries as a bucket may have.
SUFFIXES = 1 << 19
#: Suffixes in a piece of a run, each time that a bucket is split.
SPLITS = (64, 8, 1)
#: Rows of an id list that may be broadcast (24 bytes each).
BROADCAST_ROWS = 500_000
SALTS = 8
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes, by doubling: 16 + 32."""
    h, size, factor, parts = data.astype(np.uint64) + np.uint64(1), 1, _MULTIPLY, {}
    while size < 32:
        h = h[:-size] * factor + h[size:]
        factor = factor * factor
        size *= 2
        parts[size] = (h, factor)
    (a, _), (b, by) = parts[16], parts[32]
    n = len(data) - GRAM + 1
    return _mix(a[:n] * by + b[16 : 16 + n])


def anchors(data: np.ndarray, length: int):
    """``(hash, place, first, last)`` arrays: the anchors of a text and the run of suffixes that each serves.

    Of equal hashes in a suffix's reach the last is the anchor.
    """
    out, total = [], len(data) - length + 1  # suffixes of at least that length
    with np.errstate(over="ignore"):
        for base in range(0, max(0, total), PIECE):
            part = data[base : min(len(data), base + PIECE + length - 1)]
            full = _gram_hashes(part)
            place = np.arange(len(full), dtype=np.uint64)
            low = (full & ~_PLACE) | (_PLACE - place)
            size, reach = 1, length - GRAM + 1
            while size * 2 <= reach:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < reach:
                low = np.minimum(low[: len(part) - length + 1], low[reach - size :])
            at = (_PLACE - (low & _PLACE)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            out.append((full[at[first]], base + at[first], base + first, base + last))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def _anchor_hashes(length: int):
    def run(batches):
        for batch in batches:
            for text in batch.column("text"):
                h, *_ = anchors(_bytes(text), length)
                if len(h):
                    one, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int64))], names=["anchor", "n"])

    def joined(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return joined


def _filter_words(bits: int):
    """The set bits of a Bloom filter with two hashes, as (word, value)."""

    def run(batches):
        for batch in batches:
            h = batch.column("anchor").to_numpy().view(np.uint64)
            if len(h):
                at = np.unique(np.concatenate(_filter_bits(h, bits)))
                word, begin = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), begin)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    return run


def _filter_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _entries(length: int, bits: int, words: bytes):
    """Anchors that the filter holds, with the bytes that their suffixes span.

    ``key`` names the bytes and the runs' extent; suffixes are counted from the anchor.
    """

    def run(batches):
        held = np.frombuffer(words, np.uint64)
        for batch in batches:
            rows = {k: [] for k in ("row", "anchor", "first", "last", "place", "span", "key")}
            size = 0
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                data = _bytes(text)
                h, place, first, last = anchors(data, length)
                good = np.ones(len(h), bool)
                for at in _filter_bits(h, bits):
                    good &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                for k in np.flatnonzero(good).tolist():
                    span = data[first[k] : last[k] + length].tobytes()
                    lead = int(place[k] - first[k])
                    rows["row"].append(row)
                    rows["anchor"].append(int(h[k].view(np.int64)))
                    rows["first"].append(int(first[k]))
                    rows["last"].append(int(last[k]))
                    rows["place"].append(lead)
                    rows["span"].append(span)
                    rows["key"].append(hashlib.blake2b(span + lead.to_bytes(4, "little"), digest_size=16).digest())
                    size += len(span)
                if size > 8 << 20:
                    yield _entry_batch(rows)
                    rows, size = {k: [] for k in rows}, 0
            yield _entry_batch(rows)

    return run


def _entry_batch(rows) -> pa.RecordBatch:
    kinds = {"row": pa.binary(), "anchor": pa.int64(), "first": pa.int32(), "last": pa.int32(), "place": pa.int32(), "span": pa.binary(), "key": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))


def common_shifts() -> np.ndarray:
    """For each two residues the least shift that takes both into the cover."""
    held = np.isin(np.arange(2 * COVER) % COVER, RESIDUES)
    return np.array([[np.flatnonzero(held[a : a + COVER] & held[b : b + COVER])[0] for b in range(COVER)] for a in range(COVER)])


_SHIFT, _COVERED = common_shifts().astype(np.int32), np.isin(np.arange(COVER), RESIDUES)


def _words(text: np.ndarray, places: np.ndarray, size: int) -> list[np.ndarray]:
    """The ``size`` bytes from each place on as numbers that sort as they do."""
    windows = np.lib.stride_tricks.sliding_window_view(text, 8)
    return [windows[places + k].view(">u8")[:, 0].astype(np.uint64) for k in range(0, size, 8)]


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks of keys that ``order`` sorts; equal keys have one."""
    new = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def sample_ranks(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """By place, the rank of the ``depth`` bytes from each sampled place on, in their order.

    depth is a multiple of COVER. Places whose successors aren't sampled have ranks of no meaning.
    """
    at = np.full(len(text) + depth, -1, np.int32)
    at[places] = np.arange(len(places), dtype=np.int32)
    high, low = _words(text, places, COVER)
    rank, size = _dense(np.lexsort((low, high)), high, low), COVER
    while size < depth:
        step = min(size, depth - size)
        key = (rank.astype(np.int64) << 32) + rank[at[places + step]]
        rank = _dense(np.argsort(key), key)
        size += step
    out = np.zeros(len(text), np.int32)
    out[places] = rank
    return out


def sort_block(spans: list[bytes], leads: np.ndarray, buckets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's suffixes by bucket and first ``length`` bytes, and which of them tie with the one before.

    Suffixes are numbered entry by entry. Equal strings lie at equal distances from their anchors, so
    that only such suffixes are said to tie.
    """
    counts = np.array([len(s) - length + 1 for s in spans])
    sizes = np.array([len(s) for s in spans])
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(spans) + bytes(length + 8), np.uint8)
    entry = np.repeat(np.arange(len(spans), dtype=np.int32), counts)
    within = np.arange(len(entry), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    start, offset = begins.astype(np.int32)[entry] + within, within - leads.astype(np.int32)[entry]  # offset: from the anchor
    depth = (length // COVER - 1) * COVER
    # every place's distance from its anchor
    place = np.arange(len(text) - length - 8, dtype=np.int32) - np.repeat((begins + leads).astype(np.int32), sizes)
    rank = sample_ranks(text, np.flatnonzero(_COVERED[place % COVER]), depth)
    residue, bucket = offset % COVER, buckets.astype(np.int32)[entry]
    del place, entry, within
    high, low = _words(text, start, COVER)
    order = np.lexsort((low, high, bucket))
    group = _dense(order, bucket, high, low)
    del high, low
    # the last bytes, of which those before the ranks' end are equal anyway where they come to be compared
    tail = _words(text, start + length - (16 if length % COVER == 0 else 32), 16 if length % COVER == 0 else 32)
    long = rank[start + _SHIFT[residue, residue]]
    order = np.lexsort((*tail[::-1], long, group))
    i, j = order[:-1], order[1:]
    tie = (group[i] == group[j]) & (long[i] == long[j]) & (offset[i] == offset[j])
    for t in tail:
        tie &= t[i] == t[j]
    # groups of several residues: their order takes the shift that two suffixes have in common
    edge = np.flatnonzero(np.concatenate([[True], group[i] != group[j], [True]]))
    mixed = np.add.reduceat(np.concatenate([(group[i] == group[j]) & (residue[i] != residue[j]), [False]]), edge[:-1]) > 0 if len(order) else []
    tie = np.concatenate([[False], tie])

    def compare(x: int, y: int) -> int:
        shift = _SHIFT[residue[x], residue[y]]
        p, q = rank[start[x] + shift], rank[start[y] + shift]
        if p == q:
            p, q = (text[start[k] + shift + depth : start[k] + length].tobytes() for k in (x, y))
        return int(p > q) - int(p < q)

    for k in np.flatnonzero(mixed).tolist():
        part = sorted(order[edge[k] : edge[k + 1]].tolist(), key=cmp_to_key(compare))
        order[edge[k] : edge[k + 1]] = part
        tie[edge[k] + 1 : edge[k + 1]] = [offset[x] == offset[y] and compare(x, y) == 0 for x, y in zip(part, part[1:], strict=False)]
    return order, tie


def tied(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Which suffixes tie with another."""
    flags = np.zeros(len(order), bool)
    flags[order] = tie | np.concatenate([tie[1:], [False]])
    return flags


def _runs(flags: np.ndarray) -> bytes:
    """(first, last) of the runs of set flags, as 32-bit integers."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).astype("<i4").tobytes()


def _sort_buckets(length: int):
    """Rows come sorted by bucket; whole buckets fill a block."""

    def run(batches):
        rows: list[tuple] = []
        many = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "place", "span", "n")), strict=True):
                if (len(rows) >= BLOCK or many >= SUFFIXES) and r[0] != rows[-1][0]:
                    yield _sorted(rows, length)
                    rows, many = [], 0
                rows.append(r)
                many += len(r[3]) - length + 1
        if rows:
            yield _sorted(rows, length)

    return run


def _sorted(rows: list[tuple], length: int) -> pa.RecordBatch:
    alone = [k for k, r in enumerate(rows) if r[4] == 1]
    flags = [np.ones(len(r[3]) - length + 1, bool) for r in rows]
    if alone:
        spans, leads = [r[3] for r in rows], np.array([r[2] for r in rows])
        _, buckets = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        many = np.bincount(buckets)[buckets] > 1
        use = np.flatnonzero(many)
        for k in np.flatnonzero(~many).tolist():
            if rows[k][4] == 1:
                flags[k][:] = False
        if len(use):
            got = tied(*sort_block([spans[k] for k in use], leads[use], buckets[use], length))
            ends = np.cumsum([len(spans[k]) - length + 1 for k in use])
            for k, f in zip(use.tolist(), np.split(got, ends[:-1]), strict=True):
                flags[k] |= f
                if rows[k][4] == 1:
                    flags[k] = f
    hit = [k for k in range(len(rows)) if flags[k].any()]
    return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in hit], pa.binary()), pa.array([_runs(flags[k]) for k in hit], pa.binary())], names=["key", "runs"])


def _pieces(length: int, size: int):
    """The runs of large buckets' entries in pieces of ``size`` suffixes, by the bytes that a piece's suffixes share."""

    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("parent", "at", "anchor", "key", "place", "span", "n")}
            for anchor, parent, lead, span, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "place", "span", "n")), strict=True):
                for piece in range((lead - (len(span) - length)) // size, lead // size + 1):
                    first, last = max(0, lead - (piece + 1) * size + 1), min(len(span) - length, lead - piece * size)
                    part, place = span[first : last + length], lead - first
                    shared = span[lead - piece * size : lead - (piece + 1) * size + 1 + length]
                    rows["parent"].append(parent)
                    rows["at"].append(first)
                    rows["anchor"].append(xxhash.xxh3_64_intdigest(b"%d %d %d " % (anchor, size, piece) + shared) - (1 << 63))
                    rows["key"].append(hashlib.blake2b(part + b"%d %d" % (place, anchor), digest_size=16).digest())
                    rows["place"].append(place)
                    rows["span"].append(part)
                    rows["n"].append(n)
            kinds = {"parent": pa.binary(), "at": pa.int32(), "anchor": pa.int64(), "key": pa.binary(), "place": pa.int32(), "span": pa.binary(), "n": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))

    return run


def _moved(batches):
    """Runs counted from their parents' first suffixes."""
    for batch in batches:
        runs = [(np.frombuffer(r, "<i4") + np.int32(at)).tobytes() for r, at in zip(batch.column("runs").to_pylist(), batch.column("at").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("parent"), pa.array(runs, pa.binary())], names=["key", "runs"])


def _remove(length: int, texts_too: bool):
    """Removes the runs from each text."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for text, firsts, runs in zip(batch.column("text"), batch.column("firsts"), batch.column("runs"), strict=True):
                data = _bytes(text)
                mark = np.zeros(len(data) + 1, np.int32)
                for first, some in zip(firsts.as_py() or [], runs.as_py() or [], strict=True):
                    r = np.frombuffer(some, "<i4").reshape(-1, 2).astype(np.int64) + first
                    np.add.at(mark, r[:, 0], 1)
                    np.add.at(mark, r[:, 1] + length, -1)
                gone = np.cumsum(mark)[:-1] > 0
                kept = data[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if texts_too else None)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(_bytes(t)) for t in batch.column("text")], pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", "n_bytes", *out])

    return run


def _repeats(spans: DataFrame, length: int, splits: tuple[int, ...]) -> DataFrame:
    """``(key, runs)`` of entries ``spans (anchor, key, place, span, n)``: runs of suffixes that others equal."""
    # large buckets are few, as each has so many different entries
    large = cut(spans.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("anchor"), "repeats")
    small = spans if large.isEmpty() else spans.join(large, "anchor", "left_anti")
    found = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_buckets(length), "key binary, runs binary")
    if large.isEmpty() or not splits:
        return found
    schema = "parent binary, at int, anchor long, key binary, place int, span binary, n long"
    pieces = cut(spans.join(large, "anchor", "left_semi").mapInArrow(_pieces(length, splits[0]), schema), "repeats")
    parts = cut(pieces.groupBy("anchor", "key", "place", "span").agg(F.sum("n").alias("n")), "repeats")
    below = _repeats(parts, length, splits[1:]).join(pieces.select("key", "parent", "at"), "key")
    return found.union(below.select("parent", "at", "runs").mapInArrow(_moved, "key binary, runs binary"))


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """``(row, first, runs)`` of ``docs (row, text)``: runs of suffixes, counted from first, that start repeated strings."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_anchor_hashes(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    repeated = cut(counted, "repeats")
    bits = min(FILTER_BITS, 1 << max(16, (16 * repeated.count()).bit_length()))
    words = np.zeros(bits >> 6, np.uint64)
    # at most FILTER_BITS bits come to the driver and go to the tasks
    for r in repeated.mapInArrow(_filter_words(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toLocalIterator():
        words[r.word] = np.int64(r.value).view(np.uint64)
    schema = "row binary, anchor long, first int, last int, place int, span binary, key binary"
    entries = cut(docs.mapInArrow(_entries(length, bits, words.tobytes()), schema), "repeats")
    spans = cut(entries.groupBy("anchor", "key", "place", "span").agg(F.count("*").alias("n")), "repeats")
    found = _repeats(spans, length, SPLITS)
    # entries of one key may be many: they meet salted copies of its runs
    salted = cut(found, "repeats").select("key", "runs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("row", "first"), F.lit(SALTS)).cast("int")
    return entries.select("row", "first", "key", salt.alias("salt")).join(salted, ["key", "salt"]).select("row", "first", "runs")


def remove_repeats(docs: DataFrame, length: int = 400, texts_too: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row of ``docs (doc_id, text)``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in this
    document or another, is removed (``length`` is ``LEAST`` or more); strings are judged on the input and never cross documents.
    kept holds the remaining bytes (null if ``texts_too`` is false). Null texts are empty; texts shorter than ``length`` stay. Rows
    are told apart by doc_id and text, so rows with null or repeated doc_ids are documents of their
    own, and a row that comes twice loses all that ``length`` bytes cover. An empty table gives no
    rows. Other columns aren't read.
    """
    ship(docs.sparkSession)
    if length < LEAST:
        raise ValueError(f"length must be at least {LEAST}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary")))
    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), row.alias("row"))
    runs = repeated_runs(texts.where(F.octet_length("text") >= length).select("row", "text"), length)
    hit = cut(runs.groupBy("row").agg(F.collect_set(F.struct("first", "runs")).alias("r")).select("row", F.col("r.first").alias("firsts"), F.col("r.runs").alias("runs")), "repeats")
    keys = hit.select("row")
    if rows_below(keys, BROADCAST_ROWS):
        keys = F.broadcast(keys)
    changed = texts.join(keys, "row", "left_semi").join(hit.hint("shuffle_hash"), "row")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    same = texts.join(keys, "row", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if texts_too else F.lit(None).cast("binary")).alias("kept"))
    return changed.select("doc_id", "text", "firsts", "runs").mapInArrow(_remove(length, texts_too), schema).unionByName(same)
