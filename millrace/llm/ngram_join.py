"""Jaccard join of word n-gram sets by token-combination prefixes.

1. One pass over the texts hashes each document's distinct n-grams ("tokens") and names its set by a
   64-bit digest (documents of equal sets are one class from here on). Tasks gather their documents'
   tokens in chunks and send each token's 48 bits and its document's place in the chunk to the
   token's part of the hash range, packed and sorted, a few large rows for each chunk and part. A
   token that several documents of a chunk hold goes as one entry with its count, so that a token of
   all documents is an entry for each chunk.
2. Each part counts in how many documents its tokens occur, exactly. Tokens of one document only can't be
   shared and go no further; the others return to their chunks with a level of their count.
3. Two sets of Jaccard >= t share at least t of each one's tokens, so a document with fewer tokens that
   others hold links with nothing. The rest order their tokens by level, the rarest first, and differ
   in few tokens, so that signatures of a prefix in that order suffice: single tokens while at most
   ``FREQUENT`` documents hold them; where these don't fill the prefix it is extended by
   frequent tokens, and pairs of these are signatures (frequent tokens fall into groups by hash and only pairs
   within a group count, the prefix being longer by one for each group); so a frequent token alone
   never makes a candidate.
4. Classes of one signature are candidates. First each is paired with the first of its list and the
   one before it only; then, once links found so far are contracted to components, all pairs of
   classes in different components. Pairs pass the size filter and the bitmaps' bound (tokens of one document
   only and parities that differ are a lower bound of the symmetric difference) and are verified on the whole
   sets. Pairs of short lists are joined; long lists are compared in tiles, of which only pairs within
   the bound come out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .caches import held
from .components import connected_components
from .store import cut, discard, rows_below

#: A token is frequent if more documents hold it.
FREQUENT = 64
#: Frequent tokens of a prefix are dealt into groups of about this size; only pairs within one are signatures.
GROUP = 12
#: Tokens and documents of a chunk, and documents of a chunk from which on a token goes to be counted as one entry.
CHUNK_TOKENS, CHUNK_DOCS, TOGETHER = 1 << 20, 60_000, 4
#: Rows of an id list that may be broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: Longer lists are compared in tiles, of this many classes.
SHORT, TILE = 32, 2048
WORD_CACHE = 200_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-grams of words (ASCII lower-cased, split at ASCII white space)."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > WORD_CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))
        h = np.full(len(ids) - n + 1, len(ids) if len(ids) < self.n else 0, np.uint64)
        for k in range(n):
            h = _mixed(h * _MIX[0] + ids[k : len(ids) - n + 1 + k])
        return np.unique(h)


def shingler_for(n: int) -> Shingler:
    """A worker's shingler, with the words that its earlier tasks have met."""
    return held("shingles", n, lambda: Shingler(n))


def class_of(tokens: np.ndarray) -> int:
    """A set's digest as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def bitmap_bits(n: int) -> int:
    """Bits of a set's parity bitmap: a power of two, about as many as the set has tokens."""
    return 1 << max(7, min(17, (max(1, n) - 1).bit_length()))


def bitmap(tokens: np.ndarray, n: int) -> np.ndarray:
    """Parities of some of a set's tokens; n is the whole set's size."""
    bits = bitmap_bits(n)
    odd = np.bincount((tokens >> np.uint64(16)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd)


def bitmaps_differ(a: bytes, b: bytes) -> int:
    """At least so many tokens are in one set only; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m tokens whose Jaccard is at least percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def size_bucket(n: int, percent: int) -> int:
    """Sets that can link are in the same bucket or in adjacent ones."""
    return int(math.log(n) / -math.log(percent / 100) + 1e-9)


def level_of(count: np.ndarray) -> np.ndarray:
    """A count of documents, two at least, as a byte that grows with its logarithm."""
    return np.minimum(255, np.log2(count) * 8).astype(np.uint8)


def signatures(tokens: np.ndarray, levels: np.ndarray, n: int, percent: int) -> np.ndarray:
    """64-bit signatures of a set of n tokens, at least one of them shared by any two different sets that link.

    ``tokens`` has those that other documents hold too, by level and then by value.
    """
    left = n - -(-percent * n // 100) + 1 - (n - len(tokens))  # of the prefix, after the tokens of this document only
    if 100 * n < percent * (n + 1) or left <= 0:
        return tokens[:0]  # only an equal set could link, or none
    rare = int((levels <= level_of(np.array(FREQUENT))).sum())
    if rare >= left:
        return tokens[:left]
    hot, out = tokens[rare:], [tokens[:rare]]
    bucket = size_bucket(n, percent)
    for b in (bucket, bucket + 1):  # a set meets others in its own bucket and in that of larger ones
        most = (100 / percent) ** (b + 1)
        groups = max(1, int(most * (100 - percent) / 100 / GROUP))
        group = (_mixed(hot) % np.uint64(groups)).astype(np.int64)
        # the shortest prefix of frequent tokens whose signatures outnumber what may be missing
        firsts = np.zeros(len(hot), np.int64)
        firsts[np.unique(group, return_index=True)[1]] = 1
        sure = np.cumsum(1 - firsts)
        stop = int(np.searchsorted(sure, left - rare)) + 1
        if stop > len(hot):  # too few: single tokens and all groups, so that nothing is lost
            out.append(hot)
            stop = len(hot)
        order = np.argsort(group[:stop], kind="stable")
        part, g = hot[:stop][order], group[:stop][order]
        for k in range(1, len(part)):
            same = g[k:] == g[:-k]
            if not same.any():
                break
            one, other = part[:-k][same], part[k:][same]
            out.append(_mixed(_mixed(np.minimum(one, other) + np.uint64(b + 1)) * _MIX[0] + np.maximum(one, other)))
    return np.unique(np.concatenate(out))


def pack(tokens: np.ndarray) -> bytes:
    """48-bit tokens, byte by byte of all, so that the high bytes of sorted ones compress."""
    return np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view("<u8")[:, 0]


_MEMBER, _TOKENS, _CHUNK, _COUNTED = range(4)
_HOT = 0xFFFF
_PACKED = "kind int, part int, chunk long, doc_id long, digest long, n int, cls long, a binary, b binary, c binary, d binary"


def _packed(kind: int, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "part": pa.int32(), "chunk": pa.int64(), "doc_id": pa.int64(), "digest": pa.int64(), "n": pa.int32(), "cls": pa.int64(), **dict.fromkeys("abcd", pa.binary())}
    columns["kind"] = [kind] * rows
    return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()], names=list(kinds))


def _chunk(chunk: int, tokens: list[np.ndarray], cls: list[int], parts: int):
    """A chunk's tokens for each part, and a row that stays with the chunk: its classes, and the tokens that many of them hold."""
    sizes = np.array([len(t) for t in tokens], np.int32)
    token = np.concatenate(tokens) >> np.uint64(16)
    doc = np.repeat(np.arange(len(tokens), dtype=np.uint16), sizes)
    order = np.argsort(token)
    token, doc = token[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(begin, append=len(token))
    alone = np.repeat(count < TOGETHER, count)
    many, times = token[begin[count >= TOGETHER]], count[count >= TOGETHER].astype("<u2")
    own = _packed(_CHUNK, 1, part=[chunk % parts], chunk=[chunk], a=[np.array(cls, "<i8").tobytes()], b=[sizes.astype("<i4").tobytes()], c=[pack(token[~alone])], d=[doc[~alone].tobytes()])
    token, doc = token[alone], doc[alone]
    bounds = [np.searchsorted((t >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1)) for t in (token, many)]
    full = [k for k in range(parts) if any(x[k] < x[k + 1] for x in bounds)]
    cuts = [[(x[k], x[k + 1]) for k in full] for x in bounds]
    yield own
    yield _packed(_TOKENS, len(full), part=full, chunk=[chunk] * len(full), a=[pack(token[i:j]) for i, j in cuts[0]], b=[doc[i:j].tobytes() for i, j in cuts[0]], c=[pack(many[i:j]) for i, j in cuts[1]], d=[times[i:j].tobytes() for i, j in cuts[1]])


def _postings(n: int, parts: int):
    """Each document's class and set size, and its tokens in chunks."""

    def run(batches):
        shingle, task, chunks = shingler_for(n), TaskContext.get().partitionId(), 0
        tokens, classes, many = [], {}, 0
        for batch in batches:
            size, cls = [], []
            for text in batch.column("text"):
                t = shingle(text.as_py())
                size.append(len(t))
                cls.append(class_of(t) if len(t) else None)
                if len(t) and cls[-1] not in classes:
                    classes[cls[-1]] = None
                    tokens.append(t)
                    many += len(t)
                    if many >= CHUNK_TOKENS or len(tokens) >= CHUNK_DOCS:
                        yield from _chunk(task << 32 | chunks, tokens, list(classes), parts)
                        tokens, classes, many, chunks = [], {}, 0, chunks + 1
            spread = (np.arange(len(size)) + task) % parts
            yield _packed(_MEMBER, len(size), part=spread, doc_id=batch.column("doc_id"), digest=batch.column("digest"), n=size, cls=cls)
        if tokens:
            yield from _chunk(task << 32 | chunks, tokens, list(classes), parts)

    return run


def _count(batches):
    """A part's tokens that at least two documents hold, with levels, for each chunk; other rows pass."""
    chunk, many, token, doc, weight = [], [], [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind != _TOKENS).any():
            yield batch.filter(pa.array(kind != _TOKENS))
        for k in np.flatnonzero(kind == _TOKENS).tolist():
            a, b, c, d = (batch.column(x)[k].as_buffer() for x in "abcd")
            one, hot, times = unpack(a), unpack(c), np.frombuffer(d, "<u2")
            chunk.append(batch.column("chunk")[k].as_py())
            many.append(len(one) + len(hot))
            token += [one, hot]
            doc += [np.frombuffer(b, "<u2"), np.full(len(hot), _HOT, np.uint16)]
            weight += [np.ones(len(one), np.uint16), times]
    if not chunk:
        return
    token, doc, weight = (np.concatenate(x) for x in (token, doc, weight))
    order = np.argsort(token)
    sorted_token = token[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_token[1:] != sorted_token[:-1]]))
    count = np.add.reduceat(weight[order].astype(np.int64), begin)
    level = np.zeros(len(token), np.uint8)
    level[order] = np.repeat(np.where(count > 1, level_of(np.maximum(count, 2)), 0).astype(np.uint8), np.diff(begin, append=len(token)))
    del order, sorted_token, weight
    ends = np.cumsum(many)
    for k in range(0, len(chunk), 64):
        some = []
        for j in range(k, min(k + 64, len(chunk))):
            at = slice(ends[j] - many[j], ends[j])
            held_by_others = level[at] > 0
            some.append([x[at][held_by_others] for x in (token, doc, level)])
        yield _packed(_COUNTED, len(some), chunk=chunk[k : k + 64], a=[pack(t) for t, _, _ in some], b=[d.tobytes() for _, d, _ in some], c=[x.tobytes() for _, _, x in some])


def _candidates(percent: int):
    """The classes of a chunk that share enough tokens with others to link, with bitmaps of these tokens and signatures."""

    def run(key, table):
        own = table.filter(pc.equal(table["kind"], _CHUNK)).to_pylist()[0]
        back = table.filter(pc.equal(table["kind"], _COUNTED))
        cls, n = np.frombuffer(own["a"], "<i8"), np.frombuffer(own["b"], "<i4").astype(np.int64)
        token, doc, level = (np.concatenate([none, *[f(x.as_buffer()) for x in back[c]]]) for c, f, none in (("a", unpack, np.zeros(0, np.uint64)), ("b", lambda x: np.frombuffer(x, "<u2"), np.zeros(0, np.uint16)), ("c", lambda x: np.frombuffer(x, np.uint8), np.zeros(0, np.uint8))))
        hot = doc == _HOT
        order = np.argsort(token[hot])
        many, of = unpack(own["c"]), np.frombuffer(own["d"], "<u2")
        levels = level[hot][order][np.searchsorted(token[hot][order], many)] if len(many) else level[:0]
        token, doc, level = np.concatenate([token[~hot], many]), np.concatenate([doc[~hot], of]).astype(np.int64), np.concatenate([level[~hot], levels])
        shared = np.bincount(doc, minlength=len(cls))
        can = (shared >= -(-percent * n // 100)) & (100 * n >= percent * (n + 1))
        use = can[doc]
        token, doc, level = token[use], doc[use], level[use]
        order = np.lexsort((token, level, doc))
        token, level = token[order], level[order]
        ends = np.cumsum(np.where(can, shared, 0))
        rows = {k: [] for k in ("cls", "n", "alone", "bits", "sigs")}
        for k in np.flatnonzero(can).tolist():
            at = slice(ends[k] - shared[k], ends[k])
            rows["cls"].append(int(cls[k]))
            rows["n"].append(int(n[k]))
            rows["alone"].append(int(n[k] - shared[k]))
            rows["bits"].append(bitmap(token[at], int(n[k])).tobytes())
            rows["sigs"].append(signatures(token[at], level[at], int(n[k]), percent).view(np.int64))
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=list(rows))

    return run


def _lists(batches):
    """Signatures of at least two classes, out of rows sorted by signature and class.

    Each row has the first class of its list, the class before it and its place; only the last row
    is held between batches, however long a list is.
    """
    held = None  # sig, cls, n, first, place; whether it has come out
    for batch in batches:
        sig, cls, n = (batch.column(c).to_numpy() for c in ("sig", "cls", "n"))
        if not len(sig):
            continue
        if held:
            sig, cls, n = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held[:3], (sig, cls, n), strict=True))
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
        sig, cls, n = sig[new], cls[new], n[new]
        start = np.concatenate([[True], sig[1:] != sig[:-1]])
        at = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        place, first = np.arange(len(sig)) - at[run], cls[at[run]]
        if held:
            place, first = np.where(run == 0, place + held[4], place), np.where(run == 0, held[3], first)
        before = np.where(start, cls, np.concatenate([cls[:1], cls[:-1]]))
        out = (place > 0) | np.concatenate([~start[1:], [False]])
        if held and held[5]:
            out[0] = False
        came = bool(out[-1]) or bool(held and held[5] and len(sig) == 1)
        held = (sig[-1], cls[-1], n[-1], first[-1], place[-1], came)
        columns = {"sig": sig, "cls": cls, "n": n, "first": first, "before": before, "place": place.astype(np.int64)}
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in columns.values()], names=list(columns))


def _tile(percent: int):
    """Pairs of one cell of a long list, in different components, that sizes and bitmaps allow.

    A pair comes out of the first of the long lists that it shares only.
    """

    def run(key, table):
        side, cls, n, alone, of = (table.column(c).to_numpy() for c in ("side", "cls", "n", "alone", "component"))
        bits, sigs, own = table.column("bits").to_pylist(), table.column("sigs").to_pylist(), key[0].as_py()
        same = key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        maps: dict[int, np.ndarray] = {}

        def folded(size):  # all bitmaps folded to a size; shorter ones don't come up
            if size not in maps:
                rows = [np.frombuffer(b, np.uint8) for b in bits]
                maps[size] = np.stack([np.bitwise_xor.reduce(r.reshape(-1, size), axis=0) if len(r) >= size else np.zeros(size, np.uint8) for r in rows]).view(np.uint64)
            return maps[size]

        length = np.array([len(b) for b in bits])
        a, b = [], []
        for i in left.tolist():
            mine = set(sigs[i])
            j = right[(cls[right] > cls[i] if same else cls[right] != cls[i]) & (of[right] != of[i]) & (100 * n[right] >= percent * n[i]) & (100 * n[i] >= percent * n[right])]
            for size in np.unique(np.minimum(length[j], length[i])).tolist():
                some, m = j[np.minimum(length[j], length[i]) == size], folded(size)
                most = n[some] + n[i] - 2 * -(-percent * (n[some] + n[i]) // (100 + percent)) - alone[some] - alone[i]
                some = some[np.bitwise_count(m[some] ^ m[i]).sum(axis=1) <= most]
                some = some[[next(s for s in sigs[k] if s in mine) == own for k in some.tolist()]] if len(some) else some
                a.append(np.full(len(some), cls[i]))
                b.append(cls[some])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _bound(percent: int):
    """Pairs whose bitmaps allow the overlap they need."""

    def run(batches):
        for batch in batches:
            n, m, alone, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "alone", "x", "y"))
            keep = [bitmaps_differ(p, q) + k <= i + j - 2 * overlap_needed(i, j, percent) for i, j, k, p, q in zip(n, m, alone, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tokens_of(n: int):
    def run(batches):
        shingle, done = shingler_for(n), set()
        for batch in batches:
            rows = {c: t for c, t in zip(batch.column("cls").to_pylist(), batch.column("text"), strict=True) if c not in done}
            done.update(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([shingle(t.as_py()).tobytes() for t in rows.values()], pa.binary())], names=["cls", "tokens"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent = n, percent
        spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.docs = self.docs.withColumn("digest", F.xxhash64("text"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = cut(self.docs.mapInArrow(_postings(n, parts), _PACKED).repartitionById(parts, F.col("part")).mapInArrow(_count, _PACKED), "ngram")
        self.members = cut(rows.where(F.col("kind") == _MEMBER).select("doc_id", "digest", F.col("n").cast("long").alias("n"), "cls"), "ngram")
        self.classes = cut(
            self.members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row"), F.count("*").alias("copies")), "ngram"
        )
        chunks = rows.where(F.col("kind").isin(_CHUNK, _COUNTED)).select("chunk", "kind", "a", "b", "c", "d")
        self.candidates = cut(chunks.groupBy("chunk").applyInArrow(_candidates(percent), "cls long, n long, alone long, bits binary, sigs array<long>"), "ngram")
        discard(rows)

    def lists(self) -> DataFrame:
        """Signatures of at least two classes: ``(sig, cls, n, first, before, place)``."""
        emitted = self.candidates.select(F.explode("sigs").alias("sig"), "cls", "n")
        return cut(emitted.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_lists, "sig long, cls long, n long, first long, before long, place long"), "ngram")

    def _maps(self) -> DataFrame:
        """Candidates' sizes and bitmaps; those of a class are the same in each chunk."""
        return self.candidates.select("cls", "n", "alone", "bits").dropDuplicates(["cls"])

    def _near(self, a: str, b: str):
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (F.col(b) * 100 >= F.col(a) * self.percent)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (a, b)`` of classes that link."""
        c = self._maps()
        x = c.select(F.col("cls").alias("a"), "n", F.col("alone").alias("own"), F.col("bits").alias("x"))
        y = c.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("alone").alias("other"), F.col("bits").alias("y"))
        both = pairs.join(x, "a").join(y, "b").where(self._near("n", "m")).withColumn("alone", F.col("own") + F.col("other"))
        likely = cut(both.mapInArrow(_bound(self.percent), "a long, b long"), "ngram")
        wanted = cut(likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct().join(self.classes.select("cls", F.col("row.doc_id").alias("rep"), F.col("row.digest").alias("of")), "cls"), "ngram")
        sent = F.broadcast(wanted) if rows_below(wanted, BROADCAST_ROWS) else wanted
        texts = self.docs.join(sent, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("of"))).select("cls", "text")
        sets = cut(texts.mapInArrow(_tokens_of(self.n), "cls long, tokens binary").dropDuplicates(["cls"]), "ngram")
        x, y = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
        found = cut(likely.join(x, "a").join(y, "b").mapInArrow(_verify(self.percent), "a long, b long"), "ngram")
        discard(likely, wanted, sets)
        return found

    def components(self) -> DataFrame:
        """``(cls, component)`` of the classes that link with others; component is one of them."""
        lists = self.lists()
        other = F.explode(F.array("first", "before"))
        near = lists.select("cls", other.alias("other")).where("cls <> other").select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
        links = self.links(near)
        known = cut(connected_components(links).withColumnRenamed("node", "cls"), "ngram")
        held = cut(lists.select("sig", "cls", "n", "place").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "ngram")
        discard(lists)
        mixed = held.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), (F.max("place") + 1).alias("m")).where("low < high").select("sig", "m")
        whole, held = held, cut(held.join(mixed, "sig"), "ngram")
        discard(whole, known)
        more = self.links(self._short(held.where(F.col("m") <= SHORT)).union(self._long(held.where(F.col("m") > SHORT))).distinct())
        discard(held)
        groups = cut(connected_components(links.union(more)).withColumnRenamed("node", "cls"), "ngram")
        discard(links, more, self.candidates)
        return groups

    def _short(self, held: DataFrame) -> DataFrame:
        """Pairs of classes of different components within short lists."""
        held = held.select("sig", F.col("cls").alias("a"), "n", "component")
        other = held.select("sig", F.col("a").alias("b"), F.col("n").alias("m"), F.col("component").alias("of"))
        return held.join(other, "sig").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("of")) & self._near("n", "m")).select("a", "b")

    def _long(self, held: DataFrame) -> DataFrame:
        """Such pairs within long lists, as far as the bitmaps allow them: cells are pairs (i <= j) of a list's tiles."""
        sigs = held.groupBy("cls").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))  # at most a class's signatures
        tile, last = F.floor(F.col("place") / TILE), F.floor((F.col("m") - 1) / TILE)
        held = held.select("sig", "cls", "n", "component", tile.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")).join(self._maps().drop("n").join(sigs, "cls"), "cls")
        dealt = held.select("sig", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "cls", "n", "alone", "component", "bits", "sigs")
        return dealt.groupBy("sig", "i", "j").applyInArrow(_tile(self.percent), "a long, b long")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs (doc_id, text)``.

    A document's set holds its distinct n-word shingles; with fewer words the whole sequence is its
    one shingle; null texts and those without words have none and link with nothing. Documents link
    when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable by
    links, itself included. Equal sets are one class, which stands for any number of copies.
    A null doc_id links like any other row; its component is that of its class (null if nothing else
    is in it). Repeated rows are returned as often as they come. An empty table gives none. Shingles
    and sets are compared by 64-bit hashes. Other columns aren't read.
    """
    ship(docs.sparkSession)
    if not 50 <= percent <= 100 or n < 1:
        raise ValueError("percent must be 50 to 100 and n positive")
    join = _Join(docs, n, percent)
    groups = join.components()
    named = join.classes.join(groups, "cls", "left").where("copies > 1 or component is not null").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = cut(named.join(least, "component").select("cls", "component_id"), "ngram")
    discard(groups, join.classes)
    # classes of many rows meet salted copies of the classes' names
    salted = found.select("cls", "component_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    rows = join.members.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)).cast("int").alias("salt"))
    return rows.join(salted, ["cls", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group that links: that of the smallest doc_id, then text digest, then of all other columns.

    Rows are told apart by doc_id and a 64-bit digest of the text, so one doc_id may come with several texts. A null doc_id
    comes last. Rows whose text is null or has no words are in no group and stay.
    """
    ship(docs.sparkSession)
    join = _Join(docs, n, percent)
    groups = join.components()
    named = join.classes.join(groups, "cls", "left").where("copies > 1 or component is not null").select("cls", "row", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("row").alias("first"))
    found = cut(named.join(least, "component").select("cls", F.col("first.doc_id").alias("first"), F.col("first.digest").alias("of")), "ngram")
    discard(groups, join.classes)
    salted = found.select("cls", "first", "of", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    rows = join.members.where("cls is not null").select("doc_id", "digest", "cls", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(8)).cast("int").alias("salt")).join(salted, ["cls", "salt"])
    stays = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("of"))
    told = cut(rows.groupBy("doc_id", "digest").agg(F.min(stays).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "ngram")
    discard(found, join.members)
    # what a left join brings is null for the most rows, which are in no group
    named = told.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "stays")
    sent = F.broadcast(named) if rows_below(named, BROADCAST_ROWS) else named
    digest = F.xxhash64(docs["text"])
    met = docs.select(F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), docs["doc_id"].cast("long").alias("_id"), digest.alias("_of"))
    met = met.join(sent, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_digest")), "left").where("stays is null or stays")
    back = [F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    # the survivor's own copies: the least by all columns
    again = met.where("stays").groupBy("_id", "_of").agg(F.min("row").alias("row"))
    return met.where("stays is null").select(*back).unionByName(again.select(*back))
