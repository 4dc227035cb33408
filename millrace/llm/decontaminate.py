"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .caches import held
from .store import cut

#: Words of a seed.
SEED_WORDS = 3
#: Scores of a pair of words and of a gap; an item leaks where its best alignment has this share of its highest score.
MATCH, MISMATCH, GAP, LEAK = 2, -1, -1, 0.5
#: Benchmarks up to so many bytes of text are sent to every task; larger ones are taken in several passes.
BENCHMARK_BYTES = 8 << 20
#: Alignments computed at once.
BATCH = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII punctuation and controls become spaces.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words:
    """Hashes of a text's words, without case and punctuation."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_for() -> Words:
    """A worker's word hashes, with those that its earlier tasks have met."""
    return held("words", None, Words)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + count]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Sorted values with a bit table in front, so that most lookups fail at once."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h whose value is held, and the places of these values."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.values, h[at]), max(0, len(self.values) - 1))
        good = self.values[k] == h[at] if len(self.values) else np.zeros(len(at), bool)
        return at[good], k[good]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of pairs of word sequences: best score, and where it begins and ends in the window.

    Gaps cost the same for each word, so a row's horizontal steps are a running maximum; all pairs of
    the batch advance together.
    """
    count, rows, width = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((count, rows), np.uint64), np.ones((count, width), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)] = x | np.uint64(2)  # padding matches nothing
        b[k, : len(y)] = y | np.uint64(2)
    place = np.arange(width)
    slope = -GAP * place
    score, begin = np.zeros((count, width + 1), np.int32), np.tile(np.arange(width + 1), (count, 1))
    best, first, last = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for r in range(rows):
        diagonal = score[:, :-1] + np.where(b == a[:, r : r + 1], MATCH, MISMATCH)
        down = score[:, 1:] + GAP
        cell, start = np.where(diagonal >= down, diagonal, down), np.where(diagonal >= down, begin[:, :-1], begin[:, 1:])
        start = np.where(cell > 0, start, place + 1)
        cell = np.maximum(cell, 0)
        run = np.maximum.accumulate(cell + slope, axis=1)
        fresh = np.maximum.accumulate(np.where(cell + slope == run, place, 0), axis=1)
        score[:, 1:], begin[:, 1:] = run - slope, np.take_along_axis(start, fresh, axis=1)
        top = score[:, 1:].argmax(axis=1)
        peak = score[np.arange(count), top + 1]
        better = peak > best
        best = np.where(better, peak, best)
        first, last = np.where(better, begin[np.arange(count), top + 1], first), np.where(better, top + 1, last)
    return best, first, last


def matches_bound(item: np.ndarray, window: np.ndarray, span: int, vocabulary: int, place: np.ndarray) -> int:
    """No alignment of at most ``span`` words of the window matches more words of the item.

    Both hold word numbers below ``vocabulary``, which itself stands for words of no item; ``place``
    has a zero for each number and is returned so.
    """
    own, count = np.unique(item, return_counts=True)
    place[own] = np.arange(1, len(own) + 1)
    at = place[window]
    place[own] = 0
    whole = int(np.minimum(np.bincount(at, minlength=len(own) + 1)[1:], count).sum())
    sums = np.concatenate([[0], np.cumsum(at > 0)])
    return min(whole, int((sums[span:] - sums[:-span]).max() if len(window) > span else sums[-1]))


def _leaks(ids: np.ndarray, items: list[np.ndarray], share: float, clean: bool = False):
    """Aligns every passage that holds a seed of an item with it, unless its words can't reach the share; ``clean`` returns the rows that leak nothing, whole."""

    def run(batches):
        own = [np.unique(grams(i, SEED_WORDS)) for i in items]
        seed, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.argsort(seed, kind="stable")
        index, words, owner = Index(seed), words_for(), owner[order]
        starts = np.searchsorted(seed[order], index.values)
        held_by = np.diff(starts, append=len(seed))
        lexicon = Index(np.concatenate(items))
        size = len(lexicon.values)
        numbers = [np.searchsorted(lexicon.values, i) for i in items]
        present, place = np.zeros(size + 1, bool), np.zeros(size + 1, np.int64)
        lengths = np.array([len(i) for i in items])
        # an alignment of the share has at most so many gaps in the item, each a word of the document
        spans = lengths + np.ceil(MATCH * (1 - share) / -GAP * lengths).astype(np.int64)
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            waiting: list[tuple[int, int, int, np.ndarray]] = []

            def score(found=found, waiting=waiting):
                if not waiting:
                    return
                best, first, last = align([items[w[1]] for w in waiting], [w[3] for w in waiting])
                for (row, item, base, _), s, i, j in zip(waiting, best, first, last, strict=True):
                    s = s / (MATCH * lengths[item])
                    if s >= share and s > found.get((row, item), (0,))[0]:
                        found[row, item] = (float(s), int(base + i), int(base + j))
                waiting.clear()

            for row, text in enumerate(batch.column("text")):
                w = words(text.as_py() or "")
                at, k = index.find(grams(w, SEED_WORDS))
                if not len(at):
                    continue
                n = held_by[k]
                hit = owner[np.repeat(starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = np.repeat(at, n)[(order := np.argsort(hit, kind="stable"))]
                some, begins = np.unique(hit[order], return_index=True)
                number = np.full(len(w), size)
                held_at, which = lexicon.find(w)
                number[held_at] = which
                present[which] = True
                for item, ps in zip(some.tolist(), np.split(at, begins[1:]), strict=True):
                    if present[numbers[item]].sum() / lengths[item] < share:
                        continue
                    reach, p0 = int(spans[item]), None
                    for p in [*ps.tolist(), None]:
                        if p0 is not None and (p is None or p - last > reach or p - p0 > 4 * reach):
                            base = max(0, p0 - reach)
                            if matches_bound(numbers[item], number[base : last + reach], reach, size, place) / lengths[item] >= share:
                                waiting.append((row, item, base, w[base : last + reach]))
                                if len(waiting) >= BATCH:
                                    waiting.sort(key=lambda x: len(x[3]))
                                    score()
                            p0 = None
                        p0, last = p if p0 is None else p0, p
                present[which] = False
            score()
            if clean:
                stays = np.ones(batch.num_rows, bool)
                stays[[r for r, _ in found]] = False
                yield batch.filter(pa.array(stays))
                continue
            rows, docs = sorted(found.items()), batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[r] for (r, _), _ in rows], pa.int64()), pa.array([int(ids[i]) for (_, i), _ in rows], pa.int64()), pa.array([v[0] for _, v in rows], pa.float64()), pa.array([v[1] for _, v in rows], pa.int32()), pa.array([v[2] for _, v in rows], pa.int32())],
                names=["doc_id", "item_id", "score", "word_start", "word_end"],
            )

    return run


def _passes(benchmark: DataFrame):
    """The benchmark's items in groups of bounded size."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append(r)
        size += len(r.text)
        if size > BENCHMARK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _items(benchmark: DataFrame):
    """Ids and words of the items that have seeds, a group of bounded size at a time."""
    words = Words()
    for rows in _passes(benchmark):
        some = [(r.item_id, w) for r in rows if len(w := words(r.text)) >= SEED_WORDS]
        if some:
            yield np.array([r[0] for r in some]), [r[1] for r in some]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = LEAK) -> DataFrame:
    """``(doc_id, item_id, score, word_start, word_end)``: where a document of ``docs (doc_id, text)`` holds an item of ``benchmark (item_id, text)``.

    Words are compared without case and ASCII punctuation. An item's seeds are all its 3-word runs.
    Wherever a document holds a seed, the passage around it, as long as an alignment can be, is
    aligned with the item; an alignment whose score (2 a match, -1 a mismatch or gap) has at least
    ``share`` of the item's best possible one is a leak; of several in a document the best counts,
    then the first. Passages that have too few of the item's words for the share aren't aligned; a
    passage that has no 3-word run of the item is not found, whatever its score. Items of fewer than 3 words, null
    items, null and empty texts match nothing; items of equal text each match. Rows with null doc_id
    are searched too; repeated rows are returned as often as they leak. Empty tables give no rows.
    Benchmarks of over ``BENCHMARK_BYTES`` take one pass for each so many bytes. Other columns
    aren't read.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    schema = "doc_id long, item_id long, score double, word_start int, word_end int"
    out = None
    for ids, items in _items(benchmark):
        part = texts.mapInArrow(_leaks(ids, items, share), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def remove_leaking(docs: DataFrame, benchmark: DataFrame, share: float = LEAK) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, each judged by itself, whatever its doc_id; those without text stay."""
    ship(docs.sparkSession)
    for ids, items in _items(benchmark):
        docs = docs.mapInArrow(_leaks(ids, items, share, True), docs.schema)
    return docs
