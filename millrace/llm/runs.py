"""Runs of words that repeat with a period, by Lempel-Ziv blocks.

A batch of texts is one sequence of numbers in which no two texts share one. Its suffix array is made by
doubling, the longest common prefixes follow from those that can't be told from the suffix before, and the
nearest smaller positions on both sides in the suffix order give each place's longest previous factor, hence the
blocks. A run that touches a border of blocks is found there by Main's extensions to both sides; a run
strictly inside a block is copied from the block's earlier occurrence, runs being kept in buckets by start.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shipping import ship

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the texts that are searched together; a longer text is searched alone.
TOGETHER = 400_000
#: Border and period pairs looked at together.
PAIRS = 4_000_000
_SPACE = r"[\x20\x09-\x0D]+"
_FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``codes`` in order, and for each place a number that is equal where the next eight codes are.

    By doubling: only suffixes that are tied still are sorted again. The codes' own order does.
    """
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    ordered = codes[sa]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(heads, np.diff(np.r_[heads, n]))  # a suffix's rank is where its group begins
    eighth, k = None, 1
    tied = np.flatnonzero(_tied(rank[sa]))
    while True:
        if k == 8:
            eighth = rank.copy()
        if not len(tied):
            break
        mine = sa[tied]
        own, ahead = rank[mine], mine + k
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((then, own))
        mine, own, then = mine[order], own[order], then[order]
        sa[tied] = mine
        new = np.r_[True, (own[1:] != own[:-1]) | (then[1:] != then[:-1])]
        rank[mine] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[_tied(rank[mine])]
        k *= 2
    return sa, rank if eighth is None else eighth


def _tied(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    return np.r_[same, False] | np.r_[False, same] if len(ranks) else np.zeros(0, bool)


def common_prefixes(codes: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Codes that each suffix has in common with the one before it in order; 0 for the first.

    A place whose code before equals that before its neighbour has one less than the place before; only
    for the others are codes compared, all of them together a few times n log n.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (codes[:-1] == codes[np.maximum(before[1:] - 1, 0)])
    lead = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    open_ = lead[before[lead] >= 0]
    other = before[open_]
    for step in range(32):
        good = (np.maximum(open_, other) + step < n) & (codes[np.minimum(open_ + step, n - 1)] == codes[np.minimum(other + step, n - 1)])
        open_, other = open_[good], other[good]
        length[open_] = step + 1
        if not len(open_):
            break
    for i, j in zip(open_.tolist(), other.tolist(), strict=True):
        length[i] += common(codes, i + 32, j + 32)
    at = np.maximum.accumulate(np.where(follows, 0, place))
    length = length[at] - (place - at)
    return length[sa]


def common(codes: np.ndarray, i: int, j: int) -> int:
    """Codes that two places have in common from there on."""
    n, done, size = len(codes), 0, 64
    while True:
        size_now = min(size, n - max(i, j) - done)
        if size_now <= 0:
            return done
        differ = codes[i + done : i + done + size_now] != codes[j + done : j + done + size_now]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size_now, size * 2


def _nearest_smaller(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest earlier rank of a smaller position, and the codes in common with it; the place by jumps over what is known to be larger."""
    n = len(sa)
    link, least = np.arange(-1, n - 1), lcp.copy()
    open_ = np.flatnonzero((link >= 0) & (least > 0))
    while True:
        at = link[open_]
        larger = (at >= 0) & (least[open_] > 0)
        larger[larger] = sa[at[larger]] > sa[open_[larger]]
        open_, at = open_[larger], at[larger]
        if not len(open_):
            break
        link[open_], least[open_] = link[at], np.minimum(least[open_], least[at])
    least[link < 0] = 0
    return link, least


def previous_factors(codes: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest factor there that also starts earlier: its length, and where (-1 where the length is 0)."""
    n = len(codes)
    lcp = common_prefixes(codes, sa)
    up, up_len = _nearest_smaller(sa, lcp)
    down, down_len = _nearest_smaller(sa[::-1].copy(), np.r_[0, lcp[:0:-1]])
    down, down_len = n - 1 - down[::-1], down_len[::-1]
    best = np.maximum(up_len, down_len)
    from_rank = np.where(up_len >= down_len, up, np.minimum(down, n - 1))
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    length[sa] = best
    source[sa] = np.where(best > 0, sa[np.maximum(from_rank, 0)], -1)
    return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks and the end: each block is the longest previous factor, or one new code."""
    steps, at, starts, n = np.maximum(length, 1).tolist(), 0, [], len(length)
    while at < n:
        starts.append(at)
        at += steps[at]
    return np.array([*starts, n], np.int64)


def _z(s: list) -> list[int]:
    """For each place of ``s`` the codes it has in common with the start."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _extend(codes: np.ndarray, border: int, before: int, end: int, most: int) -> list[tuple[int, int, int]]:
    """Stretches ``(start, end, period)`` around a border with periods up to ``most``, that end in the block to its right, by Main's extensions.

    Comparisons stop one code behind the block; what goes on there ends in a later block. To the left they stop where no such stretch can reach.
    """
    n, reach = len(codes), before + 2 * most + 1
    right = codes[border : min(n, end + 1)].tolist()
    left = codes[max(0, border - reach) : border][::-1].tolist()
    wide = codes[border : min(n, border + most)][::-1].tolist() + codes[max(0, border - reach) : border][::-1].tolist()
    far = codes[max(0, border - most) : border].tolist() + right
    gap = [-1]
    z_right = _z(right)  # the border and a period on
    z_left = _z(left)  # a period before it, leftward
    z_wide = _z(left + gap + wide)[len(left) + 1 :]  # a period on, leftward
    z_far = _z(right + gap + far)[len(right) + 1 :]  # a period before it
    n_wide, n_far = min(most, n - border), border - max(0, border - most)
    out = []
    for q in range(1, most + 1):
        if q <= n_wide and border + q <= n:
            back, ahead = z_wide[n_wide - q] if n_wide - q < len(z_wide) else 0, z_right[q] if q < len(right) else 0
            if q < len(right) or border + q == n:
                out.append((border - back, border + ahead + q, q))
        if q <= n_far:
            back, ahead = z_left[q] if q < len(left) else 0, z_far[n_far - q]
            out.append((border - q - back, border + ahead, q))
    return out


def find_runs(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All ``(start, end, period)`` with the smallest period, ``least_words`` words and ``least_periods`` periods (2 at least) that can't be extended, in order."""
    n = len(codes)
    if n < least_words or n < 2:
        return []
    sa, eighth = suffix_array(codes)
    length, source = previous_factors(codes, sa)
    starts = blocks_of(length)
    sizes = np.diff(starts)
    codes = np.ascontiguousarray(codes)
    # a run that ends in a block and starts before it has less than that block, the one before and a period; so
    # three periods are less than twice (two: less than) the blocks, and borders of small blocks have none
    after = np.r_[sizes, 0]
    before = np.r_[0, sizes]
    most = (before + after) // (least_periods - 1)
    near = np.flatnonzero((before + after + most >= least_words) & (most > 0) & (starts > 0))
    hit = near[_may_repeat(starts[near], most[near], eighth, n)] if (least_periods - 1) * least_words >= 16 * least_periods else near
    smallest: dict[tuple[int, int], int] = {}
    for k in hit.tolist():
        for s, e, q in _extend(codes, int(starts[k]), int(before[k]), int(starts[k] + after[k]), int(most[k])):
            if e - s >= max(least_words, least_periods * q) and (e == n or codes[e] != codes[e - q]) and (s == 0 or codes[s - 1] != codes[s - 1 + q]):
                smallest[s, e] = min(q, smallest.get((s, e), q))
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    known: list[int] = []
    for (s, e), q in smallest.items():
        buckets[s].append((e, q))
    known = sorted(buckets)
    # runs strictly inside a block, from the left: those of its earlier occurrence, which may reach into the block itself
    for k in np.flatnonzero(sizes >= least_words + 2).tolist():
        begin, size = int(starts[k]), int(sizes[k])
        origin = int(source[begin])
        at = bisect_left(known, origin + 1)
        while at < len(known) and known[at] < origin + size:
            s = known[at]
            for e, q in list(buckets[s]):
                if e < origin + size:
                    to = s - origin + begin
                    if to not in buckets:
                        insort(known, to)
                    if (moved := (e - origin + begin, q)) not in buckets[to]:
                        buckets[to].append(moved)
            at += 1
    return sorted((s, e, q) for s, ends in buckets.items() for e, q in ends)


def _may_repeat(borders: np.ndarray, most: np.ndarray, eighth: np.ndarray, n: int) -> np.ndarray:
    """Borders at which eight codes repeat a period on, right or left of the border.

    A stretch of 24 codes and three periods agrees with itself a period on over 16 codes at least, so over eight to one side.
    """
    out = np.zeros(len(borders), bool)
    begin = 0
    ends = np.cumsum(most)
    while begin < len(borders):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        for k in range(begin, stop) if stop == begin + 1 else [None]:
            b = borders[begin:stop]
            if k is not None:  # one border, maybe with very many periods
                shift = np.arange(1, most[k] + 1)
                base, owner = np.full(len(shift), b[0]), None
            else:
                m = most[begin:stop]
                owner = np.repeat(np.arange(begin, stop), m)
                base = np.repeat(b, m)
                shift = np.arange(len(base)) - np.repeat(np.cumsum(m) - m, m) + 1
            good = np.zeros(len(base), bool)
            for i, j in ((base, base + shift), (base - 8, base + shift - 8), (base - shift, base), (base - shift - 8, base - 8)):
                inside = (i >= 0) & (j + 8 <= n)
                good |= inside & (eighth[np.where(inside, i, 0)] == eighth[np.where(inside, j, 0)])
            if k is not None:
                out[k] = good.any()
            else:
                out[owner[good]] = True
        begin = stop
    return out


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, a number for each word (equal words have equal ones), and the words in order of these."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), _SPACE)
    flat = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists).to_numpy()
    there = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(there).dictionary_encode()
    count = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return count, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def collapse(n_texts: int, count: np.ndarray, codes: np.ndarray, words: pa.Array, least_words: int, least_periods: int) -> list[tuple]:
    """For each text its runs' figures and digests; ``codes`` are its words' numbers, one text after the other."""
    offsets = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(n_texts), count)
    # no two texts share a number, so nothing is found across them
    apart = np.unique(owner * np.int64(max(1, len(words))) + codes, return_inverse=True)[1] if len(codes) else codes
    by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    drop = np.zeros(len(codes) + 1, np.int64)
    for s, e, q in find_runs(apart, least_words, least_periods):
        by_text[int(owner[s])].append((s - int(offsets[owner[s]]), e - s, q))
        drop[s + q] += 1
        drop[e] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    spelled = words.to_pylist()
    out = []
    for k in range(n_texts):
        own = slice(offsets[k], offsets[k + 1])
        left = " ".join(map(spelled.__getitem__, codes[own][kept[own]].tolist()))
        runs = by_text.get(k, [])
        best = (None,) * 4
        for s, n, q in runs:  # in order of start and period, so that the first of equals stays
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q, 1000 * n // q)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    return out


def planted(ids: list[int | None], count: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The words' numbers with a tenth of the texts made periodic from a word on, as the CRC of their id tells."""
    codes, offset = codes.copy(), 0
    for ident, n in zip(ids, count.tolist(), strict=True):
        h = zlib.crc32(str(ident).encode()) if ident is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            codes[offset + a : offset + n] = codes[offset + a + np.arange(n - a) % p]
        offset += n
    return codes


def _searcher(ident: str, text: str, change, least_words: int, least_periods: int):
    def search(batches):
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < whole.num_rows:
                # at least two bytes a word, the last aside
                stop = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 2 * TOGETHER, "right")))
                batch = whole.slice(begin, stop - begin)
                count, codes, words = _numbered(batch.column(text))
                if change is not None:
                    codes = change(batch.column(ident).to_pylist(), count, codes)
                rows = list(zip(*collapse(batch.num_rows, count, codes, words, least_words, least_periods), strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(ident), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=[ident, *[f.split()[0] for f in _FOUND.split(", ")]])
                begin = stop

    return search


def repeated_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", change=None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``(ident, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of each row of ``docs``.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch with its
    smallest period, ``least_words`` words and ``least_periods`` periods at least (no fewer than 2) that no neighbouring word
    extends. start to exponent_milli are of the run with the most periods, by exact comparison; of equal ones that with the
    smallest start, then period; null where there is none. ``runs_sha256`` is of the lines ``start,length,period`` of all runs by start and
    period, ``collapsed_sha256`` of the words that aren't in a run behind its first period, joined by spaces. Null and empty texts
    have no words. Rows are searched each by itself, repeated ones too; no shuffle. ``change(ids,
    counts, codes)`` may replace the words' numbers. Memory goes with a batch of texts, or the longest text.
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(_searcher(ident, text, change, least_words, least_periods), f"`{ident}` {kind}, {_FOUND}")
