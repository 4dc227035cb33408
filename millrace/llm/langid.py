"""Language ID by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood
is the product over its words, and a word's is the sum over all ways to cut it into pieces, by the
forward algorithm. The probabilities are learned by expectation maximisation (forward-backward).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shipping import ship
from .caches import held
from .store import cut, discard

#: The learner's bound: documents of each language, taken whole.
SAMPLE_DOCS = 300
EM_ROUNDS = 4
#: So many times the sample's documents, about, are ranked; a bound of their hashes keeps the others out.
RANKED = 4
#: Languages that a model may have; more are an error, as each has a probability for every piece in every worker.
MOST_LANGS = 256
#: Expected uses of pieces are whole multiples of 1 / UNIT, so that their sums don't depend on the order.
UNIT = 1 << 20
#: A worker keeps the scores of so many words at most.
CACHE = 500_000
#: Words of up to this many characters are taken together with others of their length, longer ones one by one.
WORD_MAX = 48
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
_LETTER = re.compile(r"[^\W\d_]")


class Lattice:
    """The pieces of a vocabulary, found in words of equal length."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        # a tree of all beginnings of pieces: sorted steps (node, character), where each leads, and the piece that ends there
        nodes = {"": 0}
        steps = []
        for p in self.ids:
            for size in range(1, len(p) + 1):
                if p[:size] not in nodes:
                    nodes[p[:size]] = len(nodes)
                    steps.append((nodes[p[: size - 1]] << 21 | ord(p[size - 1]), nodes[p[:size]]))
        steps.append((np.iinfo(np.int64).max, 0))  # beyond every other
        self.steps, self.ahead = np.array(sorted(steps), np.int64).T.copy()
        self.piece = np.fromiter((self.ids.get(p, len(self.ids)) for p in nodes), np.int32, len(nodes))

    def edges(self, words: list[str]) -> np.ndarray:
        """Piece ids by (start, length - 1, word); len(ids) where there is none, and one more for unknown characters.

        Lengths end with that of the longest piece found. All words walk the tree together, each as far as it leads.
        """
        n, none = len(words[0]), len(self.ids)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T.astype(np.int64)
        out, found = np.full((n, min(n, self.longest), len(words)), none, np.int32), 1
        for start in range(n):
            at, node = np.arange(len(words)), np.zeros(len(words), np.int64)
            for size in range(1, min(self.longest, n - start) + 1):
                step = node << 21 | codes[start + size - 1][at]
                k = np.searchsorted(self.steps, step)
                good = self.steps[k] == step
                at, node = at[good], self.ahead[k[good]]
                if not len(at):
                    break
                out[start, size - 1, at] = self.piece[node]
                found = max(found, size)
            out[start, 0][out[start, 0] == none] = none + 1
        return out[:, :found]


def lattice_for(pieces: list[str]) -> Lattice:
    """A worker's lattice of a vocabulary, kept from round to round."""
    return held("lattice", hashlib.blake2b("\0".join(pieces).encode()).digest(), lambda: Lattice(pieces))


def forward(edges: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha by (place, word), without scale: the learner's words are short."""
    n, longest, words = edges.shape
    alpha = np.zeros((n + 1, words))
    alpha[0] = 1
    for start in range(n):
        for size in range(1, min(longest, n - start) + 1):
            alpha[start + size] += alpha[start] * prob[edges[start, size - 1]]
    return alpha


def log_forward(edges: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Each word's log-likelihood: the sum over all segmentations, scaled from place to place."""
    n, longest, words = edges.shape
    alpha, logs = np.zeros((n + 1, words)), np.zeros(words)
    alpha[0] = 1
    for start in range(n):
        reach = min(longest, n - start)
        for size in range(1, reach + 1):
            alpha[start + size] += alpha[start] * prob[edges[start, size - 1]]
        top = alpha[start + 1 : start + reach + 1].max(axis=0)
        alpha[start + 1 : start + reach + 1] /= top
        logs += np.log(top)
    return logs + np.log(alpha[n])


def log_forward_long(lattice: Lattice, word: str, table: np.ndarray) -> np.ndarray:
    """The same for one word of any length, by language: the places ahead are held only."""
    ids, longest, n = lattice.ids, lattice.longest, len(word)
    ahead, logs = np.zeros((longest + 1, len(table))), np.zeros(len(table))
    ahead[0] = 1
    by_piece = np.ascontiguousarray(table.T)
    for start in range(n):
        here = ahead[0]
        for size in range(1, min(longest, n - start) + 1):
            k = ids.get(word[start : start + size])
            if k is not None:
                ahead[size] += here * by_piece[k]
            elif size == 1:
                ahead[1] += here * by_piece[-1]
        ahead[:-1] = ahead[1:]
        ahead[-1] = 0
        top = ahead.max(axis=0)
        ahead /= top
        logs += np.log(top)
    return logs + np.log(ahead[0])


def expected(edges: np.ndarray, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses, in 1 / UNIT, of each piece in words of equal length that occur ``counts`` times: forward and backward, scaled from place to place."""
    n, longest, words = edges.shape
    alpha, beta = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    # logarithms of what alpha and beta are divided by at each place
    ahead, behind = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    alpha[0] = beta[n] = 1
    for start in range(n):
        reach = min(longest, n - start)
        for size in range(1, reach + 1):
            alpha[start + size] += alpha[start] * prob[edges[start, size - 1]]
        top = alpha[start + 1 : start + reach + 1].max(axis=0)
        alpha[start + 1 : start + reach + 1] /= top
        ahead[start + 1 :] += np.log(top)
    out = np.zeros(len(prob))
    for start in range(n - 1, -1, -1):
        reach = min(longest, n - start)
        for size in range(1, reach + 1):
            beta[start] += beta[start + size] * prob[edges[start, size - 1]] * np.exp(behind[start + size] - behind[start + 1])
        behind[start] = behind[start + 1] + np.log(beta[start])
        beta[start] = 1
    total = np.log(alpha[n]) + ahead[n]
    for start in range(n):
        for size in range(1, min(longest, n - start) + 1):
            e = edges[start, size - 1]
            use = alpha[start] * prob[e] * beta[start + size] * np.exp(ahead[start] + behind[start + size] - total)
            out += np.bincount(e, np.rint(use * counts * UNIT), len(prob))
    return out


def expected_long(lattice: Lattice, word: str, prob: np.ndarray, count: int) -> np.ndarray:
    """The same for one word of any length: three numbers are held for each place."""
    ids, longest, n, none = lattice.ids, lattice.longest, len(word), len(lattice.ids)

    def pieces(start: int) -> np.ndarray:
        e = np.array([ids.get(word[start : start + size], none) for size in range(1, min(longest, n - start) + 1)])
        if e[0] == none:
            e[0] = none + 1
        return e

    alpha, logs = np.zeros(n + 1), np.zeros(n + 1)
    window, log = np.zeros(longest + 1), 0.0
    window[0] = 1
    for start in range(n):
        alpha[start], logs[start] = window[0], log
        e = pieces(start)
        window[1 : len(e) + 1] += window[0] * prob[e]
        window[:-1] = window[1:]
        window[-1] = 0
        top = window.max()
        window /= top
        log += np.log(top)
    total = log + np.log(window[0])
    out = np.zeros(len(prob))
    window, log = np.zeros(longest), 0.0  # beta of the places behind, the nearest first
    window[0] = 1
    for start in range(n - 1, -1, -1):
        e = pieces(start)
        paths = window[: len(e)] * prob[e]
        np.add.at(out, e, np.rint(paths * alpha[start] * np.exp(logs[start] + log - total) * count * UNIT))
        window[1:] = window[:-1].copy()
        window[0] = paths.sum()
        top = window.max()
        window /= top
        log += np.log(top)
    return out


def _by_length(words) -> dict[int, list[str]]:
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    return groups


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _uses(pieces: list[str], langs: list[str], table: np.ndarray):
    """Expected uses of pieces in rows ``(lang, word, n)`` under a model, summed by language for a task's rows."""

    def run(batches):
        lattice, place, sums = lattice_for(pieces), {lang: k for k, lang in enumerate(langs)}, {}
        for batch in batches:
            counts: dict[str, dict[str, int]] = defaultdict(dict)
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                counts[lang]["▁" + word] = n
            for lang, own in counts.items():
                k = place[lang]
                total = sums.setdefault(k, np.zeros(table.shape[1]))
                for size, ws in _by_length(own).items():
                    if size > WORD_MAX:
                        for w in ws:
                            total += expected_long(lattice, w, table[k], own[w])
                        continue
                    for at in range(0, len(ws), 4096):
                        some = ws[at : at + 4096]
                        total += expected(lattice.edges(some), table[k], np.array([own[w] for w in some], float))
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["k", "piece", "uses"])

    return run


def learn(words: DataFrame, pieces: list[str], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages of ``words (lang, word, n)`` in order, and by language the probabilities of all pieces, of none (0) and of an unknown character.

    Each round of expectation maximisation is a job over all words; what comes back is a number for each language and piece.
    """
    langs = sorted(r.lang for r in words.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    table = np.tile(np.array([0.1 ** len(p) for p in pieces] + [0, 1e-6]), (len(langs), 1))
    for _ in range(rounds if langs else 0):
        uses = words.mapInArrow(_uses(pieces, langs, table), "k int, piece int, uses long").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        seen = np.zeros(table.shape)
        seen[uses["k"].to_numpy(), uses["piece"].to_numpy()] = uses["uses"].to_numpy() / UNIT
        seen[:, :-2] += 0.01
        table = seen / seen.sum(axis=1, keepdims=True)
        table[:, -2], table[:, -1] = 0, UNKNOWN
    return langs, table


class Scorer:
    """Log-likelihoods of words by language, each computed once while a worker's cache holds it."""

    def __init__(self, pieces: list[str], table: np.ndarray, cache: int = CACHE):
        self.cache = cache
        self.lattice, self.table = Lattice(pieces), table
        self.known: dict[str, int] = {}
        self.scores, self.used = np.zeros((1024, len(table))), 0

    def _learn(self, new: list[str]) -> None:
        found: dict[str, np.ndarray] = {}
        for size, ws in _by_length("▁" + w for w in new).items():
            if size > WORD_MAX:
                found.update((w, log_forward_long(self.lattice, w, self.table)) for w in ws)
                continue
            for k in range(0, len(ws), 4096):
                e = self.lattice.edges(ws[k : k + 4096])
                found.update(zip(ws[k : k + 4096], np.array([log_forward(e, p) for p in self.table]).T, strict=True))
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used : self.used + len(new)] = [found["▁" + w] for w in new]
        self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def totals(self, docs: list[list[str] | None]) -> list[np.ndarray | None]:
        """Each document's log-likelihood by language."""
        if self.used > self.cache:
            self.known, self.used = {}, 0
        if new := set().union(*(d for d in docs if d)).difference(self.known):
            self._learn(list(new))
        at = self.known.__getitem__
        return [None if d is None else self.scores[np.fromiter(map(at, d), np.int64, len(d))].sum(axis=0) for d in docs]


def scorer_for(pieces: list[str], table: np.ndarray, cache: int) -> Scorer:
    """A worker's scorer for a model, with the words that its earlier tasks have met."""
    return held("langid", hashlib.blake2b(table.tobytes()).digest(), lambda: Scorer(pieces, table, cache))


def _scorer(pieces: list[str], langs: list[str], table: np.ndarray, keep_text: bool, cache: int):
    def score(batches):
        scorer = scorer_for(pieces, table, cache) if langs else None
        for batch in batches:
            best, share = [], []
            for at in range(0, batch.num_rows, 500):
                docs = [words_of(t) if scorer and t and _LETTER.search(t) else None for t in batch.column("text").slice(at, 500).to_pylist()]
                for total in scorer.totals(docs) if scorer else docs:
                    k = 0 if total is None else int(total.argmax())
                    best.append("und" if total is None else langs[k])
                    share.append(0.0 if total is None else float(1 / np.exp(total - total[k]).sum()))
            keep = [c for c in batch.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best, pa.string()), pa.array(share, pa.float64())], names=[*keep, "lang_pred", "score"])

    return score


def is_held_out() -> F.Column:
    """Whether a document is kept from the learner: crc32 of its doc_id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _counter(batches):
    """Word counts of the sampled texts, by language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[lang].update(words_of(text))
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def sampled_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(lang, word, n)``: all words of a bounded sample of the labelled rows that aren't held out.

    The sample: of each language, the ``sample_docs`` doc_ids of smallest hash (those above a bound
    that leaves ``RANKED`` times as many, of the approximate number of distinct doc_ids, aren't
    ranked); of rows that share such a doc_id and language the least text. Texts are taken whole, and all their words.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    rates = labelled.groupBy("lang").agg((F.lit(RANKED * sample_docs) / F.approx_count_distinct("doc_id", 0.02)).alias("rate"))
    known = rates.limit(MOST_LANGS + 1).collect()  # one row for each language
    if len(known) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rates = F.broadcast(spark.createDataFrame(known, "lang string, rate double"))
    hashed = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(rates, "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("rate") * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "doc_id"))
    chosen = hashed.distinct().withColumn("k", rank).where(F.col("k") <= sample_docs).select("doc_id", "lang")
    # at most sample_docs rows for each of MOST_LANGS languages
    texts = labelled.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    words = texts.select("lang", "text").mapInArrow(_counter, "lang string, word string, n long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Learns from the whole texts of a bounded sample (``sampled_words``); its words are written once, for all rounds."""
    words = cut(sampled_words(docs, sample_docs), "words")
    model = learn(words, pieces)
    discard(words)
    return model


def vocabulary_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


def identify_language(docs: DataFrame, vocabulary: str, carry: tuple[str, ...] = (), keep_text: bool = False, cache: int = CACHE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs (doc_id, text, lang)``.

    The columns named in ``carry`` are returned inside the struct ``row``, the text if ``keep_text``.
    A worker keeps the scores of ``cache`` words.

    lang_pred is the language of highest likelihood for the whole lower-cased text, all languages
    being as likely before (ties: the first by name); score is its share of the likelihoods' sum.
    Null texts and those without a letter are ``und`` with score 0, as is everything when no row is
    labelled outside the held-out quarter. A null doc_id isn't held out, nor learned from. Repeated
    rows are rows like any other; an empty table gives none. More than ``MOST_LANGS`` labels are an error. lang, source and doc_id never reach
    the scorer. A word's likelihood sums all its segmentations, whatever its length.
    """
    ship(docs.sparkSession)
    pieces = vocabulary_pieces(vocabulary)
    langs, table = fit(docs.select("doc_id", "text", "lang"), pieces)
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text", *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    schema = T.StructType([*(f for f in rows.schema if keep_text or f.name != "text"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(pieces, langs, table, keep_text, cache), schema)
