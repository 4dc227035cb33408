"""The learner of language ID against enumeration of all segmentations."""

import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid

PIECES = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "abab" * 4]


def segmentations(word, start=0):
    """All ways to cut a word into pieces, a character that is none standing for the unknown one."""
    if start == len(word):
        yield []
        return
    for size in range(1, len(word) - start + 1):
        part = word[start : start + size]
        if part in PIECES or size == 1:
            for rest in segmentations(word, start + size):
                yield [PIECES.index(part) if part in PIECES else len(PIECES) + 1, *rest]


def slow_uses(counts, prob):
    out = np.zeros(len(prob))
    for word, n in counts.items():
        ways = list(segmentations("▁" + word))
        weight = np.array([np.prod(prob[w]) for w in ways])
        for way, share in zip(ways, weight / weight.sum(), strict=True):
            for piece in way:
                out[piece] += share * n
    return out


def slow_learn(counts, rounds):
    prob = np.array([0.1 ** len(p) for p in PIECES] + [0, 1e-6])
    for _ in range(rounds):
        seen = slow_uses(counts, prob)
        seen[:-2] += 0.01
        prob = seen / seen.sum()
        prob[-2], prob[-1] = 0, langid.UNKNOWN
    return prob


def some_prob(seed):
    return np.array([*np.random.default_rng(seed).dirichlet(np.ones(len(PIECES))), 0, langid.UNKNOWN])


@pytest.mark.parametrize("word", ["a", "abab", "aababxa", "xx", "babababab"])
def test_expected_uses_sum_all_segmentations(word):
    lattice, prob = langid.Lattice(PIECES), some_prob(len(word))
    marked, want = "▁" + word, slow_uses({word: 3}, prob)
    assert langid.expected(lattice.edges([marked]), prob, np.array([3.0])) / langid.UNIT == pytest.approx(want, abs=1e-4)
    assert langid.expected_long(lattice, marked, prob, 3) / langid.UNIT == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("letters", ["ab", "abx", "x"])
def test_long_words_are_learned_whole(letters):
    """No cut and no underflow: words beyond the limit by both ways, where each unknown character has 1e-7."""
    rnd, lattice, prob = np.random.default_rng(3), langid.Lattice(PIECES), some_prob(3)
    word = "▁" + "".join(rnd.choice(list(letters), 400))
    one, other = langid.expected(lattice.edges([word]), prob, np.array([2.0])), langid.expected_long(lattice, word, prob, 2)
    assert one / langid.UNIT == pytest.approx(other / langid.UNIT, abs=1e-2)
    # every character is in one piece
    sizes = np.array([*map(len, PIECES), 0, 1])
    assert (other / langid.UNIT * sizes).sum() == pytest.approx(2 * len(word), rel=1e-3)


def test_learner_against_plain_rounds(spark, monkeypatch):
    """However words are dealt and whatever counts as long, the same model."""
    counts = {"x": Counter({"abab": 5, "ba": 2, "aax": 1}), "y": Counter({"bbb": 4, "ab": 1, "abababa": 7})}
    words = spark.createDataFrame([(lang, w, n) for lang, c in counts.items() for w, n in c.items()], "lang string, word string, n long")
    langs, table = langid.learn(words.repartition(3), PIECES)
    assert langs == ["x", "y"]
    for lang, got in zip(langs, table, strict=True):
        assert got == pytest.approx(slow_learn(counts[lang], langid.EM_ROUNDS), abs=1e-5)
    assert (langid.learn(words.coalesce(1), PIECES)[1] == table).all()
    monkeypatch.setattr(langid, "WORD_MAX", 3)
    assert langid.learn(words, PIECES)[1] == pytest.approx(table, abs=1e-6)


def test_sample_takes_whole_texts_and_one_row_of_an_id(spark):
    seen = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2][:3]
    held = next(k for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2)
    rows = [(seen[0], "aa " * 20_000 + "last", "x"), *[(seen[1], f"b{k}", "x") for k in range(500)], (seen[2], None, "x"), (seen[2], "c", None), (held, "d", "x"), (None, "e", "x"), (seen[2], "f", "y")]
    got = langid.sampled_words(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert {(r.lang, r.word, r.n) for r in got} == {("x", "aa", 20_000), ("x", "last", 1), ("x", "b0", 1), ("y", "f", 1)}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(docs, PIECES)


def test_no_labels_no_languages(spark):
    langs, table = langid.fit(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"), PIECES)
    assert langs == [] and table.shape == (0, len(PIECES) + 2)
