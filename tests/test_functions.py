"""Edge cases of the column functions, by hand and against a plain model."""

import ctypes
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import checksums, dates, int32, text

EDGES = [0, 1, -1, 2, -7, 7, 31, 100, 2147483647, -2147483648, 123456789, -987654321]


def wrap(n):
    return ctypes.c_int32(n & 0xFFFFFFFF).value


def trunc(a, b):
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in EDGES for b in EDGES], "a int, b int")


def test_arithmetic(pairs):
    a, b = F.col("a"), F.col("b")
    nz = F.when(b == 0, 1).otherwise(b)
    got = pairs.select("a", "b", int32.add32(a, b), int32.sub32(a, b), int32.mul32(a, b), int32.div32(a, nz), int32.mod32(a, nz), int32.add_percent(a, b), int32.scale32(a, nz, b)).collect()
    for x, y, add, sub, mul, div, mod, pct, scaled in got:
        z = y or 1
        assert (add, sub, mul) == (wrap(x + y), wrap(x - y), wrap(x * y))
        assert (div, mod) == (wrap(trunc(x, z)), x - trunc(x, z) * z)
        assert pct == wrap(x + trunc(x * y, 100))
        assert scaled == wrap(trunc(x * y, z))


def test_bits(pairs):
    a, b = F.col("a"), F.col("b")
    for x, y, on, off, bit in pairs.select("a", "b", int32.set_bit(a, b), int32.clear_bit(a, b), int32.test_bit(a, b)).collect():
        m = 1 << (y & 31)
        assert (on, off, bit) == (wrap(x | m), wrap(x & ~m), int(bool(x & m)))


def test_fields(spark):
    cases = [(v, lo, hi, n) for v in EDGES for lo, hi in ((0, 0), (3, 9), (0, 31), (31, 31), (16, 31)) for n in (-1, 0, 1, 5, 70000)]
    d = spark.createDataFrame(cases, "v int, lo int, hi int, n int")
    c = F.col
    for v, lo, hi, n, field, written in d.select("v", "lo", "hi", "n", int32.read_field(c("v"), c("lo"), c("hi")), int32.write_field(c("v"), c("lo"), c("hi"), c("n"))).collect():
        mask = (1 << (hi - lo + 1)) - 1
        assert field == wrap((v & 0xFFFFFFFF) >> lo & mask)
        fit = n if 0 <= n <= mask else 0
        assert written == wrap((v & ~(mask << lo)) | fit << lo)


def test_powers(spark):
    d = spark.createDataFrame([(0, 0), (0, 5), (2, 10), (2, 40), (-2, 31), (-3, 41), (9, 2), (27, 3), (5, 0), (-8, 3)], "a int, b int")
    got = [tuple(r) for r in d.select(int32.power32(F.col("a"), F.col("b")), int32.root32(F.col("a"), F.col("b"))).collect()]
    assert got[:5] == [(0, 0), (0, 0), (1024, 1), (2147483647, 1), (-2147483648, 0)]
    assert got[5][0] == -2147483648 and got[6] == (81, 3) and got[7][0] == 19683 and got[8] == (1, 2147483647) and got[9][1] == 0


def test_strings(spark):
    d = spark.createDataFrame([("a<b>c", None), ("x<open", "-5"), ("lone > here <", "zz"), ("", "7fffffff"), (None, "80000000")], "s string, h string")
    got = d.select(text.strip_tags(F.col("s")), text.escape_angles(F.col("s")), text.length0(F.col("s")), text.parse_radix(F.col("h"), 16), text.join_strings(F.col("s"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["ac", "x", "lone  here ", "", None]
    assert got[0][1] == "a<lt>b<gt>c"
    assert [r[2] for r in got] == [5, 6, 13, 0, 0]
    assert [r[3] for r in got] == [None, -5, None, 2147483647, None]
    assert [r[4] for r in got] == ["a<b>cnull", "x<open-5", "lone > here <zz", "7fffffff", "null80000000"]


def test_dates(spark):
    d = spark.createDataFrame([(27, 1, 2002), (1, 0, 1970), (31, 11, 1969), (29, 1, 2024)], "d int, m int, y int")
    assert [r[0] for r in d.select(dates.day_number(F.col("d"), F.col("m"), F.col("y"))).collect()] == [0, -11745, -1, 8037]
    y = spark.createDataFrame([(2000,), (1900,), (1500,), (-1,), (-5,), (0,), (2023,)], "y int")
    assert [r[0] for r in y.select(dates.is_leap(F.col("y"))).collect()] == [1, 0, 1, 1, 1, 1, 0]


def test_checksums(spark):
    words = ["", "a", "hello", "Someone"]
    d = spark.createDataFrame([(w,) for w in words], "s string")
    for w, c, h in d.select("s", checksums.crc32_signed(F.col("s").cast("binary")), checksums.polynomial_hash(F.col("s"))).collect():
        want = 0
        for ch in w:
            want = want * 31 + ord(ch)
        assert (c, h) == (wrap(zlib.crc32(w.encode())), wrap(want))


def by_steps(a, b, lang=0):
    """The order of two texts, character by character: letters, then characters, lengths and capitals."""
    two = {"Æ": "AE", "æ": "ae", "ß": "ss", "Œ": "OE", "œ": "oe"}
    base = {"ä": "a", "Ä": "A", "é": "e", "É": "E", "ÿ": "y", "Ÿ": "Y", "ç": "c", "ñ": "ñ"}
    up = lambda c: c.upper() if len(c.upper()) == 1 else c
    sign = lambda n: (n > 0) - (n < 0)

    def first(pairs):
        return next((sign(ord(x.lower()) - ord(y.lower())) for x, y in pairs if x != y and up(x) != up(y) and x.lower() != y.lower()), 0)

    x, y = ([base.get(c, c) for e in t for c in two.get(e, e)] for t in (a, b))
    if n := first(zip(x, y, strict=False)) or sign(len(x) - len(y)):
        return n
    if n := first(zip(a[::-1], b[::-1], strict=False) if lang == 2 else zip(a, b, strict=False)) or sign(len(a) - len(b)):
        return n
    weight = lambda c: ord(c.lower()) * 16 + 1 if c.isupper() else ord(c) * 16
    return next((sign(weight(p) - weight(q)) for p, q in zip(a, b, strict=True) if p != q), 0)


def test_locale_order_by_steps(spark):
    import random

    rnd = random.Random(8)
    made = lambda: "".join(rnd.choice("aAäÄæÆeEéÉsSßoOœŒyÿŸçñz -") for _ in range(rnd.randrange(5)))
    pairs = [(made(), made()) for _ in range(3_000)] + [("Æsop", "AEsop"), ("Straße", "STRASSE"), ("", "a"), ("", ""), ("a\U0001f600", "a\U0001f601")]
    d = spark.createDataFrame(pairs + [(None, "a"), ("a", None)], "a string, b string").select("*", *[text.compare_folded(F.col("a"), F.col("b"), n).alias(f"o{n}") for n in (0, 2)], (text.locale_key(F.col("a")) == text.locale_key(F.col("b"))).alias("same"))
    for r in d.collect():
        if r.a is None or r.b is None:
            assert (r.o0, r.o2, r.same) == (None, None, None)
        else:
            assert (r.o0, r.o2, r.same) == (by_steps(r.a, r.b), by_steps(r.a, r.b, 2), r.a == r.b), (r.a, r.b)


def test_lines_wrap_word_by_word(spark):
    import random

    rnd, widths = random.Random(3), {" ": 3, "i": 2, "m": 9}
    texts = ["".join(rnd.choice(["i", "m", "x", " ", " ", "<br>"]) for _ in range(rnd.randrange(40))) for _ in range(300)]

    def wrapped(t, most):
        lines, widest = 0, 0
        for part in t.split("<br>"):
            now = None
            for word in part.split(" "):
                size = sum(widths.get(c, 6) for c in word)
                if now is None or now + 3 + size > most:
                    lines, now = lines + 1, size
                else:
                    now += 3 + size
                widest = max(widest, now)
        return lines, widest

    d = spark.createDataFrame([(t, k % 5 * 10) for k, t in enumerate(texts)] + [(None, 5)], "t string, w int")
    got = d.select("t", "w", text.wrap_lines(widths, 6)("t", F.col("w")).alias("l")).select("t", "w", "l.lines", "l.widest").collect()
    assert all((r.lines, r.widest) == wrapped(r.t or "", r.w) for r in got)


def test_sums_wrap_at_32_bits(spark):
    from millrace.operators import aggregates

    rows = [(k % 5, k % 3, q) for k, q in enumerate([2**31 - 1, -(2**31), 2**40 + 5, -7, None, 1, 2**62, -(2**62)] * 9)] + [(9, 2, 1), (None, 0, 2**31)]
    want = {}
    for container, item, q in rows:
        want[container] = wrap(want.get(container, 0) + (q or 0) * (item == 0))
    got = aggregates.wrapped_sums(spark.createDataFrame(rows, "container int, item int, qty long").repartition(4), F.col("item") == 0)
    assert {r.container: r.qty for r in got.collect()} == want


def test_any_number_of_wanted_values(spark):
    from millrace.operators import lookups

    entries = spark.createDataFrame([("a", 1)] * 50 + [("a", 2), ("b", None), (None, 1)], "e string, v int")
    wanted = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", None), (None, 1), ("c", 2)], "e string, v int")
    got = sorted(map(tuple, lookups.enum_contains_any(entries, "e", "v", wanted).collect()), key=repr)
    assert got == sorted([("a", 1, 50), ("a", 3, 0), ("b", None, 0), (None, 1, 0), ("c", 2, 0)], key=repr)
