"""String functions with 0-based places, null-tolerant joins and tag stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Printable characters of code page 1252 beyond Latin-1.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _s(x) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def join_strings(*parts: Column) -> Column:
    """Joined parts; a null reads "null"."""
    return F.concat(*[_s(p) for p in parts])


def append_signed(s: Column, n: Column) -> Column:
    return F.concat(_s(s), F.when(n >= 0, F.lit("+")).otherwise(F.lit("")), n.cast("string"))


def length0(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def slice0(s: Column, begin: Column, end: Column) -> Column:
    """Characters from begin up to end, counted from 0."""
    return F.substring(s, begin + 1, end - begin)


def index_of(s: Column, t: Column, start: Column) -> Column:
    """First place of t at or after start, from 0; -1 if there is none."""
    return (F.call_function("locate", t, s, F.greatest(start, F.lit(0)) + 1) - 1).cast("int")


def escape_angles(s: Column) -> Column:
    """< and > as the tags <lt> and <gt>."""
    return F.replace(F.replace(F.replace(s, F.lit("<"), F.lit("\x01")), F.lit(">"), F.lit("<gt>")), F.lit("\x01"), F.lit("<lt>"))


def strip_tags(s: Column) -> Column:
    """Text outside <tags>; an open tag runs to the end, a lone > goes too."""
    return F.regexp_replace(F.regexp_replace(s, "<[^>]*>?", ""), ">", "")


def is_printable(c: Column) -> Column:
    return F.when(c.rlike("^[\\x20-\\x7e\\xa0-\\xff" + CP1252 + "]$"), 1).otherwise(0)


def is_alphanumeric(c: Column) -> Column:
    return F.when(c.rlike("^[0-9A-Za-z]$"), 1).otherwise(0)


def is_alpha(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z]$"), 1).otherwise(0)


def is_digit(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 1).otherwise(0)


def upper_char(c: Column) -> Column:
    """A character's upper case; those without one of a single character stay."""
    return F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)


def grouped(n: Column, separator: str = ",") -> Column:
    """An integer with its digits in groups of three."""
    return F.translate(F.format_number(n.cast("long"), 0), ",", separator)


# Letters that count as two, and runs of letters that count as their first; others stay.
_TWO = {"Æ": "AE", "æ": "ae", "ß": "ss", "Œ": "OE", "œ": "oe"}
_RUNS = (("ÀÁÂÃÄÅ", "A"), ("Ç", "C"), ("ÈÉÊË", "E"), ("ÌÍÎÏ", "I"), ("ÒÓÔÕÖ", "O"), ("ÙÚÛÜ", "U"), ("ÝŸ", "Y"), ("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("òóôõö", "o"), ("ùúûü", "u"), ("ýÿ", "y"))


def _lower_char(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 1)


def _unaccented(s: Column) -> Column:
    for letter, two in _TWO.items():
        s = F.replace(s, F.lit(letter), F.lit(two))
    return F.translate(s, "".join(r for r, _ in _RUNS), "".join(to * len(r) for r, to in _RUNS))


def locale_key(s: Column, lang: int = 0) -> Column:
    """A key that sorts and joins texts as the locale does: a struct, null for a null text.

    First the letters without accents and case, two of them for a ligature; then all characters without case, from the end where
    ``lang`` is 2, a text before its own continuations; then all characters, a capital behind its small letter. Equal keys are
    equal texts. Characters go by code point; one without a single small or capital letter stays as it is.
    """
    folded = _unaccented(s)
    plain = lambda t: F.transform(F.split(t, ""), lambda c: _lower_char(upper_char(c)))
    whole = plain(s)
    small = lambda c: F.when(c.rlike(r"[\p{IsUppercase}\p{Lt}]"), F.ascii(_lower_char(c)) * 16 + 1).otherwise(F.ascii(c) * 16)
    return F.when(s.isNotNull(), F.struct(F.array_join(plain(folded), "").alias("letters"), F.array_join(F.reverse(whole) if lang == 2 else whole, "").alias("characters"), F.transform(F.split(s, ""), small).alias("raw")))


#: Texts of characters whose case goes one to one, capitals before their small letters by code point, or that have none.
_PLAIN = r"\A[\x00-\xff\u2000-\u2070\u20a0-\u20cf\u2190-\u23ff\u2500-\u27bf\u3000-\u312f\u3400-\u9fff\uac00-\ud7a3]*\z"


def _bound(a: Column, b: Column, then) -> Column:
    """``then(a, b)`` with each of both made once, however often it is used."""
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: then(p["a"], p["b"])), F.lit(0))


def compare_folded(a: Column, b: Column, lang: int = 0) -> Column:
    """-1, 0 or 1 by the texts' locale keys; null where one is null.

    Texts of plain characters are compared as whole strings: without accents and case, then without case, and then, as they differ in case
    only and a capital is both less by code point and behind its small letter, by code point the other way. Others have their keys built.
    """
    lower = lambda s: F.replace(F.lower(s), F.lit("µ"), F.lit("μ"))  # noqa: E731  the one whose capital has another small letter
    letters = lambda s: F.when(s.rlike(r"\A[\x00-\x7f]*\z"), F.lower(s)).otherwise(lower(_unaccented(s)))
    characters = lambda s: F.reverse(lower(s)) if lang == 2 else lower(s)
    order = lambda x, y, equal: F.when(x < y, -1).when(x > y, 1).otherwise(equal)

    def compared(a: Column, b: Column) -> Column:
        by_case = F.when(a > b, -1).otherwise(1)
        by_characters = _bound(characters(a), characters(b), lambda x, y: order(x, y, by_case))
        whole = _bound(letters(a), letters(b), lambda x, y: order(x, y, by_characters))
        keys = _bound(locale_key(a, lang), locale_key(b, lang), lambda x, y: order(x, y, F.lit(0)))
        return F.when(a == b, 0).when(a.rlike(_PLAIN) & b.rlike(_PLAIN), whole).when(a.isNotNull() & b.isNotNull(), keys)

    return _bound(a, b, compared)


def wrap_lines(widths: dict[str, int], default: int):
    """A function (text, width) -> struct (lines, widest): greedy wrapping at spaces by glyph widths, new lines at <br>.

    One fold over the words with the lines so far, the widest and the current one's width as state; a word that is wider than
    the limit has a line for itself. A null text is empty, which is one line.
    """
    space = widths.get(" ", default)

    def wrapped(s: Column | str, limit: Column) -> Column:
        s = F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(""))
        # the first word of each part begins a line
        words = F.flatten(F.transform(F.split(s, "<br>", -1), lambda part: F.transform(F.split(part, " ", -1), lambda w, k: F.struct(text_width(w, widths, default).alias("size"), (k == 0).alias("first")))))
        start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("widest"), F.lit(0).alias("now"))

        def step(state: Column, w: Column) -> Column:
            room = state["now"] + space + w["size"]
            ends = w["first"] | (room > limit)
            return F.struct((state["lines"] + ends.cast("int")).alias("lines"), F.greatest(state["widest"], state["now"]).alias("widest"), F.when(ends, w["size"]).otherwise(room).alias("now"))

        return F.aggregate(words, start, step, lambda end: F.struct(end["lines"].alias("lines"), F.greatest(end["widest"], end["now"]).alias("widest")))

    return wrapped


def text_width(s: Column, widths: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])
    return F.aggregate(F.split(F.coalesce(s, F.lit("")), ""), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(default))))


#: The characters of bytes 128 to 159 in code page 1252; unassigned bytes have none.
_CP1252 = [bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)]


def decode_url(s: Column) -> Column:
    """%xx decoded as bytes of code page 1252 and + as a space; malformed escapes stay, byte 0 and unassigned bytes go."""
    table = F.array(*[F.lit(c) for c in _CP1252])

    def decoded(t: Column) -> Column:
        byte = F.conv(F.substring(t, 2, 2), 16, 10).cast("int")
        char = F.when(byte == 0, "").when(byte.between(128, 159), F.get(table, byte - 128)).otherwise(F.char(byte))
        return F.when(F.length(t) == 3, char).when(t == "+", " ").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)%[0-9a-fA-F]{2}|."), F.lit(0)), decoded), "")


def parse_radix(s: Column, radix: int) -> Column:
    """A signed 32-bit integer in a radix; null where the text isn't one or doesn't fit."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    good = F.lower(s).rlike(f"^[+-]?[{digits}]{{1,12}}$")
    size = F.conv(F.regexp_replace(s, "^[+-]", ""), radix, 10).cast("decimal(20,0)")
    value = F.when(s.startswith("-"), -size).otherwise(size)
    return F.when(good & value.between(-(1 << 31), (1 << 31) - 1), value.cast("int"))
