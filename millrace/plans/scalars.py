"""Integer, bit-field, text, date and checksum functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksums, dates, digests, int32, text
from ..sources import load
from .registry import query

_W = "(((({0}) + 2147483648) & 4294967295) - 2147483648)"  # wraps a long to 32 bits
_OPERANDS = "SELECT l_orderkey, l_linenumber, " + _W.format("l_orderkey * 1000003 - l_partkey * 77777777") + " AS a, (l_suppkey * 7919 - l_linenumber * 100000)::bigint AS b, l_linenumber::bigint AS c FROM lineitem"


def _operands(spark, sf_dir):
    a = int32.wrap32(F.col("l_orderkey") * 1000003 - F.col("l_partkey") * 77777777)
    b = (F.col("l_suppkey") * 7919 - F.col("l_linenumber") * 100000).cast("int")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), F.col("l_linenumber").cast("int").alias("c"))


@query(f"""
SELECT l_orderkey, l_linenumber, {_W.format('a + b')}::int AS added, {_W.format('a - b')}::int AS subtracted, {_W.format('a * b')}::int AS multiplied,
  {_W.format('a // c')}::int AS divided, (a % c)::int AS remainder, least(a, b)::int AS low, greatest(a, b)::int AS high
FROM ({_OPERANDS})""")
def int_arithmetic(spark, sf_dir):
    d, a, b, c = _operands(spark, sf_dir), F.col("a"), F.col("b"), F.col("c")
    return d.select(
        "l_orderkey", "l_linenumber", int32.add32(a, b).alias("added"), int32.sub32(a, b).alias("subtracted"), int32.mul32(a, b).alias("multiplied"),
        int32.div32(a, c).alias("divided"), int32.mod32(a, c).alias("remainder"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, {_W.format('a + a * c // 100')}::int AS raised, {_W.format('(a * b) // c')}::int AS scaled,
  {_W.format('c + ' + _W.format(_W.format('b - c') + ' * ' + _W.format('l_orderkey % 100 - c')) + ' // 7')}::int AS between,
  CASE WHEN c - 1 = 0 THEN 0 ELSE greatest(-2147483648.0, least(2147483647.0, trunc(pow((c - 1)::double, (c * 3)::double))))::bigint::int END AS powered,
  CASE WHEN c - 1 = 0 THEN 0 WHEN c - 2 = 0 THEN 2147483647 ELSE trunc(pow((c - 1)::double, 1.0::double / (c - 2)))::int END AS rooted
FROM ({_OPERANDS})""")
def int_interpolation(spark, sf_dir):
    d, a, b, c = _operands(spark, sf_dir), F.col("a"), F.col("b"), F.col("c")
    x = (F.col("l_orderkey") % 100).cast("int")
    return d.select(
        "l_orderkey", "l_linenumber", int32.add_percent(a, c).alias("raised"), int32.scale32(a, c, b).alias("scaled"), int32.lerp32(c, b, c, c + 7, x).alias("between"),
        int32.power32(c - 1, c * 3).alias("powered"), int32.root32(c - 1, c - 2).alias("rooted"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, {_W.format('u | (1::bigint << s)')}::int AS with_bit, {_W.format('u & ~(1::bigint << s)')}::int AS without_bit,
  (CASE WHEN u & (1::bigint << s) <> 0 THEN 1 ELSE 0 END)::int AS bit, {_W.format('u & (b & 4294967295)')}::int AS both, {_W.format('u | (b & 4294967295)')}::int AS either
FROM (SELECT *, a & 4294967295 AS u, (l_orderkey + l_linenumber) % 32 AS s FROM ({_OPERANDS}))""")
def int_bits(spark, sf_dir):
    d, a, b = _operands(spark, sf_dir), F.col("a"), F.col("b")
    s = (F.col("l_orderkey") + F.col("l_linenumber")).cast("int")  # only the low five bits count
    return d.select(
        "l_orderkey", "l_linenumber", int32.set_bit(a, s).alias("with_bit"), int32.clear_bit(a, s).alias("without_bit"), int32.test_bit(a, s).alias("bit"),
        a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("either"),
    )


@query(f"""
SELECT l_orderkey, l_linenumber, {_W.format('(u >> lo) & m')}::int AS field, {_W.format('(u & ~(m << lo)) | ((CASE WHEN v < 0 OR v > m THEN 0 ELSE v END) << lo)')}::int AS written
FROM (SELECT *, a & 4294967295 AS u, l_orderkey % 20 AS lo, (1::bigint << (c + 1)) - 1 AS m, l_orderkey % 300 - 5 AS v FROM ({_OPERANDS}))""")
def bit_fields(spark, sf_dir):
    d, a, lo = _operands(spark, sf_dir), F.col("a"), (F.col("l_orderkey") % 20).cast("int")
    hi = lo + F.col("c")
    return d.select("l_orderkey", "l_linenumber", int32.read_field(a, lo, hi).alias("field"), int32.write_field(a, lo, hi, (F.col("l_orderkey") % 300 - 5).cast("int")).alias("written"))


@query("""
SELECT l_orderkey, l_linenumber, v, v >> 28 AS plane, (v >> 14) & 16383 AS x, v & 16383 AS y
FROM (SELECT l_orderkey, l_linenumber, ((l_linenumber % 4) * 268435456 + (l_partkey % 16384) * 16384 + l_suppkey % 16384)::int AS v FROM lineitem)""")
def coordinates(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem")
    d = d.select("l_orderkey", "l_linenumber", int32.pack_coordinate(F.col("l_linenumber") % 4, F.col("l_partkey") % 16384, F.col("l_suppkey") % 16384).alias("v"))
    return d.select("*", *[c.alias(n) for n, c in int32.unpack_coordinate(F.col("v")).items()])


@query("""
SELECT p_partkey, p_name || p_size AS joined, p_brand || CASE WHEN p_size - 25 >= 0 THEN '+' ELSE '' END || (p_size - 25) AS signed, lower(p_name) AS lowered, length(p_name)::int AS n,
  substr(p_name, 3, 4) AS part, (CASE WHEN instr(substr(p_type, 4), 'e') > 0 THEN instr(substr(p_type, 4), 'e') + 2 ELSE -1 END)::int AS at,
  CASE WHEN p_size % 2 = 1 THEN p_brand ELSE p_type END AS chosen, p_name || chr((65 + p_size % 26)::int) AS appended, p_size::varchar AS shown
FROM part""")
def strings(spark, sf_dir):
    name, size = F.col("p_name"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        "p_partkey", text.join_strings(name, size).alias("joined"), text.append_signed(F.col("p_brand"), size - 25).alias("signed"), F.lower(name).alias("lowered"), text.length0(name).alias("n"),
        text.slice0(name, F.lit(2), F.lit(6)).alias("part"), text.index_of(F.col("p_type"), F.lit("e"), F.lit(3)).alias("at"), F.when(size % 2 == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("chosen"),
        F.concat(name, F.char(65 + size % 26)).alias("appended"), size.cast("string").alias("shown"),
    )


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '', 'g') AS plain,
  replace(replace(replace(url, '<', chr(1)), '>', '<gt>'), chr(1), '<lt>') AS escaped FROM pages""")
def tags(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"), text.escape_angles(F.col("url")).alias("escaped"))


@query(r"""
SELECT c, count(*) AS n, (CASE WHEN regexp_matches(c, '^[0-9A-Za-z]$') THEN 1 ELSE 0 END)::int AS alphanumeric, (CASE WHEN regexp_matches(c, '^[A-Za-z]$') THEN 1 ELSE 0 END)::int AS alpha,
  (CASE WHEN regexp_matches(c, '^[0-9]$') THEN 1 ELSE 0 END)::int AS digit, (CASE WHEN regexp_matches(c, '^[\x20-\x7e\xa0-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]$') THEN 1 ELSE 0 END)::int AS printable, lower(c) AS low, CASE WHEN c = 'ß' THEN c ELSE upper(c) END AS up
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c""")
def characters(spark, sf_dir):
    c = F.col("c")
    found = load(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return found.select("c", "n", text.is_alphanumeric(c).alias("alphanumeric"), text.is_alpha(c).alias("alpha"), text.is_digit(c).alias("digit"), text.is_printable(c).alias("printable"), F.lower(c).alias("low"), text.upper_char(c).alias("up"))


@query("""
SELECT o_orderkey, o_orderdate::date - DATE '2002-02-27' AS day, CASE WHEN y < 1970 THEN -1 ELSE (make_date(y, month(o_orderdate), day(o_orderdate)) - DATE '2002-02-27') END::int AS numbered,
  day(o_orderdate) || '-' || strftime(o_orderdate, '%b-%Y') AS shown, (epoch(o_orderdate)::bigint // 60)::int AS minutes, replace(format('{:,}', o_custkey * 997), ',', '.') AS grouped
FROM (SELECT *, year(o_orderdate) - o_orderkey % 40 * 0 AS y FROM orders)""")
def day_numbers(spark, sf_dir):
    d = F.col("o_orderdate")
    number = dates.day_number(F.dayofmonth(d), F.month(d) - 1, F.year(d))
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(d, F.lit(dates.EPOCH)).alias("day"), number.alias("numbered"), dates.day_text(number).alias("shown"), dates.minutes_since_epoch(d).alias("minutes"), text.grouped(F.col("o_custkey") * 997, ".").alias("grouped")
    )


@query("""
SELECT y, (CASE WHEN z < 1582 THEN (z % 4 + 4) % 4 = 0 ELSE (z % 4 = 0 AND z % 100 <> 0) OR z % 400 = 0 END)::int AS leap
FROM (SELECT y, CASE WHEN y < 0 THEN y + 1 ELSE y END AS z FROM (SELECT (o_orderkey % 3000 - 400)::int AS y FROM orders GROUP BY 1))""")
def leap_years(spark, sf_dir):
    years = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3000 - 400).cast("int").alias("y")).distinct()
    return years.select("y", dates.is_leap(F.col("y")).alias("leap"))


@query("""
SELECT c_custkey, (list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295) + 2147483648 & 4294967295) - 2147483648 AS hash FROM customer""")
def name_hashes(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", checksums.polynomial_hash(F.col("c_name")).alias("hash"))


@query(r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b::bigint] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
), d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, xor(list_reduce([4294967295::bigint] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) AS crc FROM d, crc_table
)
SELECT doc_id, (CASE WHEN crc >= 2147483648 THEN crc - 4294967296 ELSE crc END)::int AS crc FROM c""")
def checksums_signed(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", checksums.crc32_signed(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))


@query("""
SELECT conv_id, turn, (list_sum(list_transform(string_split(text, ''), lambda c: CASE c WHEN ' ' THEN 3 WHEN 'i' THEN 2 WHEN 'l' THEN 2 WHEN 'm' THEN 9 ELSE 6 END)))::int AS width FROM conversations""")
def text_widths(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.text_width(F.col("text"), GLYPHS, 6).alias("width"))


GLYPHS = {" ": 3, "i": 2, "l": 2, "m": 9}


_GLYPH_WIDTHS = "list_sum(list_transform(string_split(w, ''), lambda c: CASE c WHEN '' THEN 0 WHEN ' ' THEN 3 WHEN 'i' THEN 2 WHEN 'l' THEN 2 WHEN 'm' THEN 9 ELSE 6 END))"


@query(f"""
WITH t AS (SELECT conv_id, turn, text, {{'size': 0, 'first': false, 'lines': 0, 'widest': 0, 'now': 0}} AS start, flatten(list_transform(string_split(coalesce(text, ''), '<br>'), lambda p: list_transform(string_split(p, ' '), lambda w, k:
  {{'size': coalesce({_GLYPH_WIDTHS}, 0)::INT, 'first': k = 1, 'lines': 0, 'widest': 0, 'now': 0}}))) AS words FROM conversations),
f AS (SELECT conv_id, turn, list_reduce([start] || words, lambda s, w: {{'size': 0, 'first': false, 'lines': (s.lines + (w.first OR s.now + 3 + w.size > 400)::INT)::INT, 'widest': greatest(s.widest, s.now)::INT,
  'now': (CASE WHEN w.first OR s.now + 3 + w.size > 400 THEN w.size ELSE s.now + 3 + w.size END)::INT}}) AS s FROM t)
SELECT conv_id, turn, s.lines AS lines, greatest(s.widest, s.now) AS widest FROM f""")
def text_layout(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.wrap_lines(GLYPHS, 6)("text", F.lit(400)).alias("l")).select("conv_id", "turn", "l.lines", "l.widest")


_PLAIN = "list_transform(string_split({0}, ''), lambda c: CASE WHEN c = 'ß' THEN c ELSE lower(upper(c)) END)"
_FOLDED = "translate(replace(replace(replace(replace(replace({0}, 'Æ', 'AE'), 'æ', 'ae'), 'ß', 'ss'), 'Œ', 'OE'), 'œ', 'oe'), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸàáâãäåçèéêëìíîïòóôõöùúûüýÿ', 'AAAAAACEEEEIIIIOOOOOUUUUYYaaaaaaceeeeiiiiooooouuuuyy')"


def _order(n: str, lang: int) -> str:
    """SQL of the keys of a column: letters, characters, raw ones."""
    plain, folded = _PLAIN.format(n), f"array_to_string({_PLAIN.format(_FOLDED.format(n))}, '')"
    whole = f"array_to_string({f'list_reverse({plain})' if lang == 2 else plain}, '')"
    raw = f"list_transform(string_split({n}, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN lower(c) <> c THEN unicode(lower(c)) * 16 + 1 ELSE unicode(c) * 16 END)"
    return f"{folded} AS f{n}{lang}, {whole} AS w{n}{lang}, {raw} AS r{n}{lang}"


def _compared(lang: int) -> str:
    less = lambda k: f"WHEN {k}a{lang} < {k}b{lang} THEN -1 WHEN {k}a{lang} > {k}b{lang} THEN 1"
    return f"CASE WHEN a IS NULL THEN NULL {less('f')} {less('w')} {less('r')} ELSE 0 END"


@query(f"""
WITH d AS (SELECT doc_id, text AS a, CASE doc_id % 4 WHEN 0 THEN substr(text, 3) WHEN 1 THEN translate(text, 'aeiouéèüöä', 'äéíóúeeuoa') WHEN 2 THEN translate(text, 'etaoinETAOIN', 'ETAOINetaoin') ELSE rpad(replace(replace(text, 'ss', 'ß'), 'ae', 'æ'), length(text)::INT, ' ') END AS b FROM documents),
k AS (SELECT doc_id, a, b, {_order("a", 0)}, {_order("b", 0)}, {_order("a", 2)}, {_order("b", 2)} FROM d)
SELECT doc_id, a, b, {_compared(0)} AS "order", {_compared(2)} AS order_from_end FROM k""")
def collated_compare(spark, sf_dir):
    """Each text with itself moved, with other accents, other case, or ligatures."""
    t, k = F.col("text"), F.col("doc_id") % 4
    b = F.when(k == 0, F.expr("substring(text, 3)")).when(k == 1, F.translate(t, "aeiouéèüöä", "äéíóúeeuoa")).when(k == 2, F.translate(t, "etaoinETAOIN", "ETAOINetaoin"))
    ligatures = F.rpad(F.replace(F.replace(t, F.lit("ss"), F.lit("ß")), F.lit("ae"), F.lit("æ")), F.length(t), F.lit(" "))
    d = load(spark, sf_dir, "documents").select("doc_id", t.alias("a"), b.otherwise(ligatures).alias("b"))
    return d.select("*", text.compare_folded(F.col("a"), F.col("b")).alias("order"), text.compare_folded(F.col("a"), F.col("b"), 2).alias("order_from_end"))


@query("""
SELECT c_custkey, h, CASE WHEN v <= 2147483647 THEN v::int END AS parsed FROM (
  SELECT c_custkey, format('{:x}', c_custkey * 1234567) AS h, (c_custkey * 1234567)::bigint AS v FROM customer)""")
def radix_parse(spark, sf_dir):
    h = F.lower(F.hex(F.col("c_custkey") * 1234567))
    return load(spark, sf_dir, "customer").select("c_custkey", h.alias("h")).select("*", text.parse_radix(F.col("h"), 16).alias("parsed"))


_CP1252 = ", ".join(f"'{c}'" for c in text._CP1252)


@query(f"""
SELECT page_id, list_aggregate(list_transform(regexp_extract_all(url || '?a=%41%zz+%e9%80%81%00%2B%4', '(?s)%[0-9a-fA-F]{{2}}|.'), lambda t: CASE
    WHEN length(t) < 3 THEN CASE t WHEN '+' THEN ' ' ELSE t END WHEN t = '%00' THEN ''
    WHEN ('0x' || substr(t, 2))::int BETWEEN 128 AND 159 THEN ([{_CP1252}])[('0x' || substr(t, 2))::int - 127] ELSE chr(('0x' || substr(t, 2))::int) END), 'string_agg', '') AS decoded FROM pages""")
def url_parts(spark, sf_dir):
    """Urls with escapes of every kind behind them."""
    return load(spark, sf_dir, "pages").select("page_id", text.decode_url(F.concat("url", F.lit("?a=%41%zz+%e9%80%81%00%2B%4"))).alias("decoded"))


@query(None)
def digests_512(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", digests.digest_512(F.col("text")).alias("digest"))


@query("""
SELECT client_id, coalesce(name, 'null') || '/' || coalesce(city, 'null') || '/' || coalesce(segment, 'null') AS joined, coalesce(email, 'null') || CASE WHEN nation_id >= 0 THEN '+' ELSE '' END || nation_id::VARCHAR AS signed, coalesce(length(city), 0)::INT AS size,
  replace(format('{:,}', updated), ',', chr(160)) AS grouped, replace(format('{:,}', -updated), ',', '.') AS dotted FROM (SELECT *, epoch_us(updated_at) // 1000 AS updated FROM clients)""")
def null_strings(spark, sf_dir):
    """Clients' texts, which may be null, joined; and large numbers in groups, also parted by no-break spaces."""
    c = load(spark, sf_dir, "clients")
    updated = F.unix_millis(F.col("updated_at").cast("timestamp"))
    return c.select(
        "client_id", text.join_strings(F.col("name"), F.lit("/"), F.col("city"), F.lit("/"), F.col("segment")).alias("joined"), text.append_signed(F.col("email"), F.col("nation_id")).alias("signed"), text.length0(F.col("city")).alias("size"),
        text.grouped(updated, "\u00a0").alias("grouped"), text.grouped(-updated, ".").alias("dotted"),
    )
