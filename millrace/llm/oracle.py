"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', (((('0x' || substr(hex, {5 * k + 1}, 5))::int >> {s}) & 31) + 1), 1)" for k in range(8) for s in (15, 10, 5, 0)
)

ORACLE["op6_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE["op3_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::double[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id
"""

ORACLE["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


# the CRC's table is made from its polynomial; bytes are read from the text's hex
ORACLE["op10_shards"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), hexed AS (
  SELECT doc_id, octet_length(b) AS n, hex(b) AS h FROM d
), s AS (
  SELECT doc_id, (n + 1)::BIGINT AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table
), o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s
), p AS (
  SELECT *, least(15, floor(before::DOUBLE / total::DOUBLE * 16))::INT AS shard FROM o
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""


def _licenses() -> str:
    from .licenses import THRESHOLD, templates, words

    values = ", ".join(f"({k}, '{n}', '{' '.join(words(t))}')" for k, (n, t) in enumerate(templates()))
    return f"""
WITH f AS (
  SELECT doc_id, text, source AS source_dir, source || (CASE WHEN doc_id % 7 = 0 THEN '/' ELSE '/p' || (doc_id % 7) || '/' END) || doc_id || '.txt' AS path FROM documents
), t(k, name, body) AS (VALUES {values}
), tw AS (SELECT k, w, 1 + ln(count(*)) AS tf FROM (SELECT k, unnest(string_split(body, ' ')) AS w FROM t) GROUP BY 1, 2
), n AS (SELECT count(*) AS n FROM f
), df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM f) GROUP BY 1
), tv AS (SELECT k, w, tf * idf AS x, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS size
  FROM (SELECT k, w, tf, ln((1.0 + n.n) / (1 + coalesce(df.df, 0))) + 1 AS idf FROM tw CROSS JOIN n LEFT JOIN df USING (w))
), parts AS (
  SELECT doc_id, 'whole' AS kind, 0 AS part, lower(text) AS body FROM f WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'line', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS l FROM f)
  UNION ALL SELECT doc_id, 'block', unnest(range(len(l))), unnest(l) FROM (SELECT doc_id, string_split_regex(lower(text), '\n[ \t\r]*\n') AS l FROM f)
), pw AS (SELECT doc_id, kind, part, w, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, kind, part, unnest(string_split_regex(body, '[^a-z0-9]+')) AS w FROM parts) WHERE w <> '' GROUP BY ALL
), pv AS (SELECT doc_id, kind, part, w, tf * (ln((1.0 + n.n) / (1 + df.df)) + 1) AS x FROM pw CROSS JOIN n JOIN df USING (w)
), ps AS (SELECT doc_id, kind, part, sqrt(sum(x * x)) AS size FROM pv GROUP BY ALL
), s AS (
  SELECT doc_id, kind, part, k, round(sum(pv.x * tv.x / tv.size) / any_value(ps.size), 6) AS score FROM pv JOIN tv USING (w) JOIN ps USING (doc_id, kind, part) GROUP BY 1, 2, 3, 4
), own AS (
  SELECT doc_id, max(score) AS score, min(k) FILTER (score = m) AS k, bool_or(kind = 'whole') AS is_license_file
  FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM s WHERE score >= {THRESHOLD}) GROUP BY 1
), o AS (SELECT doc_id, path, score, name AS own_license, is_license_file, regexp_replace(path, '/[^/]*$', '') AS dir FROM own JOIN t USING (k) JOIN f USING (doc_id)
), lf AS (SELECT dir, min(path) AS path, arg_min(own_license, path) AS lic FROM o WHERE is_license_file AND path IS NOT NULL GROUP BY 1
)
SELECT f.doc_id, f.path, o.own_license, o.score, coalesce(o.is_license_file, false) AS is_license_file,
       coalesce(o.own_license, a.lic, b.lic) AS license,
       CASE WHEN o.own_license IS NOT NULL THEN f.path WHEN a.lic IS NOT NULL THEN a.path ELSE b.path END AS license_path
FROM f LEFT JOIN o ON o.doc_id = f.doc_id
LEFT JOIN lf a ON a.dir = regexp_replace(f.path, '/[^/]*$', '')
LEFT JOIN lf b ON b.dir = f.source_dir
"""


ORACLE["op4_licenses"] = _licenses()


def _crc(name: str, of: str) -> str:
    """A CTE ``name (x, h)``: the unsigned CRC of each distinct number's decimal digits."""
    return f"""{name} AS (
  SELECT x, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(x::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT {of} AS x FROM {{table}} WHERE {of} IS NOT NULL), crc_table
)"""


_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))
)"""
_USED = "CASE WHEN h % 2 = 1 THEN epoch_us({t}) - ((epoch_us({t}) % 3600000000) + 3600000000) % 3600000000 ELSE epoch_us({t}) END"

ORACLE["op11_asof_orders"] = f"""
WITH {_CRC_TABLE}, {_crc("ch", "click_id").format(table="clicks")}, {_crc("sh", "sale_id").format(table="sales")}, c AS (
  SELECT click_id, client_id, {_USED.format(t="ts")} AS ts_us FROM (SELECT click_id, min(client_id) AS client_id, min(ts) AS ts FROM clicks GROUP BY 1) k LEFT JOIN ch ON ch.x = k.click_id
), s AS (
  SELECT client_id, sale_id, h, {_USED.format(t="sold_at")} AS at_us, floor(100 * total + 0.5)::BIGINT AS total_cents, priority::BIGINT AS priority FROM sales LEFT JOIN sh ON sh.x = sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), o AS (
  SELECT client_id, sale_id, at_us, total_cents, priority FROM s UNION ALL SELECT client_id, -1 - sale_id, at_us, total_cents, 6 - priority FROM s WHERE h % 3 <> 0
), b AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, at_us) AS n_tied, row_number() OVER (PARTITION BY client_id, at_us ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST, total_cents NULLS LAST) AS k FROM o
), m AS (
  SELECT c.click_id, c.client_id, c.ts_us, b.sale_id, b.at_us, b.total_cents, b.n_tied, coalesce(c.ts_us - b.at_us <= 864000000000, false) AS good
  FROM c ASOF LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON c.client_id = b.client_id AND c.ts_us >= b.at_us
)
SELECT click_id, client_id, ts_us, CASE WHEN good THEN sale_id END AS sale_id, CASE WHEN good THEN ts_us - at_us END AS lag_us, CASE WHEN good THEN total_cents END AS total_cents, CASE WHEN good THEN n_tied ELSE 0 END AS n_tied FROM m
"""

ORACLE["op12_url_filters"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, q, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
