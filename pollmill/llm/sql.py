"""DuckDB SQL for the queries that SQL can express."""

CHECKS: dict[str, str] = {}

#: Words `[^\x20\x09-\x0D]+`
_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"

CHECKS["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format(t='text')} AS w FROM documents
), m AS (
  SELECT r, doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_basic,
    len(list_filter(w, lambda x: regexp_matches(x, '^[#*$%&|<>]|[#*$%&|<>]$'))) AS n_symbol_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d
), p AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), g AS (
  SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS win,
    count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM p
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) > 1 AS again FROM g WHERE k = 8
), q AS (
  SELECT p.r, max(coalesce(h.again, false)::INT) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
  FROM p LEFT JOIN h USING (r, i)
), a AS (
  SELECT r, sum(hit) AS n_repeat_words FROM q GROUP BY r
), f AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, n_upper, n_basic AS n_letters, n_symbol_words, n_stutter
  FROM m LEFT JOIN a USING (r)
), b AS (
  SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
    + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 8 * (10 * n_symbols > 3 * n_words)::INT
    + 16 * (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 32 * (n_letters >= 40 AND 10 * n_upper > 6 * n_letters)::INT
    + 64 * (10 * n_symbol_words > 5 * n_words)::INT + 128 * (2 * n_stutter > n_words)::INT AS failed_bits
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
  failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits
FROM b
"""

_PLAIN = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHECKS["op1_decontamination"] = rf"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_PLAIN.format(t='text')} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, array_to_string(w[i + 1 : i + 13], ' ') AS win, least(13, len(w)) AS k
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format(t='text')} AS w FROM documents
), kinds AS (
  SELECT DISTINCT k FROM win
), spot AS (
  SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(greatest(0, len(w) - k + 1))) AS i FROM d, kinds)
), hit AS (
  SELECT DISTINCT spot.r, spot.i, spot.k, win.item FROM spot JOIN win USING (win, k)
), items AS (
  SELECT r, list(DISTINCT item) AS items FROM hit GROUP BY r
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (r) LEFT JOIN covered USING (r)
"""

_KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: (pattern, group of the value, rank)
_KINDS = {
    "assign": (rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": ("(AKIA[A-Z0-9]{16,})", 1),
    "hex": ("([0-9a-f]{24,})", 1),
    "opaque": ("([A-Za-z0-9+/_-]{20,})", 1),
}


def _spans(rank: int, kind: str, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, len(array_to_string(gaps[1:i], '')) + len(array_to_string(m[1:i - 1], '')) AS start, m[i] AS found, v[i] AS value
  FROM (SELECT r, m, v, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS gaps FROM d))"""


CHECKS["op5_secrets"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), s AS ({" UNION ALL ".join(_spans(i, k, p, g) for i, (k, (p, g)) in enumerate(_KINDS.items()))}
), f AS (
  SELECT * FROM s WHERE CASE kind WHEN 'assign' THEN length(value) >= 6
    WHEN 'opaque' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') ELSE true END
), o AS (
  SELECT value, count(DISTINCT coalesce('=' || source, 'null')) AS n_owners FROM f JOIN d USING (r) GROUP BY value
), k AS (
  SELECT r, rank, kind, start, n_owners < 2 AS live, kind || ':' || start || ':' || (start + length(found)) AS span
  FROM f JOIN o USING (value) WHERE rank < 3 OR n_owners < 2
), g AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live
  FROM k GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (r)
"""

CHECKS["op8_warc"] = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last, count(*) OVER (PARTITION BY h, payload_bytes) AS k,
    list_transform(range(8), lambda i: ('0x' || h[i * 5 + 1 : i * 5 + 5])::BIGINT) AS v FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::BIGINT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN k > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""

CHECKS["op4_substring_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t='text')} AS w FROM documents
), spot AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS win FROM (SELECT r, w, unnest(range(greatest(0, len(w) - 34))) AS i FROM d)
), again AS (
  SELECT win FROM spot GROUP BY win HAVING count(*) > 1
), gone AS (
  SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM spot JOIN again USING (win)) GROUP BY r
), word AS (
  SELECT r, w[p + 1] AS x, p FROM (SELECT r, w, unnest(range(len(w))) AS p FROM d)
), left_over AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM word
  WHERE (r, p) NOT IN (SELECT r, unnest(ps) FROM gone) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN left_over USING (r)
"""

CHECKS["op11_importance_resampling"] = rf"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) v(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format(t='text')} AS w FROM documents
), b AS (
  SELECT unnest({_PLAIN.format(t='text')}) AS word FROM benchmark
), f AS (
  SELECT r, unnest(w) AS word FROM d
), h AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM b)
), k AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::INT])), 4294967295) % 10000 AS bucket FROM h, tab
), own AS (
  SELECT bucket, count(*) AS n FROM f JOIN k USING (word) GROUP BY bucket
), aim AS (
  SELECT bucket, count(*) AS n FROM b JOIN k USING (word) GROUP BY bucket
), g AS (
  SELECT x.bucket, floor(1000 * ln(((coalesce(aim.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM own) + 10000)::DOUBLE)
    / ((coalesce(own.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM aim) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) x(bucket) LEFT JOIN own USING (bucket) LEFT JOIN aim USING (bucket)
), m AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) GROUP BY r
), s AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (r)
), o AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place,
    sum((n_features >= 20)::BIGINT) OVER () AS n FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM o
"""

CHECKS["op12_filter_audit"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS.format(t='text')} AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS f
  FROM d LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, good, toxic, f, count(*) AS n, (f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT) AS k FROM m GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), q AS (
  SELECT part, good, toxic, n, k, filter_order, step, fails,
    len(list_filter(range(1, step), lambda i: failed(f, filter_order[i]))) > 0 AS gone, n * 120 // greatest(k, 1) AS share
  FROM (SELECT *, failed(f, filter_order[step]) AS fails FROM p, o, (SELECT unnest(range(1, 6)) AS step))
)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n * good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
  coalesce(sum(n * toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost, coalesce(sum(share) FILTER (fails), 0)::BIGINT AS shapley
FROM q GROUP BY part, filter_order, step
"""
_FAILED = "(CASE {c} WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END)"
for _c in ("filter_order[i]", "filter_order[step]"):
    CHECKS["op12_filter_audit"] = CHECKS["op12_filter_audit"].replace(f"failed(f, {_c})", _FAILED.format(c=_c))

_MOMENTS = "coalesce(least(0.5::DOUBLE, greatest(1 / 10001::DOUBLE, sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0))), 0.5)"
_TWO = "'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp', 'com.br', 'co.nz', 'co.za', 'com.cn', 'co.in', 'co.kr', 'com.mx', 'com.tr'"

CHECKS["op13_url_filter"] = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), q AS (
  SELECT *, regexp_extract(host, '(?s)^(?:.*@)?(.*?)\.?(?::[0-9]*)?$', 1) AS name, try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) AS key FROM p
), r AS (
  SELECT *, string_split(name, '.') AS a, regexp_matches(name, '^([0-9.]+|\[.*)$') AS ip FROM q
), u AS (
  SELECT *, array_to_string(a[-2:], '.') IN ({_TWO}) AS two FROM r
), v AS (
  SELECT page_id, host, path, name, key, CASE WHEN ip THEN name WHEN two THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain,
    CASE WHEN ip THEN 'ip' WHEN two THEN array_to_string(a[-2:], '.') ELSE a[-1] END AS suffix FROM u
), l AS (
  SELECT doc_id AS key, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), h AS (
  SELECT name, domain, suffix, count(l.bad) AS n, count(*) FILTER (l.bad) AS bad FROM v LEFT JOIN l USING (key) GROUP BY ALL
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM h) AS m FROM h GROUP BY suffix
), s2 AS (
  SELECT suffix, (bad + k * m) / (n + k) AS m FROM s, (SELECT 1 / rho - 1 AS k FROM (SELECT {_MOMENTS} AS rho FROM s WHERE n > 0))
), d AS (
  SELECT domain, suffix, n, bad, m FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL) JOIN s2 USING (suffix)
), d2 AS (
  SELECT domain, suffix, (bad + k * m) / (n + k) AS m FROM d, (SELECT 1 / rho - 1 AS k FROM (SELECT {_MOMENTS} AS rho FROM d WHERE n > 0))
), e AS (
  SELECT name, n, bad, m FROM h JOIN d2 USING (domain, suffix)
), e2 AS (
  SELECT name, n, bad, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM e, (SELECT 1 / rho - 1 AS k FROM (SELECT {_MOMENTS} AS rho FROM e WHERE n > 0))
), z AS (
  SELECT name, n, bad, greatest(0.0, a / (a + b) - 1.6448536269514722 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low FROM e2
), f AS (
  SELECT v.*, z.n, z.bad, z.low, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM v JOIN z USING (name)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS n_outcomes, bad::BIGINT AS n_bad, round(low, 6) AS bad_low
FROM f
"""
