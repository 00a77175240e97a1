"""SQL twins of the corpus queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = rf"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS phrase, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (
  SELECT row, i, size, w[i:i + size - 1] AS phrase
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT row, i, windows.size, item_id FROM windows JOIN phrases USING (phrase)),
hit_words AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row),
hit_items AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY row),
marked AS (SELECT DISTINCT row, unnest(range(i, i + size)) AS p FROM hits),
runs AS (
  SELECT row, min(p) - 1 AS a, max(p) AS b
  FROM (SELECT row, p, p - row_number() OVER (PARTITION BY row ORDER BY p) AS g FROM marked)
  GROUP BY row, g),
spans AS (SELECT row, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM doc_words LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row) LEFT JOIN spans USING (row)
"""

_RULES = {
    "symbols_to_words": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
}

_QUALITY = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT row, i, w[i:i + 2] AS x FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) > 2)),
again AS (SELECT row, x FROM windows GROUP BY row, x HAVING count(*) > 1),
repeated AS (
  SELECT row, count(DISTINCT p) AS n FROM (
    SELECT row, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN again USING (row, x)) GROUP BY row),
lined AS (
  SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM texts JOIN lined USING (row) LEFT JOIN repeated USING (row)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
grid AS (SELECT unnest([10, 20, 50, 100, 150, 200, 250, 300, 400, 500, 650, 800, 1000, 1500, 2000]) AS cutoff),
good AS (
  SELECT * FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counted AS ({" UNION ALL ".join(
    f"SELECT lang, '{rule}' AS rule, cutoff, count(*) AS n, "
    f"count(*) FILTER (1000 * {count} > cutoff * {per}) AS k FROM good, grid GROUP BY lang, cutoff"
    for rule, (count, per) in _RULES.items())}),
tested AS (
  SELECT lang, rule, cutoff, k < n * 0.01 / 3 AND list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
        - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.01 / 3) + (n - i) * ln(1 - 0.01 / 3))))
    <= 0.05 / ((SELECT count(*) FROM counted) / 15) AS safe
  FROM counted),
chosen AS (
  SELECT lang, {", ".join(f"min(cutoff) FILTER (safe AND rule = '{r}') AS {r}" for r in _RULES)}
  FROM tested GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND NOT ({" OR ".join(
    f"coalesce(1000 * {count} > {per} * chosen.{rule}, false)" for rule, (count, per) in _RULES.items())}) AS kept
FROM based LEFT JOIN chosen ON based.lang IS NOT DISTINCT FROM chosen.lang
"""

_LINES = r"""
WITH lines AS (
  SELECT row, doc_id, source, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_
  FROM (SELECT row, doc_id, source, unnest(range(len(l))) AS pos, unnest(l) AS line
    FROM (SELECT row_number() OVER () AS row, doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
spread AS (
  SELECT line FROM lines WHERE full_ GROUP BY line HAVING count(DISTINCT source) >= 5),
first_ AS (
  SELECT line, doc_id AS f_id, pos AS f_pos FROM lines SEMI JOIN spread USING (line)
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) = 1),
judged AS (
  SELECT row, doc_id, pos, lines.line, full_,
    f_pos IS NOT NULL AND NOT (doc_id IS NOT DISTINCT FROM f_id AND pos = f_pos) AS gone
  FROM lines LEFT JOIN first_ ON full_ AND lines.line = first_.line),
cleaned AS (
  SELECT row, count(*) FILTER (full_) AS n, count(*) FILTER (gone) AS g,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t
  FROM judged GROUP BY row)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS text_sha256
FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN cleaned USING (row)
"""

_SECRET_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)

_SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(
    f"SELECT row, {n} AS o, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{pattern}') AS p, "
    f"regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS c FROM texts"
    for n, (kind, pattern, group, least) in enumerate(_SECRET_RULES))}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces WHERE len(m) > 0),
spans AS (
  SELECT row, o, kind,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
    length(m[i]) AS size
  FROM each WHERE length(c[i]) >= least),
listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, o) FILTER (o < 3) AS base,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, o) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""

_WARC = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_ FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM first_ THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_ THEN first_ END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

_DIVERGENCE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
tokens AS (SELECT row, lang, source, unnest(w) AS term FROM texts),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counted AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
totals AS (
  SELECT lang, source, v + coalesce(t, 0) AS total
  FROM groups JOIN sizes USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS t FROM counted GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // total AS p
  FROM totals JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // any_value(total) AS q
  FROM counted JOIN (
    SELECT lang, v + sum(n) AS total FROM counted JOIN sizes USING (lang) GROUP BY lang, v) USING (lang)
  GROUP BY lang, term),
pairs AS (
  SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source),
found AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups AS a JOIN groups AS b USING (lang)
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT
  FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

_VECTOR_ROUNDS = 6


def _vector_round(n: int) -> str:
    """Parts to their nearest entries of codebook n, and the codebook after that."""
    return f"""
near_{n} AS MATERIALIZED (
  SELECT row, p, any_value(x) AS x, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT row, p, x, k, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut JOIN book_{n} USING (p))
  GROUP BY row, p),
book_{n + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(m, e) AS e
  FROM book_{n} LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
    FROM (SELECT p, k, i, sum(x[i]) AS s, count(*) AS n FROM near_{n}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, k, i)
    GROUP BY p, k) USING (p, k))"""


_VECTORS = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM vectors, unnest(range(8)) AS u(p)),
book_0 AS MATERIALIZED (SELECT p, row - 1 AS k, x AS e FROM cut WHERE row <= 16),
{",".join(_vector_round(n) for n in range(_VECTOR_ROUNDS + 1))},
coded AS (
  SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near_{_VECTOR_ROUNDS} GROUP BY row),
labelled AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN vectors USING (row) GROUP BY label),
digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book_{_VECTOR_ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN vectors USING (row) JOIN labelled ON vectors.label IS NOT DISTINCT FROM labelled.label, digest
"""

_SQL = {
    "op1_decontamination": _DECONTAMINATION,
    "op10_warc": _WARC,
    "op12_vector_codes": _VECTORS,
    "op13_divergence": _DIVERGENCE,
    "op2_secret_scan": _SECRETS,
    "op4_line_dedup": _LINES,
    "op6_quality_rules": _QUALITY,
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
