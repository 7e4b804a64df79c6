"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    16 + length(role) + length(text)
      + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM parts
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM sums GROUP BY conv_id
"""

OP6 = r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'allow'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM cut
"""

OP3 = r"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), found AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM grams
), repeated AS (
  SELECT id, count(DISTINCT i + k) AS n FROM found, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY id
), lines AS (
  SELECT id, unnest(string_split(t, chr(10))) AS line FROM w
), dups AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), m AS (
  SELECT w.id, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN repeated USING (id) LEFT JOIN dups USING (id)
), v AS (
  SELECT id, lang, source, n_words, unnest([
    {'metric': 'symbols', 'spread': 60, 'v': 1000 * n_symbols // greatest(n_words, 1)},
    {'metric': 'repeats', 'spread': 60, 'v': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'metric': 'dup_lines', 'spread': 60, 'v': 1000 * n_dup_lines // greatest(n_lines, 1)},
    {'metric': 'word_length', 'spread': 500, 'v': 1000 * word_chars // greatest(n_words, 1)}]) AS s FROM m
), b AS (
  SELECT lang, source, s.metric AS metric, s.spread AS spread, ((s.v >> greatest(length(bin(s.v)) - 8, 0)) << greatest(length(bin(s.v)) - 8, 0)) AS bin
  FROM v WHERE n_words > 0
), counts AS (
  SELECT lang, source, metric, bin, max(spread) AS spread, count(*) AS n FROM b GROUP BY lang, source, metric, bin
), merged AS (
  SELECT metric, bin, max(spread) AS spread, sum(n) AS n FROM counts GROUP BY metric, bin
), blend AS (
  SELECT lang, source, metric, bin, spread, n AS own, 0 AS every FROM counts
  UNION ALL SELECT g.lang, g.source, metric, bin, spread, 0, n FROM (SELECT DISTINCT lang, source, metric FROM counts) g JOIN merged USING (metric)
), cells AS (
  SELECT lang, source, metric, bin, max(spread) AS spread, sum(own) AS own, sum(every) AS every FROM blend GROUP BY lang, source, metric, bin
), placed AS (
  SELECT lang, source, metric, bin, spread, sum(own) OVER up AS own, sum(every) OVER up AS every, sum(own) OVER g AS n, sum(every) OVER g AS total
  FROM cells WINDOW up AS (PARTITION BY lang, source, metric ORDER BY bin), g AS (PARTITION BY lang, source, metric)
), cut AS (
  SELECT lang, source, metric, max(spread) AS spread, min(bin) FILTER (100 * (total * own + 20 * every) >= 25 * total * (n + 20)) AS low, min(bin) FILTER (100 * (total * own + 20 * every) >= 75 * total * (n + 20)) AS high
  FROM placed GROUP BY lang, source, metric
), fence AS (
  SELECT lang, source, metric, high + 6 * greatest(high - low, spread) AS fence FROM cut
), bad AS (
  SELECT DISTINCT v.id FROM v JOIN fence ON v.lang IS NOT DISTINCT FROM fence.lang AND v.source IS NOT DISTINCT FROM fence.source AND v.s.metric = fence.metric AND v.s.v > fence.fence
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.id IS NULL AS kept
FROM m LEFT JOIN bad USING (id)
"""

OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL
), qs AS (
  SELECT DISTINCT item_id, text, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM q WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM qs
), ds AS (
  SELECT DISTINCT id, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes)
), n AS (
  SELECT item_id, text, count(*) AS shingles FROM qs GROUP BY ALL
), hits AS (
  SELECT id, ds.doc_id, item_id, text, count(*) AS shared FROM ds JOIN qs USING (k, g) GROUP BY ALL
)
SELECT doc_id, hits.item_id, shared, shingles, shared / shingles AS containment FROM hits JOIN n ON hits.item_id IS NOT DISTINCT FROM n.item_id AND hits.text = n.text WHERE 10 * shared >= 8 * shingles
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), g AS (
  SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
"""


def _codes(rounds: int = 2) -> str:
    """The vector codes' SQL: a codebook, the nearest entries and the moved codebook for each round, then the last assignment."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS (
  SELECT r, p, any_value(x.a) AS a, any_value(x.b) AS b, any_value(x.c) AS c, any_value(x.d) AS d,
    min(64 * ((x.a - e.a) * (x.a - e.a) + (x.b - e.b) * (x.b - e.b) + (x.c - e.c) * (x.c - e.c) + (x.d - e.d) * (x.d - e.d)) + k) AS best
  FROM parts x JOIN book{i} e USING (p) GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS (
  SELECT p, k, coalesce(m.a, e.a) AS a, coalesce(m.b, e.b) AS b, coalesce(m.c, e.c) AS c, coalesce(m.d, e.d) AS d
  FROM book{i} e LEFT JOIN (
    SELECT p, best % 64 AS k, CAST(floor(sum(a) / count(*)) AS BIGINT) AS a, CAST(floor(sum(b) / count(*)) AS BIGINT) AS b,
      CAST(floor(sum(c) / count(*)) AS BIGINT) AS c, CAST(floor(sum(d) / count(*)) AS BIGINT) AS d
    FROM near{i} GROUP BY p, best % 64) m USING (p, k)
)""")
    return r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS x
  FROM embeddings WHERE len(embedding) > 0 AND len([v FOR v IN embedding IF v IS NULL OR isnan(v) OR isinf(v)]) = 0
), parts AS (
  SELECT r, p, x[4 * p + 1] AS a, x[4 * p + 2] AS b, x[4 * p + 3] AS c, x[4 * p + 4] AS d FROM (SELECT r, x, unnest(generate_series(0, 15)) AS p FROM kept)
), book0 AS (
  SELECT p, r AS k, a, b, c, d FROM parts WHERE r < 64
), """ + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(lpad(lower(hex(best % 64)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), books AS (
  SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


ORACLE = {"op1_chat_format": OP1, "op3_quality_rules": OP3, "op6_url_filter": OP6, "op10_decontaminate": OP10, "op11_exact_dedup": OP11, "op13_vector_codes": _codes()}
