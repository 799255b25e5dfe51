"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM s
), w AS (
  SELECT *, CAST([3, 1, 2][((pos - 1) % 3) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM r
), o AS (
  SELECT *, cap / weight AS lv, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w
), q AS (
  SELECT *, (budget - cap_before) / weight_left AS share FROM o
), c AS (
  SELECT *, share * weight >= cap AS clamped FROM q
), l AS (
  SELECT first(share ORDER BY lv, pos) AS level FROM c WHERE NOT clamped
), t AS (
  SELECT source, source_size, CASE WHEN clamped OR level IS NULL THEN cap ELSE least(level * weight, cap) END AS target
  FROM c LEFT JOIN l ON true
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(least(floor(rate * size + draw), size * 2) AS BIGINT) AS taken FROM x
"""

LINE_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), r AS (
  SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM r)
), h AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n >= 2
), p AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), u AS (
  SELECT rid, unnest(lines) AS line FROM r
), f AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(line, '[#*$%&|<>]')) + len(regexp_extract_all(line, '[!?]{2,}')) AS marks,
    len(regexp_extract_all(line, '\p{Lu}{2,}')) AS capitals, len(regexp_extract_all(line, '[|»›·>]')) AS separators
  FROM u
), v AS (
  SELECT rid, words, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, line,
    words > 0 AND (marks * 5 > words OR (words >= 5 AND capitals * 2 > words)
      OR (words < 3 AND NOT regexp_matches(line, '[.!?…:;,"''”’»)\]][ \t\r]*$')) OR separators * 4 > words
      OR regexp_matches(line, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|enable javascript|lorem ipsum|licensed under the|subscribe to our|click here|sign up for)')) AS fails
  FROM f
), a AS (
  SELECT rid, CAST(sum(chars) AS BIGINT) AS word_chars, CAST(sum(CASE WHEN fails THEN 0 ELSE chars END) AS BIGINT) AS kept_chars,
    count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines
  FROM v GROUP BY rid
), z AS (
  SELECT r.doc_id, CAST(len(w) AS BIGINT) AS n_words, a.word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(a.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, a.kept_chars
  FROM r JOIN a USING (rid) LEFT JOIN p USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * (word_chars - kept_chars) > 40 * word_chars) AS kept
FROM z
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""

CHAT_PARTS = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, 16 + length(regexp_replace(role, '[\\<>]', '__', 'g')) + length(regexp_replace(text, '[\\<>]', '__', 'g')) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def _codes(rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT x.vec_id, x.part, x.v, c.entry, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM x JOIN c{r} c USING (part)),
n{r} AS (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM d{r} GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(floor(total / n) ORDER BY pos) AS v FROM (
  SELECT part, entry, pos, sum(v[pos])::DOUBLE AS total, count(*) AS n FROM (SELECT n.part, n.entry, x.v, unnest(range(1, len(x.v) + 1)) AS pos FROM n{r} n JOIN x USING (vec_id, part)) GROUP BY ALL
) GROUP BY part, entry),
c{r + 1} AS (SELECT c.part, c.entry, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)
), c0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM x QUALIFY entry < 256
),""" + ",".join(steps) + f""",
e AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""


WORD_RUNS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w0, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM documents
), b AS (
  SELECT *, len(w0) AS n, h // 10 AS g FROM d
), c AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM b
), p AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c
), u AS (
  SELECT r, i, CASE WHEN a IS NULL OR i < a THEN w0[i + 1] ELSE w0[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)
), e AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.r = y.r AND x.word = y.word AND x.i < y.i
), s AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island
), f AS (
  SELECT r, start, length, min(q) AS q FROM s WHERE length >= 2 * q AND length >= 12 GROUP BY r, start, length
), best AS (
  SELECT r, count(*) AS n_runs, first(start ORDER BY length DESC, start, q) AS start, max(length) AS length, first(q ORDER BY length DESC, start, q) AS period,
    sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM f GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM f
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op1_warc": WARC, "op4_mixing": MIXING, "op6_line_rules": LINE_RULES, "op11_chat_parts": CHAT_PARTS, "op12_gnat_codes": _codes(), "op13_word_runs": WORD_RUNS}
