"""DuckDB SQL for the registered queries that SQL can express."""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n'))
      + length(replace(replace(text, '\', '\b'), '<', '\l')) + 13 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS turns
  FROM rows
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = turns) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""


def _base32_sha1(payload: str) -> str:
    letters = [
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1({payload}), {start}, 5) AS BIGINT)"
        f" >> {shift}) & 31)::BIGINT, 1)"
        for start in range(1, 41, 5)
        for shift in (15, 10, 5, 0)
    ]
    return " || ".join(letters)


OP9 = f"""
WITH heads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    {_base32_sha1("coalesce(html, '')")} AS payload_digest,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM heads
"""


OP10 = """
WITH rows AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), every AS (
  SELECT doc_id, text, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM rows
), occurrences AS (
  SELECT * FROM every WHERE length(line) >= 40
), lines AS (
  SELECT line, length(line) AS n, min({doc_id: doc_id, pos: pos}) AS first FROM occurrences GROUP BY line
), halves AS (
  SELECT line, n, first, 0 AS half, n AS own, left(line, n // 2) AS part FROM lines
  UNION ALL SELECT line, n, first, 1, n, substr(line, n // 2 + 1) FROM lines
  UNION ALL SELECT line, n, first, 0, n - 1, left(line, (n - 1) // 2) FROM lines
  UNION ALL SELECT line, n, first, 1, n - 1, substr(line, (n - 1) // 2 + 2) FROM lines
), near AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.first AS a_first, b.first AS b_first
  FROM halves a JOIN halves b ON a.half = b.half AND a.own = b.own AND a.part = b.part AND a.line <> b.line
  WHERE b.own = b.n AND levenshtein(a.line, b.line) <= 1
), gone AS (
  SELECT a AS line FROM near WHERE b_first < a_first UNION SELECT b FROM near WHERE a_first < b_first
), judged AS (
  SELECT e.doc_id, e.text, e.line, e.pos,
    length(e.line) < 40 OR (l.first = {doc_id: e.doc_id, pos: e.pos} AND g.line IS NULL) AS kept
  FROM every e LEFT JOIN lines l ON e.line = l.line LEFT JOIN gone g ON e.line = g.line
), rebuilt AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (NOT kept) AS dropped_lines,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '') AS reduced
  FROM judged GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(dropped_lines, 0) AS dropped_lines, r.reduced AS text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id AND d.text = r.text
"""


OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counts WHERE f >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM frequent WHERE m >= 2
), inner_parts AS (
  SELECT DISTINCT lang, f, unnest(list_concat(
    [array_to_string(ws[:len(ws) - 1], ' ')], [array_to_string(ws[2:], ' ')])) AS phrase
  FROM candidates
), kept AS (
  SELECT c.* FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, f, ws, m, unnest(range(1, m)) AS k FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, a.f AS l, b.f AS r, CAST(n AS BIGINT) AS n, k,
    CAST((1000 * CAST(c.f AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(a.f AS HUGEINT) * CAST(b.f AS HUGEINT)) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN frequent a ON a.lang = c.lang AND a.phrase = array_to_string(ws[:k], ' ')
  JOIN frequent b ON b.lang = c.lang AND b.phrase = array_to_string(ws[k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
  phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


OP13 = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s
  ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2, "op9_warc_revisit": OP9, "op10_line_dedup": OP10, "op11_collocations": OP11, "op13_hard_negatives": OP13}
