"""SQL for the queries that SQL can express, written apart from the DataFrame code."""

from __future__ import annotations

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS shown,
    regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS body FROM conversations
), people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns),
rendered AS (
  SELECT t.conv_id, p.perspective, t.turn, t.role, t.text, t.body, t.role = p.perspective AS mine,
    CASE WHEN t.role = p.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || t.shown || '|>' || chr(10) END AS frame
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), whole AS (SELECT *, frame || body || '<|end|>' || chr(10) AS segment FROM rendered),
placed AS (
  SELECT *, length(segment)::BIGINT AS length,
    (sum(length(segment)) OVER w - length(segment))::BIGINT AS start, row_number() OVER w - 1 AS position
  FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn ASC NULLS FIRST, md5(role || ':' || text) ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, turn, position, segment, start, length,
  start + CASE WHEN mine THEN length(frame) ELSE 0 END AS mask_start,
  CASE WHEN mine THEN length - length(frame) ELSE 0 END AS mask_length
FROM placed
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS walk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS kind FROM sized GROUP BY source
), weighed AS (
  SELECT *, list_value(5, 2, 1)[(kind % 3 + 1)::INT] AS weight, source_size * 3 AS full_size FROM sources
), levels AS (
  SELECT *, full_size::DOUBLE / weight AS reach,
    (sum(source_size) OVER () - sum(full_size) OVER below + full_size)::DOUBLE / sum(weight) OVER above AS level
  FROM weighed
  WINDOW below AS (ORDER BY full_size::DOUBLE / weight, kind ROWS UNBOUNDED PRECEDING),
    above AS (ORDER BY full_size::DOUBLE / weight, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT *, CASE WHEN reach < level THEN full_size::DOUBLE
    ELSE weight * (SELECT level FROM levels WHERE reach >= level ORDER BY reach, kind LIMIT 1) END AS target
  FROM levels
), placed AS (
  SELECT d.*, t.source_size, t.kind, t.target, floor(t.target + 0.5)::BIGINT AS demand,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.walk, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
    ELSE (demand // source_size) * size + greatest(0, least(size, demand % source_size - start)) END::BIGINT AS taken
  FROM placed
), shared AS (SELECT *, CASE WHEN taken > 0 THEN start::DOUBLE / demand END AS share FROM taken)
-- the times by which weights of 0.5 + t, 1 and 1.5 - t have demanded a share of the whole
SELECT doc_id, size, source_size, target, taken,
  round(CASE kind % 3 WHEN 0 THEN sqrt(0.25::DOUBLE + 2 * share) - 0.5 WHEN 1 THEN share ELSE 1.5 - sqrt(2.25::DOUBLE - 2 * share) END, 6) AS position
FROM shared
"""


#: Kind, pattern, the group whose length counts, and its least length, as the contract states them.
_KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def _spans(kind: int) -> str:
    _, pattern, group, least = _KINDS[kind]
    return f"""
  SELECT doc_id, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    start := list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    size := length(m[i]), counted := length(c[i])))) AS s, {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS c,
    string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE regexp_matches(text, '{pattern}'))"""


_NAMES = [k for k, *_ in _KINDS]
SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_spans(k) for k in range(len(_KINDS)))}),
kept AS (
  SELECT doc_id, kind, s.start::BIGINT AS start, (s.start + s.size)::BIGINT AS stop, list_value({", ".join(f"'{k}'" for k in _NAMES)})[kind + 1] AS name
  FROM found WHERE s.counted >= least
), listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(_NAMES))},
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _NAMES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*)::BIGINT AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS one, array_to_string(w[c + 1:k], ' ') AS two
  FROM candidates, (VALUES (1), (2)) AS t(c) WHERE c < k
), valued AS (
  SELECT cuts.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = one AND l.k = c
    JOIN f r ON r.lang = cuts.lang AND r.phrase = two AND r.k = cuts.k - c
), best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
held AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE k = 3)
  GROUP BY ALL
), kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.part WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank::BIGINT AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON k.lang = t.lang WHERE k.rank <= 2000
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL = f"""
WITH lists AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, row, len(terms) AS n, terms FROM lists WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total t GROUP BY term, t.docs
), lengths AS (SELECT row, doc_id, 75 + (25 * n * t.docs) // t.terms AS m FROM docs, total t),
scored AS (
  SELECT a.item_id, l.row, any_value(l.doc_id) AS doc_id, sum(a.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * l.m)))::BIGINT AS score
  FROM asked a JOIN tf ON a.term = tf.term JOIN weighed w ON w.term = tf.term JOIN lengths l ON l.row = tf.row GROUP BY a.item_id, l.row
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
