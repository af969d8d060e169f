"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import collocations, line_runs, spelling
from .quality_rules import Rules
from .sharding import MODULUS, PRIME, SMALL, round_keys
from .url_filters import OP9_SQL

RULES = Rules()
#: A word by the rules, as a regular expression.
RUN = r"[^\x20\x09-\x0D]+"

OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, host, unnest(regexp_extract_all(text, '{RUN}')) AS w, unnest(range(len(regexp_extract_all(text, '{RUN}')))) AS i FROM docs),
base AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
wins AS (SELECT rid, i, lead(i, 4) OVER s AS last, w || chr(1) || lead(w, 1) OVER s || chr(1) || lead(w, 2) OVER s || chr(1) || lead(w, 3) OVER s || chr(1) || lead(w, 4) OVER s AS win FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)),
often AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM wins WHERE last IS NOT NULL) WHERE n > 1),
reps AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS at FROM often, range(5) AS r(k)) GROUP BY rid),
print AS (SELECT rid, host, md5(array_to_string(regexp_extract_all(lower(text), '{RUN}'), ' ')) AS print FROM docs WHERE regexp_matches(text, '{RUN}')),
raw AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT *, regexp_extract_all(lower(line), '{RUN}') AS parts FROM raw WHERE regexp_matches(line, '{RUN}')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
norm AS (SELECT rid, host, array_to_string(parts, ' ') AS line, sum(len(parts)) AS n FROM lines GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT print) AS total FROM print GROUP BY host),
freq AS (SELECT n.host, n.line FROM norm n JOIN print USING (rid) JOIN hosts h ON h.host = n.host GROUP BY n.host, n.line, total
         HAVING count(DISTINCT print) > {RULES.min_docs} AND count(DISTINCT print) > least({RULES.max_share}::DOUBLE * total, {RULES.max_docs})),
gone AS (SELECT rid, sum(n) AS gone FROM norm JOIN freq USING (host, line) GROUP BY rid),
whole AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (coalesce(n_words, 0) - coalesce(gone, 0))::BIGINT AS words_left
  FROM docs LEFT JOIN base USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN reps USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat} * n_words AS base_failed,
       NOT (n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat} * n_words) AND words_left >= {RULES.min_words} AS kept
FROM whole
"""

OP2_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS s FROM docs, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS k FROM sets GROUP BY doc_id
          UNION ALL SELECT doc_id, 0, '' FROM docs WHERE len(words) = 0),
classes AS (SELECT k, min(doc_id) AS rep, count(*) AS weight, min(n) AS n FROM sizes GROUP BY k),
rsets AS (SELECT rep, s FROM sets JOIN classes ON rep = doc_id),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM rsets a JOIN rsets b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
linked AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM common JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
ends AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
roots AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
ranked AS (SELECT rep, class_id, row_number() OVER (PARTITION BY class_id ORDER BY rep) AS rn FROM roots),
earlier AS (SELECT b AS rep, list(a) AS before FROM linked GROUP BY b),
walk AS (
  SELECT class_id, rn, [rep] AS heads FROM ranked WHERE rn = 1
  UNION ALL SELECT w.class_id, r.rn, CASE WHEN list_has_any(w.heads, e.before) THEN w.heads ELSE list_append(w.heads, r.rep) END
  FROM walk w JOIN ranked r ON r.class_id = w.class_id AND r.rn = w.rn + 1 LEFT JOIN earlier e ON e.rep = r.rep),
heads AS (SELECT DISTINCT unnest(heads) AS head FROM walk),
first AS (SELECT b AS rep, min(a) AS rep_doc_id, arg_min(similarity, a) AS similarity FROM linked JOIN heads ON head = a WHERE b NOT IN (SELECT head FROM heads) GROUP BY b),
degrees AS (SELECT a AS rep, sum(weight)::BIGINT AS n_links FROM ends JOIN classes ON rep = b GROUP BY a),
found AS (SELECT s.doc_id, r.class_id, c.weight - 1 AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(f.rep_doc_id, rep) AS rep_doc_id, coalesce(f.similarity, 1) AS similarity
          FROM sizes s JOIN classes c USING (k) JOIN roots r USING (rep) LEFT JOIN first f USING (rep) LEFT JOIN degrees USING (rep))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, n_copies, n_links, rep_doc_id, similarity::DOUBLE AS similarity FROM found
UNION ALL SELECT doc_id, doc_id, 1, 0, 0, doc_id, 1 FROM documents WHERE text IS NULL
"""


def permuted(x: str) -> str:
    """One pass of the sharding operator's Feistel network over a column x, with the sides a and b in scope."""
    left, right = f"(({x}) % a)", f"(({x}) // a)"
    for i, (add, mul, mul2) in enumerate(round_keys(17)):
        of = left if i % 2 else right
        mixed = f"((((({of} % {PRIME} + {add}) * {mul}) % {PRIME}) * {mul2}) % {MODULUS} % {SMALL})"
        if i % 2:
            right = f"(({right} + {mixed}) % b)"
        else:
            left = f"(({left} + {mixed}) % a)"
    return f"({right} * a + {left})"


#: The CRC of bytes by its polynomial, one step a byte over a list of bytes.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"

OP8_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS id, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT id, {BIT}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY id) AS tab FROM bits WHERE k = 8),
docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM docs),
keyed AS (SELECT doc_id, (len(bytes) + 1)::BIGINT AS size, {CRC} AS text_crc32 FROM bytes, crc),
sides AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*)::BIGINT AS n, (floor(sqrt((count(*) - 1)::DOUBLE)) + 1)::BIGINT AS a FROM documents)),
walk AS (
  SELECT rid, {permuted('rid')} AS p FROM (SELECT row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS rid FROM keyed), sides
  UNION ALL SELECT rid, {permuted('p')} FROM walk, sides WHERE p >= n)
SELECT k.doc_id, k.size, k.text_crc32, 'rows' AS law, (p % 16)::INTEGER AS shard, (p // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM (SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS rid FROM keyed) k JOIN walk USING (rid), sides WHERE p < n
"""

LOWERED = f"translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}')"
PHRASES = collocations.Rules()

OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, list_slice(w, i, i + k - 1) AS g FROM words, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 6)) AS u(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
tot AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE len(g) > 1 AND f >= {PHRASES.least}),
cut AS (SELECT lang, g, f AS a, k, list_slice(g, 1, k) AS g1, list_slice(g, k + 1, len(g)) AS g2 FROM cand, unnest(range(1, len(g))) AS t(k)),
cuts AS (SELECT cut.*, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.g = g1 JOIN f y ON y.lang = cut.lang AND y.g = g2 JOIN tot ON tot.lang = cut.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
parts AS (SELECT lang, list_slice(g, i, i + k - 1) AS g, max(f) AS longer FROM cand, unnest(range(1, len(g) + 1)) AS t(i), unnest(range(2, len(g))) AS u(k) WHERE i + k - 1 <= len(g) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN parts USING (lang, g) WHERE longer IS NULL OR longer < a QUALIFY rank <= {PHRASES.top}
"""

OP12_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS id, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT id, {BIT}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY id) AS tab FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOWERED}, '{spelling.RUN}')) AS run FROM documents),
once AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
coded AS (SELECT *, list_transform(range(octet_length(encode(id || ':' || run))), lambda i: ('0x' || hex(encode(id || ':' || run))[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM once),
hashed AS (SELECT run, times, {CRC} AS h FROM coded, crc),
words AS (SELECT CASE WHEN h % {spelling.SLIPS} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= {spelling.LEAST_LENGTH} AND n >= {spelling.LEAST_TIMES}),
dels AS (SELECT word, n, length(word) AS len, i, left(word, i) || substr(word, i + 2) AS d FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.len = b.len AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM dels a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM dels a JOIN words b ON a.d = b.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM pairs GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.FACTOR} * n THEN best END AS form, CASE WHEN best_n >= {spelling.FACTOR} * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS root, 1 AS k FROM found WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM found LEFT JOIN ends USING (word)
"""

LINES = line_runs.Rules()
KEY = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{spelling.UPPER}', '{spelling.LOWER}')"

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT rid, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM docs),
keyed AS (SELECT *, {KEY} AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= {LINES.least_chars} GROUP BY key HAVING count(DISTINCT rid) >= {LINES.least_docs}),
kept AS (SELECT *, often.key IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM kept GROUP BY rid
"""

SQL = {"op2_ngram_jaccard": OP2_SQL, "op8_sharding": OP8_SQL, "op9_url_filters": OP9_SQL, "op10_quality_rules": OP10_SQL, "op11_collocations": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_line_dedup": OP13_SQL}
