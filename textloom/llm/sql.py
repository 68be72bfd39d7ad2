"""DuckDB SQL for the operators that SQL can express."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, role || '">' || replace(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g'), '"', '\q') || '<' AS formatted,
  length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>"]', '', 'g')) + 22 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments,
  sum(ceil((n - 22 - length(role) - length(regexp_replace(role, '[^\\<>"]', '', 'g'))) / 4.0))::BIGINT AS expanded_tokens
FROM f GROUP BY conv_id
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d JOIN sizes ON len(w) >= n),
hits AS (
  SELECT doc_id, i, dg.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dg JOIN bw ON bw.g = dg.g AND bw.n = dg.n),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
h AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 5 * n_letter_words < 4 * n_words OR 2 * n_capitals > n_letters) AS kept
FROM b
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{WORDS}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
q AS (SELECT item_id, term, count(*) AS often FROM i GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, docs),
x AS (
  SELECT item_id, r, doc_id, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN v USING (term), s GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""

OP13 = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, b: xor(c // 2, 3988292384 * (c % 2)))) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (
  SELECT src.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind FROM src, bits),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last_char, role[1] AS initial FROM dam),
f AS (
  SELECT conv_id, i, turn, role, text, initial, CASE WHEN last_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM num),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
ins(p, q, w, l) AS (
  SELECT * FROM (VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 3, 'I'), ('s', 'u', 3, 'I'), ('u', 'a', 3, 'I'), ('a', 'u', 3, 'I'), ('', 'a', 6, 'II'), ('s', 'a', 6, 'II'))),
walk AS (
  SELECT c.conv_id, 0::BIGINT AS i, q AS st, w::BIGINT AS cost, l AS audit, '' AS out FROM c, ins WHERE p = ''
  UNION ALL
  (SELECT conv_id, i, st, best.cost, best.audit, best.out FROM (
    SELECT w.conv_id, f.i, ins.q AS st, min({'cost': w.cost + e.cost + ins.w, 'audit': w.audit || e.l || ins.l, 'out': w.out || e.out || (CASE ins.l WHEN '' THEN '' WHEN 'I' THEN chr(10) || (CASE ins.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END) ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END)}) AS best
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1,
    LATERAL (SELECT unnest([
      {'ok': true, 'st': w.st, 'cost': 4, 'l': 'D', 'out': ''},
      {'ok': f.fault NOT IN ('blank', 'duplicate') AND w.st || f.initial IN ('s', 'u', 'su', 'au', 'ua'), 'st': f.initial, 'cost': CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'l': 'K', 'out': chr(10) || f.role || ':' || f.text},
      {'ok': f.fault NOT IN ('blank', 'duplicate'), 'st': CASE w.st WHEN 'u' THEN 'a' ELSE 'u' END, 'cost': 3 + CASE f.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'l': 'R', 'out': chr(10) || (CASE w.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END) || f.text}]) AS e),
    ins WHERE e.ok AND ins.p = e.st GROUP BY w.conv_id, f.i, ins.q) z)),
done AS (SELECT w.conv_id, min({'cost': w.cost, 'audit': w.audit, 'out': w.out}) AS best FROM walk w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE w.st IN ('', 'a') GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.out[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES = {"op4_chat_formatting": OP4, "op6_minhash_near_dedup": OP6, "op9_benchmark_decontamination": OP9, "op11_quality_rules": OP11, "op12_lexical_search": OP12, "op13_conversation_repair": OP13}
