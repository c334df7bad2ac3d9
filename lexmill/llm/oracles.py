"""DuckDB SQL with the results of the queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]"

#: Brute force over all pairs, and components by a recursive walk.
OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, range(0, 5) t(k) WHERE n > 1 GROUP BY doc_id),
u AS (SELECT doc_id, source, text, unnest(lines) AS line FROM w),
z AS (SELECT doc_id, source, text, array_to_string(list_filter(string_split_regex(lower(line), '{_SPACE}+'), lambda x: x <> ''), ' ') AS line FROM u),
s AS (SELECT *, len(line) - len(replace(line, ' ', '')) + 1 AS words FROM z),
f AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM s GROUP BY source, line HAVING count(DISTINCT doc_id) >= 20),
t AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
o AS (SELECT f.source, f.line FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE f.n > 0.01 * t.docs),
x AS (SELECT s.doc_id, sum(s.words) AS removed FROM s JOIN o ON s.source IS NOT DISTINCT FROM o.source AND s.line = o.line GROUP BY s.doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, len(regexp_replace(text, '{_SPACE}+', '', 'g')) AS word_chars,
      len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(x.removed, 0)::BIGINT AS removed_words FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.2 * n_words AS kept FROM m
"""

#: The digests straight from the turns. The length of the windows without building them: from prefix sums the last turn
#: that a window begun at each turn would hold, and a recursive walk from window to window.
OP7 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, coalesce(conv_id::VARCHAR, 'none') AS k, row_number() OVER w AS nth, 4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens,
  len(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|</?ROLE>>|/?INST\])', '\1\\\2\3', 'g')) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 20 + len(hex(role)) END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
y AS (SELECT k, min(nth) AS y_nth, arg_min(tokens, nth) AS y_tokens, arg_min(chars, nth) AS y_chars FROM n WHERE role = 'system' GROUP BY k),
s AS (SELECT n.*, (nth - 1) // 4096 AS part, sum(tokens) OVER o AS upto, sum(chars) OVER o AS chars_upto, CASE WHEN y_nth < nth THEN y_tokens ELSE 0 END AS y_cost, CASE WHEN y_nth < nth THEN y_chars ELSE 0 END AS y_len,
  lag(CASE role WHEN 'system' THEN 0 ELSE tokens END, 1) OVER o AS h1, lag(CASE role WHEN 'system' THEN 0 ELSE tokens END, 2) OVER o AS h2,
  lag(CASE role WHEN 'system' THEN 0 ELSE chars END, 1) OVER o AS c1, lag(CASE role WHEN 'system' THEN 0 ELSE chars END, 2) OVER o AS c2
  FROM n LEFT JOIN y USING (k) WINDOW o AS (PARTITION BY n.k ORDER BY nth)),
b AS (SELECT *, CASE WHEN h1 IS NULL OR y_cost + tokens + h1 > 1024 THEN 0 WHEN h2 IS NULL OR y_cost + tokens + h1 + h2 > 1024 THEN 1 ELSE 2 END AS repeats FROM s),
e AS (SELECT *, upto - tokens + 1024 - y_cost - CASE WHEN repeats > 0 THEN h1 ELSE 0 END - CASE WHEN repeats > 1 THEN h2 ELSE 0 END AS reach FROM b),
z AS (SELECT e.k, e.nth, e.part, any_value(e.y_len + CASE WHEN e.repeats > 0 THEN e.c1 ELSE 0 END + CASE WHEN e.repeats > 1 THEN e.c2 ELSE 0 END) AS more, max(j.nth) AS last
  FROM e JOIN s j ON j.k = e.k AND j.part = e.part AND j.nth BETWEEN e.nth AND e.nth + 256 AND (j.nth = e.nth OR j.upto <= e.reach) GROUP BY e.k, e.nth, e.part),
win AS (SELECT k, part, nth, last, more FROM z WHERE nth = part * 4096 + 1 UNION ALL SELECT z.k, z.part, z.nth, z.last, z.more FROM win JOIN z ON z.k = win.k AND z.part = win.part AND z.nth = win.last + 1),
m AS (SELECT k, sum(more) AS more FROM win GROUP BY k),
a AS (SELECT k, any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM n GROUP BY k)
SELECT conv_id, n_turns, turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(a.chars + m.more AS BIGINT) AS formatted_chars FROM a JOIN m USING (k)
"""

OP9 = rf"""
WITH l AS (SELECT doc_id, text IS NULL AS is_null, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), ' ') AS norm FROM l),
k AS (SELECT doc_id, pos AS at_first, lead(pos) OVER w AS at_next, lead(pos, 2) OVER w AS at_last, norm AS one, norm || chr(10) || lead(norm) OVER w AS two, norm || chr(10) || lead(norm) OVER w || chr(10) || lead(norm, 2) OVER w AS three
  FROM n WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
win AS (SELECT doc_id, at_first, at_last, three AS h FROM k WHERE at_last IS NOT NULL
  UNION ALL SELECT doc_id, at_first, at_next, two FROM k WHERE at_next IS NOT NULL AND len(regexp_extract_all(two, '[^ \n]+')) > 50
  UNION ALL SELECT doc_id, at_first, at_first, one FROM k WHERE len(regexp_extract_all(one, '[^ ]+')) > 50),
f AS (SELECT *, first_value(doc_id) OVER o AS kept_doc, first_value(at_last) OVER o AS kept_last, row_number() OVER o AS nth FROM win WINDOW o AS (PARTITION BY h ORDER BY doc_id, at_first)),
c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = kept_doc THEN greatest(at_first, kept_last + 1) ELSE at_first END, at_last + 1)) AS pos FROM f WHERE nth > 1)
SELECT l.doc_id, CASE WHEN bool_or(l.is_null) THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') END AS text, count(*) AS n_lines, count(c.pos) AS n_removed
FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
"""

def _sized(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_sized, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


#: Level by level over whole groups; CRC-32 bit by bit from its polynomial, the last bit of which says who is tampered with.
OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other,
  list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))) & 1 AS odd FROM documents),
n AS (SELECT row_number() OVER () AS rid, doc_id, g, leaf, CASE WHEN odd = 1 AND doc_id IS NOT NULL THEN other ELSE leaf END AS held, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS total FROM d),
t AS (SELECT g, 0 AS lvl, i, total, leaf AS node FROM n UNION ALL SELECT g, lvl + 1, i // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE total > 1 GROUP BY g, lvl, i // 3, total),
s AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS total FROM t WHERE total = 1),
u AS (SELECT 0 AS lvl, i, total, subroot AS node FROM s UNION ALL SELECT lvl + 1, i // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE total > 1 GROUP BY lvl, i // 3, total),
p AS (SELECT n.rid, 0 AS part, t.lvl, t.i < n.i // (3 ** t.lvl)::BIGINT AS is_left, t.i, t.node FROM n JOIN t ON t.g = n.g AND t.total > 1 AND t.i // 3 = n.i // (3 ** (t.lvl + 1))::BIGINT AND t.i <> n.i // (3 ** t.lvl)::BIGINT
  UNION ALL SELECT n.rid, 1, u.lvl, u.i < s.i // (3 ** u.lvl)::BIGINT, u.i, u.node FROM n JOIN s USING (g) JOIN u ON u.total > 1 AND u.i // 3 = s.i // (3 ** (u.lvl + 1))::BIGINT AND u.i <> s.i // (3 ** u.lvl)::BIGINT),
h AS (SELECT n.rid, 0 AS part, t.lvl FROM n JOIN (SELECT DISTINCT g, lvl FROM t WHERE total > 1) t USING (g) UNION ALL SELECT n.rid, 1, u.lvl FROM n, (SELECT DISTINCT lvl FROM u WHERE total > 1) u),
w AS (SELECT h.rid, row_number() OVER (PARTITION BY h.rid ORDER BY h.part, h.lvl) AS k, coalesce(x.lefts, '') AS lefts, coalesce(x.rights, '') AS rights FROM h
  LEFT JOIN (SELECT rid, part, lvl, string_agg(node, '' ORDER BY i) FILTER (WHERE is_left) AS lefts, string_agg(node, '' ORDER BY i) FILTER (WHERE NOT is_left) AS rights FROM p GROUP BY rid, part, lvl) x USING (rid, part, lvl)),
f AS (SELECT rid, 1 AS k, held AS node FROM n UNION ALL SELECT f.rid, f.k + 1, sha256(w.lefts || f.node || w.rights) FROM f JOIN w USING (rid, k)),
q AS (SELECT rid, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof FROM w GROUP BY rid)
SELECT n.doc_id, n.leaf, s.subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.node AS folded_root, e.node = r.root AS verified
FROM (SELECT node AS root FROM u WHERE total = 1) r, n JOIN s USING (g) JOIN (SELECT rid, arg_max(node, k) AS node FROM f GROUP BY rid) e USING (rid) LEFT JOIN q USING (rid)
"""

ORACLES = {"op13_merkle_manifest": OP13, "op4_embedding_near_dedup": OP4, "op6_line_frequency_rules": OP6, "op7_chat_formatting": OP7, "op9_line_window_dedup": OP9}
