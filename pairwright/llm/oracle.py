"""SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: Documents are linked when their sets of word 5-grams (all words, if fewer) have a Jaccard similarity of 0.8 or more.
ORACLE["op4_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n <= b.n / 0.8 AND b.n <= a.n / 0.8
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n.n, 0)::BIGINT AS n_links, c.doc_id = c.class_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

#: Every word inside an occurrence of ten consecutive words of an item (or of a whole shorter item).
ORACLE["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS x
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
v AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN k WHERE len(w) >= k),
h AS (SELECT v.doc_id, v.s, v.k, p.item_id FROM v JOIN p ON p.k = v.k AND p.x = array_to_string(v.w[v.s:v.s + v.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM (SELECT doc_id, s, unnest(range(0, k)) AS o FROM (SELECT DISTINCT doc_id, s, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: Cosines of all pairs in double precision.
ORACLE["op1_lattice_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: Digests of the turns and of the assistant's texts; lengths from the template.
ORACLE["op3_chat_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, 24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
      + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS n FROM t),
o AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM f
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = m))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""

#: Nodes are the distinct beginnings of the rebuilt conversations; crc32 of the decimal ids is computed bit by bit.
ORACLE["op11_prefix_trie"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, i, c) AS (SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM t
  UNION ALL SELECT conv_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
ids AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = 8 * length(s)),
r AS (SELECT conv_id, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d
  FROM (SELECT i.conv_id, 0 AS own, p, k, w FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 20 AND p <= h
        UNION ALL SELECT i.conv_id, 1, p, k, w FROM ids i JOIN t ON t.conv_id = i.conv_id AND p > h)),
x AS (SELECT conv_id, d, w, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
n AS (SELECT path, d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n FROM x GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS c FROM n WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(c, 0) AS c FROM n LEFT JOIN kids USING (path)),
sums AS (SELECT left(path, 32 * j) AS path, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM own) GROUP BY 1),
last AS (SELECT conv_id, max(d) AS d, arg_max(path, d) AS path FROM x GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS e FROM last GROUP BY path)
SELECT o.conv_id, o.d::BIGINT AS depth, up.conv_id AS parent_conv_id, o.n::BIGINT AS n_convs, o.c::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM own o JOIN sums s USING (path) LEFT JOIN ends USING (path) LEFT JOIN n up ON o.d > 0 AND up.path = left(o.path, 32 * (o.d - 1))"""

#: Phrases of 1 to 5 words per language, the lowest-scoring cut of each, and the first 2,000 of a language; products as 128-bit integers.
ORACLE["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, unnest([array_to_string(v[1:k - 1], ' '), array_to_string(v[2:k], ' ')]) AS phrase, a FROM (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 2)),
longest AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY lang, phrase),
c AS (SELECT f.*, string_split(phrase, ' ') AS v FROM f LEFT JOIN longest USING (lang, phrase) WHERE k > 1 AND (longest IS NULL OR 100 * longest < 100 * a)),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(v[1:cut], ' ') AS x, array_to_string(v[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
