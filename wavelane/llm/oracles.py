"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Every string of 100 bytes, as hex; those that start earlier elsewhere; and the bytes that such strings cover.
OP4 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * 227) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 128)) AS b FROM d WHERE len(h) >= 200)),
w AS (SELECT doc_id, b + p AS p, substr(piece, 2 * p + 1, 200) AS x FROM (SELECT doc_id, b, piece, unnest(range(0, least(128, len(piece) // 2 - 99))) AS p FROM q)),
f AS (SELECT x, min(doc_id * 16777216 + p) AS first FROM w GROUP BY x HAVING count(*) > 1),
s AS (SELECT doc_id, p FROM w JOIN f ON w.x = f.x WHERE doc_id * 16777216 + p > first),
i AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s),
g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM i),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, k),
n AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS from_end FROM r),
t AS (SELECT n.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)) || CASE WHEN from_end = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept, sum(b - a) AS gone, count(*) AS spans FROM n JOIN d ON n.doc_id = d.doc_id GROUP BY n.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""

#: Shingle sets, pairs that share shingles, and the least document that links lead to.
OP10 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
f AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, len(s) AS n FROM e WHERE len(s) > 0 GROUP BY ALL),
x AS (SELECT doc_id, n, hash(unnest(s)) AS h FROM f),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
v AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS reach FROM v UNION SELECT c.doc_id, v.b FROM c JOIN v ON c.reach = v.a),
m AS (SELECT doc_id, min(reach) AS least FROM c GROUP BY doc_id),
k AS (SELECT f.s, coalesce(m.least, f.doc_id) AS least FROM f LEFT JOIN m ON f.doc_id = m.doc_id)
SELECT e.doc_id, CAST(len(e.s) AS BIGINT) AS n_shingles, CAST(coalesce(k.least, e.doc_id) AS BIGINT) AS component_id, e.doc_id = coalesce(k.least, e.doc_id) AS kept FROM e LEFT JOIN k ON list_sort(e.s) = k.s"""

#: Words with the white space after them, the first with what is before it too; sentences; spans and runs of 51 words by their words; and
#: the words that one covers which starts earlier elsewhere.
OP9 = r"""WITH u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS u, regexp_extract(text, '^[\x20\x09-\x0D]+') AS head FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(u))) AS k, unnest(u) AS unit, len(u) AS n, head FROM u),
c AS (SELECT doc_id, k, n, CASE WHEN k = 0 THEN head || unit ELSE unit END AS unit, regexp_extract(unit, '^[^\x20\x09-\x0D]+') AS word, regexp_matches(unit, '^[^\x20\x09-\x0D]*[.!?]([\x20\x09-\x0D]|$)') OR contains(unit, chr(10)) OR k = n - 1 AS closes FROM w),
d AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
b AS (SELECT doc_id, s, min(k) AS a FROM d GROUP BY doc_id, s UNION ALL SELECT doc_id, max(s) + 1, max(n) FROM d GROUP BY doc_id),
x AS (SELECT i.doc_id, i.a AS a, min(j.a) AS b FROM b i JOIN b j ON i.doc_id = j.doc_id AND j.s >= i.s + 2 AND j.a - i.a >= 12 GROUP BY i.doc_id, i.a UNION SELECT j.doc_id, max(i.a), j.a FROM b i JOIN b j ON i.doc_id = j.doc_id AND j.s >= i.s + 2 AND j.a - i.a >= 12 GROUP BY j.doc_id, j.a UNION SELECT doc_id, k, k + 51 FROM d WHERE k + 51 <= n),
l AS (SELECT doc_id, list(word ORDER BY k) AS words FROM d GROUP BY doc_id),
y AS (SELECT x.doc_id, a, b, array_to_string(words[a + 1 : b], ' ') AS content FROM x JOIN l ON x.doc_id = l.doc_id),
f AS (SELECT content, min(doc_id * 16777216 + a) AS first FROM y GROUP BY content HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS k FROM y JOIN f ON y.content = f.content WHERE doc_id * 16777216 + a > first),
h AS (SELECT doc_id, sum(CASE WHEN m = 2 THEN 1 ELSE 0 END) AS n_removed, sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) AS n_cut FROM (SELECT d.doc_id, d.s, CASE WHEN count(g.k) = count(*) THEN 2 WHEN count(g.k) > 0 THEN 1 ELSE 0 END AS m FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.k = g.k GROUP BY d.doc_id, d.s) GROUP BY doc_id),
r AS (SELECT d.doc_id, max(d.s) + 1 AS n_sentences, coalesce(string_agg(CASE WHEN g.k IS NULL THEN unit END, '' ORDER BY d.k), '') AS kept FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.k = g.k GROUP BY d.doc_id)
SELECT u.doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, coalesce(kept, text) AS text FROM u LEFT JOIN r ON u.doc_id = r.doc_id LEFT JOIN h ON u.doc_id = h.doc_id"""

#: crc32 by its shift register, a byte at a time, over the distinct runs of each document; words and counts; pairs at distance one by
#: their length; forms; and roots by following forms. DuckDB's distance counts bytes, so each letter above ASCII stands as one other byte there.
OP11 = r"""WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run HAVING length(run) >= 5),
t AS (SELECT list(list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) g(b)),
x AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM k),
c AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UBIGINT))), lambda a, b: xor(a >> 8, steps[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS crc FROM x, t),
v AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n) AS n, length(word) AS l, translate(word, '@LETTERS', '@BYTES') AS b FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM w a JOIN w b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.word <> b.word AND levenshtein(a.b, b.b) = 1),
o AS (SELECT *, count(*) OVER (PARTITION BY word) AS c, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT word, c, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM o WHERE k = 1),
z AS (SELECT word, word AS here, 0 AS depth FROM w UNION ALL SELECT z.word, f.form, depth + 1 FROM z JOIN f ON z.here = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(here, depth) AS root FROM z GROUP BY word)
SELECT w.word, f.form, e.root, CAST(w.n AS BIGINT) AS n, CAST(coalesce(f.c, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM w JOIN e ON w.word = e.word LEFT JOIN f ON w.word = f.word"""
OP11 = OP11.replace("@LETTERS", "".join(map(chr, range(0xC0, 0x100)))).replace("@BYTES", "".join(chr(c) for c in range(0x21, 0x60) if c not in (0x27, 0x5C)) + "{|}")

#: The filters applied one after the other, in all orders, to every document.
OP13 = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > least] AS fails FROM w),
d AS (SELECT m.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM m LEFT JOIN labels ON m.doc_id = labels.doc_id),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT g.*, o, step, o[step] AS f, fails[o[step]] AS failing, len(list_filter(o[1 : step - 1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS n_fails FROM g, s),
r AS (SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

ORACLES = {"op4_suffix_levels": OP4, "op9_sentence_spans": OP9, "op10_near_dup": OP10, "op11_spelling_variants": OP11, "op13_filter_audit": OP13}
