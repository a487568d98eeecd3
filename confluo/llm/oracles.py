"""DuckDB SQL for the queries that SQL can express; each states the contract by brute force."""

from __future__ import annotations

from .decontaminate import COVERAGE, LEAST_WORDS, LONG_MATCH, MASKS, SURE_WORDS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WARC = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     known AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM rows),
     tops AS (SELECT payload_digest, max(page_id) AS top FROM known WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM known LEFT JOIN tops USING (payload_digest)
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, chr(1))]
        ELSE [array_to_string(ws[i : i + 3], chr(1)) FOR i IN range(1, len(ws) - 2)] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents JOIN component ON id = doc_id LEFT JOIN n USING (doc_id)
"""

REPEATS = """
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, octet_length(h) - 99)) AS p FROM h),
m AS (SELECT doc_id, p, md5(h[p + 1 : p + 100]) AS m FROM p),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS r FROM m),
d AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS fresh FROM k WHERE r > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM d),
s AS (SELECT doc_id, island, min(p) AS b, max(p) + 100 AS e FROM i GROUP BY 1, 2),
c AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM s),
a AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last,
      string_agg(CASE WHEN b > before THEN hex(h[before + 1 : b]) ELSE '' END, '' ORDER BY b) AS kept FROM c JOIN h USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN h ELSE unhex(kept || CASE WHEN last < octet_length(h) THEN hex(h[last + 1 : octet_length(h)]) ELSE '' END) END) AS kept_sha256
FROM h LEFT JOIN a USING (doc_id)
"""


def _seeds(key: str, words: str) -> str:
    parts = []
    for number, mask in enumerate(MASKS):
        picked = " || ' ' || ".join(f"ws[i + {j + 1}]" for j, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, i AS pos, '{number} ' || {picked} AS seed FROM (SELECT *, unnest(range(0, len(ws) - {len(mask) - 1})) AS i FROM {words})")
    return " UNION ALL ".join(parts)


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

LEAKS = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL AND len({_WORDS}) >= {LEAST_WORDS}),
ds AS ({_seeds("doc_id", "d")}), bs AS ({_seeds("item_id", "b")}),
diagonals AS (SELECT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs ON ds.seed = bs.seed JOIN b USING (item_id) GROUP BY ALL HAVING count(*) >= max(CASE WHEN len(b.ws) >= {SURE_WORDS} THEN 2 ELSE 1 END)),
pairs AS (SELECT doc_id, item_id, shift, len(b.ws) AS item_words, d.ws AS dw, b.ws AS bw, unnest(range(0, len(b.ws))) AS i FROM diagonals JOIN d USING (doc_id) JOIN b USING (item_id)),
same AS (SELECT * FROM pairs WHERE i + shift >= 0 AND i + shift < len(dw) AND dw[i + shift + 1] = bw[i + 1]),
found AS (SELECT doc_id, item_id, item_words, count(DISTINCT i) AS matched, min(i + shift) AS first_word FROM same GROUP BY 1, 2, 3)
SELECT doc_id, item_id, matched, CAST(item_words AS BIGINT) AS item_words, CAST(first_word AS BIGINT) AS first_word, round(matched / item_words, 6) AS covered
FROM found WHERE matched >= {COVERAGE} * item_words OR matched >= {LONG_MATCH}
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT *, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain'
                  WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

MERGE = """
WITH steps AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS steps),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
names AS (SELECT doc_id, unnest(['row', 'lang', 'source']) AS name FROM d UNION ALL SELECT doc_id, CAST(i AS VARCHAR) FROM lines),
bytes AS (SELECT doc_id, name, branch, list_transform(string_split(branch || ':' || doc_id || ':' || name, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
          FROM names, (VALUES ('L'), ('R')) AS branches(branch)),
codes AS (SELECT doc_id, name, branch,
                 xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 11 AS code FROM bytes, steps),
e AS (SELECT doc_id, name, max(code) FILTER (branch = 'L') AS l, max(code) FILTER (branch = 'R') AS r FROM codes GROUP BY ALL),
line_edits AS (SELECT doc_id, i, line, CASE WHEN l <= 2 THEN l END AS l, CASE WHEN r <= 2 THEN r END AS r,
                      CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END AS lg, CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END AS rg
               FROM lines JOIN e USING (doc_id) WHERE e.name = CAST(i AS VARCHAR)),
line_states AS (SELECT *, CASE WHEN l <> r THEN NULL ELSE coalesce(l, r) END AS code, CASE WHEN lg <> rg THEN NULL ELSE coalesce(lg, rg) END AS gap FROM line_edits),
line_parts AS (SELECT *, CASE code WHEN 0 THEN NULL WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' ELSE line END AS kept FROM line_states),
texts AS (SELECT doc_id, count(code) + count(gap) AS clean, count(*) FILTER (l <> r AND l > 0 AND r > 0) AS ee, count(*) FILTER (l <> r AND l * r = 0) AS ed,
                 count(*) FILTER (lg <> rg) AS ii, count(l) + count(lg) AS by_l, count(r) + count(rg) AS by_r,
                 coalesce(string_agg(CASE WHEN kept IS NULL THEN gap WHEN gap IS NULL THEN kept ELSE kept || chr(10) || gap END, chr(10) ORDER BY i), '') AS merged
          FROM line_parts GROUP BY 1),
cells AS (SELECT doc_id, 'lang' AS name, lang AS v FROM d UNION ALL SELECT doc_id, 'source', source FROM d),
cell_edits AS (SELECT doc_id, name, v, nullif(CASE l WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END, v) AS l,
                      nullif(CASE r WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END, v) AS r FROM cells JOIN e USING (doc_id, name)),
cell_states AS (SELECT doc_id, max(CASE WHEN l <> r THEN v ELSE coalesce(l, r, v) END) FILTER (name = 'lang') AS lang,
                       max(CASE WHEN l <> r THEN v ELSE coalesce(l, r, v) END) FILTER (name = 'source') AS source,
                       count(*) FILTER (coalesce(l, r) IS NOT NULL AND NOT coalesce(l <> r, false)) AS clean, count(*) FILTER (l <> r) AS ee, count(l) AS by_l, count(r) AS by_r
                FROM cell_edits GROUP BY 1),
fates AS (SELECT doc_id, CASE WHEN l = 0 AND r = 0 THEN 'dropped' WHEN l = 0 THEN CASE WHEN t.by_r + c.by_r > 0 THEN 'disputed' ELSE 'dropped' END
                 WHEN r = 0 THEN CASE WHEN t.by_l + c.by_l > 0 THEN 'disputed' ELSE 'dropped' END ELSE 'merged' END AS fate
          FROM e JOIN texts t USING (doc_id) JOIN cell_states c USING (doc_id) WHERE e.name = 'row'),
kept AS (SELECT doc_id, CASE fate WHEN 'merged' THEN c.lang WHEN 'disputed' THEN d.lang END AS lang, CASE fate WHEN 'merged' THEN c.source WHEN 'disputed' THEN d.source END AS source,
                CASE fate WHEN 'merged' THEN t.merged WHEN 'disputed' THEN d.text END AS text,
                CASE fate WHEN 'merged' THEN t.clean + c.clean WHEN 'dropped' THEN 1 ELSE 0 END AS n_clean, CASE fate WHEN 'merged' THEN t.ee + c.ee ELSE 0 END AS n_edit_edit,
                CASE fate WHEN 'merged' THEN t.ed WHEN 'disputed' THEN 1 ELSE 0 END AS n_edit_delete, CASE fate WHEN 'merged' THEN t.ii ELSE 0 END AS n_insert_insert
         FROM d JOIN fates USING (doc_id) JOIN texts t USING (doc_id) JOIN cell_states c USING (doc_id)),
adds AS (SELECT -1 - doc_id AS doc_id, 'L' AS branch, CASE l WHEN 3 THEN '!' ELSE '?' END AS text, lang, source FROM d JOIN e USING (doc_id) WHERE name = 'row' AND l IN (3, 4)
         UNION ALL SELECT -2 - doc_id, 'R', CASE r WHEN 3 THEN '!' ELSE '?' END, lang, source FROM d JOIN e USING (doc_id) WHERE name = 'row' AND r IN (3, 4)),
new AS (SELECT doc_id, count(DISTINCT {'t': text, 'l': lang, 's': source}) AS values, min(text) AS text, min(lang) AS lang, min(source) AS source FROM adds GROUP BY 1),
added AS (SELECT doc_id, CASE WHEN values = 1 THEN lang END AS lang, CASE WHEN values = 1 THEN source END AS source, CASE WHEN values = 1 THEN text END AS text,
                 CASE WHEN values = 1 THEN 1 ELSE 0 END AS n_clean, 0 AS n_edit_edit, 0 AS n_edit_delete, CASE WHEN values > 1 THEN 1 ELSE 0 END AS n_insert_insert FROM new)
SELECT doc_id, lang, source, sha256(text) AS text_sha256, CAST(n_clean AS BIGINT) AS n_clean, CAST(n_edit_edit AS BIGINT) AS n_edit_edit,
       CAST(n_edit_delete AS BIGINT) AS n_edit_delete, CAST(n_insert_insert AS BIGINT) AS n_insert_insert
FROM (SELECT * FROM kept UNION ALL SELECT * FROM added)
"""
