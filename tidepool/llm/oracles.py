"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL = f"""
WITH docs AS (SELECT row_number() OVER () AS did, doc_id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
kept AS (SELECT did, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM kept),
tfs AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(terms) AS term FROM kept) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM dfs, total),
sizes AS (SELECT did, doc_id, 50 + (50 * n * nd) // nl AS m FROM kept, total),
scored AS (SELECT a.item_id, t.did, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * s.m))) AS BIGINT) AS score
 FROM asked a JOIN weights w USING (term) JOIN tfs t USING (term) JOIN sizes s USING (did) GROUP BY a.item_id, t.did),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN kept USING (did) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

PHRASES = f"""
WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(part, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM parts),
grams AS (
 SELECT lang, unnest(ws) AS phrase, 1 AS k FROM pieces
 UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM pieces
 UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM pieces),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
cuts AS (
 SELECT c.lang, c.phrase, c.k, 1 AS cut, c.a, x.a AS l, y.a AS r FROM f c JOIN f x ON x.lang = c.lang AND x.phrase = c.ws[1] JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[2:], ' ') WHERE c.k >= 2
 UNION ALL SELECT c.lang, c.phrase, c.k, 2, c.a, x.a, y.a FROM f c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:2], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = c.ws[3] WHERE c.k = 3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
around AS (SELECT lang, part, max(a) AS whole FROM (
 SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM f WHERE k = 3) GROUP BY lang, part),
stay AS (SELECT c.* FROM lowest c LEFT JOIN around o ON o.lang = c.lang AND o.part = c.phrase WHERE o.whole IS NULL OR 100 * o.whole < 50 * c.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, k, a, l, r, n, score FROM stay JOIN sizes USING (lang))
SELECT lang, rank, phrase, k AS words, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
