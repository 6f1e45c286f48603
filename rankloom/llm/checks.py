"""The same results in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_lowered(column)}, '(?:[0-9a-z]|[^\\x00-\\x7F])+')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM ds),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
       FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# A run of 40 words that occurs earlier is covered by shortest windows of whole lines that hold 40 words,
# those that begin and those that end at its lines.
OP7 = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
           WHERE text IS NOT NULL),
w AS (SELECT *, CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[ \\t\\x0b\\f\\r]+')) END AS words
   FROM (SELECT *, trim(body, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS bare FROM l)),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS up_to FROM w),
p AS (SELECT a.doc_id, a.line AS a, b.line AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.line >= a.line
      AND b.up_to - a.up_to + a.words >= 40),
g AS (SELECT doc_id, a AS line, min(b) + 1 AS e FROM p GROUP BY doc_id, a UNION SELECT doc_id, max(a), b + 1 FROM p GROUP BY doc_id, b),
t AS (SELECT g.doc_id, g.line, g.e, md5(array_to_string(string_split(d.text, chr(10))[g.line + 1:g.e], chr(10))) AS body
      FROM g JOIN documents d USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(line) OVER o AS fl, row_number() OVER o AS k FROM t
      WINDOW o AS (PARTITION BY body ORDER BY doc_id, line)),
x AS (SELECT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(line, fl + e - line) ELSE line END, e)) AS line
      FROM f WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, line FROM x),
kept AS (SELECT l.doc_id, count(*) AS before, count(gone.line) AS removed,
                string_agg(body, chr(10) ORDER BY l.line) FILTER (WHERE gone.line IS NULL) AS body
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(before, 0) AS BIGINT) AS lines_before, CAST(coalesce(removed, 0) AS BIGINT) AS lines_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(body, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

# The same with runs of one word.
LINE_DEDUP_EVERY_RUN = OP7.replace(">= 40", ">= 1")

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, text, unnest({_words('text')}) AS t FROM benchmark),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT item_id, text, r, doc_id,
             CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN f USING (t) CROSS JOIN c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 10
"""

OP13 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
