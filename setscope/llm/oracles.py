"""DuckDB twins of the queries that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(w) OVER (ORDER BY most::DOUBLE / w, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM src),
common AS (
  SELECT arg_min(level, (most::DOUBLE / w, -level)) AS common FROM lev WHERE level <= most::DOUBLE / w),
targets AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, common * w), most::DOUBLE) AS target
  FROM lev LEFT JOIN common ON true),
rated AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, s.size * 64 > t.source_size AS head,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate,
         rate - floor(rate) AS fraction,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC,
             ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT, s.doc_id NULLS FIRST) AS place,
         ('0x' || substr(md5('mix:' || 'first:' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
         ('0x' || substr(md5('mix:' || 'others:' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start2
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
heads AS (
  SELECT *, floor(start + fraction * place) - floor(start + fraction * (place - 1)) AS more FROM rated),
owed AS (
  SELECT source, count(*) FILTER (head) AS n_first, coalesce(sum(size) FILTER (head), 0)::BIGINT AS words_first,
         coalesce(sum(more::BIGINT * size) FILTER (head), 0)::BIGINT AS drawn_first,
         coalesce(sum(size) FILTER (NOT head), 0)::BIGINT AS words_others, max(size) AS largest
  FROM heads GROUP BY source),
drawn AS (
  SELECT h.*, h.place - o.n_first AS nth,
         CASE WHEN o.words_others > 0 THEN h.fraction + (h.fraction * o.words_first - o.drawn_first)
              * least(1.0::DOUBLE / o.words_others, least(h.fraction, 1.0::DOUBLE - h.fraction) / o.largest)
              ELSE h.fraction END AS f2
  FROM heads h JOIN owed o ON h.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN head THEN more
                            ELSE floor(start2 + f2 * nth) - floor(start2 + f2 * (nth - 1)) END) * size)::BIGINT AS taken
FROM drawn
"""

LINE_DEDUP = r"""
WITH u AS (
  SELECT doc_id, unnest(lines) AS unit, generate_subscripts(lines, 1) - 1 AS place
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
n AS (
  SELECT *, lower(trim(regexp_replace(unit, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY place
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
  FROM u),
m AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) > 1 AS gone
  FROM n),
g AS (
  SELECT doc_id, (count(*) FILTER (gone))::INT AS n_removed,
         coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
         coalesce(string_agg(start_at || '-' || (start_at + length(unit)), ',' ORDER BY place) FILTER (gone), '') AS removed_spans
  FROM m GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(n_removed, 0)::INT AS n_removed,
       coalesce(removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
r AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(
          text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
        FROM documents WHERE text IS NOT NULL)),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 5)) AS k))
  GROUP BY 1, 2, 3),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest(range(2, 4)) AS m) WHERE m < k)
  GROUP BY 1, 2),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.cover IS NULL OR 100 * i.cover::HUGEINT < 80 * c.a::HUGEINT),
halves AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
cuts AS (
  SELECT h.lang, h.phrase, a, c, l.n AS l, r.n AS r, ((2000000 * a::HUGEINT) // (l.n + r.n))::BIGINT AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.x JOIN f r ON r.lang = h.lang AND r.phrase = h.y),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM cuts) WHERE i = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, words.n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle
                    AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
