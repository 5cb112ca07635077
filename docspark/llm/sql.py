"""DuckDB SQL for the operators that SQL can express."""

_MEASURED = r"""
words AS (SELECT {columns}, coalesce(text, '') AS body, source,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM {table}),
numbered AS (SELECT row_number() OVER () AS row_no, * FROM words),
windows AS (SELECT row_no, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM numbered WHERE len(w) >= 3)),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS n FROM windows) WHERE n >= 2),
repeated AS (SELECT row_no, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY row_no),
measured AS (SELECT {columns}, coalesce(source, '') AS host, len(w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words FROM numbered LEFT JOIN repeated USING (row_no)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM ruled GROUP BY host),
pool AS (SELECT sum(f) / sum(n) AS m, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 0) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM pool),
verdicts AS (SELECT host, (f + m * k) / (n + k) <= 0.5 AS host_kept FROM hosts, prior)
"""

OP10 = "WITH " + _MEASURED.format(columns="doc_id", table="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM ruled JOIN verdicts USING (host)
"""

OP8 = """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""

OP11 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND c >= 10),
covering AS (SELECT lang, inside, max(c) AS c FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS inside, c FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT a.* FROM candidates a LEFT JOIN covering b ON a.lang = b.lang AND a.g = b.inside WHERE b.c IS NULL OR 100 * b.c < 50 * a.c),
cuts AS (SELECT lang, k, g, c, unnest(range(1, k)) AS cut FROM kept),
sides AS (SELECT x.lang, x.g, x.c AS a, x.cut, p.c AS l, q.c AS r, (1000000::HUGEINT * x.c * x.c) // (p.c::HUGEINT * q.c) AS score
  FROM cuts x JOIN counts p ON p.lang = x.lang AND p.g = x.g[1:x.cut] JOIN counts q ON q.lang = x.lang AND q.g = x.g[x.cut + 1:x.k]),
scored AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
