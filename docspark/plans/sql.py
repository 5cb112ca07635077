"""DuckDB SQL that says the same as the registered queries, put together from a few shared expressions."""

from __future__ import annotations

from ..functions.values import EN_STOP_WORDS, SMALL_TALK

NOT_WORD = r"[^\p{L}\p{N}_\s]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def norm(x: str) -> str:
    return collapse(rf"regexp_replace(lower(coalesce({x}, '')), '{NOT_WORD}', ' ', 'g')")


def loose(x: str) -> str:
    return collapse(rf"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', ' ', 'g')")


def words(normal: str) -> str:
    return f"list_filter(string_split({normal}, ' '), lambda x: x <> '')"


def quoted(items: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


MEANINGFUL = rf"length({strip('text')}) >= 15 AND regexp_matches({strip('text')}, '[\x{{0600}}-\x{{06FF}}a-zA-Z]')"
TERMS = f"""terms AS (SELECT item_id, qn, list_filter(w, lambda x: length(x) > 2 AND x NOT IN ({quoted(EN_STOP_WORDS)})) AS kws,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS bigs, text AS query
  FROM (SELECT *, {words('qn')} AS w FROM (SELECT item_id, text, {norm('text')} AS qn FROM benchmark)))"""
KEPT = f"""kept AS (SELECT doc_id, text, source, {norm('text')} AS dn FROM (SELECT *, row_number() OVER (PARTITION BY substr({strip('text')}, 1, 1000) ORDER BY doc_id) AS rn
  FROM documents WHERE {MEANINGFUL}) WHERE rn = 1)"""
SCORE = """CASE WHEN len(kws) > 0 THEN least(1.0::DOUBLE, len(list_filter(kws, lambda t: contains(dn, t)))::DOUBLE / len(kws)
  + CASE WHEN len(bigs) > 0 THEN len(list_filter(bigs, lambda t: contains(dn, t)))::DOUBLE / len(bigs) * 1.5 ELSE 0 END) ELSE 0 END"""
RANKED = f"""{TERMS}, {KEPT}, scored AS (SELECT item_id, query, doc_id, text, source, {SCORE} AS score FROM terms, kept),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 24)"""
BUDGET = "budget AS (SELECT * FROM (SELECT *, sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank) AS s FROM gated) WHERE s <= 6000 OR rank = 1)"
GATED = "gated AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM ranked WHERE rank <= 6) WHERE best >= 0.05)"
LOOSE_WORDS = f"list_filter({words(loose('query'))}, lambda x: length(x) > 2)"
SENTENCES = rf"""sentences AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM documents),
rows AS (SELECT doc_id, i - 1 AS pos, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM sentences))"""
BUCKET = "(('0x' || substr(md5(w), 31, 2))::INT % 128)"
CELL_PRICE = "CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END"
PART_LINES = f"""lines AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, 'Row ' || (row_number() OVER (ORDER BY p_partkey) + 1) || ': p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_type: ' || p_type || ' | p_size: ' || p_size || ' | p_retailprice: ' || {CELL_PRICE} AS line FROM part)"""
COSINE = "round(list_cosine_similarity(q.v, p.v), 6)"
VECTORS = "points AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
FACTS = "facts AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'preference' WHEN 'assistant' THEN 'decision' ELSE 'fact' END AS category, (1 + turn % 5)::INT AS importance, conv_id % 7 + turn // 2 AS updated_at FROM conversations)"
FORM = r"CASE WHEN len(string_split({0}, ' ')) > 6 THEN '' ELSE lower({0}) END".format(collapse(rf"regexp_replace({strip('coalesce(text, chr(32))')}, '[\s!.,?؟،]+$', '', 'g')"))
TALK = "MAP {" + ", ".join(f"{quoted([p])}: '{k}'" for k, ps in SMALL_TALK.items() for p in ps) + "}"
LINES = "lines AS (SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
SUSPECT = r"(length(t) > 0 AND len(regexp_extract_all(t, '[0-9٠-٩]')) >= 0.4 * length(t) AND regexp_matches(t, '[^0-9٠-٩.,/\-:٫٬،]'))"

ORACLES = {
    "flagship_grounded_search": f"WITH {RANKED}, {GATED}, {BUDGET} SELECT item_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM budget",
    "lang_script_profile": r"SELECT doc_id, CASE WHEN a > 0 AND a >= l THEN 'ar' ELSE 'en' END AS detected, a > 0 AND l > 0 AS mixed FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) AS a, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM documents)",
    "normalize_text": f"SELECT doc_id, length(n)::INT AS n_chars, md5(n) AS form FROM (SELECT doc_id, {norm('text')} AS n FROM documents)",
    "loose_text": f"SELECT doc_id, length(n)::INT AS n_chars, md5(n) AS form FROM (SELECT doc_id, {loose('text')} AS n FROM documents)",
    "keywords_bigrams": f"WITH {TERMS} SELECT item_id, array_to_string(kws, ' ') AS kws, array_to_string(bigs, '|') AS bigrams FROM terms",
    "meaningful_filter": f"SELECT doc_id FROM documents WHERE {MEANINGFUL}",
    "enrich_text": f"SELECT doc_id, md5(b || CASE WHEN lower(b) <> b THEN chr(10) || chr(10) || '[lowercase]' || chr(10) || chr(10) || lower(b) ELSE '' END) AS enriched FROM (SELECT doc_id, {strip('text')} AS b FROM documents)",
    "code_like_queries": rf"SELECT kind, id, x <> '' AND NOT contains(x, ' ') AND regexp_matches(x, '^[\p{{L}}\p{{N}}_\-.:/]*[\p{{Nd}}./:][\p{{L}}\p{{N}}_\-.:/]*$') AS code_like FROM (SELECT 'page' AS kind, page_id AS id, {strip('url')} AS x FROM pages UNION ALL SELECT 'item', item_id, {strip('text')} FROM benchmark)",
    "content_hash_registry": "WITH h AS (SELECT doc_id, source, sha256(text) AS file_hash FROM documents), reg AS (SELECT DISTINCT source, file_hash FROM h WHERE doc_id % 3 = 0) SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.source = h.source AND reg.file_hash = h.file_hash)",
    "prefix_dedupe": f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr({strip('text')}, 1, 1000) ORDER BY doc_id) AS rn FROM documents WHERE {strip('text')} <> '') WHERE rn = 1",
    "hit_dedupe": f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS idx FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr({strip('text')}, 1, 700), source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
    "chunk_ids": "SELECT doc_id, source || '::0::' || i || '::' || substr(md5(text), 1, 8) AS chunk_id, i::INT AS chunk_index, n AS total_chunks FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, pos::INT AS pos, md5(sentence) AS sentence FROM rows",
    "sentence_windows": f"WITH {SENTENCES} SELECT doc_id, pos::INT AS pos, md5(array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ')) AS window_md5 FROM rows",
    "hash_embedding": rf"SELECT item_id, bucket::INT AS bucket, count(*) AS n FROM (SELECT item_id, {BUCKET} AS bucket FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark)) GROUP BY ALL",
    "vector_topk_by_label": f"WITH {VECTORS} SELECT query_id, point_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, {COSINE} AS score FROM points q JOIN points p ON q.label = p.label WHERE q.vec_id % 10 = 0)) WHERE rank <= 8",
    "knn_join": f"""WITH {VECTORS}, pairs AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, q.label = p.label AS same, {COSINE} AS score FROM points q, points p),
      ranked AS (SELECT true AS scoped, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM pairs WHERE same UNION ALL SELECT false, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) FROM pairs)
      SELECT scoped, query_id, point_id, score, rank::INT AS rank FROM ranked WHERE rank <= CASE WHEN scoped THEN 3 ELSE 5 END""",
    "multi_variant_union": f"WITH {VECTORS}, hits AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, point_id) AS rank FROM (SELECT q.vec_id AS v, q.vec_id // 40 AS question, p.vec_id AS point_id, {COSINE} AS score FROM points q, points p WHERE q.vec_id % 10 = 0)), first AS (SELECT *, row_number() OVER (PARTITION BY question, point_id ORDER BY v, rank) AS f FROM hits WHERE rank <= 8) SELECT question, point_id, (row_number() OVER (PARTITION BY question ORDER BY v, rank) - 1)::INT AS idx FROM first WHERE f = 1",
    "post_topk_source_filter": f"WITH {VECTORS}, hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, p.label AS label, {COSINE} AS score FROM points q, points p WHERE q.vec_id % 10 = 0)) SELECT query_id, point_id, rank::INT AS rank FROM hits WHERE rank <= 8 AND label = 3",
    "blended_rerank": f"WITH {RANKED}, blended AS (SELECT item_id, doc_id, rank, greatest(score, CASE WHEN len(lw) > 0 THEN len(list_filter(lw, lambda x: contains(ld, x)))::DOUBLE / len(lw) ELSE 0 END) - (rank - 1) * 0.001 AS final FROM (SELECT *, {LOOSE_WORDS} AS lw, {loose('text')} AS ld FROM ranked)) SELECT item_id, doc_id, round(final, 6) AS final, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(final, 6) DESC, rank) AS place FROM blended) WHERE place <= 6",
    "confidence_gate": f"WITH {RANKED} SELECT item_id, doc_id FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM ranked) WHERE best >= 0.5",
    "relative_cut": f"WITH {RANKED} SELECT item_id, doc_id FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM ranked) WHERE score >= greatest(best * 0.5, 0.05)",
    "context_budget": f"WITH {RANKED}, {GATED}, {BUDGET} SELECT item_id, count(*) AS n, sum(length(text))::BIGINT AS chars, md5(string_agg('[Chunk ' || rank || ' | ' || source || ' | page 0]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM budget GROUP BY item_id",
    "citations": f"WITH {RANKED}, per AS (SELECT item_id, source, count(*) AS n, min(rank) AS f FROM ranked GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS place FROM per) SELECT item_id, 'Sources: ' || string_agg(source || ' (p. 1)', ' | ' ORDER BY place) AS citation FROM top WHERE place <= 3 GROUP BY item_id",
    "active_document": f"WITH {RANKED}, per AS (SELECT item_id, source, count(*) AS n, min(rank) AS f FROM ranked GROUP BY ALL) SELECT item_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS place FROM per) WHERE place = 1",
    "sheet_rows": f"WITH {PART_LINES} SELECT pos, line FROM lines",
    "sheet_row_groups": f"""WITH {PART_LINES}, size AS (SELECT greatest(3, least(50, 700 // greatest(1, sum(length(line)) FILTER (pos < 5) // count(*) FILTER (pos < 5))))::BIGINT AS rows, count(*) AS n FROM lines),
      shape AS (SELECT rows, n, greatest(1, rows - least(rows - 1, round_even(rows * (150 / 700.0::DOUBLE), 0)::BIGINT)) AS step FROM size), starts AS (SELECT s, rows, n FROM (SELECT unnest(range(0, n, step)) AS s, rows, n, step FROM shape) WHERE s = 0 OR s - step + rows < n)
      SELECT s AS start, (s + 2) || '-' || (least(s + rows, n) + 1) AS row_range, md5('[Sheet: part]' || chr(10) || string_agg(line, chr(10) ORDER BY pos)) AS chunk FROM starts JOIN lines ON pos >= s AND pos < s + rows GROUP BY s, rows, n""",
    "sheet_summary": f"WITH {PART_LINES} SELECT '[Sheet: part — Summary]' || chr(10) || 'This sheet has ' || count(*) || ' rows and 6 columns: p_partkey, p_name, p_brand, p_type, p_size, p_retailprice.' || chr(10) || 'Sample data:' || chr(10) || string_agg(line, chr(10) ORDER BY pos) FILTER (pos < 5) AS chunk FROM lines",
    "page_packing": """WITH RECURSIVE p AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
      f AS (SELECT source, doc_id, i, 0 AS no, n AS len FROM p WHERE i = 1 UNION ALL
        SELECT p.source, p.doc_id, p.i, f.no + CASE WHEN f.len + p.n + 2 > 6000 AND f.len > 0 THEN 1 ELSE 0 END, CASE WHEN (f.len + p.n + 2 > 6000 AND f.len > 0) OR f.len = 0 THEN p.n ELSE f.len + 2 + p.n END FROM f JOIN p ON p.source = f.source AND p.i = f.i + 1)
      SELECT source, no AS slice_no, min(doc_id) AS page_start, max(doc_id) AS page_end, max(len)::INT AS n_chars FROM f GROUP BY source, no""",
    "report_buckets": rf"""WITH items AS (SELECT source, doc_id, 'technical_terms' AS section, regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 1) AS xs FROM documents UNION ALL SELECT source, doc_id, 'numbers', regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(\d[\d.,]*%?)', 1) FROM documents),
      rows AS (SELECT source, doc_id, section, i, xs[i] AS x FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM items)),
      first AS (SELECT *, row_number() OVER (PARTITION BY source, section, substr({collapse('lower(x)')}, 1, 200) ORDER BY doc_id, i) AS f FROM rows)
      SELECT source, section, (row_number() OVER (PARTITION BY source, section ORDER BY doc_id, i))::INT AS place, x || ' (p. ' || doc_id || ')' AS item FROM first WHERE f = 1""",
    "memory_recent_window": "SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id",
    "memory_compaction_flags": """WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      f AS (SELECT conv_id, turn, i, [n] AS held, n > 600 AS cut FROM m WHERE i = 1 UNION ALL
        SELECT conv_id, turn, i, h AS held, len(h) > 4 OR list_sum(h) > 600 AS cut FROM (SELECT m.conv_id, m.turn, m.i, list_append(CASE WHEN f.cut THEN list_slice(f.held, greatest(len(f.held) - 1, 1), len(f.held)) ELSE f.held END, m.n) AS h FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1))
      SELECT conv_id, turn, cut AS compacts FROM f""",
    "small_talk_route": f"SELECT conv_id, turn, CASE WHEN form <> '' THEN {TALK}[form] END AS category FROM (SELECT conv_id, turn, {FORM} AS form FROM conversations)",
    "route_override_matrix": f"""SELECT conv_id, turn, a AS action, d AS n_documents, r AS n_retrieved, c AS chatty, CASE WHEN a = 'respond' AND d > 0 THEN 'generate' WHEN a IN ('respond', 'generate') AND d = 0 AND r = 0 AND NOT c THEN 'retrieve' ELSE a END AS taken
      FROM (SELECT conv_id, turn, ['respond', 'generate', 'retrieve', 'summarize'][(conv_id + turn) % 4 + 1] AS a, conv_id % 3 AS d, turn % 2 AS r, CASE WHEN form <> '' THEN {TALK}[form] END IS NOT NULL AS c FROM (SELECT conv_id, turn, {FORM} AS form FROM conversations))""",
    "fact_eviction": f"WITH {FACTS} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, updated_at DESC, turn DESC) AS r FROM facts) WHERE r <= 3",
    "fact_render": f"WITH {FACTS}, placed AS (SELECT *, '- [' || category || '] ' || text AS line, row_number() OVER w AS r, sum(length('- [' || category || '] ' || text) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM facts WINDOW w AS (PARTITION BY conv_id ORDER BY importance DESC, updated_at DESC, turn)) SELECT conv_id, string_agg(line, chr(10) ORDER BY r) AS facts FROM placed WHERE s <= 300 OR r = 1 GROUP BY conv_id",
    "job_latest_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "session_idle": "SELECT event_id, session_no::BIGINT AS session_no FROM (SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))",
    "job_ttl": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stage_profile": "SELECT user_id, stage, round(ms, 4) AS ms, round(ms / sum(ms) OVER (PARTITION BY user_id), 4) AS share FROM (SELECT user_id, event_type AS stage, sum(value) AS ms FROM events GROUP BY ALL)",
    "latency_nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg, max(value) FILTER (r = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(value) FILTER (r = round_even(0.95 * (n - 1), 0) + 1) AS p95 FROM r GROUP BY event_type",
    "request_marks": "SELECT user_id, (min(epoch_us(ts)) FILTER (event_type = 'click') - min(epoch_us(ts)) FILTER (event_type = 'view')) / 1000.0 AS dispatch_ms, (min(epoch_us(ts)) FILTER (event_type = 'purchase') - min(epoch_us(ts)) FILTER (event_type = 'view')) / 1000.0 AS total_ms FROM events GROUP BY user_id",
    "cer_levenshtein": f"SELECT item_id, round(CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(r, h)::DOUBLE / length(r) END, 6) AS cer FROM (SELECT item_id, text AS r, lead(text) OVER (ORDER BY item_id) AS h FROM (SELECT item_id, {loose('text')} AS text FROM benchmark)) WHERE h IS NOT NULL",
    "ocr_line_merge": f"WITH pairs AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text) AS r FROM documents), rows AS (SELECT source, r, i, l[i] AS line FROM (SELECT source, r, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, r, string_split(text, chr(10)) AS l FROM pairs))), first AS (SELECT *, row_number() OVER (PARTITION BY source, {collapse('lower(line)')} ORDER BY r, i) AS f FROM rows WHERE {collapse('lower(line)')} <> '') SELECT source, (row_number() OVER (PARTITION BY source ORDER BY r, i))::INT AS place, md5(line) AS line FROM first WHERE f = 1",
    "fractured_lines": rf"""WITH {LINES}, s AS (SELECT *, {strip('line')} AS s FROM lines), m AS (SELECT *, s <> '' AND length(s) <= 15 AND NOT regexp_matches(s, '^[\-•*]|^\(?\d+[.)،]') AS fits FROM s),
      i AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM m),
      p AS (SELECT *, CASE WHEN fits THEN (row_number() OVER (PARTITION BY doc_id, island, fits ORDER BY pos) - 1) // 6 ELSE -1 END AS part FROM i),
      g AS (SELECT doc_id, min(pos) AS a0, CASE WHEN count(*) > 1 THEN string_agg(s, ' ' ORDER BY pos) ELSE min(line) END AS line FROM p GROUP BY doc_id, island, part)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a0) - 1)::INT AS place, md5(line) AS line FROM g""",
    "digit_tokens": f"SELECT doc_id, len(list_filter(string_split(text, ' '), lambda t: {SUSPECT}))::INT AS n FROM documents",
    "reindex_swap": "SELECT doc_id, md5(text) AS body FROM documents WHERE doc_id <> 7 UNION ALL SELECT doc_id, md5(upper(text)) FROM documents WHERE doc_id = 7",
    "upload_validation": """SELECT page_id, CASE WHEN html = '' AND mark % 2 = 1 THEN 'empty' WHEN i = 11 THEN 'unsupported' WHEN i IN (6, 8, 9, 10) OR page_id % 2 = 0 THEN 'ok' ELSE 'invalid' END AS status,
      CASE WHEN (html <> '' OR mark % 2 = 0) AND i < 11 AND (i IN (6, 8, 9, 10) OR page_id % 2 = 0) THEN ['pdf', 'docx', 'doc', 'excel', 'excel', 'excel', 'image', 'txt', 'markdown', 'json'][i] END AS file_type FROM (SELECT page_id, html, page_id % 11 + 1 AS i, page_id % 2 AS mark FROM pages)""",
    "content_types": """SELECT page_id, ['application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/msword', 'application/vnd.ms-excel', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'text/csv',
      'application/octet-stream', 'text/plain', 'text/markdown', 'application/json', 'application/octet-stream'][page_id % 11 + 1] AS content_type FROM pages""",
    "query_variants": f"SELECT item_id, array_to_string(list_distinct_ordered, '|') AS variants FROM (SELECT item_id, list_filter([b, n, lower(b), l], lambda x, i: x <> '' AND list_position([b, n, lower(b), l], x) = i) AS list_distinct_ordered FROM (SELECT item_id, {strip('text')} AS b, {norm(strip('text'))} AS n, {loose(strip('text'))} AS l FROM benchmark))",
    "refusal_markers": "SELECT conv_id, turn, contains(lower(text), 'not available in the uploaded files') OR contains(lower(text), 'no relevant documents were found') OR contains(lower(text), 'only answers questions about the uploaded documents') AS refuses FROM conversations",
    "star_join_rollup": "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "star_window_rank": "SELECT c_nationkey, c_custkey, rk::INT AS rk FROM (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer) WHERE rk <= 3",
    "star_set_ops": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
}
ORACLES["indexed_grounded_search"] = ORACLES["flagship_grounded_search"]
