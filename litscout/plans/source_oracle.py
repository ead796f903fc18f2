"""The SQL for DuckDB of the queries in ``source_queries``."""

from __future__ import annotations

from .oracle import CAP, DOT, HAY, RECENCY, TITLE, WORDS, collapse, has
from .queries import ASOF, CANDIDATE, DOCS, LIBRARY

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
OLD = "ts < TIMESTAMP '2024-01-28'"
LAST = "(SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events {}) WHERE k = 1)"
NORM = f"lower({collapse(TITLE)})"

#: Token-set similarity of (t, u) in the table {pairs}: words as sets; the longest common subsequence of what is not shared, bit by bit.
RATIO = """
w AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(u, ' '), lambda x: x <> '')) AS b FROM {pairs}),
v AS (SELECT *, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS oa, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS ob,
             list_sort(list_filter(a, lambda x: list_contains(b, x))) AS held FROM w),
s AS (SELECT *, array_to_string(oa, ' ') AS x, array_to_string(ob, ' ') AS y, CASE WHEN len(held) > 0 THEN length(array_to_string(held, ' ')) + 1 ELSE 0 END AS sg FROM v),
m AS (SELECT *, (1::HUGEINT << length(x)) - 1 AS every, list_transform(range(1, length(y) + 1), lambda j: list_reduce(
        list_prepend(0::HUGEINT, list_transform(range(1, length(x) + 1), lambda i: CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN 1::HUGEINT << (i - 1)::HUGEINT ELSE 0::HUGEINT END)), lambda p, q: p | q)) AS masks FROM s),
l AS (SELECT *, length(x) - bit_count(list_reduce(list_prepend(every, masks), lambda row, k: ((row + (row & k)) | (row - (row & k))) & every)) AS lcs FROM m),
scored AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE WHEN sg > 0 AND (x = '' OR y = '') THEN 1.0::DOUBLE ELSE greatest(
        1 - (length(x) + length(y) - 2 * lcs)::DOUBLE / (2 * sg + length(x) + length(y)),
        CASE WHEN sg > 0 THEN 1 - (1 + length(x))::DOUBLE / (2 * sg - 1 + length(x)) ELSE 0 END, CASE WHEN sg > 0 THEN 1 - (1 + length(y))::DOUBLE / (2 * sg - 1 + length(y)) ELSE 0 END) END AS score FROM l)
"""
EVENTS = "(SELECT * FROM documents JOIN events ON event_id = doc_id)"
ALT = "CASE WHEN {0} = 0 THEN 0.0::DOUBLE ELSE ln(1 + {0}) END"
JOURNALS = "(VALUES ('src1', 9.0::DOUBLE), ('src2', 0.5::DOUBLE), ('src12', 30.0::DOUBLE)) AS j(venue, sjr)"
QUALITY = "CASE WHEN sjr IS NULL THEN 1.0::DOUBLE ELSE greatest(ln(1 + sjr), 1.0::DOUBLE) END"
LABEL = "CASE WHEN score >= 0.75 THEN 'must_read' WHEN score >= 0.5 THEN 'consider' ELSE 'ignore' END"

SQL = {
    "q_library_items": """SELECT doc_id AS ordinal, CASE WHEN doc_id % 4 = 0 THEN 'o' ELSE 'd' END || doc_id AS key, CASE WHEN doc_id % 2 = 1 THEN doc_id ELSE doc_id % 3 END AS version,
        CASE WHEN doc_id % 5 = 1 THEN source ELSE '' END AS title, lang AS abstract, lang || ' ' || source AS creators, lang AS tags, CASE WHEN doc_id % 3 = 0 THEN 2020 END AS year, source AS collections FROM documents""",
    "q_unified_candidates": f"""SELECT event_id, 'public-api' AS source, CASE WHEN event_id % 5 = 0 THEN 's' || user_id ELSE CAST(event_id AS VARCHAR) END AS identifier, event_type AS title,
        CASE WHEN event_id % 2 = 0 THEN 'A|B' ELSE 'Solo' END AS authors, {ISO.format("date_trunc('second', ts)")} AS published, '{{"cited_by":' || user_id || '.0}}' AS metrics, event_type AS kind FROM events WHERE event_id % 7 <> 0""",
    "q_graph_candidates": """SELECT doc_id, 'graph' AS source, CASE doc_id % 4 WHEN 1 THEN 'W' || doc_id WHEN 2 THEN 'ids' WHEN 3 THEN '10.1' ELSE source END AS identifier, source AS title,
        CASE WHEN doc_id % 3 = 2 THEN lang || ' ' || source || ' ' || lang ELSE lang END AS abstract, lang AS authors, CASE WHEN doc_id % 2 = 0 THEN 'http://v' ELSE 'http://l' END AS url, source AS venue,
        CAST(n_chars AS DOUBLE) AS cited, '["' || lang || '"]' AS concepts FROM documents""",
    "q_registry_candidates": """SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN '10.2/' || doc_id WHEN 2 THEN 'http://u' ELSE 'unknown' END AS identifier, source AS title, 'a & b ' || lang AS abstract, 'G ' || lang AS authors,
        '2024-01-02T03:04:05+00:00' AS published, source AS venue, CAST(n_chars AS DOUBLE) AS cited, 'Queried' AS queried FROM documents WHERE doc_id % 9 <> 0""",
    "q_preprint_candidates": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10.3/' || doc_id ELSE 'bx' END AS identifier, CASE WHEN doc_id % 2 = 0 THEN '10.3/' || doc_id END AS doi, lang || '|B' AS authors,
        CASE WHEN doc_id % 3 = 0 THEN 'http://own' WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.3/' || doc_id END AS url, '2024-02-03T00:00:00+00:00' AS published, lang AS category FROM documents""",
    "q_feed_candidates": """SELECT 'arxiv' AS source, 'http://a/' || item_id AS identifier, r_name || ' ' || item_id AS title, 's' || item_id AS abstract, r_name || '|N2' AS authors, 'http://l/' || item_id AS url,
        printf('2024-01-%02dT00:00:00+00:00', item_id % 28 + 1) AS published, 'arXiv' AS venue, 'c' || item_id % 3 AS category FROM benchmark JOIN region ON item_id % 5 = r_regionkey""",
    "q_candidate_json": f"""SELECT source, ordinal, identifier, md5(title) AS title, md5(abstract) AS abstract, '2024-01-02T03:04:05+00:00' AS published, CAST(0 AS BIGINT) AS authors FROM (
        SELECT 'graph' AS source, doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS identifier, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents
        UNION ALL SELECT 'registry', 1099511627776 + page_id, url, {TITLE}, NULL FROM pages UNION ALL SELECT 'arxiv', 2199023255552 + item_id, CAST(item_id AS VARCHAR), text, NULL FROM benchmark)""",
    "q_stored_items": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '|' || source ELSE '' END AS creators, CAST(0 AS BIGINT) AS empty FROM documents",
    "q_inverted_gaps": f"SELECT doc_id, md5(string_agg(CASE WHEN pos = first THEN chr(2) || 'last' ELSE word END, ' ' ORDER BY pos)) AS digest FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id) AS first FROM {WORDS}) GROUP BY doc_id",
    "q_iso_parse": f"SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN {ISO.format('ts - INTERVAL 2 HOUR')} END AS at FROM events",
    "q_topic_settings": f"SELECT ordinal AS doc_id, 'literature' AS query FROM (SELECT ordinal, {HAY} AS h FROM {DOCS}) WHERE NOT {has('h', ['ouen the'])} AND {has('h', ['the ', 'tion'])}",
    "q_topics_empty": "SELECT min(doc_id) AS ordinal, source FROM documents GROUP BY source",
    "q_score": f"""WITH x AS (SELECT doc_id AS ordinal, coalesce(label / 10.0::DOUBLE, 0.0::DOUBLE) AS similarity, CASE WHEN doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE {RECENCY.format('ts', ASOF)} END AS recency_score,
          CASE WHEN doc_id % 3 = 0 THEN {ALT.format('value')} ELSE 0.0::DOUBLE END AS metric_score, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE {ALT.format('value')} END AS alt,
          CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS author_bonus, CASE WHEN source = 'src3' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS venue_bonus, {QUALITY} AS journal_quality, sjr AS journal_sjr
          FROM {EVENTS} d LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN {JOURNALS} ON j.venue = d.source),
        y AS (SELECT *, similarity * 0.62 + recency_score * 0.1 + metric_score * 0.1 + alt * 0.03 + journal_quality * 0.05 + author_bonus * 0.02 + venue_bonus * 0.1 AS score FROM x)
        SELECT ordinal, round(score, 8) AS score, round(similarity, 8) AS similarity, round(recency_score, 8) AS recency_score, round(metric_score, 8) AS metric_score, author_bonus, venue_bonus,
               round(journal_quality, 8) AS journal_quality, round(journal_sjr, 8) AS journal_sjr, CASE WHEN abs(score - 0.5) > 1e-9 THEN {LABEL} END AS label FROM y""",
    "q_token_set_ratio": f"""WITH x AS (SELECT page_id, {NORM} AS t FROM pages), p AS (SELECT x.page_id, x.t, y.t AS u FROM x JOIN x y ON y.page_id = x.page_id + 1), {RATIO.format(pairs='p')}
        SELECT page_id, round(score, 6) AS score FROM scored""",
    "q_fuzzy_library": f"""WITH x AS (SELECT page_id, starts_with(url, 'https:') AS safe, {NORM} AS t FROM pages), p AS (SELECT a.t, b.t AS u FROM (SELECT DISTINCT t FROM x WHERE NOT safe AND t <> '') a, (SELECT DISTINCT t FROM x WHERE safe AND t <> '') b),
        {RATIO.format(pairs='p')} SELECT page_id FROM x WHERE NOT safe AND t NOT IN (SELECT t FROM scored WHERE score >= 0.9 - 1e-9)""",
    "q_fuzzy_dedupe": f"""WITH RECURSIVE x AS (SELECT page_id, {NORM} AS t, row_number() OVER (ORDER BY page_id) AS n FROM pages), d AS (SELECT DISTINCT t FROM x WHERE t <> ''), p AS (SELECT a.t, b.t AS u FROM d a, d b),
        {RATIO.format(pairs='p')}, near AS MATERIALIZED (SELECT t, list(u) AS us FROM scored WHERE score >= 0.9 - 1e-9 GROUP BY t), r AS MATERIALIZED (SELECT x.*, coalesce(us, []) AS us FROM x LEFT JOIN near ON near.t = x.t),
        g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS titles, CAST([] AS BIGINT[]) AS ids
              UNION ALL SELECT r.n, CASE WHEN list_has_any(titles, us) THEN titles ELSE list_append(titles, t) END, CASE WHEN list_has_any(titles, us) THEN ids ELSE list_append(ids, page_id) END FROM g JOIN r ON r.n = g.n + 1)
        SELECT unnest(ids) AS page_id FROM g WHERE n = (SELECT max(n) FROM x)""",
    "q_journal_csv": "SELECT lower(p_brand) AS title_key, CAST(max(p_partkey) AS DOUBLE) AS sjr FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_brand",
    "q_profile_document": """WITH v AS (SELECT source || ' ' AS venue, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS pos FROM documents GROUP BY source)
        SELECT (SELECT count(*) FROM documents) AS item_count, 'given' AS model, 0.6::DOUBLE AS x, pos, venue FROM v WHERE pos < 5""",
    "q_vector_index": "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings WHERE vec_id % 3 = 0",
    "q_candidate_snapshot": """WITH c AS (SELECT 'graph' AS source, count(*) AS n FROM documents UNION ALL SELECT 'registry', count(*) FROM pages UNION ALL SELECT 'arxiv', count(*) FROM benchmark)
        SELECT source, n, 'stale' AS kind FROM c WHERE source <> 'graph' UNION ALL SELECT source, n, 'fresh' FROM c""",
    "q_library_sync": f"""WITH b AS {LAST.format('WHERE ' + OLD)}, n AS {LAST.format('WHERE NOT ' + OLD)}
        SELECT coalesce(n.user_id, b.user_id) AS user_id, coalesce(n.event_id, b.event_id) AS version, coalesce(n.event_type, b.event_type) AS title, n.user_id IS NOT NULL AND n.event_type IS DISTINCT FROM b.event_type AS stale,
               (SELECT max(event_id) FROM events) AS cursor, (SELECT max(event_id) FROM events WHERE {OLD}) AS asked_since, (SELECT count(*) FROM events) AS fetched
        FROM b FULL JOIN n ON b.user_id = n.user_id WHERE coalesce(n.event_type, '') <> 'error'""",
    "q_full_sync": f"""WITH b AS {LAST.format('WHERE ' + OLD)}, n AS {LAST.format('WHERE NOT ' + OLD)}
        SELECT user_id, event_id AS version, (SELECT count(*) FROM b WHERE user_id NOT IN (SELECT user_id FROM n)) AS removed FROM n""",
    "q_page_stream": """SELECT event_type AS title, count(*) AS n, count(*) AS places, sum(event_id)::BIGINT AS ids, 8 AS pages FROM events GROUP BY event_type""",
    "q_keyed_stream": f"SELECT user_id, event_id AS version, event_type AS title FROM {LAST.format('')} WHERE event_type <> 'error'",
    "q_state_log": """WITH l AS (SELECT user_id, event_id % 10 AS b, max(event_id) AS v, arg_max(event_type, event_id) AS e FROM events GROUP BY ALL),
        gone AS (SELECT user_id, max(b) AS b FROM l WHERE e = 'error' GROUP BY user_id),
        r AS (SELECT l.user_id, max(v) AS version, arg_max(e, v) AS title FROM l LEFT JOIN gone g ON g.user_id = l.user_id WHERE l.b > coalesce(g.b, -1) GROUP BY l.user_id)
        SELECT user_id, version, title FROM r""",
    "q_stream_sync": f"SELECT user_id, event_id AS version, event_type AS title FROM {LAST.format('')}",
    "q_watch_flagship": f"""WITH lib AS (SELECT md5(text) AS k, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE {LIBRARY}),
        c AS (SELECT * FROM (SELECT d.*, ts, value, md5(text) AS k, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents d JOIN events ON event_id = 20 * doc_id % (SELECT count(*) FROM events) WHERE {CANDIDATE}) WHERE copy = 1),
        f AS (SELECT * FROM (SELECT *, lower(concat_ws(' ', nullif(text, ''), source)) AS h FROM c) WHERE NOT {has('h', ['casino'])} AND ({has('h', ['the ', 'de '])} AND {has('h', ['tion', 'ment'])} OR {has('h', ['die'])}) AND k NOT IN (SELECT k FROM lib)),
        m AS (SELECT f.doc_id, max({DOT}) AS similarity FROM f JOIN embeddings a ON a.vec_id = f.doc_id, lib b GROUP BY f.doc_id),
        y AS (SELECT f.doc_id, source, ts, coalesce(similarity, 0.0::DOUBLE) AS similarity, coalesce(similarity, 0.0::DOUBLE) * 0.62 + ({RECENCY.format('ts', ASOF)}) * 0.1 + ({ALT.format('value')}) * 0.1 + {QUALITY} * 0.05
               + CASE WHEN lang = 'de' THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN source = 'src3' THEN 0.1::DOUBLE ELSE 0 END AS score FROM f LEFT JOIN m ON m.doc_id = f.doc_id LEFT JOIN {JOURNALS} ON j.venue = f.source),
        r AS (SELECT *, source = 'src3' AS pre FROM y WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 25 DAY), cut AS ({CAP.format(order='score DESC, doc_id', rows='r')})
        SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, round(similarity, 4) AS similarity, round(score, 6) AS score, CASE WHEN abs(score - 0.5) > 1e-6 THEN {LABEL} END AS label,
               CASE WHEN doc_id % 2 = 0 THEN 'http://page.example' ELSE 'http://resolved.example/' || source END AS url FROM cut WHERE NOT pre OR p > was ORDER BY rank LIMIT 20""",
    "q_step_counts": f"""WITH x AS (SELECT doc_id, ts, source IN ('src3', 'src4', 'src5', 'src6', 'src7', 'src8') AS pre, doc_id % 11 <> 0 AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY AS ok FROM {EVENTS}),
        r AS (SELECT * FROM x WHERE ok), cut AS ({CAP.format(order='doc_id DESC', rows='r')})
        SELECT 'recency' AS step, count(*) AS removed FROM x WHERE NOT ok UNION ALL SELECT 'preprints', count(*) FROM cut WHERE pre AND p <= was""",
}
SQL["q_fuzzy_components"] = SQL["q_fuzzy_dedupe"]
SQL["q_report_document"] = "SELECT row_number() OVER (ORDER BY (doc_id * 7919 % 1000) / 10::DOUBLE DESC, doc_id) AS rank, doc_id FROM documents"
