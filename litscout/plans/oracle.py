"""The SQL for DuckDB of the queries in ``queries``; that of ``source_queries`` is in ``source_oracle``."""

from __future__ import annotations

from .queries import ASOF, CANDIDATE, DOCS, LIBRARY

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
# Unicode white space as Python's str knows it
WS = r"[\s\x0B\x1C-\x1F\x85\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def has(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


HAY = "lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(venue, '')))"
XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def xml(x: str) -> str:
    return XML.format(x)


def attr(x: str) -> str:
    return f"""replace(replace({xml(x)}, '"', '&#34;'), '''', '&#39;')"""


RANKED = """(SELECT doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS identifier, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 2 = 0 THEN text END AS abstract,
  lang || ', ' || source AS authors, CASE WHEN doc_id % 3 = 0 THEN 'http://x/?a=1&b=' || doc_id END AS url, CASE WHEN doc_id % 7 > 0 THEN ts END AS published,
  CASE WHEN doc_id % 5 > 0 THEN source END AS venue, (doc_id % 8) / 8.0::DOUBLE AS score, 0.25::DOUBLE AS similarity, 'consider' AS label
  FROM documents JOIN events ON event_id = doc_id)"""
#: The references that occur in the pages; ``&amp`` counts without its semicolon.
UNESCAPED = "regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
RFC = "strftime({}, '%a, %d %b %Y %H:%M:%S +0000')"
DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
CAP = """
SELECT *, coalesce(lag(p) OVER (ORDER BY {order}), 0) AS was FROM (
 SELECT *, j + least(0, coalesce(min(slack) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING), 0)) AS p FROM (
  SELECT *, CASE WHEN pre THEN 3 * q // 7 - j END AS slack FROM (
   SELECT *, sum(CASE WHEN pre THEN 1 ELSE 0 END) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS j,
          sum(CASE WHEN pre THEN 0 ELSE 1 END) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS q
   FROM {rows})))
"""
RECENCY = "CASE WHEN datesub('day', {0}, TIMESTAMP '{1}') <= 3 THEN 1.0::DOUBLE WHEN datesub('day', {0}, TIMESTAMP '{1}') <= 7 THEN 0.7::DOUBLE WHEN datesub('day', {0}, TIMESTAMP '{1}') <= 30 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END"
WORDS = r"(SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents))"
LOG = "(SELECT user_id AS key, event_id AS version, event_type, value FROM events)"

SQL = {
    "q_exact_dedupe": f"SELECT doc_id FROM (SELECT ordinal AS doc_id, row_number() OVER (PARTITION BY {strip('lower(abstract)')} ORDER BY ordinal) AS k FROM {DOCS} WHERE {strip('abstract')} <> '') WHERE k = 1",
    "q_topic_filter": f"""SELECT ordinal AS doc_id FROM (SELECT ordinal, {HAY} AS h FROM {DOCS}) WHERE NOT {has('h', ['ouen the', 'zu_der'])}
        AND ({has('h', ['the ', 'de '])} AND {has('h', ['tion', 'ment'])} OR {has('h', ['die'])} AND {has('h', ['keit', 'lich'])}) AND {has('h', ['er', 'la'])}""",
    "q_topic_groups": f"""SELECT doc_id FROM (SELECT ordinal AS doc_id, row_number() OVER (PARTITION BY {strip('lower(abstract)')} ORDER BY ordinal) AS k
        FROM (SELECT *, {HAY} AS h FROM {DOCS}) WHERE NOT {has('h', ['casino'])} AND {has('h', ['of', 'des'])} AND {has('h', ['in'])} AND {strip('abstract')} <> '') WHERE k = 1""",
    "q_library_anti": f"""SELECT doc_id FROM documents d WHERE {CANDIDATE} AND {strip('lower(text)')} NOT IN (SELECT {strip('lower(text)')} FROM documents WHERE {LIBRARY})
        AND NOT EXISTS (SELECT 1 FROM documents l WHERE l.{LIBRARY} AND l.doc_id % 20 = d.doc_id % 50)""",
    "q_title_normalize": f"SELECT ordinal, {strip('title')} AS clean, lower({collapse('title')}) AS norm FROM {DOCS}",
    "q_identifier_normalize": f"""SELECT page_id, {strip('lower(u)')} AS norm, CASE WHEN lower({strip('u')}) LIKE 'http%' THEN {strip('u')} ELSE 'https://doi.org/' || {strip('u')} END AS doi_url,
        regexp_matches(u, '^(?i)https?://(dx\\.)?doi\\.org/') AS is_doi FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/10.1/' || page_id ELSE upper(url) END AS u FROM pages)""",
    "q_strip_html": f"SELECT page_id, nullif({collapse(chr(114) + 'egexp_replace(html, ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')}, '') AS plain FROM pages",
    "q_abstract_unescaped": f"SELECT page_id, md5({collapse('regexp_replace(' + UNESCAPED + ', ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')}) AS digest FROM pages",
    "q_inverted_index_text": f"SELECT doc_id, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM {WORDS} GROUP BY doc_id",
    "q_year_extract": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
    "q_author_join": "SELECT c_custkey, trim(concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_mktsegment, '') END, CASE WHEN c_custkey % 5 <> 0 THEN nullif(c_name, '') END)) AS name FROM customer",
    "q_content_hash": "SELECT doc_id, sha256(text || lang || CASE WHEN source = 'src0' THEN '' ELSE source END) AS digest FROM documents",
    "q_haystack": f"""SELECT ordinal, md5(lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), CASE WHEN venue <> 'src0' THEN venue END))) AS hay,
        md5(concat_ws(chr(10), nullif(title, ''), nullif(abstract, ''), venue || '; b')) AS embed FROM {DOCS}""",
    "q_json_metrics": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, true AS suffix_rejected FROM events",
    "q_date_parse": f"""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, {RFC.format("date_trunc('day', ts)")} AS rfc, true AS no_date FROM events""",
    "q_recency_score": f"SELECT event_id, greatest(datesub('day', ts, TIMESTAMP '{ASOF}'), 0) AS days, {RECENCY.format('ts', ASOF)} AS recency FROM events",
    "q_log_metric": "SELECT event_id, CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE round(ln(1 + value), 9) END AS metric FROM events",
    "q_journal_quality": """WITH m AS (SELECT lower(p_brand) AS k, round(avg(p_retailprice) / 500, 6) AS sjr FROM part WHERE p_brand < 'Brand#4' GROUP BY p_brand)
        SELECT p_partkey, round(CASE WHEN m.sjr IS NULL THEN 1.0::DOUBLE ELSE greatest(ln(1 + m.sjr), 1.0::DOUBLE) END, 9) AS quality, round(m.sjr, 6) AS sjr FROM part LEFT JOIN m ON lower(p_brand) = m.k""",
    "q_whitelist_bonus": "SELECT conv_id, CASE WHEN bool_or(lower(role) IN ('system', ' user')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM conversations GROUP BY conv_id",
    "q_label": """SELECT event_id, s AS score, CASE WHEN s >= 0.75 THEN 'must_read' WHEN s >= 0.5 THEN 'consider' ELSE 'ignore' END AS label
        FROM (SELECT event_id, round(value * 0.01::DOUBLE + 0.25::DOUBLE * 0.5::DOUBLE, 9) AS s FROM events)""",
    "q_top1_similarity": f"SELECT a.vec_id, round(max({DOT}), 4) AS similarity FROM embeddings a, embeddings b WHERE a.label >= 5 AND b.label < 5 GROUP BY a.vec_id",
    "q_topk_similarity": f"""SELECT vec_id, rank, round(s, 4) AS similarity FROM (SELECT a.vec_id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b WHERE a.label >= 5 AND b.label < 5) WHERE rank <= 5""",
    "q_cell_index": f"""SELECT vec_id, rank, round(s, 4) AS similarity FROM (SELECT a.vec_id, {DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b) WHERE rank <= 2""",
    "q_centroid": """WITH m AS (SELECT pos, avg(x::DOUBLE) AS m FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY pos)
        SELECT CAST(pos AS BIGINT) AS pos, round(m / (sqrt(sum(m * m) OVER ()) + 1e-12), 6) AS x FROM m""",
    "q_l2_normalize": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * (vec_id + 1) AS x FROM embeddings)
        SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-12), 6) AS x FROM e""",
    "q_top_authors": f"SELECT author, count FROM (SELECT word AS author, count(*) AS count, min((doc_id, pos)) AS first FROM {WORDS} GROUP BY word ORDER BY count DESC, first LIMIT 20)",
    "q_top_venues": "SELECT source AS venue, count(*) AS count FROM documents WHERE source NOT IN ('src3', '') GROUP BY source ORDER BY count DESC, min(doc_id) LIMIT 20",
    "q_profile_summary": """WITH x AS (SELECT * FROM documents JOIN embeddings ON doc_id = vec_id), a AS (SELECT lang, count(*) AS n FROM x GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1)
        SELECT (SELECT count(*) FROM x) AS item_count, 'given-vectors' AS model, CAST(64 AS BIGINT) AS dims, lang AS first_author, n AS author_count FROM a""",
    "q_ordered_distinct": "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type",
    "q_upsert_latest": f"SELECT key, version, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS k FROM {LOG}) WHERE k = 1",
    "q_tombstone": f"SELECT key, version FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS k FROM {LOG}) WHERE k = 1 AND event_type <> 'error'",
    "q_cursor_max": f"SELECT max(version) AS cursor, count(*) AS fetched FROM {LOG}",
    "q_incremental_state": """WITH x AS (SELECT user_id AS key, event_id AS version, event_type, ts < TIMESTAMP '2024-01-28' AS old FROM events),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS k FROM x WHERE old) WHERE k = 1),
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS k FROM x WHERE NOT old) WHERE k = 1)
        SELECT coalesce(n.key, b.key) AS key, greatest(n.version, b.version) AS version, CASE WHEN b.key IS NULL OR n.version > b.version THEN n.event_type ELSE b.event_type END AS event_type,
               CASE WHEN b.key IS NULL THEN true WHEN n.version > b.version THEN n.event_type <> b.event_type ELSE false END AS stale
        FROM b FULL JOIN n ON b.key = n.key WHERE coalesce(n.event_type, '') <> 'error'""",
    "q_recent_filter": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY",
    "q_stable_rank": "SELECT row_number() OVER (ORDER BY floor(o_totalprice / 10000) DESC, o_orderkey) AS rank, o_orderkey FROM orders ORDER BY rank LIMIT 50",
    "q_preprint_cap": "SELECT event_id FROM (" + CAP.format(order="value DESC, event_id", rows="(SELECT event_id, value, event_type IN ('view', 'click') AS pre FROM events)") + ") WHERE NOT pre OR p > was",
    "q_limit_per_query": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 10",
    "q_union_sources": f"""SELECT source, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM (
        SELECT 'graph' AS source, split_part(text, chr(10), 1) AS title, doc_id AS ordinal FROM documents
        UNION ALL SELECT 'registry', {TITLE}, 1099511627776 + page_id FROM pages UNION ALL SELECT 'arxiv', text, 2199023255552 + item_id FROM benchmark) WHERE {strip('title')} <> '' GROUP BY source""",
    "q_enrich_join": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND lang <> '' THEN lang WHEN lang <> 'en' THEN source WHEN doc_id % 3 > 0 THEN lang END AS abstract,
        CASE WHEN doc_id % 4 = 0 THEN 'http://own.example/x' WHEN lang <> 'en' AND (doc_id % 3 = 0 OR doc_id % 4 = 1) THEN 'http://page.example/y'
             WHEN source < 'src15' THEN 'http://resolved.example/z' WHEN doc_id % 4 = 1 THEN 'HTTPS://DX.DOI.ORG/10.1' WHEN doc_id % 4 = 2 THEN '' END AS url FROM documents""",
    "q_rss_items": f"""SELECT ordinal, '<item><title>' || {xml('title')} || '</title>' || coalesce('<link>' || {xml('url')} || '</link>', '') || '<guid>' || identifier || '</guid><pubDate>'
        || {RFC.format(f"coalesce(published, TIMESTAMP '{ASOF}')")} || '</pubDate>' || coalesce('<category>' || {xml('venue')} || '</category>', '') || '<description>'
        || concat_ws(chr(10), {xml('abstract')}, 'Published: ' || coalesce(strftime(published, '%Y-%m-%dT%H:%M:%S+00:00'), 'Unknown'), 'Venue: ' || coalesce(venue, 'Unknown')) || '</description></item>' AS item FROM {RANKED}""",
    "q_report_rows": f"""SELECT rank, '<section><h2>' || rank || '. <a href="' || coalesce({attr('url')}, '#') || '">' || {attr('title')} || '</a></h2><p>Label: ' || label || ' | Score: ' || printf('%.3f', score)
        || ' | Similarity: ' || printf('%.3f', similarity) || ' | Published: ' || coalesce(strftime(published, '%Y-%m-%d'), 'Unknown') || ' | Venue: ' || coalesce(venue, 'Unknown') || '</p>'
        || coalesce('<p>' || {attr('abstract')} || '</p>', '') || '<p>Authors: ' || authors || '</p></section>' AS html, 'report-20240201.html' AS file
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal) AS rank FROM {RANKED}) WHERE rank <= 50""",
    "q_push_payload": f"""SELECT ordinal, '{{"itemType":"note","note":"Recommended due to score ' || printf('%.3f', score) || '","tags":[{{"tag":"litscout"}},{{"tag":"' || label || '"}}],"collections":["C1"]}}' AS body FROM {RANKED}""",
}
