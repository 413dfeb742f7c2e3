"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from prosegrid.functions.pii import PATTERNS
from prosegrid.functions.sentiment import LEXICON

_SPACE = r"[\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS payload_id, text FROM documents"
_TALK = "SELECT concat_ws('-', conv_id, turn) AS payload_id, role, text FROM conversations"
_PUNCTUATION = r"""[!-/:-@\[-`{-~]+"""


def _tokens(change: str, keep: str = "x <> ''") -> str:
    """A cleaning step over the white-space tokens of documents; ``x`` is a token."""
    return f"""SELECT payload_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> ''), lambda x: {change}), lambda x: {keep}), ' ') AS processed_text FROM ({_DOCS})"""


def _boundary(at: str) -> str:
    """The last place at or before ``at`` where a chunk may end; t has blanks for all white space."""
    return f"(CASE WHEN {at} <= 0 THEN 0 WHEN {at} >= length(t) THEN length(t) WHEN strpos(reverse(t[1 : {at} + 1]), ' ') = 0 THEN 0 ELSE {at} + 1 - strpos(reverse(t[1 : {at} + 1]), ' ') END)"


def _chunks(segments: str, limit: int, stride: int) -> str:
    """Tables s (doc, segment, text, t) and c (chunks by their bounds) of a recursive query."""
    begin = f"(CASE WHEN {stride} > 0 AND n > 0 THEN {_boundary(f'(e + 1 - {stride})')} + 1 ELSE e + 1 END)"
    return f"""WITH RECURSIVE s AS (SELECT doc, segment, text, translate(text, chr(10) || chr(9), '  ') AS t FROM ({segments}) WHERE text <> ''),
c AS (SELECT doc, segment, t, 0 AS n, 0 AS b, CAST({_boundary(f'least({limit}, length(t))')} AS BIGINT) AS e FROM s
  UNION ALL SELECT doc, segment, t, n, b, CAST({_boundary(f'least(b + {limit}, length(t))')} AS BIGINT) AS e
  FROM (SELECT doc, segment, t, n + 1 AS n, CAST({begin.replace('n > 0', 'TRUE')} AS BIGINT) AS b FROM c WHERE e + 1 < length(t))),
k AS (SELECT doc, segment, n, substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) AS phrase FROM c JOIN s USING (doc, segment) WHERE e > b),
chunks AS (SELECT doc AS document_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY segment, n) - 1 AS INTEGER) AS chunk_id, CAST(length(phrase) AS INTEGER) AS chunk_length,
  CAST(count(*) OVER (PARTITION BY doc) AS INTEGER) AS total_chunks, phrase FROM k)
"""


_WHOLE = "SELECT CAST(doc_id AS VARCHAR) AS doc, 0 AS segment, text FROM documents"
_LINES = "SELECT doc, generate_subscripts(parts, 1) AS segment, unnest(parts) AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS doc, string_split(text, chr(10)) AS parts FROM documents)"
_SCORES = """, scored AS (SELECT document_id AS payload_id, phrase, label, (length(phrase) - length(replace(phrase, label, ''))) / CAST(length(phrase) AS DOUBLE) AS score
  FROM chunks, (VALUES ('e'), ('t')) AS l(label)), kept AS (SELECT * FROM scored WHERE score > 0.02),
sizes AS (SELECT document_id AS payload_id, sum(length(phrase)) AS size, sum(length(phrase)) + count(*) - 1 AS n_chars FROM chunks GROUP BY 1)
"""
_VALENCES = ", ".join(f"('{w}', {v})" for w, v in LEXICON.items())


def _compound(source: str) -> str:
    """(payload_id, c) by lexicon for rows (payload_id, text)."""
    return f"""SELECT payload_id, CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END AS c FROM (SELECT payload_id, coalesce(sum(CAST(v AS DOUBLE)), 0) AS s
FROM (SELECT payload_id, unnest(string_split_regex(lower(text), '[^a-z'']+')) AS w FROM ({source})) LEFT JOIN (VALUES {_VALENCES}) AS l(w, v) USING (w) GROUP BY payload_id)"""


def _two_sided(source: str) -> str:
    return f"""SELECT payload_id, label, round(CASE WHEN label = 'positive' THEN p ELSE 1 - p END, 6) AS score
FROM (SELECT payload_id, CASE WHEN c < 0 THEN 1 + c ELSE c END AS p FROM ({_compound(source)})), (VALUES ('positive'), ('negative')) AS n(label)"""


_EMAIL = PATTERNS["EMAIL_ADDRESS"][0]
_IP = PATTERNS["IP_ADDRESS"][0]
_CLEAN = f"""SELECT doc_id, lang, array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(text), '{_SPACE}+'), lambda x: x <> ''),
 lambda x: regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')), lambda x: x <> ''), ' ') AS text FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {
        "flagship_clean_score_flatten": f"""SELECT payload_id, 'documents' AS source_name, lang AS meta_lang, CAST(length(text) AS INTEGER) AS n_clean,
            round(CASE WHEN c < 0 THEN 1 + c ELSE c END, 6) AS positive, round(CASE WHEN c < 0 THEN -c ELSE 1 - c END, 6) AS negative
            FROM (SELECT CAST(doc_id AS VARCHAR) AS payload_id, lang, text FROM ({_CLEAN})) JOIN ({_compound(f'SELECT CAST(doc_id AS VARCHAR) AS payload_id, text FROM ({_CLEAN})')}) USING (payload_id)""",
        "source_dataframe_concat": "SELECT CAST(p_partkey AS VARCHAR) AS payload_id, concat_ws(' ', p_name, p_brand, p_type) AS processed_text, 'Pandas' AS source_name FROM part",
        "source_include_columns": "SELECT CAST(doc_id AS VARCHAR) AS payload_id, concat_ws('/', lang, source) AS processed_text, lang AS meta_lang, n_chars AS meta_n_chars FROM documents",
        "source_lookback_filter": "SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
        "source_newest_per_key": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20",
        "source_cursor_state": "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(max(ts)) AS since_micros, arg_max(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS since_id FROM events GROUP BY user_id",
        "source_incremental": "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
        "source_user_enrich": "SELECT o_orderkey AS id, c_name AS username, 'https://twitter.com/' || c_name AS user_url, 'https://twitter.com/twitter/statuses/' || o_orderkey AS tweet_url FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "source_search_match": "SELECT conv_id, turn FROM conversations WHERE (contains(lower(text), 'please') OR contains(lower(text), 'explain') OR contains(lower(text), '#help') OR contains(lower(text), 'the')) AND NOT turn > 2 AND NOT role = 'system'",
        "source_search_payloads": "SELECT CAST(event_id AS VARCHAR) AS payload_id, concat_ws(' ', event_type, props) AS processed_text FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
        "source_comments_of_posts": "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS payload_id, concat(l_returnflag, l_linestatus) AS processed_text FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-06-01' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01')",
        "source_forum_comments": "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS payload_id, l_returnflag AS processed_text, o_orderstatus AS post_title FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '1996-06-01' AND l_linenumber <= 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
        "source_feed": "SELECT CAST(event_id AS VARCHAR) AS payload_id, event_type || '. ' || user_id AS processed_text FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
        "source_app_address": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'us' END AS country, CASE WHEN p_partkey % 7 <> 0 THEN lower(replace(p_brand, '#', '-')) END AS app_name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS app_id FROM part",
        "source_package_address": "SELECT p_partkey, 'com.' || replace(p_brand, '#', '.') AS package_name, 'us' AS country, 'en' AS language FROM part",
        "source_app_reviews": "SELECT CAST(event_id AS VARCHAR) AS payload_id, concat_ws('. ', event_type, props) AS processed_text FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts > TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
        "source_package_reviews": "SELECT CAST(event_id AS VARCHAR) AS payload_id, props AS processed_text FROM events WHERE event_type IN ('click', 'view', 'purchase') AND user_id % 5 + 1 = 3 AND ts > TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200",
        "source_publisher_reviews": "SELECT CAST(event_id AS VARCHAR) AS payload_id, props AS processed_text FROM events",
        "source_place_reviews": "SELECT l_orderkey || '-' || l_linenumber AS payload_id, l_returnflag AS processed_text, l_suppkey AS place_id, 'place' AS kind FROM lineitem WHERE epoch(l_shipdate) > epoch(TIMESTAMP '1996-06-01')",
        "source_news": "SELECT CAST(event_id AS VARCHAR) AS payload_id, event_type || '.' || chr(10) || chr(10) || ' ' || user_id AS processed_text FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100",
        "source_video_comments": "SELECT CAST(event_id AS VARCHAR) AS payload_id, event_type AS processed_text FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 30",
        "source_polled": "SELECT key, CAST(n AS VARCHAR) AS id, CAST(1700000000 + 60 * n AS BIGINT) AS ts, key || ' ' || n AS text FROM (VALUES ('us'), ('fr'), ('de')) AS k(key), (SELECT unnest(range(51, 101)) AS n)",
        "clean_lower": _tokens("lower(x)"),
        "clean_whitespace": f"SELECT payload_id, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS processed_text FROM ({_DOCS})",
        "clean_punctuation": _tokens(f"regexp_replace(x, '{_PUNCTUATION}', '', 'g')"),
        "clean_special_chars": _tokens("regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')"),
        "clean_stop_words": _tokens("x", "x NOT IN ('the', 'of', 'and', 'in', 'to', 'de', 'la', 'der', 'die', 'und', 'que', 'el')"),
        "clean_domain_keywords": f"""SELECT payload_id, array_to_string(list_filter(string_split(replace(replace(replace(array_to_string(list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> ''), ' '),
            'the', 'THE'), 'tion', 'TION'), 'la ', 'LA '), ' '), lambda x: x <> ''), ' ') AS processed_text FROM ({_DOCS})""",
        "clean_regex": _tokens(r"regexp_replace(x, '([a-z])([0-9])', '\1 \2', 'g')"),
        "split_chars": _chunks(_WHOLE, 512, 0) + "SELECT document_id, chunk_id, chunk_length, total_chunks, phrase FROM chunks",
        "split_stride": _chunks(_WHOLE, 512, 128) + "SELECT document_id, chunk_id, chunk_length, total_chunks, phrase FROM chunks",
        "split_paragraph": _chunks(_LINES, 128, 0) + "SELECT document_id, chunk_id, chunk_length, total_chunks, phrase FROM chunks",
        "analyze_dummy": "SELECT CAST(doc_id AS VARCHAR) AS payload_id, 'seen' AS dummy_data FROM documents",
        "analyze_merge_precedence": "SELECT CAST(doc_id AS VARCHAR) AS payload_id, 'first' AS dummy_data FROM documents",
        "analyze_sentiment_lexicon": _two_sided(_TALK),
        "util_sentiment_score": f"SELECT payload_id, round(c, 6) AS compound FROM ({_compound(_TALK)})",
        "analyze_classify": "SELECT CAST(doc_id AS VARCHAR) AS payload_id, CASE WHEN length(text) >= 500 THEN 'long' ELSE 'short' END AS label, CAST(0.75 AS DOUBLE) AS score FROM documents",
        "analyze_pii_email": f"SELECT payload_id, len(regexp_extract_all(text, '{_EMAIL}')) AS n_found FROM ({_DOCS})",
        "analyze_pii_ip": f"SELECT payload_id, len(list_filter(regexp_extract_all(text, '{_IP}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS INTEGER))) < 256)) AS n_found FROM ({_DOCS})",
        "anonymize_pii": f"SELECT payload_id, regexp_replace(text, '{_EMAIL}', '<EMAIL_ADDRESS>', 'g') AS processed_text FROM ({_DOCS})",
        "aggregate_average": _chunks(_WHOLE, 512, 0) + _SCORES + """SELECT payload_id, CAST(n_chars AS INTEGER) AS n_chars, label, round(sum(score * length(phrase)) / max(size), 6) AS score
            FROM sizes LEFT JOIN kept USING (payload_id) GROUP BY payload_id, n_chars, label""",
        "aggregate_max_categories": _chunks(_WHOLE, 512, 0) + _SCORES + "SELECT payload_id, label, CAST(count(*) AS INTEGER) AS n, round(max(score), 6) AS top FROM kept WHERE score > 0.11 GROUP BY payload_id, label",
        "aggregate_passthrough": f"SELECT payload_id, text AS processed_text FROM ({_TALK})",
        "sink_flatten": "SELECT event_id, event_type AS meta_event_type, user_id AS meta_who_user_id, printf('%.2f', value) AS meta_who_value FROM events",
        "sink_frame_append": "SELECT 'old' AS payload_id, 'kept' AS note, NULL AS source_name, NULL AS segmented_data_dummy_data UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'documents', 'x' FROM documents",
        "sink_sentiment_rule": """SELECT event_id, CASE WHEN n > 8.0 THEN 'Strong Negative' WHEN n > 0.3 THEN 'Negative' WHEN p >= 0.8 THEN 'Strong Positive' WHEN p > 0.4 THEN 'Positive' ELSE 'Neutral' END AS label
            FROM (SELECT event_id, 1 - (event_id % 101) / CAST(100 AS DOUBLE) AS p, (event_id % 101) / CAST(100 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS n FROM events)""",
        "sink_json_action": f"""SELECT payload_id, '{{"create":{{"_index":"es_index"}}}}' AS action, text, role FROM ({_TALK})""",
        "util_parse_time": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 2 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT)
            WHEN 3 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS epoch FROM events""",
        "state_upsert": "SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "stream_incremental": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY event_type",
        "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_epoch, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    }
