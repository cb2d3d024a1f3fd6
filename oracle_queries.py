"""SQL counterparts of the registered queries, for DuckDB.

They compute every answer from the columns the log lines were rendered from; only the views with
odd text (conversations, documents, pages) apply a pattern, in another regex dialect than Spark's.
"""

from __future__ import annotations

_LOG = r"""
WITH log AS (
    SELECT
        event_id,
        event_id % 97 = 0 AS is_junk,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
        (user_id // 256) || '-*' || (user_id % 256 % 10) AS ip_group,
        '/' || event_type || '/' || (event_id % 50) || '?k=' || json_extract_string(props, '$.k')
            AS path,
        '/' || event_type || '/' || (event_id % 50) AS path_only,
        event_type || '#' || (event_id % 50 % 10) AS path_group,
        'ua/' || (user_id % 7) AS user_agent,
        CASE WHEN user_id % 7 <= 2 THEN 'early ' || (user_id % 7) ELSE 'ua/' || (user_id % 7) END AS agent_group,
        CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status_code,
        CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END
            AS traffic_bytes,
        strftime(ts, '%d/') || CASE WHEN event_id % 101 = 0 THEN 'Foo' ELSE strftime(ts, '%b') END
            || strftime(ts, '/%Y:%H:%M:%S') || ' +0000' AS timestamp_str,
        CASE WHEN event_id % 101 <> 0 THEN strftime(ts, '%Y-%m-%d %H:00') END AS hour,
        CASE WHEN event_id % 101 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day,
        CASE WHEN event_id % 101 <> 0 THEN strftime(ts, '%Y-%m') END AS month
    FROM events
),
rec AS (SELECT * FROM log WHERE NOT is_junk)
"""


def _count(kind: str, bucket: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, {bucket} AS bucket, count(*) AS visits, "
        f"CAST(sum(traffic_bytes) AS BIGINT) AS traffic_bytes FROM rec "
        f"WHERE {bucket} IS NOT NULL GROUP BY ALL"
    )


def _counters(ip="ip", path="path", user_agent="user_agent", log=None) -> str:
    parts = [
        _count("dimension:ip", ip),
        _count("dimension:path", path),
        _count("dimension:user-agent", user_agent),
        _count("dimension:status", "status_code"),
        _count("trend:hour", "hour"),
        _count("trend:day", "day"),
        _count("trend:month", "month"),
        _count("meta:total", "'all'"),
        "SELECT 'meta:parse_errors' AS kind, 'all' AS bucket, count(*) AS visits, "
        "CAST(0 AS BIGINT) AS traffic_bytes FROM log WHERE is_junk HAVING count(*) > 0",
    ]
    return (log or _LOG) + ", counters AS (" + " UNION ALL ".join(parts) + ")\n"


_COUNTERS = _counters()


def _dimension(column: str) -> str:
    return (
        _LOG + f"SELECT {column} AS bucket, count(*) AS visits, "
        "CAST(sum(traffic_bytes) AS BIGINT) AS traffic_bytes FROM rec "
        f"WHERE {column} IS NOT NULL GROUP BY ALL"
    )


def _ranked(column: str, sort_by: str, name: str = "ranked") -> str:
    """Buckets of one column with shares and rank."""
    metric = {"visits": "visits", "traffic": "traffic_bytes"}[sort_by]
    return f"""
{name} AS (
    SELECT key, visits, traffic_bytes,
        CAST(visits AS DOUBLE) / CAST(sum(visits) OVER () AS DOUBLE) * 100 AS visit_pct,
        CASE WHEN sum(traffic_bytes) OVER () = 0 THEN 0.0
            ELSE CAST(traffic_bytes AS DOUBLE) / CAST(sum(traffic_bytes) OVER () AS DOUBLE) * 100
            END AS traffic_pct,
        CAST(row_number() OVER (ORDER BY {metric} DESC, visits DESC, key) AS INTEGER) AS rank
    FROM (
        SELECT {column} AS key, count(*) AS visits,
            CAST(sum(traffic_bytes) AS BIGINT) AS traffic_bytes
        FROM rec GROUP BY ALL
    )
)"""


_METRIC_ROW = "key, visits, traffic_bytes, visit_pct, traffic_pct"


def _top(column: str, sort_by: str, top: int = 30) -> str:
    return _LOG + f", {_ranked(column, sort_by)} SELECT {_METRIC_ROW} FROM ranked WHERE rank <= {top}"


def _human(value: str) -> str:
    return f"""CASE WHEN {value} < 1024 THEN {value} || ' B'
        WHEN {value} < 1024 * 1024 THEN printf('%.2f KB', {value} / 1024e0)
        WHEN {value} < 1024 * 1024 * 1024 THEN printf('%.2f MB', {value} / 1024e0 / 1024e0)
        WHEN {value} < 1024 * 1024 * 1024 * 1024::BIGINT
            THEN printf('%.2f GB', {value} / 1024e0 / 1024e0 / 1024e0)
        ELSE printf('%.2f TB', {value} / 1024e0 / 1024e0 / 1024e0 / 1024e0) END"""


# White space of all of Unicode, which \s does not cover in this dialect.
_WS = (
    r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

_PAGES = rf"""
WITH rec AS (
    SELECT page_id, regexp_extract(url, '^[^{_WS}]+') AS path,
        CAST(strlen(html) AS BIGINT) AS traffic_bytes
    FROM pages
)
"""


def _page_groups(bucket: str) -> str:
    return (
        _PAGES + f"SELECT {bucket} AS bucket, count(*) AS visits, "
        "CAST(sum(traffic_bytes) AS BIGINT) AS traffic_bytes FROM rec GROUP BY ALL"
    )


def _trend_points(bucket: str, label_end: int) -> str:
    return _LOG + (
        f"SELECT row_number() OVER (ORDER BY {bucket}) - 1 AS x, {bucket} AS bucket, "
        f"substr({bucket}, 6, {label_end - 5}) AS label, count(*) AS visits, "
        "CAST(sum(traffic_bytes) AS BIGINT) AS traffic_bytes FROM rec "
        f"WHERE {bucket} IS NOT NULL GROUP BY {bucket}"
    )


_RECORD = """
    CASE WHEN NOT is_junk THEN ip END AS ip,
    CASE WHEN NOT is_junk THEN path END AS path,
    CASE WHEN NOT is_junk THEN user_agent END AS user_agent,
    CASE WHEN NOT is_junk THEN status_code END AS status_code,
    CASE WHEN NOT is_junk THEN traffic_bytes END AS traffic_bytes,
    CASE WHEN NOT is_junk THEN timestamp_str END AS timestamp_str
"""

_ALL_DIMENSIONS = ", ".join(
    _ranked(column, "traffic", f"by_{name}")
    for name, column in (
        ("ip", "ip"),
        ("path", "path"),
        ("user_agent", "user_agent"),
        ("status", "status_code"),
    )
)

_TOP_TEN_OF_ALL = _LOG + f", {_ALL_DIMENSIONS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, rank, {_METRIC_ROW} FROM by_{name} WHERE rank <= 10"
    for name in ("ip", "path", "user_agent", "status")
)

_HUGE = """
WITH rec AS (
    SELECT CAST(200 + event_id % 5 AS VARCHAR) AS status_code,
        CASE event_id % 5
            WHEN 0 THEN 18446744073709551615::HUGEINT - user_id
            WHEN 1 THEN 9223372036854775807::HUGEINT + user_id
            WHEN 2 THEN 0::HUGEINT
            WHEN 3 THEN 9223372036854775807::HUGEINT - user_id
            ELSE user_id::HUGEINT
        END AS traffic_bytes
    FROM events
)
"""

_TWICE = _LOG.replace("FROM events", "FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
_ODD = (
    _LOG.replace("event_id % 97 = 0 AS is_junk", "event_id % 97 = 0 OR (event_id % 11 = 0 AND event_id % 7 <> 0) AS is_junk")
    .replace("json_extract_string(props, '$.k')\n            AS path", "json_extract_string(props, '$.k')\n            AS path_0")
    .replace("(user_id % 7) AS user_agent", "(user_id % 7) AS user_agent_0")
    .replace("rec AS (SELECT * FROM log WHERE NOT is_junk)", """
rec AS (
    SELECT *, CASE WHEN event_id % 7 = 0 THEN '-' ELSE path_0 END AS path,
        CASE WHEN event_id % 7 = 0 AND event_id % 89 <> 0 THEN '-' ELSE user_agent_0 END AS user_agent
    FROM log WHERE NOT is_junk
)""")
)

ORACLE_SQL = {
    "several_inputs": _counters(log=_TWICE) + "SELECT * FROM counters",
    "odd_file_names": _COUNTERS + "SELECT * FROM counters",
    "carriage_returns": _COUNTERS + "SELECT * FROM counters",
    "undecodable_and_bare_lines": _counters(log=_ODD) + "SELECT * FROM counters",
    "save_and_export": _COUNTERS + """
SELECT * FROM counters WHERE kind <> 'meta:parse_errors'
""",
    "bars_by_visits": _LOG + f", {_ranked('ip', 'visits')}" + """
SELECT rank, CASE WHEN length(key) > 14 THEN substr(key, 1, 13) || '~' ELSE key END AS label,
    visits AS value, CAST(visits AS VARCHAR) AS value_text
FROM ranked WHERE rank <= 20
""",
    "huge_byte_counts": _HUGE + """
SELECT status_code AS bucket, count(*) AS visits, CAST(sum(traffic_bytes) AS VARCHAR) AS traffic_bytes
FROM rec GROUP BY ALL
""",
    "human_bytes_of_huge_sums": _HUGE + """
SELECT count(*) AS visits,
    printf('%.2f TB', CAST(sum(traffic_bytes) AS DOUBLE) / 1024e0 / 1024e0 / 1024e0 / 1024e0) AS traffic_text
FROM rec
""",
    "top_paths_without_query": _top("path_only", "traffic"),
    "parse_lines": _LOG + f"SELECT event_id, {_RECORD} FROM log",
    "parse_fallback_lines": _LOG + f"SELECT event_id, {_RECORD} FROM log",
    "parse_page_requests": _PAGES + "SELECT page_id, path, traffic_bytes FROM rec",
    "request_path": _LOG + "SELECT event_id, path FROM log",
    "request_path_any_text": rf"""
SELECT conv_id, turn,
    coalesce(nullif(regexp_extract(text, '^[{_WS}]*[^{_WS}]+[{_WS}]+([^{_WS}]+)', 1), ''), '-')
        AS path
FROM conversations
""",
    "parse_bytes": r"""
SELECT
    CASE WHEN regexp_full_match(token, '\+?[0-9]+')
        THEN coalesce(try_cast(ltrim(token, '+') AS BIGINT), 0) ELSE 0 END AS traffic_bytes,
    count(*) AS tokens
FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS token FROM documents)
GROUP BY ALL
""",
    "parse_error_count": _LOG + """
SELECT count(*) AS lines, count_if(is_junk)::BIGINT AS parse_errors
FROM log
""",
    "rejected_lines": _LOG + "SELECT event_id, 'garbage ' || event_id AS value FROM log WHERE is_junk",
    "timestamp_buckets": _LOG + """
SELECT event_id, CASE WHEN NOT is_junk THEN hour END AS hour,
    CASE WHEN NOT is_junk THEN day END AS day, CASE WHEN NOT is_junk THEN month END AS month
FROM log
""",
    "group_ip_subnet": _dimension("ip_group"),
    "group_path_first_segment": _dimension("path_group"),
    "group_path_strip_query": _dimension("path_only"),
    "group_user_agent": _dimension("agent_group"),
    "group_page_url_host": _page_groups(
        r"coalesce(nullif(regexp_extract(path, '^\w+://([^/?#]+)', 1), ''), path)"
    ),
    "group_page_url_strip_query": _page_groups("split_part(path, '?', 1)"),
    "group_rule_refusals": """
SELECT event_type, form, option, CASE WHEN refused THEN 'Invalid ' || option ELSE '' END AS refusal
FROM (SELECT DISTINCT event_type FROM events),
    (VALUES ('whole', false), ('groups', false), ('open group', true), ('open class', true),
        ('look-ahead', true), ('back-reference', true), ('bad range', true), ('nothing to repeat', true)
    ) AS forms(form, refused),
    (VALUES ('group_ip_regex'), ('group_path_regex'), ('group_ua_regex')) AS options(option)
""",
    "summary": _LOG + """
SELECT count_if(NOT is_junk)::BIGINT AS visits,
    CAST(coalesce(sum(traffic_bytes) FILTER (NOT is_junk), 0) AS BIGINT) AS traffic_bytes,
    count_if(is_junk)::BIGINT AS parse_errors,
    (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS files, 'visits' AS sort
FROM log
""",
    "dim_ip": _dimension("ip"),
    "dim_path": _dimension("path"),
    "dim_user_agent": _dimension("user_agent"),
    "dim_status": _dimension("status_code"),
    "trend_day": _dimension("day"),
    "trend_hour": _dimension("hour"),
    "trend_month": _dimension("month"),
    "counter_table": _COUNTERS + "SELECT * FROM counters",
    "counter_table_grouped": _counters("ip_group", "path_group", "agent_group") + "SELECT * FROM counters",
    "snapshot_merge": _COUNTERS + "SELECT * FROM counters",
    "pct_of_total": _top("path_group", "visits", 100),
    "top_ip_by_visits": _top("ip", "visits"),
    "top_path_by_traffic": _top("path", "traffic"),
    "top_path_from_lines": _top("path", "traffic"),
    "top_user_agent_by_visits": _top("user_agent", "visits"),
    "top_status_by_traffic": _top("status_code", "traffic"),
    "top_n_all_dimensions": _TOP_TEN_OF_ALL,
    "top_n_each_dimension": _TOP_TEN_OF_ALL,
    "date_series": _COUNTERS + """
SELECT replace(kind, 'trend:', '') AS granularity, bucket, visits, traffic_bytes
FROM counters WHERE kind LIKE 'trend:%'
""",
    "top_rows_page": _LOG + f", {_ranked('ip', 'visits')}" + f"""
, listed AS (SELECT * FROM ranked WHERE rank <= 30)
SELECT {_METRIC_ROW}, rank FROM listed
WHERE rank > least(25, greatest((SELECT count(*) FROM listed) - 10, 0))
    AND rank <= least(25, greatest((SELECT count(*) FROM listed) - 10, 0)) + 10
""",
    "table_text": _LOG + f", {_ranked('ip', 'traffic')}" + f"""
SELECT key, CAST(visits AS VARCHAR) AS visits, {_human('traffic_bytes')} AS traffic,
    printf('%.2f%%', visit_pct) AS visit_pct, printf('%.2f%%', traffic_pct) AS traffic_pct
FROM ranked WHERE rank <= 30
""",
    "human_bytes": _LOG + f"""
, paths AS (
    SELECT path_only AS key, count(*) AS visits, CAST(sum(traffic_bytes) AS BIGINT) AS b
    FROM rec GROUP BY ALL
)
SELECT key, CAST(visits AS VARCHAR) AS visits_text, {_human('b')} AS traffic_text,
    {_human('(b * 1000003)')} AS large_text
FROM paths
""",
    "bar_series": _LOG + f", {_ranked('path', 'traffic')}" + f"""
SELECT rank, CASE WHEN length(key) > 14 THEN substr(key, 1, 13) || '~' ELSE key END AS label,
    traffic_bytes AS value, {_human('traffic_bytes')} AS value_text
FROM ranked WHERE rank <= 12
""",
    "trend_points": _trend_points("hour", 13),
    "trend_points_day": _trend_points("day", 10),
    "export_rows": _COUNTERS + "SELECT * FROM counters WHERE kind NOT LIKE 'meta:%'",
    "snapshot_roundtrip": _COUNTERS + """
SELECT * FROM counters
UNION ALL SELECT 'meta:files', 'all', CAST(1 AS BIGINT), CAST(0 AS BIGINT)
""",
    "json_any_layout": _COUNTERS + """
SELECT * FROM counters
UNION ALL SELECT 'meta:files', 'all', CAST(1 AS BIGINT), CAST(0 AS BIGINT)
""",
    "json_roundtrip": _COUNTERS + """
SELECT * FROM counters
UNION ALL SELECT 'meta:files', 'all', CAST(1 AS BIGINT), CAST(0 AS BIGINT)
""",
    "scan_log_files": _COUNTERS + "SELECT * FROM counters",
}
