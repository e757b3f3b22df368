"""The registered queries as SQL over the same tables, written independently of the library."""

from __future__ import annotations

DOC = """doc AS (
  SELECT doc_id, i - 1 AS lineno, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""

EV = """ev AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) - 1 AS lineno FROM (
    SELECT strftime(ts, '%Y%m%d') AS day, date_diff('day', DATE '1970-01-01', ts::DATE) AS file_rank,
           epoch_us(ts) AS ts_us, event_type, event_id, user_id, ts,
           coalesce(json_extract_string(props, '$.k'), '') AS k,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' | ' || upper(event_type) || ' | event_id=' || event_id ||
           ' user_id=' || user_id || ' k=' || coalesce(json_extract_string(props, '$.k'), '') AS line
    FROM events))"""

EVM = EV + """, evm AS (
  SELECT day, file_rank, ts, event_id * 3 AS pos, line, event_id, 0 AS sub FROM ev
  UNION ALL
  SELECT day, file_rank, ts, event_id * 3 + sub, '    at frame' || sub || ' event_id=' || event_id, event_id, sub
  FROM ev, (VALUES (1), (2)) s(sub) WHERE event_type = 'error')"""

CAT = EV + """, cat AS (
  SELECT *, CASE WHEN is_live THEN NULL ELSE midnight END AS rotate_us,
         CASE WHEN is_live THEN 1706745600000000 ELSE midnight END AS key_us,
         CASE WHEN is_live THEN '/logs/app.log'
              ELSE '/logs/old/app.log-' || day || '-' || (midnight // 1000000) || '.gz' END AS path
  FROM (SELECT day, file_rank AS day_rank, (file_rank + 1) * 86400000000 AS midnight,
               day = (SELECT strftime(max(ts), '%Y%m%d') FROM events) AS is_live,
               min(ts_us) AS first_us, sum(strlen(line) + 1)::BIGINT AS size_bytes
        FROM ev GROUP BY day, file_rank)),
ranked AS (SELECT *, row_number() OVER (ORDER BY key_us, path) - 1 AS file_rank FROM cat)"""

LISTED = """SELECT file_rank, path, size_bytes, first_us, rotate_us,
  (rotate_us - first_us) // 3600000000 AS hours, (rotate_us - first_us) % 3600000000 // 60000000 AS minutes,
  (rotate_us - first_us) % 60000000 // 1000000 AS seconds, size_bytes // 1000000 AS size_mb,
  CASE WHEN NOT is_live THEN size_bytes * 20 // 1000000 END AS est_mb FROM ranked"""

LAST = 9223372036854775807


def occ(source: str, keys: str, patterns: list[str]) -> str:
    """CTE ``occ``: every occurrence, ``match_pos`` in bytes. The lengths between occurrences tell where they are; patterns
    that can overlap themselves are tested at every character."""
    listed = ", ".join("('" + p.replace("'", "''") + "')" for p in patterns)
    overlapping = ", ".join("'" + p.replace("'", "''") + "'" for p in patterns if any(p[:n] == p[-n:] for n in range(1, len(p)))) or "''"
    return f"""pats(pattern) AS (VALUES {listed}),
occ AS MATERIALIZED (
  SELECT {keys}, line, pattern, gaps + (j - 1) * strlen(pattern) AS match_pos, gaps + j * strlen(pattern) AS match_end
  FROM (SELECT {keys}, line, pattern, j, sum(strlen(parts[j])) OVER (PARTITION BY {keys}, pattern ORDER BY j)::BIGINT AS gaps, len(parts) AS n
        FROM (SELECT {keys}, line, pattern, parts, unnest(range(1, len(parts) + 1)) AS j
              FROM (SELECT {keys}, line, pattern, string_split(line, pattern) AS parts
                    FROM {source}, pats WHERE contains(line, pattern) AND pattern NOT IN ({overlapping}))))
  WHERE j < n
  UNION ALL
  SELECT {keys}, line, pattern, strlen(substr(line, 1, i - 1)), strlen(substr(line, 1, i - 1)) + strlen(pattern)
  FROM (SELECT {keys}, line, pattern, unnest(range(1, length(line) + 1)) AS i
        FROM {source}, pats WHERE contains(line, pattern) AND pattern IN ({overlapping}))
  WHERE substr(line, i, length(pattern)) = pattern)"""


def duration(us: str) -> str:
    return (
        f"(({us}) // 86400000000) || 'd ' || (({us}) % 86400000000 // 3600000000) || 'h ' || "
        f"(({us}) % 3600000000 // 60000000) || 'm ' || (({us}) % 60000000 // 1000000) || 's ' || (({us}) % 1000000) || 'us'"
    )


TYPES = ["| SIGNUP |", "| PURCHASE |", "| ERROR |", "| VIEW |", "| CLICK |"]

# files of 500 events, rotated in the second after the last of them, every other one compressed, the last one live
FILES = EV + """, lines AS (SELECT *, event_id // 500 AS part, row_number() OVER w - 1 AS nth, (sum(strlen(line) + 1) OVER w)::BIGINT - strlen(line) - 1 AS line_offset
  FROM ev WINDOW w AS (PARTITION BY event_id // 500 ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
files AS (SELECT *, CASE WHEN live THEN 'app.log' ELSE 'app.log-20240201-' || ends || CASE WHEN part % 2 = 0 THEN '.gz' ELSE '' END END AS name
  FROM (SELECT part, part = (SELECT max(event_id) // 500 FROM ev) AS live, min(ts_us) AS first_us, max(ts_us) // 1000000 + 1 AS ends,
               sum(strlen(line) + 1)::BIGINT AS bytes FROM lines GROUP BY part))"""
MOMENT = "epoch_us(TIMESTAMP '2024-01-11 12:00:00')"

ORACLE = {
    "search_any": f"""WITH {DOC} SELECT doc_id, lineno, line FROM doc
WHERE contains(line, 'nthe') OR contains(line, 'tion') OR contains(line, 'é')""",
    "search_occurrences": f"""WITH {DOC}, {occ('doc', 'doc_id, lineno', ['the', 'anan', 'é', '|'])}
SELECT doc_id, lineno, pattern, row_number() OVER (PARTITION BY doc_id, lineno, pattern ORDER BY match_pos) - 1 AS occurrence,
       match_pos, match_end FROM occ""",
    "search_order": f"""WITH {DOC}, {occ('doc', 'doc_id, lineno', ['nthe', 'the', 'he', 'e'])}
SELECT doc_id, pattern, lineno, match_pos,
       row_number() OVER (PARTITION BY doc_id ORDER BY lineno, match_end, strlen(pattern) DESC) AS match_no FROM occ""",
    "search_pattern_table": f"""WITH {DOC},
pats AS (SELECT DISTINCT pattern FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS pattern FROM benchmark)
         WHERE pattern <> ''),
selfish AS (SELECT DISTINCT pattern FROM (SELECT pattern, unnest(range(1, length(pattern))) AS k FROM pats)
            WHERE left(pattern, k) = right(pattern, k)),
pairs AS MATERIALIZED (SELECT doc_id, lineno, line, p.pattern, s.pattern IS NOT NULL AS again
  FROM doc, pats p LEFT JOIN selfish s ON p.pattern = s.pattern WHERE contains(line, p.pattern)),
hits AS (SELECT doc_id, pattern, len(string_split(line, pattern)) - 1 AS n, strlen(string_split(line, pattern)[1]) AS first_pos
         FROM pairs WHERE NOT again
  UNION ALL
  SELECT doc_id, pattern, count(*), min(strlen(left(line, i - 1)))
  FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM pairs WHERE again)
  WHERE substr(line, i, length(pattern)) = pattern GROUP BY doc_id, lineno, pattern)
SELECT doc_id, pattern, sum(n)::BIGINT AS n, min(first_pos) AS first_pos, max(n) - 1 AS top FROM hits GROUP BY ALL""",
    "nested_all_of": f"""WITH {DOC}, {occ('doc', 'doc_id, lineno', ['the', 'er'])}
SELECT p.doc_id, p.lineno, p.match_end AS parent_end, c.match_pos
FROM occ p JOIN occ c ON p.doc_id = c.doc_id AND p.lineno = c.lineno WHERE p.pattern = 'the' AND c.pattern = 'er'""",
    "print_matches": f"""WITH {EV} SELECT file_rank, event_id AS pos, 'stdout' AS sink, line || chr(10) AS text FROM ev WHERE event_type = 'error'
UNION ALL SELECT file_rank, event_id, 'stdout', line || chr(10) FROM ev WHERE user_id = 13""",
    "count_rules": f"""WITH {DOC}, {occ('doc', 'doc_id, lineno', ['the', 'anan', 'é', 'tion', 'no such text'])}
SELECT pats.pattern, count(occ.doc_id) AS n FROM pats LEFT JOIN occ ON pats.pattern = occ.pattern GROUP BY pats.pattern""",
    "count_nested": f"""WITH {DOC}, {occ('doc', 'doc_id, lineno', ['the', 'er'])}, n AS (
  SELECT (SELECT count(*) FROM occ WHERE pattern = 'the') AS the,
         (SELECT count(*) FROM occ p JOIN occ c ON p.doc_id = c.doc_id AND p.lineno = c.lineno
          WHERE p.pattern = 'the' AND c.pattern = 'er') AS er)
SELECT 'stdout' AS sink, 'the: ' || the || chr(10) AS text FROM n
UNION ALL SELECT 'stdout', 'er in the:' || chr(9) || er FROM n
UNION ALL SELECT 'stdout', 'none: 0' || chr(10) UNION ALL SELECT 'stdout', 'below none: 0' || chr(10)""",
    "interval_by_rule": f"""WITH {EV}, gaps AS (
  SELECT event_id, '| ' || upper(event_type) || ' |' AS pattern,
         abs(ts_us - lag(ts_us) OVER (PARTITION BY event_type ORDER BY event_id)) AS interval_us FROM ev)
SELECT event_id, pattern, interval_us, {duration('interval_us')} AS shown FROM gaps WHERE interval_us IS NOT NULL""",
    "max_count": f"""WITH {EV} SELECT event_id, pattern FROM (
  SELECT event_id, '| ' || upper(event_type) || ' |' AS pattern, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n
  FROM ev) WHERE n <= 100""",
    "exit_cutoff": f"""WITH {EV}, cut AS (SELECT min(event_id) AS stop FROM ev WHERE line LIKE '%2024-01-20 %')
SELECT file_rank, event_id AS pos, '| ERROR | ' || right(line, 5) || chr(10) AS text
FROM ev, cut WHERE event_type = 'error' AND (stop IS NULL OR event_id < stop)
UNION ALL SELECT file_rank, event_id, 'end ' || ts_us || chr(10) FROM ev, cut WHERE event_id = stop""",
    "max_count_exit": f"""WITH {EV}, e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ev WHERE event_type = 'error'),
cut AS (SELECT coalesce((SELECT event_id FROM e WHERE n = 150), (SELECT max(event_id) + 1 FROM ev)) AS stop)
SELECT file_rank, event_id AS pos, 'stdout' AS sink, 'E ' || left(line, 26) || chr(10) AS text FROM e WHERE n <= 150
UNION ALL SELECT file_rank, event_id, 'stdout', 'V ' || left(line, 26) || chr(10) FROM ev, cut WHERE event_type = 'view' AND event_id < stop
UNION ALL SELECT {LAST}, {LAST}, 'stdout', 'errors ' || (SELECT count(*) FROM e WHERE n <= 150) || chr(10)
UNION ALL SELECT {LAST}, {LAST}, 'stdout', 'views ' || (SELECT count(*) FROM ev, cut WHERE event_type = 'view' AND event_id < stop) || chr(10)""",
    "nested_max_count": f"""WITH {EV}, e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ev WHERE event_type = 'error'),
u AS (SELECT *, row_number() OVER (ORDER BY event_id) AS m FROM e WHERE n <= 200 AND user_id::VARCHAR LIKE '1%')
SELECT file_rank, 'user_id=' || user_id || ' ' || lineno || chr(10) AS text FROM u WHERE m <= 30
UNION ALL SELECT {LAST}, (SELECT count(*) FROM u WHERE m <= 30)::VARCHAR""",
    "regex_extract": f"""WITH {EV} SELECT event_id,
  CASE WHEN regexp_matches(line, 'user_id=([0-9]+) k=9') THEN regexp_extract(line, 'user_id=([0-9]+) k=9', 1) END AS user,
  CASE WHEN regexp_matches(line, 'k=1[0-9]') THEN regexp_extract(line, 'k=1[0-9]') END AS k FROM ev""",
    "var_carry": f"""WITH {EV}, c AS (SELECT *,
  last_value(CASE WHEN event_type = 'error' THEN user_id::VARCHAR END IGNORE NULLS) OVER w AS u,
  last_value(CASE WHEN event_type = 'purchase' AND regexp_matches(line, 'k=9[0-9]') THEN regexp_extract(line, 'k=(9[0-9])', 1) END IGNORE NULLS) OVER w AS h
  FROM ev WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT file_rank, event_id AS pos, coalesce(u, '${{user}}') || ' ' || coalesce(h, '${{high}}') || chr(10) AS text
FROM c WHERE event_type = 'purchase'""",
    "var_match": f"""WITH {EV} SELECT file_rank, event_id AS pos, user_id || ' ' ||
  CASE WHEN regexp_matches(line, 'k=9[0-9]') THEN regexp_extract(line, 'k=(9[0-9])', 1) ELSE '${{high}}' END || chr(10) AS text
FROM ev WHERE event_type = 'purchase'""",
    "cat_range": f"""WITH {EVM}, seen AS (SELECT *, last_value(CASE WHEN sub = 0 THEN ts END IGNORE NULLS)
  OVER (ORDER BY day, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM evm)
SELECT day, pos, line FROM seen WHERE seen BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-09 10:45:00'""",
    "cat_continued": f"""WITH {EVM}, seen AS (SELECT *, last_value(CASE WHEN sub = 0 THEN ts END IGNORE NULLS)
  OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM evm)
SELECT pos // 500 AS file_rank, pos, line FROM seen
WHERE seen BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-09 10:45:00'""",
    "cat_split": f"""WITH {EVM}, s AS (SELECT day, pos, (sum(strlen(line) + 1) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT // 20000 AS chunk FROM evm),
f AS (SELECT chunk, arg_min(day, pos) AS first_day FROM s GROUP BY chunk)
SELECT day, pos, s.chunk, repeat('zz', (s.chunk // 676)::INT) || chr((97 + s.chunk % 676 // 26)::INT) || chr((97 + s.chunk % 26)::INT)
  || '-app.log-' || first_day AS chunk_name FROM s JOIN f ON s.chunk = f.chunk""",
    "context": f"""WITH {DOC}, h AS (SELECT doc_id, lineno FROM doc WHERE contains(line, 'ananth') OR contains(line, '|')),
w AS (SELECT doc_id, lineno + step AS lineno, bool_or(step = 0) AS is_hit FROM h, (VALUES (-2), (-1), (0), (1)) t(step) GROUP BY ALL)
SELECT doc.doc_id, doc.lineno, is_hit, line FROM doc JOIN w ON doc.doc_id = w.doc_id AND doc.lineno = w.lineno""",
    "context_action": f"""WITH {EV}, m AS (SELECT day, file_rank, lineno, event_id, line FROM ev WHERE user_id = 13)
SELECT m.file_rank, m.event_id AS pos, n.lineno || ': ' || substr(n.line, 30) || chr(10) AS text
FROM m JOIN ev n ON m.day = n.day AND n.lineno - m.lineno IN (-1, 1, 2)
UNION ALL SELECT file_rank, event_id, line || chr(10) FROM m""",
    "line_positions": f"""WITH {EVM} SELECT day, pos, row_number() OVER w - 1 AS lineno,
  (sum(strlen(line) + 1) OVER w)::BIGINT - strlen(line) - 1 AS line_offset
FROM evm WINDOW w AS (PARTITION BY day ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "line_slice": f"""WITH {EV} SELECT event_id, substr(line, 3, 3) AS a, right(line, 3) AS b, left(line, -2) AS c, '' AS d,
  line AS e, substr(line, (length(line) - 9)::BIGINT, 6) AS f FROM ev""",
    "byte_sizes": f"""WITH {DOC} SELECT doc_id, lineno, greatest(least(strlen(line), 40) - 3, 0) AS cut, strlen(line) AS size FROM doc""",
    "match_plus": f"""WITH {EV}, {occ('ev', 'event_id', ['user_id=', 'k='])}
SELECT event_id, match_pos, substr(line, match_pos + 1, strlen(pattern) + 3) AS shown FROM occ""",
    "match_until": f"""WITH {EV}, {occ('ev', 'event_id', ['user_id=', 'k='])}
SELECT event_id, match_pos, split_part(substr(line, match_pos + 1), ' ', 1) AS shown FROM occ""",
    "render_format": f"""WITH {EV} SELECT event_id, lineno || '| user_id=|' || left(' user_id=' || user_id || ' k=' || k, 13) || '| user_id=' || user_id
  || '|' || left(line, 19) || '|' || right(line, 4) || '|' || ts_us || '|${{none}}|' || chr(10) AS text FROM ev""",
    "time_parse": f"""WITH {EVM} SELECT day, pos, CASE WHEN sub = 0 THEN epoch_us(ts) END AS full_us,
  CASE WHEN sub = 0 THEN epoch_us(date_trunc('second', ts)) END AS second_us,
  CASE WHEN sub = 0 THEN epoch_us(date_trunc('minute', ts)) END AS minute_us,
  CASE WHEN sub = 0 THEN epoch_us(date_trunc('day', ts)::TIMESTAMP) END AS day_us,
  CASE WHEN sub = 0 THEN epoch_us(ts) // 10000 * 10000 END AS part_us FROM evm""",
    "time_format": f"""WITH {EV} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS fine FROM ev""",
    "duration_text": f"""WITH {EV} SELECT event_id, {duration("ts_us - epoch_us(TIMESTAMP '2023-12-30')")} AS shown FROM ev""",
    "duration_parts": f"""WITH {EV}, d AS (SELECT event_id, ts_us - epoch_us(TIMESTAMP '2020-05-17 01:02:03') AS us FROM ev),
y AS (SELECT *, us % 31536000000000 AS r FROM d)
SELECT event_id, us // 31536000000000 AS year, r // 2592000000000 AS month, r % 2592000000000 // 86400000000 AS day,
  r % 2592000000000 % 86400000000 // 3600000000 AS hour, r % 3600000000 // 60000000 AS minute, r % 60000000 // 1000000 AS second,
  r % 1000000 AS micro, us // 2592000000000 AS some_month, us % 2592000000000 // 3600000000 AS some_hour,
  us % 2592000000000 % 3600000000 AS some_micro FROM y""",
    "hms_parse": f"""WITH {EV} SELECT event_id, epoch_us(date_trunc('second', ts)) % 86400000000 AS full_us,
  epoch_us(date_trunc('minute', ts)) % 86400000000 AS minute_us, epoch_us(date_trunc('hour', ts)) % 86400000000 AS hour_us FROM ev""",
    "catalog_list": f"WITH {CAT} {LISTED}",
    "catalog_at": f"""WITH {CAT} {LISTED} WHERE first_us <= epoch_us(TIMESTAMP '2024-01-11 03:00:10')
  AND (rotate_us IS NULL OR rotate_us > epoch_us(TIMESTAMP '2024-01-11 03:00:10'))""",
    "catalog_range": f"""WITH {CAT} {LISTED} WHERE first_us <= epoch_us(TIMESTAMP '2024-01-13 05:00:10')
  AND key_us >= epoch_us(TIMESTAMP '2024-01-11 03:00:10')""",
    "catalog_month": f"""WITH {CAT} {LISTED} WHERE first_us < epoch_us(TIMESTAMP '2024-02-01') AND key_us >= epoch_us(TIMESTAMP '2024-01-01')""",
    "catalog_summary": f"""WITH {CAT}, t AS (SELECT min(first_us) AS first_us, max(key_us) AS last_us, sum(size_bytes)::BIGINT AS size_bytes,
  coalesce(sum(CASE WHEN NOT is_live THEN size_bytes * 20 END), 0)::BIGINT AS est_bytes, count(*) AS files FROM ranked),
u AS (SELECT *, last_us - first_us AS us, CASE WHEN size_bytes > 1000000000 THEN 1000000000 ELSE 1000000 END AS per FROM t)
SELECT first_us, last_us, size_bytes, est_bytes, files, us // 2592000000000 AS months, us % 2592000000000 // 86400000000 AS days,
  us % 2592000000000 % 86400000000 // 3600000000 AS hours, us % 3600000000 // 60000000 AS minutes, us % 60000000 // 1000000 AS seconds,
  size_bytes // per AS size_shown, est_bytes // per AS est_shown, CASE WHEN per = 1000000 THEN 'MB' ELSE 'GB' END AS unit FROM u""",
    "rotate_time": """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN (page_id + 1600317601) * 1000000 END AS rotate_us,
  CASE WHEN page_id % 3 <> 0 THEN strftime(make_timestamp((page_id + 1600317601) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE 'n/a' END AS shown
FROM pages""",
    "files_after": f"WITH {CAT} SELECT file_rank, path, size_bytes FROM ranked WHERE key_us > epoch_us(TIMESTAMP '2024-01-18')",
    "files_before": f"""WITH {CAT}, l AS (SELECT *, lag(key_us) OVER (ORDER BY key_us, path) AS before FROM ranked)
SELECT row_number() OVER (ORDER BY key_us DESC, path DESC) - 1 AS file_rank, path, size_bytes FROM l
WHERE (before IS NULL OR before <= epoch_us(TIMESTAMP '2024-01-20 12:00:00')) AND first_us <= epoch_us(TIMESTAMP '2024-01-20 12:00:00')""",
    "route_sinks": f"""WITH {EV}, e AS (SELECT * FROM ev WHERE event_type = 'error'), v AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT file_rank, event_id AS pos, 'stdout' AS sink, line || chr(10) AS text FROM e
UNION ALL SELECT file_rank, event_id, 'errors.log', '| ERROR | at ' || ts_us || chr(10) FROM e
UNION ALL SELECT file_rank, event_id, 'stdout', 'user 13' || chr(10) FROM e WHERE user_id = 13
UNION ALL SELECT file_rank, event_id, 'user13.log', line || chr(10) FROM e WHERE user_id = 13
UNION ALL SELECT file_rank, event_id, 'stderr', 'E' FROM e
UNION ALL SELECT file_rank, event_id, 'views.log', substr(line, 30) || chr(10) FROM v
UNION ALL SELECT file_rank, event_id, 'stdout', 'v' || chr(10) FROM v
UNION ALL SELECT {LAST}, {LAST}, 'stdout', 'errors: ' || (SELECT count(*) FROM e) || chr(10)""",
    "lifecycle_rows": f"""WITH {CAT}, s AS (SELECT * FROM ev WHERE event_type = 'signup')
SELECT 'stdout' AS sink, left(line, 19) || chr(10) AS text FROM s
UNION ALL SELECT 'stdout', 'signups ' || (SELECT count(*) FROM s) || chr(10)
UNION ALL SELECT 'stdout', 'begin' || chr(10) UNION ALL SELECT 'stdout', 'end' || chr(10) UNION ALL SELECT 'end.log', 'done' || chr(10)
UNION ALL SELECT 'stdout', 'start ' || path || ' (' || coalesce(strftime(make_timestamp(rotate_us), '%Y-%m-%d %H:%M:%S'), 'n/a') || ')' || chr(10) FROM ranked
UNION ALL SELECT 'stdout', 'stop ' || path || chr(10) FROM ranked""",
    "lifecycle_variables": f"""WITH {CAT},
users AS (SELECT day, arg_max(user_id, event_id) FILTER (WHERE event_type = 'error')::VARCHAR AS u FROM ev GROUP BY day),
told AS (SELECT path, r.file_rank, last_value(u IGNORE NULLS) OVER (ORDER BY r.file_rank ROWS UNBOUNDED PRECEDING) AS now,
  last_value(u IGNORE NULLS) OVER (ORDER BY r.file_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM ranked r JOIN users ON r.day = users.day)
SELECT 'stdout' AS sink, 'first ${{user}}' || chr(10) AS text
UNION ALL SELECT 'stdout', 'last ' || coalesce(arg_max(now, file_rank), '${{user}}') || chr(10) FROM told
UNION ALL SELECT 'stdout', path || ' opens after ' || coalesce(before, '${{user}}') || chr(10) FROM told
UNION ALL SELECT 'stdout', path || ' closes with ' || coalesce(now, '${{user}}') || chr(10) FROM told""",
    "count_many": f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id)
SELECT 'stdout' AS sink, i || ': ' || coalesce(n, 0) || chr(10) AS text FROM range(1000) t(i) LEFT JOIN n ON user_id = i""",
    "output_text": f"""WITH {EV}, u AS (SELECT * FROM ev WHERE user_id::VARCHAR LIKE '1%'),
parts AS (
  SELECT 'stdout' AS sink, event_id, 0 AS n, CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'click' THEN 'CLICK ' ELSE '' END
         || 'user_id=' || user_id || ': ' || line AS line FROM u
  UNION ALL SELECT 'clicks.log', event_id, 0, '| CLICK | event_id' || left(line, 10) FROM u WHERE event_type = 'click'
  UNION ALL SELECT 'clicks.log', event_id, 1, lineno::VARCHAR FROM u WHERE event_type = 'click')
SELECT sink, row_number() OVER (PARTITION BY sink ORDER BY event_id, n) - 1 AS out_lineno, line FROM parts""",
    "custom_action": f"""WITH {EV} SELECT file_rank, event_id AS pos, upper(event_type) AS text FROM ev WHERE user_id = 13
UNION ALL SELECT file_rank, event_id, line || chr(10) FROM ev WHERE user_id = 13""",
    "many_rules": f"""WITH {EV} SELECT file_rank, '| ERROR | ' || left(line, 10) || chr(10) AS text FROM ev WHERE event_type = 'error' AND user_id < 100
UNION ALL SELECT {LAST}, n || ': ' || (SELECT count(*) FROM ev WHERE user_id = n) || chr(10) FROM range(100) t(n)""",
    "track_entity": f"""WITH {EV}, u AS (SELECT * FROM ev WHERE user_id = 7),
v AS (SELECT *, abs(ts_us - lag(ts_us) OVER (ORDER BY event_id)) AS gap FROM u WHERE event_type = 'view')
SELECT file_rank, event_id AS pos, 'stdout' AS sink, {duration('gap')} || ' between views' || chr(10) AS text FROM v WHERE gap IS NOT NULL
UNION ALL SELECT file_rank, event_id, 'purchases.txt', substr(line, 1, 26) || ' bought, line ' || lineno || chr(10) FROM u WHERE event_type = 'purchase'
UNION ALL SELECT file_rank, event_id, 'errors.txt', substr(line, 1, 10) || ' k=1' || chr(10) FROM u WHERE event_type = 'error' AND contains(line, ' k=1')
UNION ALL SELECT {LAST}, {LAST}, 'stdout', 'purchases: ' || (SELECT count(*) FROM u WHERE event_type = 'purchase') || chr(10)""",
    "posix_classes": f"""WITH {EV} SELECT event_id, upper(event_type) AS kind, user_id::VARCHAR AS user_id FROM ev""",
    "file_list": f"""WITH {FILES} SELECT part AS file_rank, name, first_us, CASE WHEN NOT live THEN ends * 1000000 END AS rotate_us,
  CASE WHEN name NOT LIKE '%.gz' THEN bytes END AS plain_bytes FROM files""",
    "file_lines": f"WITH {FILES} SELECT part AS file_rank, nth AS lineno, line_offset, line FROM lines",
    "file_cat": f"""WITH {FILES} SELECT part // 2 AS file_rank, line FROM lines
WHERE part % 2 = 0 AND ts BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-05 06:30:00' + INTERVAL 300 HOUR + INTERVAL 15 MINUTE""",
    "file_direction": f"""WITH {FILES}, kept AS (
  SELECT part, name, row_number() OVER (ORDER BY part DESC) - 1 AS file_rank
  FROM (SELECT *, lag(ends) OVER (ORDER BY part) * 1000000 AS before FROM files) WHERE first_us <= {MOMENT} AND coalesce(before <= {MOMENT}, true))
SELECT file_rank, name, n_lines, last_line FROM kept
LEFT JOIN (SELECT part, count(*) AS n_lines, max(line) AS last_line FROM lines WHERE ts_us <= {MOMENT} GROUP BY part) USING (part)""",
    "file_search": f"""WITH {FILES} SELECT part AS file_rank, ' user_id=' || user_id || ' ' || (line_offset + strpos(line, ' user_id=1') - 1) || ' ' || line_offset || ' ' || nth || chr(10) AS text
FROM lines WHERE contains(line, ' user_id=1')""",
    "sinks_read_back": f"""WITH {EV} SELECT 'all.log' AS sink, run::BIGINT AS run, row_number() OVER (PARTITION BY run ORDER BY event_id) AS n, left(line, 26) AS line
FROM ev JOIN (VALUES ('error', 0), ('view', 1)) k(event_type, run) USING (event_type)
UNION ALL SELECT 'last.log', 1, row_number() OVER (ORDER BY event_id), substr(line, 30) FROM ev WHERE event_type = 'view'""",
    "regex_longest": f"""WITH {EV} SELECT event_id, left(k, 2) AS digits,
  CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'view' THEN 'VIEW' END AS word,
  'user' AS pair, 'event_id=' || event_id AS whole FROM ev""",
    "last_of_equal_patterns": f"""WITH {EV} SELECT event_id AS pos, '| ERROR | last' || chr(10) AS text FROM ev WHERE event_type = 'error'
UNION ALL SELECT event_id, line || chr(10) FROM ev WHERE event_type = 'click'
UNION ALL SELECT event_id, 'k=7 ' || (strpos(line, ' k=7')) FROM ev WHERE k LIKE '7%'
UNION ALL SELECT event_id, 'user_id=7  ' || (strpos(line, 'user_id=7 ') - 1) FROM ev WHERE user_id = 7""",
    "offset_formats": f"""WITH {EV}, placed AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY day ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT - strlen(line) - 1 AS place FROM ev)
SELECT file_rank, (place + strpos(line, '| VIEW |') - 1) || ' ' || place || chr(10) AS text FROM placed WHERE event_type = 'view'
UNION ALL SELECT file_rank, (strpos(line, 'k=') - 1) || ' ' || place || chr(10) FROM placed WHERE event_type = 'view'""",
    "custom_at_end": f"""WITH {EV} SELECT file_rank, event_id AS pos, 'stdout' AS sink, (strlen(line) * 3)::VARCHAR AS text FROM ev WHERE event_type = 'error' AND event_id % 3 = 0
UNION ALL SELECT {LAST}, {LAST}, 'stdout', 'sum ' || coalesce(sum(strlen(line) * 3), 0)::BIGINT FROM ev WHERE event_type = 'error'""",
    "sql_search": f"""WITH {EV}, {occ('ev', 'event_id', ['user_id=1', '0', '|'])}
SELECT event_id, pattern, row_number() OVER (PARTITION BY event_id, pattern ORDER BY match_pos) - 1 AS occurrence, match_pos FROM occ""",
    "sql_values": f"""WITH {EV}, gaps AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY day, event_type ORDER BY event_id) AS gap FROM ev)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, {duration('gap')} AS pause, 'user_id=' || user_id AS user, right(line, 4) AS tail,
       substr(line, 12, 5) AS clock FROM gaps WHERE gap IS NOT NULL""",
}
