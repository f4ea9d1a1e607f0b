"""DuckDB SQL oracles for the registered queries.

Each text runs on the driver's pre-registered views (``events`` and friends)
and must give the same rows as the Spark query of the same name.  CTE names
never reuse a table name.
"""

from __future__ import annotations

import datetime as dt

from wayfarer.plans import cluster_queries
from wayfarer.plans.workload import (ALL_MIN_FREQ, ALL_MIN_LEN, CLASS_MIN_FREQ, CLASS_MIN_LEN,
                                     DIVERGENCE_TOP, EXPORT_AS_OF, EXPORT_DAYS, MEDIUM_COLUMNS)
from wayfarer.sources import events_adapter as A

GOAL = A.GOAL_EVENT
CONV_PATHS = ", ".join(f"'{p}'" for p in A.CONVERSION_PAGE_PATH)
BRAND_RX = "|".join(b.strip().lower() for b in A.BRAND)
PHRASE_RX = "|".join(dict.fromkeys(A.REMOVAL_PHRASES))
HOST = A.HOST

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


FLAT = f"""
ev_k AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
flat AS (
  SELECT event_id,
    concat(CAST(user_id AS VARCHAR), '.', CAST(user_id % 7 AS VARCHAR)) AS user_pseudo_id,
    CAST(ts AS DATE) AS event_date,
    ts AS event_timestamp,
    CASE WHEN event_type IN ('view', 'click') THEN 'page_view'
         WHEN event_type = 'signup' THEN 'session_start'
         WHEN event_type = 'purchase' AND value >= 150 THEN 'purchase'
         WHEN event_type = 'purchase' THEN 'small_purchase'
         ELSE event_type END AS event_name,
    concat(CAST(user_id AS VARCHAR), '.', CAST(user_id % 7 AS VARCHAR), '.',
           CAST(CAST(ts AS DATE) AS VARCHAR)) AS ga_session_id,
    CAST(dayofmonth(CAST(ts AS DATE)) AS BIGINT) AS ga_session_number,
    CAST(CASE WHEN k % 10 = 0 THEN NULL WHEN value >= 10 THEN 1 ELSE 0 END AS BIGINT)
      AS session_engaged,
    CASE WHEN k % 11 = 0 THEN NULL
         WHEN k % 9 = 0 THEN '{HOST}'
         WHEN k % 9 = 8 THEN concat('{HOST}/Thank-You',
                                    CASE WHEN k % 2 = 0 THEN '/' ELSE '?o=1' END)
         WHEN k % 9 = 7 AND user_id % 10 = 3 THEN '{HOST}/Careers/open'
         ELSE concat('{HOST}/Page-', CAST(k % 9 AS VARCHAR),
                     CASE WHEN k % 3 = 0 THEN '/' WHEN k % 3 = 1 THEN '?utm=x'
                          ELSE '#top' END) END AS page_location,
    CASE WHEN k % 5 = 0 THEN NULL
         ELSE concat('Page ', CAST(k % 9 AS VARCHAR),
                     CASE WHEN k % 2 = 0 THEN ' | Acme' ELSE ' - Acme Shop' END)
         END AS page_title,
    '(not set)' AS campaign,
    CASE WHEN k % 4 = 0 THEN 'Google ' WHEN k % 4 = 1 THEN 'newsletter'
         WHEN k % 4 = 2 THEN '(direct)' ELSE NULL END AS source,
    CASE WHEN k % 4 = 0 THEN 'CPC' WHEN k % 4 = 1 THEN 'email'
         WHEN k % 4 = 2 THEN '(none)' ELSE NULL END AS medium,
    concat(coalesce(CASE WHEN k % 4 = 0 THEN 'Google ' WHEN k % 4 = 1 THEN 'newsletter'
                         WHEN k % 4 = 2 THEN '(direct)' ELSE NULL END, '(direct)'),
           ' / ',
           coalesce(CASE WHEN k % 4 = 0 THEN 'CPC' WHEN k % 4 = 1 THEN 'email'
                         WHEN k % 4 = 2 THEN '(none)' ELSE NULL END, '(not set)'))
      AS source_medium,
    '(not set)' AS geo_region,
    '(not set)' AS geo_city,
    'desktop' AS device_category
  FROM ev_k)"""

# A third of the events without a source_medium.
FLAT_UNSET = """
flat_unset AS (
  SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE source_medium END AS source_medium)
  FROM flat)"""

# One event in fifty without a usable timestamp.
FLAT_UNTIMED = """
flat_untimed AS (SELECT * FROM flat WHERE event_id % 50 <> 0)"""

RANK = ("CASE WHEN event_name = 'session_start' THEN 0 "
        "WHEN event_name = 'page_view' THEN 1 ELSE 2 END")


def _title(x: str) -> str:
    t = f"regexp_extract(coalesce({x}, '(not set)'), '(.*?)(?:\\s[-|]\\s|$)', 1)"
    t = f"regexp_replace({t}, '(?i){BRAND_RX}', '', 'g')"
    return _strip(t)


def _url(x: str, default: str | None = "/") -> str:
    src = f"coalesce({x}, '{default}')" if default is not None else x
    u = f"regexp_replace({src}, '[?#].*$', '')"
    u = f"regexp_replace({u}, '^https?://[^/]+', '')"
    u = f"rtrim(lower({_strip(u)}), '/')"
    return f"({u} || '/')"


CLEAN = f"""
rel AS (
  SELECT event_id, replace(user_pseudo_id, '.', '_') AS user_pseudo_id, event_date,
         event_timestamp, event_name, ga_session_id, ga_session_number,
         CAST(coalesce(session_engaged, 0) AS BIGINT) AS session_engaged,
         page_location, page_title, campaign, source, medium, source_medium,
         geo_region, geo_city, device_category
  FROM flat
  WHERE event_name IN ('session_start', 'page_view', '{GOAL}')
    AND user_pseudo_id IS NOT NULL AND event_timestamp IS NOT NULL
    AND NOT contains(replace(user_pseudo_id, '.', '_'), '___PII_REDACTED___')),
copied AS (
  SELECT * FROM rel
  UNION ALL
  SELECT * REPLACE ('page_view' AS event_name) FROM rel
  WHERE event_name = 'session_start' AND page_location IS NOT NULL),
viewed AS (
  SELECT * FROM copied
  WHERE NOT (event_name = 'page_view' AND page_location IS NULL)
    AND event_timestamp IS NOT NULL),
shared AS (
  SELECT *, count(*) OVER (PARTITION BY user_pseudo_id, event_timestamp) AS n_same
  FROM viewed),
moved AS (
  SELECT * EXCLUDE (n_same) REPLACE (
    CASE WHEN event_name = 'session_start' AND n_same > 1
         THEN event_timestamp - INTERVAL 2 SECOND ELSE event_timestamp END
      AS event_timestamp)
  FROM shared),
secs AS (
  SELECT *, epoch_us(event_timestamp) // 1000000 AS event_timestamp_sec,
         {RANK} AS ev_rank
  FROM moved),
gaps AS (
  SELECT *, CAST(coalesce(event_timestamp_sec - lag(event_timestamp_sec) OVER (
           PARTITION BY user_pseudo_id ORDER BY event_timestamp, ev_rank, event_id), 0)
         AS DOUBLE) AS event_timestamp_diff
  FROM secs),
normed AS (
  SELECT *, {_url('page_location')} AS loc, {_title('page_title')} AS ttl FROM gaps),
clean AS (
  SELECT event_id, user_pseudo_id AS user_id, event_date, event_name, event_timestamp,
         event_timestamp_sec, event_timestamp_diff, geo_region, geo_city, device_category,
         lower({_strip("coalesce(campaign, '(not set)')")}) AS campaign,
         lower({_strip("coalesce(source, '(not set)')")}) AS source,
         CASE WHEN lower({_strip("coalesce(medium, '(not set)')")}) = '(none)' THEN 'direct'
              ELSE lower({_strip("coalesce(medium, '(not set)')")}) END AS medium,
         lower({_strip("coalesce(source_medium, '(not set)')")}) AS source_medium,
         ga_session_id, ga_session_number, session_engaged,
         loc AS page_location,
         CASE WHEN loc = '/' THEN 'Home' WHEN ttl = '' THEN '(not set)' ELSE ttl END
           AS page_title
  FROM normed)"""

USERS = f"""
counts AS (
  SELECT user_id,
         count(DISTINCT event_date) AS unique_days,
         count(DISTINCT page_location) AS unique_pages,
         count(DISTINCT event_timestamp) AS pageviews,
         CAST(round_even(CAST(sum(session_engaged) AS DOUBLE)
                         / count(DISTINCT event_timestamp) * 100.0, 0) AS DOUBLE) / 100.0
           AS engaged_sessions,
         count(DISTINCT ga_session_id) AS total_sessions
  FROM clean WHERE event_name = 'page_view' GROUP BY user_id),
band AS (SELECT user_id FROM counts WHERE unique_pages > 2 AND unique_pages < 75),
conv_users AS (SELECT DISTINCT user_id FROM clean WHERE event_name = '{GOAL}'),
multi AS (
  SELECT user_id, page_location, page_title, event_date, event_name, event_timestamp,
         event_timestamp_sec, event_timestamp_diff, geo_region, geo_city, device_category,
         campaign, source, medium, source_medium, ga_session_id, session_engaged, event_id
  FROM clean WHERE user_id IN (SELECT user_id FROM band)),
removed AS (
  SELECT DISTINCT user_id FROM multi
  WHERE regexp_matches(page_location, '(?i)\\b(?:{PHRASE_RX})\\b')),
kept AS (SELECT * FROM multi WHERE user_id NOT IN (SELECT user_id FROM removed)),
first_conv AS (
  SELECT user_id, min(event_timestamp) AS first_conversion_timestamp
  FROM kept WHERE page_location IN ({CONV_PATHS}) GROUP BY user_id),
truncated AS (
  SELECT k.* EXCLUDE (event_timestamp_sec)
  FROM kept k LEFT JOIN first_conv f USING (user_id)
  WHERE f.first_conversion_timestamp IS NULL
     OR k.event_timestamp < f.first_conversion_timestamp)"""


def _labelled(page_repr: str = "page_location") -> str:
    return f"""
labelled AS (
  SELECT *,
    coalesce(CASE
      WHEN event_name = 'page_view' THEN concat('Navigated to: ', {page_repr})
      WHEN event_name = 'session_start' THEN
        CASE WHEN concat('Originated from: ', source_medium) = 'Originated from: (not set)'
                  AND source <> '(not set)'
             THEN concat('Originated from: ', source)
             ELSE concat('Originated from: ', source_medium) END
      ELSE '' END, '') AS label
  FROM truncated)"""


JOURNEYS = f"""
stats AS (
  SELECT user_id,
         count(DISTINCT event_date) AS unique_days,
         count(DISTINCT page_location) AS unique_pages,
         count(DISTINCT event_timestamp) AS unique_pageviews,
         CAST(sum(session_engaged) AS DOUBLE) / count(DISTINCT event_timestamp)
           AS engaged_sessions,
         count(DISTINCT ga_session_id) AS total_sessions
  FROM labelled GROUP BY user_id),
firsts AS (
  SELECT user_id, label,
         min((event_timestamp, {RANK}, event_id)) AS first_key
  FROM labelled WHERE label <> '' GROUP BY user_id, label),
lists AS (
  SELECT user_id, list(label ORDER BY first_key) AS activity_list
  FROM firsts GROUP BY user_id),
journeys_all AS (
  SELECT s.*, coalesce(l.activity_list, []::VARCHAR[]) AS activity_list,
         CASE WHEN s.user_id IN (SELECT user_id FROM conv_users) THEN 1 ELSE 0 END
           AS converted
  FROM stats s LEFT JOIN lists l USING (user_id))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def journeys_ctes(page_repr: str = "page_location") -> str:
    return _with(FLAT, CLEAN, USERS, _labelled(page_repr), JOURNEYS)


JOURNEY_SELECT = """
SELECT user_id, unique_days, unique_pages, unique_pageviews, engaged_sessions,
       total_sessions, array_to_string(activity_list, ' -> ') AS activity_list_text,
       CAST(len(activity_list) AS BIGINT) AS n_activities, CAST(converted AS INTEGER) AS converted
FROM journeys_all"""

CLEAN_COLS = ("event_id, user_id, event_date, event_name, event_timestamp, "
              "event_timestamp_sec, event_timestamp_diff, geo_region, geo_city, "
              "device_category, campaign, source, medium, source_medium, ga_session_id, "
              "ga_session_number, session_engaged, page_location, page_title")

MEDIUMS = """
mcounts AS (
  SELECT source_medium, count(*) AS count FROM clean
  WHERE event_name = 'session_start' GROUP BY source_medium),
mkept AS (
  SELECT source_medium, count,
         'medium_' || regexp_replace(regexp_replace(source_medium, '[^a-zA-Z0-9]+', '_', 'g'),
                                     '^[ _]+|[ _]+$', '', 'g') AS medium_column
  FROM mcounts
  WHERE count > (SELECT quantile_cont(count, 0.1) FROM mcounts)),
mstarts AS (
  SELECT user_id, event_timestamp,
         CASE WHEN source_medium IN (SELECT source_medium FROM mkept)
              THEN source_medium ELSE '(not set)' END AS medium
  FROM clean WHERE event_name = 'session_start'),
mper AS (
  SELECT g.user_id, g.medium, g.first_seen,
         coalesce((SELECT medium_column FROM mkept k WHERE k.source_medium = g.medium),
                  '(not set)') AS medium_column
  FROM (SELECT user_id, medium, min(event_timestamp) AS first_seen
        FROM mstarts GROUP BY user_id, medium) g)"""


def _mix_score(strategy: str) -> str:
    if strategy == "even":
        return "1.0 / count(*) OVER (PARTITION BY user_id)"
    order = "ASC" if strategy == "first" else "DESC"
    return (f"CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY medium {order})"
            " = 1 THEN 1.0 ELSE 0.0 END")


def _wide(scores: str) -> str:
    columns = ",\n  ".join(f"sum(CASE WHEN medium_column = '{c}' THEN score ELSE 0.0 END) AS \"{c}\""
                           for c in MEDIUM_COLUMNS)
    return f"SELECT user_id,\n  {columns}\nFROM {scores} GROUP BY user_id"


def journeys_with_mix_sql(strategy: str = "first") -> str:
    return (journeys_ctes() + "," + MEDIUMS + f""",
mscores AS (SELECT user_id, medium_column, CAST({_mix_score(strategy)} AS DOUBLE) AS score FROM mper),
jout AS ({JOURNEY_SELECT.strip()})
SELECT * FROM jout LEFT JOIN ({_wide('mscores')}) wide USING (user_id)""")


def _mix_sql(strategy: str) -> str:
    if strategy == "even":
        score = "1.0 / count(*) OVER (PARTITION BY user_id)"
    else:
        order = "ASC" if strategy == "first" else "DESC"
        score = (f"CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY medium {order})"
                 " = 1 THEN 1.0 ELSE 0.0 END")
    return (_with(FLAT, CLEAN, MEDIUMS)
            + f"\nSELECT user_id, medium, medium_column, CAST({score} AS DOUBLE) AS score FROM mper")


def journey_registry() -> dict[str, str]:
    base = _with(FLAT, CLEAN, USERS)
    jl = journeys_ctes()
    return {
        "clickstream": _with(FLAT) + "\nSELECT * FROM flat",
        "clean_events": _with(FLAT, CLEAN) + f"\nSELECT {CLEAN_COLS} FROM clean",
        "clean_events_text_time": _with(FLAT, FLAT_UNTIMED, CLEAN.replace("FROM flat\n", "FROM flat_untimed\n"))
                                  + f"\nSELECT {CLEAN_COLS} FROM clean",
        "event_gaps": _with(FLAT, CLEAN) + "\nSELECT user_id, event_id, event_name, "
                      "event_timestamp, event_timestamp_diff FROM clean",
        "user_counts": base + "\nSELECT * FROM counts",
        "multi_page_users": base + "\nSELECT user_id FROM band",
        "converters": base + "\nSELECT user_id FROM conv_users",
        "removed_users": base + "\nSELECT user_id FROM removed",
        "first_conversion": base + "\nSELECT * FROM first_conv",
        "truncated_events": base + "\nSELECT * FROM truncated",
        "labelled_events": jl + "\nSELECT user_id, event_id, event_name, event_timestamp, "
                           "label FROM labelled",
        "journeys": jl + JOURNEY_SELECT,
        "journeys_by_title": journeys_ctes("page_title") + JOURNEY_SELECT,
        "journeys_with_mix": journeys_with_mix_sql("first"),
        "relevant_events": _with(FLAT, CLEAN) + "\nSELECT * FROM rel",
        "balanced_journeys": journeys_ctes() + """,
conv_j AS (SELECT user_id, converted FROM journeys_all WHERE converted = 1),
non_j AS (
  SELECT user_id, converted,
         row_number() OVER (ORDER BY CAST(('0x' || substr(md5(user_id || ':42'), 1, 15))
                                          AS BIGINT), user_id) AS r
  FROM journeys_all WHERE converted = 0),
picked AS (
  SELECT user_id, converted FROM conv_j
  UNION ALL
  SELECT user_id, converted FROM non_j WHERE r <= (SELECT count(*) FROM conv_j))
SELECT p.user_id, CAST(p.converted AS INTEGER) AS converted,
       array_to_string(j.activity_list, ' -> ') AS activity_list_text
FROM picked p JOIN journeys_all j USING (user_id)""",
        "medium_mix_first_by_time": _with(FLAT, CLEAN, MEDIUMS) + """
SELECT user_id, medium, medium_column,
       CAST(CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY first_seen, medium) = 1
                 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM mper""",
        "medium_mix_not_set": _with(FLAT, FLAT_UNSET, CLEAN.replace("FROM flat\n", "FROM flat_unset\n"), MEDIUMS)
                              + f"\nSELECT user_id, medium, medium_column, CAST({_mix_score('even')} AS DOUBLE) "
                                "AS score FROM mper",
        "medium_mix_wide": _with(FLAT, CLEAN, MEDIUMS) + ",\nmscores AS (SELECT user_id, medium_column, "
                           f"CAST({_mix_score('first')} AS DOUBLE) AS score FROM mper)\n" + _wide("mscores"),
        "converted_events": jl + """
SELECT user_id, event_id, event_name, event_timestamp, label,
       CAST(CASE WHEN user_id IN (SELECT user_id FROM conv_users) THEN 1 ELSE 0 END AS INTEGER) AS converted
FROM labelled""",
        "journey_vectors": journeys_ctes() + """
SELECT user_id, CAST(len(activity_list) AS BIGINT) AS n_features,
       CAST(converted AS INTEGER) AS converted FROM journeys_all""",
        "medium_counts": _with(FLAT, CLEAN, MEDIUMS) + "\nSELECT * FROM mcounts",
        "kept_mediums": _with(FLAT, CLEAN, MEDIUMS) + "\nSELECT * FROM mkept",
        "medium_mix_first": _mix_sql("first"),
        "medium_mix_last": _mix_sql("last"),
        "medium_mix_even": _mix_sql("even"),
    }


# ---- sequences and divergence -------------------------------------------------------
# Brute force: every subsequence of every list (recursive CTE), support by
# distinct list id, closure by one-item deletions of equal support.


def _mine(name: str, where: str, min_freq: int) -> str:
    return f"""
{name}_s AS (SELECT user_id AS id, activity_list AS a FROM journeys_all WHERE {where}),
{name}_r AS (
  SELECT id, a, i::INT AS i, [a[i]] AS p
  FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM {name}_s)
  UNION
  SELECT id, a, j::INT, list_append(p, a[j])
  FROM (SELECT id, a, p, unnest(range(i + 1, len(a) + 1)) AS j FROM {name}_r)),
{name}_f AS (
  SELECT p, count(DISTINCT id) AS freq FROM {name}_r GROUP BY p
  HAVING count(DISTINCT id) >= {min_freq}),
{name}_d AS (
  SELECT DISTINCT list_concat(p[1:k - 1], p[k + 1:len(p)]) AS p, freq
  FROM (SELECT p, freq, unnest(range(1, len(p) + 1)) AS k FROM {name}_f)),
{name}_c AS (SELECT p, freq FROM {name}_f ANTI JOIN {name}_d USING (p, freq))"""


def _rwith(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _pattern_base() -> list[str]:
    return [FLAT, CLEAN, USERS, _labelled(), JOURNEYS]


def _text(rel: str, min_len: int) -> str:
    return (f"\nSELECT array_to_string(p, ' -> ') AS sequence, CAST(freq AS BIGINT) AS freq, "
            f"CAST(len(p) AS BIGINT) AS length FROM {rel} WHERE len(p) >= {min_len}")


CLASS_SETS = f"""
conv_k AS (SELECT p, freq FROM conv_c WHERE len(p) >= {CLASS_MIN_LEN}),
non_k AS (SELECT p, freq FROM non_c WHERE len(p) >= {CLASS_MIN_LEN}),
conv_o AS (SELECT p, freq FROM conv_k ANTI JOIN non_k USING (p)),
non_o AS (SELECT p, freq FROM non_k ANTI JOIN conv_k USING (p)),
pairs AS (
  SELECT n.p AS np, n.freq AS nf, c.p AS cp,
         len(list_filter(range(1, least(len(n.p), len(c.p)) + 1),
                         lambda i: n.p[1:i] = c.p[1:i])) AS d
  FROM non_o n CROSS JOIN conv_o c),
scored AS (
  SELECT array_to_string(cp, ' -> ') AS conversion_seq,
         array_to_string(np, ' -> ') AS non_conversion_seq,
         np[d + 1] AS diversion,
         ((d::DOUBLE / least(len(np), len(cp))) * (d::DOUBLE / least(len(np), len(cp))))
           / (((len(np) - d + (len(cp) - d))::DOUBLE / (len(np) + len(cp) - d)) + 1.0)
           AS divergence_score,
         CAST(nf AS BIGINT) AS non_conv_freq
  FROM pairs WHERE d < len(np) AND d < len(cp))"""


def _class_query(select: str) -> str:
    return (_rwith(*_pattern_base(), _mine("conv", "converted = 1", CLASS_MIN_FREQ),
                   _mine("non", "converted = 0", CLASS_MIN_FREQ), CLASS_SETS) + select)


def pattern_registry() -> dict[str, str]:
    allp = _rwith(*_pattern_base(), _mine("allj", "TRUE", ALL_MIN_FREQ))
    return {
        "frequent_sequences": allp + _text("allj_c", ALL_MIN_LEN),
        "frequent_sequences_open": allp + _text("allj_f", 1),
        "conv_sequences": _class_query(_text("conv_k", CLASS_MIN_LEN)),
        "nonconv_sequences": _class_query(_text("non_k", CLASS_MIN_LEN)),
        "conv_only_sequences": _class_query(_text("conv_o", CLASS_MIN_LEN)),
        "nonconv_only_sequences": _class_query(_text("non_o", CLASS_MIN_LEN)),
        "shared_sequences": _class_query(
            "\nSELECT array_to_string(p, ' -> ') AS sequence, CAST(len(p) AS BIGINT) AS length"
            " FROM conv_k SEMI JOIN non_k USING (p)"),
        "sequence_support": _class_query("""
, nonj AS (SELECT activity_list AS a FROM journeys_all WHERE converted = 0)
SELECT array_to_string(k.p, ' -> ') AS sequence,
       CAST(count(j.a) AS BIGINT) AS support
FROM conv_k k LEFT JOIN nonj j
  ON list_count(list_transform(k.p, lambda x: list_position(j.a, x))) = len(k.p)
 AND list_transform(k.p, lambda x: list_position(j.a, x))
     = list_sort(list_transform(k.p, lambda x: list_position(j.a, x)))
GROUP BY k.p"""),
        "divergence_top": _class_query(f"""
SELECT *, divergence_score * non_conv_freq AS weight FROM scored
ORDER BY weight DESC, non_conv_freq DESC, non_conversion_seq, conversion_seq
LIMIT {DIVERGENCE_TOP}"""),
        "divergence_count": _class_query(
            "\nSELECT CAST(count(*) AS BIGINT) AS divergent_pairs FROM scored"),
    }


# ---- features, keywords, pages ------------------------------------------------------

TOKEN_RX = r"[\pL\pN_]{2,}"


def extra_registry() -> dict[str, str]:
    allp = _rwith(*_pattern_base(), _mine("allj", "TRUE", ALL_MIN_FREQ))
    contains = ("list_count(list_transform(k.p, lambda x: list_position(j.activity_list, x)))"
                " = len(k.p) AND list_transform(k.p, lambda x: list_position(j.activity_list, x))"
                " = list_sort(list_transform(k.p, lambda x: list_position(j.activity_list, x)))")
    return {
        "sequence_features": allp + f"""
, pk AS (SELECT p FROM allj_c WHERE len(p) >= {ALL_MIN_LEN})
SELECT j.user_id, CAST(count(k.p) AS BIGINT) AS n_contained, CAST(j.converted AS INTEGER) AS converted
FROM journeys_all j LEFT JOIN pk k ON {contains}
GROUP BY j.user_id, j.converted""",
        "topic_keywords": f"""
WITH words AS (
  SELECT lang AS topic, lower(unnest(regexp_extract_all(text, '{TOKEN_RX}'))) AS word
  FROM documents),
tf AS (SELECT topic, word, count(*) AS tf FROM words GROUP BY topic, word),
size AS (SELECT topic, sum(tf) AS class_size FROM tf GROUP BY topic),
ft AS (SELECT word, sum(tf) AS f FROM tf GROUP BY word),
avgc AS (SELECT CAST(floor(avg(class_size)) AS DOUBLE) AS a FROM size),
w AS (
  SELECT tf.topic, tf.word,
         round(tf.tf / size.class_size * ln(1.0 + (SELECT a FROM avgc) / ft.f), 9) AS weight
  FROM tf JOIN size USING (topic) JOIN ft USING (word)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank FROM w)
SELECT topic, word AS keyword, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
        "url_paths": f"SELECT page_id, {_url('url', None)} AS path FROM pages",
    }


# ---- nested export source ------------------------------------------------------------

EXPORT_LO = (EXPORT_AS_OF - dt.timedelta(days=EXPORT_DAYS)).isoformat()
EXPORT_HI = EXPORT_AS_OF.isoformat()


def _param_sql(key: str, s: str = "NULL::VARCHAR", i: str = "NULL::BIGINT") -> str:
    return f"{{'key': '{key}', 'value': {{'string_value': {s}, 'int_value': {i}}}}}"


RAW_EXPORT = FLAT + f""",
raw_base AS (
  SELECT f.*, e.user_id, e.value, e.k,
         CAST(dayofmonth(f.event_date) AS BIGINT) AS dom
  FROM flat f JOIN ev_k e USING (event_id)),
raw_all AS (
  SELECT event_id,
    strftime(event_date, '%Y%m%d') AS event_date,
    event_name,
    epoch_us(event_timestamp) AS event_timestamp,
    CASE WHEN user_id % 13 <> 0 THEN user_pseudo_id END AS user_pseudo_id,
    {{'region': CASE WHEN k % 3 = 0 THEN '' ELSE 'Region ' || CAST(user_id % 5 AS VARCHAR) END,
     'city': CASE WHEN k % 4 <> 0 THEN 'City ' || CAST(user_id % 3 AS VARCHAR) END}} AS geo,
    {{'category': CASE WHEN k % 6 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'mobile'
                                                ELSE 'desktop' END END}} AS device,
    {{'name': 'campaign_' || CAST(user_id % 4 AS VARCHAR), 'medium': medium,
     'source': source}} AS traffic_source,
    {{'manual_campaign_name': CASE WHEN k % 5 = 1 THEN 'spring' END,
     'manual_medium': CASE WHEN k % 5 = 1 THEN 'social' END,
     'manual_source': CASE WHEN k % 5 = 1 THEN 'facebook' END}} AS collected_traffic_source,
    CASE WHEN k % 17 = 0 THEN [] ELSE list_filter([
      {_param_sql('ga_session_id', i="CASE WHEN k % 7 <> 0 THEN user_id * 100 + dom END")},
      {_param_sql('ga_session_number', i='dom')},
      {_param_sql('session_engaged', s="CASE WHEN k % 10 <> 0 THEN CASE WHEN value >= 10 THEN '1' ELSE '0' END END")},
      {_param_sql('page_location', s='page_location')},
      {_param_sql('page_title', s='page_title')}],
      lambda p: p.value.string_value IS NOT NULL OR p.value.int_value IS NOT NULL) END
      AS event_params,
    CASE WHEN event_date = DATE '2024-01-30' AND user_id % 2 = 0
         THEN 'intraday_' || strftime(event_date, '%Y%m%d')
         ELSE strftime(event_date, '%Y%m%d') END AS table_suffix
  FROM raw_base),
raw_export AS (
  SELECT * EXCLUDE (event_id) FROM raw_all
  UNION ALL
  SELECT * EXCLUDE (event_id) FROM raw_all WHERE event_id % 10 = 0),
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_pseudo_id, event_name, event_timestamp
                                 ORDER BY event_timestamp) AS rn
    FROM raw_export) WHERE rn = 1)"""

FLATTEN = """,
flat_export AS (
  SELECT 0::BIGINT AS event_id,
    CAST(strptime(max(event_date), '%Y%m%d') AS DATE) AS event_date,
    event_name,
    make_timestamp(event_timestamp) AS event_timestamp,
    user_pseudo_id,
    coalesce(nullif(max(geo.region), ''), '(not set)') AS geo_region,
    coalesce(nullif(max(geo.city), ''), '(not set)') AS geo_city,
    coalesce(nullif(max(device.category), ''), '(not set)') AS device_category,
    user_pseudo_id || '.' || CAST(max(CASE WHEN params.key = 'ga_session_id'
                                          THEN params.value.int_value END) AS VARCHAR)
      AS ga_session_id,
    max(CASE WHEN params.key = 'ga_session_number' THEN params.value.int_value END)
      AS ga_session_number,
    coalesce(CAST(max(CASE WHEN params.key = 'session_engaged'
                           THEN params.value.string_value END) AS BIGINT), 0) AS session_engaged,
    max(CASE WHEN params.key = 'page_location' THEN params.value.string_value END)
      AS page_location,
    max(CASE WHEN params.key = 'page_title' THEN params.value.string_value END) AS page_title,
    coalesce(max(collected_traffic_source.manual_campaign_name), max(traffic_source.name),
             '(not set)') AS campaign,
    coalesce(max(collected_traffic_source.manual_medium), max(traffic_source.medium),
             '(not set)') AS medium,
    coalesce(max(collected_traffic_source.manual_source), max(traffic_source.source),
             '(not set)') AS source,
    coalesce(max(collected_traffic_source.manual_source), max(traffic_source.source),
             '(direct)') || ' / ' ||
    coalesce(max(collected_traffic_source.manual_medium), max(traffic_source.medium),
             '(not set)') AS source_medium
  FROM deduped, unnest(event_params) AS t(params)
  WHERE user_pseudo_id IS NOT NULL
  GROUP BY user_pseudo_id, event_timestamp, event_name)"""

EXPORT_COLS = ("event_date, event_name, event_timestamp, user_pseudo_id, geo_region, geo_city, "
               "device_category, ga_session_id, ga_session_number, session_engaged, "
               "page_location, page_title, campaign, medium, source, source_medium")


def export_registry() -> dict[str, str]:
    base = "WITH " + RAW_EXPORT
    # The cleaning CTEs read ``flat``: point them at the flattened export.
    clean_from_export = CLEAN.replace("FROM flat\n", "FROM flat_export\n")
    return {
        "export_dedup": base + """
SELECT user_pseudo_id, event_name, event_timestamp,
       CAST(len(event_params) AS BIGINT) AS n_params FROM deduped""",
        "export_scan": base.replace("FROM raw_export) WHERE rn = 1", f"""FROM raw_export
    WHERE try_strptime(table_suffix, '%Y%m%d') BETWEEN DATE '{EXPORT_LO}' AND DATE '{EXPORT_HI}')
  WHERE rn = 1""") + FLATTEN + f"\nSELECT {EXPORT_COLS} FROM flat_export",
        "export_events": base + FLATTEN + f"\nSELECT {EXPORT_COLS} FROM flat_export",
        "export_shards": base + f"""
SELECT CAST(strptime(regexp_extract(table_suffix, '[0-9]+', 0), '%Y%m%d') AS DATE) AS table_date,
       contains(table_suffix, 'intraday') AS is_intraday, count(*) AS n_events
FROM raw_export
WHERE try_strptime(table_suffix, '%Y%m%d') BETWEEN DATE '{EXPORT_LO}' AND DATE '{EXPORT_HI}'
GROUP BY ALL""",
        "export_journeys": base + FLATTEN + "," + clean_from_export + "," + USERS + ","
                           + _labelled() + "," + JOURNEYS + JOURNEY_SELECT,
    }


# ---- reports --------------------------------------------------------------------------


def report_registry() -> dict[str, str]:
    top = pattern_registry()["divergence_top"]
    return {
        "divergence_report": f"""
WITH top AS ({top.strip()})
SELECT weight, non_conv_freq, non_conversion_seq, conversion_seq,
       'Conversion Sequence: ' || conversion_seq || chr(10) ||
       'Non-Conversion Sequence: ' || non_conversion_seq || chr(10) ||
       'Diversion Node: ' || diversion || chr(10) ||
       'Diversion Score: ' || CAST(CAST(round_even(divergence_score, 2) AS DOUBLE) AS VARCHAR)
       || ' Frequency: ' || CAST(non_conv_freq AS VARCHAR) AS report
FROM top""",
        "user_counts_ranked": _with(FLAT, CLEAN, USERS) + "\nSELECT * FROM counts",
    }


def registry() -> dict[str, str]:
    """DuckDB text for every query that SQL can express."""
    out = {}
    for part in (journey_registry, pattern_registry, extra_registry, export_registry,
                 report_registry):
        out.update(part())
    allj = _rwith(*_pattern_base(), _mine("allj", "TRUE", ALL_MIN_FREQ))
    patterns = allj + _text("allj_c", ALL_MIN_LEN)
    out.update(cluster_queries.oracle_sql(patterns, _rwith(*_pattern_base())))
    return out
