"""DuckDB SQL giving the same answers as the queries, written separately from them.

Where the library aggregates over time buckets, the SQL orders whole groups; where it ray-casts,
the SQL compares with box sides; and so on.
"""

from __future__ import annotations

from tidemark import fixed_values as fixed
from tidemark.plans.queries import BOXES, CLEAN_DAYS, ORDERS_AS_OF, SWEEP_MINUTES, WATERMARK

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
ORACLES: dict[str, str] = {}


def _values(rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def _map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


def _time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


_RULES = [(name, severity, i) for i, (name, severity, _) in enumerate(fixed.RULES)]
_RULE_CASES = {
    "unique_key_missing": "unique_key IS NULL",
    "complaint_type_missing": "complaint_type_raw IS NULL",
    "complaint_type_unrecognized": "complaint_type_raw IS NOT NULL AND NOT known_category",
    "created_date_missing": "created_date IS NULL",
    "created_date_future": f"created_date > {AS_OF} + INTERVAL 1 HOUR",
    "closed_before_created": "closed_date < created_date - INTERVAL 1 MINUTE",
    "zip_missing": "incident_zip IS NULL AND trim(coalesce(zip_raw, '')) = ''",
    "zip_malformed": "incident_zip IS NULL AND trim(coalesce(zip_raw, '')) <> ''",
    "zip_outside_nyc": "incident_zip IS NOT NULL AND NOT in_city",
    "coords_missing": "latitude IS NULL AND longitude IS NULL",
    "coords_partial": "(latitude IS NULL) <> (longitude IS NULL)",
    "coords_null_island": "abs(latitude) < 1e-6 AND abs(longitude) < 1e-6",
    "coords_swapped": "NOT in_box AND swapped_in_box",
    "coords_outside_nyc": "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT in_box "
    "AND NOT swapped_in_box AND NOT (abs(latitude) < 1e-6 AND abs(longitude) < 1e-6)",
    "borough_zip_conflict": "agrees = false",
}
_DETAILS = {
    "closed_before_created": "'closed_date precedes created_date by ' || "
    "CASE date_part('day', created_date - closed_date) WHEN 0 THEN '' WHEN 1 THEN '1 day, ' "
    "ELSE date_part('day', created_date - closed_date) || ' days, ' END || "
    "CAST(date_part('hour', created_date - closed_date) AS VARCHAR) || ':' || "
    "lpad(CAST(date_part('minute', created_date - closed_date) AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST(CAST(floor(date_part('second', created_date - closed_date)) AS INT) AS VARCHAR), 2, '0')",
    "borough_zip_conflict": "'borough is ' || borough || ' but ZIP ' || incident_zip || "
    "' is allocated to ' || coalesce(zip_borough, 'None')",
}
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
_POINT = "coalesce(CAST(latitude AS VARCHAR), 'None') || '{0}' || coalesce(CAST(longitude AS VARCHAR), 'None')"
_FIELD_VALUES = {
    "complaint_type_unrecognized": "complaint_type_raw",
    "created_date_future": _ISO.format("created_date"),
    "closed_before_created": _ISO.format("closed_date"),
    "zip_malformed": "zip_raw",
    "zip_outside_nyc": "incident_zip",
    "coords_partial": "'lat=' || " + _POINT.format(" lon="),
    "coords_null_island": "'0,0'",
    "coords_swapped": _POINT.format(","),
    "coords_outside_nyc": _POINT.format(","),
    "borough_zip_conflict": "borough || '/' || incident_zip",
}


def _failures_cte() -> str:
    parts = []
    texts = {name: (severity, detail) for name, severity, detail in fixed.RULES}
    for name, condition in _RULE_CASES.items():
        severity, detail = texts[name]
        detail = _DETAILS.get(name, f"'{detail}'")
        value = _FIELD_VALUES.get(name, "CAST(NULL AS VARCHAR)")
        parts.append(
            f"SELECT event_id, unique_key, '{name}' AS rule, '{severity}' AS severity, "
            f"{detail} AS detail, {value} AS field_value FROM std WHERE {condition}"
        )
    return "failures AS (" + " UNION ALL ".join(parts) + ")"


_IN_BOX = "coalesce({0} BETWEEN 40.477 AND 40.918 AND {1} BETWEEN -74.259 AND -73.700, false)"
_FEED = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k FROM events),
feed AS (
  SELECT event_id, ts, k, props,
    CASE WHEN event_id % 499 <> 0 THEN CAST(event_id AS VARCHAR) END AS unique_key,
    CASE event_type
      WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'Noise - Residential' ELSE 'noise  residential' END
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'Heating' ELSE 'HEAT/HOT WATER' END
      WHEN 'error' THEN 'Abandoned Vehicle'
      WHEN 'purchase' THEN CASE WHEN k % 20 <> 0 THEN 'Street Condition' END
      WHEN 'signup' THEN 'Brand New Category' END AS complaint_type_raw,
    CASE WHEN event_id % 487 = 0 THEN NULL
         WHEN event_id % 491 = 0 THEN ts + INTERVAL 60 DAY ELSE ts END AS created_date,
    CASE WHEN k % 3 = 0 THEN NULL
         WHEN k % 11 = 1 THEN ts - INTERVAL 2 HOUR
         WHEN k % 11 = 2 THEN ts - INTERVAL 30 SECOND
         ELSE ts + to_seconds(CAST(floor(value * 3600 + 0.5) AS BIGINT)) END AS closed_date,
    CASE WHEN k % 3 = 0 THEN 'Open' ELSE 'Closed' END AS status,
    ['MANHATTAN', 'The Bronx', 'Kings', 'Queens', 'Staten Is', 'Unspecified'][user_id % 6 + 1] AS borough_raw,
    CASE k WHEN 7 THEN 'N/A' WHEN 8 THEN '' WHEN 9 THEN '11215' WHEN 10 THEN '10463'
      ELSE ['10011', '10457', '11215-3401', ' 11375 ', '10314', '07030'][user_id % 6 + 1] END AS zip_raw,
    CASE WHEN k % 2 = 0
      THEN (user_id % 40 + 1) || ' East ' || (user_id % 9 + 4) || 'th Street'
      ELSE (user_id % 40 + 1) || ' E. ' || (user_id % 9 + 4) || ' ST' END AS address_raw,
    CASE WHEN k = 20 THEN NULL WHEN k = 22 THEN '0' WHEN k = 23 THEN '-73.9'
         WHEN k = 24 THEN '34.05' WHEN k = 25 THEN 'N/A' ELSE '40.7' END AS lat_raw,
    CASE WHEN k IN (20, 21) THEN NULL WHEN k = 22 THEN '0' WHEN k = 23 THEN '40.7'
         WHEN k = 24 THEN '-118.24' ELSE '-73.9' END AS lon_raw,
    date_trunc('second', ts) + to_seconds(60 * k) AS source_updated_at
  FROM ev
),
aliases(label, canonical) AS (VALUES {_values(fixed.CATEGORY_ALIASES)}),
spellings(spelling, borough) AS (VALUES {_values(fixed.BOROUGH_SPELLINGS)}),
ranges(lo, hi, zip_borough) AS (VALUES {_values(fixed.ZIP_RANGES)}),
tidy AS (
  SELECT *,
    upper(trim(regexp_replace(complaint_type_raw, '\\s+', ' ', 'g'))) AS label,
    trim(regexp_replace(complaint_type_raw, '\\s+', ' ', 'g')) AS complaint_type,
    nullif(nullif(regexp_extract(zip_raw, '^\\s*(\\d{{5}})(\\s*-?\\s*\\d{{4}})?\\s*$', 1), ''), '00000') AS incident_zip,
    array_to_string(list_transform(
      string_split(regexp_replace(trim(regexp_replace(regexp_replace(upper(address_raw),
        '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(\\d+)(ST|ND|RD|TH)\\b', '\\1', 'g'), ' '),
      lambda t: coalesce({_map(fixed.ADDRESS_WORDS)}[t], t)), ' ') AS address_norm,
    TRY_CAST(lat_raw AS DOUBLE) AS latitude, TRY_CAST(lon_raw AS DOUBLE) AS longitude
  FROM feed
),
std AS (
  SELECT t.*, coalesce(a.canonical, t.label) AS complaint_type_norm,
    a.label IS NOT NULL AS known_category, s.borough,
    r.zip_borough,
    coalesce(r.zip_borough IS NOT NULL OR t.incident_zip IN ('10463', '11370'), false) AS in_city,
    CASE WHEN t.incident_zip IS NULL OR s.borough IS NULL THEN NULL
         WHEN t.incident_zip = '10463' THEN s.borough IN ('BRONX', 'MANHATTAN')
         WHEN t.incident_zip = '11370' THEN s.borough = 'QUEENS'
         ELSE r.zip_borough = s.borough END AS agrees,
    {_IN_BOX.format("t.latitude", "t.longitude")} AS in_box,
    {_IN_BOX.format("t.longitude", "t.latitude")} AS swapped_in_box
  FROM tidy t
  LEFT JOIN aliases a ON a.label = t.label
  LEFT JOIN spellings s ON s.spelling = upper(t.borough_raw)
  LEFT JOIN ranges r ON TRY_CAST(t.incident_zip AS INTEGER) BETWEEN r.lo AND r.hi
    AND t.incident_zip NOT IN ('10463', '11370')
),
{_failures_cte()},
verdicts AS (
  SELECT s.event_id, coalesce(bool_or(f.severity = 'reject'), false) AS is_rejected,
    count(f.rule) FILTER (WHERE f.severity <> 'observe') AS defect_count,
    count(f.rule) AS failure_count,
    coalesce(bool_or(f.rule = 'borough_zip_conflict'), false) AS zip_borough_conflict,
    coalesce(bool_or(f.rule = 'complaint_type_unrecognized'), false) AS unrecognized_type
  FROM std s LEFT JOIN failures f USING (event_id) GROUP BY s.event_id
),
batch AS (SELECT * FROM std JOIN verdicts USING (event_id)),
accepted AS (SELECT * FROM batch WHERE NOT is_rejected)
"""


def _links(name: str, source: str, group: str, time: str, key: str, minutes: int) -> str:
    """Chained links by ordering whole groups."""
    over = f"PARTITION BY {group} ORDER BY {time}, {key}"
    return f"""
{name}_gaps AS (
  SELECT {group}, {time} AS t, {key} AS key,
    CASE WHEN {time} - lag({time}) OVER ({over}) <= INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS opens
  FROM {source}
),
{name}_numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY {group} ORDER BY t, key ROWS UNBOUNDED PRECEDING) AS cluster
  FROM {name}_gaps
),
{name}_all AS (
  SELECT *, first_value(key) OVER c AS head, first_value(t) OVER c AS head_t
  FROM {name}_numbered WINDOW c AS (PARTITION BY {group}, cluster ORDER BY t, key)
),
{name} AS (
  SELECT key AS unique_key, head AS duplicate_of,
    round((epoch_us(t) - epoch_us(head_t)) / 60000000.0, 2) AS minutes_apart
  FROM {name}_all WHERE key <> head
)"""


_EVENTS = "keyed AS (SELECT *, CAST(event_id AS VARCHAR) AS event_key FROM events)"
_CLEAN = (
    _FEED
    + ","
    + _links("links", "accepted", "complaint_type_norm, address_norm", "created_date", "unique_key", 60)
    + """,
clean AS (
  SELECT a.*, l.duplicate_of AS is_duplicate_of FROM accepted a LEFT JOIN links l USING (unique_key)
)"""
)


def _rollup(source: str) -> str:
    survivor = "is_duplicate_of IS NULL"
    return f"""
SELECT CAST(created_date AS DATE) AS day, coalesce(borough, 'UNSPECIFIED') AS borough,
  coalesce(complaint_type_norm, 'UNKNOWN') AS complaint_type_norm,
  count(*) FILTER (WHERE {survivor}) AS request_count,
  count(*) FILTER (WHERE {survivor} AND closed_date IS NOT NULL) AS closed_count,
  quantile_cont(epoch_us(closed_date) - epoch_us(created_date), 0.5)
    FILTER (WHERE {survivor} AND closed_date >= created_date) / 3600000000.0 AS median_hours_to_close,
  count(*) FILTER (WHERE {survivor} AND defect_count > 0) AS defect_count,
  count(*) FILTER (WHERE is_duplicate_of IS NOT NULL) AS duplicate_count
FROM {source} GROUP BY 1, 2, 3"""


_DAILY = _CLEAN + ", daily AS (" + _rollup("clean") + ")"
_DAY_TEXT = "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM"

ORACLES["standardize_feed"] = f"""WITH {_FEED}
SELECT event_id, unique_key, {_time("created_date")} AS created_date, {_time("closed_date")} AS closed_date,
  {_time("source_updated_at")} AS source_updated_at, complaint_type, complaint_type_norm, known_category,
  status, borough, incident_zip, address_raw AS incident_address, address_norm, latitude, longitude
FROM std"""

ORACLES["clean_document_text"] = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents)
SELECT doc_id, nullif(whole, '') AS cleaned, substr(nullif(whole, ''), 1, 2000) AS cut_2000, length(whole) AS whole_length,
  md5(whole) AS whole_md5 FROM d"""

ORACLES["category_canonical_counts"] = f"""WITH {_FEED}
SELECT complaint_type_norm, known_category, count(*) AS n FROM std GROUP BY ALL"""

ORACLES["address_key_counts"] = f"""WITH {_FEED}
SELECT address_norm, count(*) AS n FROM tidy GROUP BY ALL"""

ORACLES["validation_failures"] = f"WITH {_FEED} SELECT * FROM failures"

_REPORT = f"""WITH {_FEED}, rules(rule, severity, ord) AS (VALUES {_values(_RULES)}),
counted AS (SELECT rule, count(*) AS n FROM failures GROUP BY rule)
SELECT r.rule, r.severity, r.ord, coalesce(c.n, 0) AS failures,
  round(100.0 * coalesce(c.n, 0) / (SELECT count(*) FROM feed), 3) AS rate_pct
FROM rules r LEFT JOIN counted c USING (rule)"""
ORACLES["rule_counts_zero_filled"] = _REPORT
ORACLES["stored_rule_report"] = _REPORT

ORACLES["accepted_rejected_split"] = f"""WITH {_FEED}
SELECT count(*) AS rows_fetched, count(*) FILTER (WHERE is_rejected) AS rows_rejected,
  count(*) FILTER (WHERE unique_key IS NULL) AS rows_keyless,
  count(*) FILTER (WHERE NOT is_rejected) AS rows_accepted,
  count(*) FILTER (WHERE NOT is_rejected AND failure_count > 0) AS rows_flagged,
  count(*) FILTER (WHERE NOT is_rejected AND unrecognized_type) AS unrecognized_types,
  {_time("max(source_updated_at) FILTER (WHERE unique_key IS NOT NULL)")} AS max_updated_at
FROM batch"""

ORACLES["observed_counters"] = ORACLES["accepted_rejected_split"]
ORACLES["record_verdicts"] = f"WITH {_FEED} SELECT * FROM verdicts"

ORACLES["orders_date_rules"] = f"""
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS closed FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderdate AS created, closed FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, 'closed_before_created' AS rule, 'flag' AS severity,
  'closed_date precedes created_date by ' || date_diff('day', closed, created)
    || CASE WHEN date_diff('day', closed, created) = 1 THEN ' day, ' ELSE ' days, ' END || '0:00:00' AS detail,
  strftime(closed, '%Y-%m-%dT%H:%M:%S+00:00') AS field_value
FROM o WHERE closed < created - INTERVAL 1 MINUTE
UNION ALL
SELECT o_orderkey, 'created_date_future', 'flag', 'created_date is in the future',
  strftime(created, '%Y-%m-%dT%H:%M:%S+00:00')
FROM o WHERE created > TIMESTAMP '{ORDERS_AS_OF}' + INTERVAL 1 HOUR"""

ORACLES["replay_rules"] = f"""WITH {_FEED}
SELECT unique_key, rule, CASE rule WHEN 'created_date_future' THEN 'fixed'
  WHEN 'zip_outside_nyc' THEN 'new' ELSE 'same' END AS outcome
FROM failures WHERE unique_key IS NOT NULL"""

ORACLES["zip_borough_range_join"] = f"""WITH {_FEED}
SELECT event_id, incident_zip, borough, zip_borough, in_city, CAST(agrees AS VARCHAR) AS agrees FROM std"""

ORACLES["coordinate_classes"] = f"""WITH {_FEED}
SELECT s.event_id, f.rule AS coordinate_class, in_box,
  coalesce(abs(latitude) < 1e-6 AND abs(longitude) < 1e-6, false) AS zero_point,
  NOT in_box AND swapped_in_box AS swapped
FROM std s LEFT JOIN failures f ON f.event_id = s.event_id AND f.rule LIKE 'coords%'"""

ORACLES["pair_distance"] = """
WITH p AS (
  SELECT o_orderkey, radians((o_orderkey % 1700) / 10.0 - 85) AS a, radians((o_orderkey % 3590) / 10.0 - 179) AS b,
    radians(c_nationkey * 5.0 - 60) AS c, radians(c_nationkey * 12.0 - 150) AS d
  FROM orders JOIN customer ON c_custkey = o_custkey
)
SELECT o_orderkey, round(2 * 6371.0088 * asin(sqrt(
  pow(sin((c - a) / 2), 2) + cos(a) * cos(c) * pow(sin((d - b) / 2), 2))), 5) AS km FROM p"""

ORACLES["boundary_regions"] = """
WITH p AS (
  SELECT c_custkey, c_custkey * 7 % 3000 / 10.0::DOUBLE - 149.95::DOUBLE AS x,
    c_custkey * 13 % 1000 / 10.0::DOUBLE - 49.97::DOUBLE AS y FROM customer
)
SELECT c_custkey, (
  SELECT r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  WHERE x BETWEEN n_nationkey * 12 - 150 AND n_nationkey * 12 - 140
    AND y BETWEEN n_regionkey * 20 - 50 AND n_regionkey * 20 - 35
) AS found_region FROM p"""
ORACLES["point_in_polygon"] = f"""WITH {_FEED},
boxes(name, ord, w, s, e, n) AS (VALUES {_values([(b[0], i, *b[1:]) for i, b in enumerate(BOXES)])}),
points AS (
  SELECT event_id, borough, agrees, CAST(40.45 AS DOUBLE) + (event_id % 487) / 1000.0 AS y,
    CAST(-74.28 AS DOUBLE) + (event_id % 613) / 1000.0 AS x FROM std
),
found AS (
  SELECT p.*, (SELECT arg_min(name, ord) FROM boxes
    WHERE x BETWEEN w AND e AND y BETWEEN s AND n) AS found_borough FROM points p
)
SELECT event_id, found_borough,
  CASE WHEN agrees = false THEN 'borough_zip_conflict'
       WHEN borough <> found_borough AND {_IN_BOX.format("y", "x")} THEN 'borough_geo_conflict' END AS failed_rule
FROM found"""

ORACLES["dup_links_events"] = (
    f"WITH {_EVENTS}," + _links("links", "keyed", "event_type, user_id", "ts", "event_key", 60)
    + " SELECT * FROM links"
)
ORACLES["dup_links_feed"] = f"WITH {_CLEAN} SELECT * FROM links"
ORACLES["incremental_links"] = (
    """WITH moved AS (
  SELECT CAST(event_id AS VARCHAR) AS event_key, event_type,
    CASE WHEN event_id % 7 = 0 THEN user_id % 5 ELSE user_id END AS user_id,
    CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 90 MINUTE ELSE ts END AS ts
  FROM events
),"""
    + _links("links", "moved", "event_type, user_id", "ts", "event_key", 60)
    + """ SELECT event_key AS unique_key, duplicate_of AS is_duplicate_of
FROM moved m LEFT JOIN links l ON l.unique_key = m.event_key"""
)
ORACLES["live_clusters"] = f"""
WITH gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS opens
  FROM events WHERE event_type <> '' AND user_id IS NOT NULL AND ts IS NOT NULL
  WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps
)
SELECT event_type, user_id, {_time("min(ts)")} AS first_at, {_time("max(ts)")} AS last_at,
  arg_min(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS survivor, count(*) AS members
FROM numbered GROUP BY event_type, user_id, cluster"""
ORACLES["cluster_sizes"] = (
    f"WITH {_EVENTS}," + _links("links", "keyed", "event_type, user_id", "ts", "event_key", 1440)
    + " SELECT duplicate_of, count(*) AS absorbed FROM links GROUP BY 1"
)


def _sweep(source: str, group: str, time: str, key: str) -> str:
    return ",".join(_links(f"w{m}", source, group, time, key, m) for m in SWEEP_MINUTES) + " UNION ALL ".join(
        f"""
SELECT {m} AS window_minutes, (SELECT count(*) FROM {source}) AS candidates, count(*) AS collapsed,
  round(100.0 * count(*) / (SELECT count(*) FROM {source}), 2) AS collapsed_pct,
  coalesce((SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM w{m} GROUP BY duplicate_of)), 0) AS largest_cluster
FROM w{m}"""
        for m in SWEEP_MINUTES
    )


ORACLES["dedup_window_sweep"] = f"WITH {_EVENTS}," + _sweep("keyed", "event_type, user_id", "ts", "event_key")
ORACLES["dedup_sweep_recent"] = (
    f"WITH {_FEED}, recent AS (SELECT * FROM accepted WHERE complaint_type_norm IS NOT NULL "
    f"AND address_norm IS NOT NULL AND created_date >= {AS_OF} - INTERVAL 20 DAY),"
    + _sweep("recent", "complaint_type_norm, address_norm", "created_date", "unique_key")
)
ORACLES["neighbour_band_join"] = f"""
SELECT DISTINCT c.event_id, c.event_type, c.user_id, {_time("c.ts")} AS ts
FROM events c JOIN events t ON c.event_type = t.event_type AND c.user_id = t.user_id
  AND c.ts BETWEEN t.ts - INTERVAL 1440 MINUTE AND t.ts + INTERVAL 1440 MINUTE
WHERE t.ts >= TIMESTAMP '{WATERMARK}'"""
ORACLES["apply_links"] = (
    f"WITH {_FEED},"
    + _links("links", "accepted", "complaint_type_norm, address_norm", "created_date", "unique_key", 240)
    + """ SELECT a.unique_key, l.duplicate_of AS is_duplicate_of
FROM accepted a LEFT JOIN links l USING (unique_key)"""
)

ORACLES["latest_revision"] = f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  {_time("l_shipdate")} AS l_shipdate
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
  l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC,
  l_returnflag DESC, l_linestatus DESC) = 1"""

ORACLES["stream_latest_revision"] = ORACLES["latest_revision"]
ORACLES["upsert_insert_update"] = f"""
WITH s AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
i AS (
  SELECT o_orderkey, o_totalprice + 1 AS price,
    o_orderdate + CASE WHEN o_orderstatus = 'P' THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END AS d
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
),
m AS (
  SELECT coalesce(i.o_orderkey, s.o_orderkey) AS o_orderkey,
    CASE WHEN i.o_orderkey IS NULL OR i.d < s.o_orderdate THEN 'kept'
         WHEN s.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change,
    s.o_totalprice AS old_price, i.price, s.o_orderdate AS old_d, i.d
  FROM s FULL JOIN i ON s.o_orderkey = i.o_orderkey
)
SELECT o_orderkey, change, round(CASE change WHEN 'kept' THEN old_price ELSE price END, 2) AS o_totalprice,
  {_time("CASE change WHEN 'kept' THEN old_d ELSE d END")} AS o_orderdate FROM m"""
ORACLES["bucketed_upsert"] = ORACLES["upsert_insert_update"]
ORACLES["order_lookup"] = f"""
WITH k AS (SELECT max(o_orderkey) AS o_orderkey FROM orders),
r AS (
  SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
  UNION ALL
  SELECT * REPLACE (o_totalprice + 1 AS o_totalprice,
    o_orderdate + CASE WHEN o_orderstatus = 'P' THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END AS o_orderdate)
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS o_totalprice,
  {_time("o_orderdate")} AS o_orderdate
FROM r JOIN k USING (o_orderkey) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1"""

ORACLES["raw_keep_seen_count"] = f"""WITH {_FEED}
SELECT unique_key, props AS payload, {_time("source_updated_at")} AS source_updated_at,
  CAST(1 + CASE WHEN source_updated_at < TIMESTAMP '{WATERMARK}' THEN 1 ELSE 0 END AS BIGINT) AS seen_count
FROM batch WHERE unique_key IS NOT NULL AND failure_count > 0"""

ORACLES["daily_rollup"] = f"WITH {_DAILY} {_DAY_TEXT} daily"
ORACLES["daily_by_differences"] = ORACLES["daily_rollup"]
ORACLES["daily_rollup_orders"] = f"""
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS closed_date FROM lineitem GROUP BY 1),
o AS (
  SELECT r_name AS borough, o_orderpriority AS complaint_type_norm, o_orderdate AS created_date, closed_date,
    CASE WHEN closed_date < o_orderdate THEN 1 ELSE 0 END AS defect_count, NULL AS is_duplicate_of
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey LEFT JOIN s ON l_orderkey = o_orderkey
)
{_DAY_TEXT} ({_rollup("o")})"""
ORACLES["touched_day_rollup"] = f"""WITH {_DAILY}
{_DAY_TEXT} daily WHERE day IN (
  SELECT CAST(created_date AS DATE) FROM clean WHERE source_updated_at >= TIMESTAMP '{WATERMARK}')"""
ORACLES["recent_day_rollup"] = f"WITH {_DAILY} {_DAY_TEXT} daily"
ORACLES["daily_by_dimension"] = f"WITH {_DAILY}" + " UNION ALL ".join(
    f"""
SELECT '{name}' AS dimension, CAST({column} AS VARCHAR) AS key, CAST(sum(request_count) AS BIGINT) AS request_count,
  CAST(sum(closed_count) AS BIGINT) AS closed_count, CAST(sum(defect_count) AS BIGINT) AS defect_count,
  CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count,
  CAST(round(CAST(avg(median_hours_to_close) AS DECIMAL(38, 10)), 1) AS DOUBLE) AS avg_median_hours_to_close
FROM daily WHERE day >= DATE '2024-02-01' - 20 GROUP BY {column}"""
    for name, column in (("day", "day"), ("borough", "borough"), ("complaint_type", "complaint_type_norm"))
)

ORACLES["top_categories"] = f"""WITH {_CLEAN}
SELECT complaint_type_norm AS complaint_type, count(*) AS n, bool_or(unrecognized_type) AS has_unrecognized
FROM clean WHERE complaint_type_norm IS NOT NULL AND is_duplicate_of IS NULL
GROUP BY 1 ORDER BY n DESC, complaint_type LIMIT 40"""
ORACLES["borough_defect_rate"] = f"""WITH {_CLEAN}
SELECT coalesce(borough, 'UNSPECIFIED') AS borough, count(*) AS n,
  count(*) FILTER (WHERE defect_count > 0) AS with_defects,
  round(100.0 * count(*) FILTER (WHERE defect_count > 0) / count(*), 2) AS defect_rate_pct
FROM clean WHERE is_duplicate_of IS NULL GROUP BY 1"""
_PAGE = """is_duplicate_of IS NULL AND borough = 'BROOKLYN' AND status ILIKE 'clo_ed' AND defect_count > 0
  AND created_date >= DATE '2024-01-05'"""
ORACLES["requests_page"] = f"""WITH {_CLEAN}
SELECT unique_key, {_time("c.created_date")} AS created_date, {_time("closed_date")} AS closed_date,
  complaint_type_norm, status, borough, incident_zip, address_raw AS incident_address, defect_count
FROM clean c WHERE {_PAGE} ORDER BY c.created_date DESC NULLS LAST, unique_key LIMIT 50 OFFSET 25"""
ORACLES["requests_seek"] = f"""WITH {_CLEAN}
SELECT unique_key, {_time("c.created_date")} AS created_date, complaint_type_norm, borough, defect_count
FROM clean c WHERE {_PAGE} ORDER BY c.created_date DESC NULLS LAST, unique_key LIMIT 25 OFFSET 50"""
ORACLES["requests_total"] = f"WITH {_CLEAN} SELECT count(*) AS total FROM clean WHERE {_PAGE}"
ORACLES["request_detail"] = f"""WITH {_CLEAN}
SELECT c.unique_key, c.is_duplicate_of,
  (SELECT count(*) FROM failures f WHERE f.unique_key = c.unique_key) AS failure_count,
  (SELECT min(rule) FROM failures f WHERE f.unique_key = c.unique_key) AS first_rule,
  (SELECT max(rule) FROM failures f WHERE f.unique_key = c.unique_key) AS last_rule,
  (SELECT count(*) FROM clean d WHERE d.is_duplicate_of = c.unique_key) AS duplicate_count,
  {_time("(SELECT min(created_date) FROM clean d WHERE d.is_duplicate_of = c.unique_key)")} AS first_duplicate_at,
  {_time("(SELECT max(created_date) FROM clean d WHERE d.is_duplicate_of = c.unique_key)")} AS last_duplicate_at
FROM clean c"""
ORACLES["quality_labels"] = f"""WITH {_CLEAN}
SELECT unique_key, CASE
  WHEN zip_borough_conflict OR unrecognized_type OR is_duplicate_of IS NOT NULL THEN concat_ws(', ',
    CASE WHEN zip_borough_conflict THEN 'borough conflict' END,
    CASE WHEN unrecognized_type THEN 'new category' END,
    CASE WHEN is_duplicate_of IS NOT NULL THEN 'duplicate' END)
  WHEN defect_count = 1 THEN '1 defect' WHEN defect_count > 1 THEN defect_count || ' defects'
  ELSE '' END AS labels
FROM clean"""
ORACLES["store_totals"] = f"""WITH {_DAILY}
SELECT (SELECT count(*) FROM clean) AS clean_rows,
  (SELECT count(*) FROM clean WHERE is_duplicate_of IS NOT NULL) AS duplicate_rows,
  (SELECT count(*) FROM clean WHERE defect_count > 0) AS defective_rows,
  (SELECT count(*) FROM batch WHERE unique_key IS NOT NULL AND failure_count > 0) AS raw_rows,
  (SELECT count(*) FROM daily) AS agg_rows, (SELECT CAST(min(day) AS VARCHAR) FROM daily) AS agg_since"""

ORACLES["incremental_scan"] = f"""WITH {_FEED}
SELECT event_id, {_time("f.source_updated_at")} AS source_updated_at FROM feed f
WHERE f.source_updated_at >= TIMESTAMP '{WATERMARK}'"""
ORACLES["next_watermark"] = f"""WITH {_FEED}
SELECT count(*) AS rows_fetched, {_time("max(source_updated_at) + INTERVAL 1 MILLISECOND")} AS watermark
FROM feed WHERE source_updated_at >= {AS_OF} - INTERVAL 3 DAY"""
_PROBE_FIELDS = [
    ("unique_key", "unique_key"),
    ("complaint_type", "complaint_type_raw"),
    ("created_date", "created_date"),
    ("closed_date", "closed_date"),
    ("status", "status"),
    ("borough", "borough_raw"),
    ("incident_zip", "nullif(zip_raw, '')"),
    ("incident_address", "address_raw"),
    ("latitude", "lat_raw"),
    ("longitude", "lon_raw"),
    ("updated_at", "source_updated_at"),
    ("k", "k"),
]
# Fields that are absent from a record are not written to its JSON; empty text is.
ORACLES["drift_probe"] = f"WITH {_FEED}, fields AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS field, {'zip_raw' if name == 'incident_zip' else column} IS NOT NULL AS present, "
    f"{column} IS NOT NULL AS filled FROM feed"
    for name, column in _PROBE_FIELDS
) + """)
SELECT field, count(*) FILTER (WHERE present) AS rows_present, count(*) FILTER (WHERE filled) AS rows_filled,
  round(100.0 * count(*) FILTER (WHERE filled) / count(*) FILTER (WHERE present), 2) AS fill_pct
FROM fields GROUP BY field"""

ORACLES["day_table_counts"] = f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
WHERE ts >= {AS_OF} - INTERVAL 21 DAY AND NOT (ts >= TIMESTAMP '{WATERMARK}' AND event_id % 10 = 0) GROUP BY 1"""
ORACLES["retention_counts"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS name, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL {days} DAY) AS kept,
  count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL {days} DAY) AS pruned FROM events"""
    for name, days in (("raw", 7), ("clean", 21), ("runs", 365))
)

_RUNS = """
runs AS (
  SELECT CAST(day(ts) AS BIGINT) AS id, date_trunc('day', min(ts)) AS started_at, max(ts) AS finished_at,
    CASE WHEN day(ts) % 7 = 0 THEN 'partial' WHEN day(ts) % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
    count(*) AS rows_fetched, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS rows_inserted,
    count(*) FILTER (WHERE event_type = 'purchase') AS rows_updated,
    count(*) FILTER (WHERE event_type = 'error') AS rows_rejected,
    count(*) FILTER (WHERE value > 20) AS rows_flagged,
    count(*) FILTER (WHERE event_type = 'signup') AS duplicates_collapsed
  FROM events GROUP BY day(ts)
)"""
ORACLES["run_log_delta"] = f"""WITH {_RUNS}
SELECT id, status, {_time("r.started_at")} AS started_at, rows_fetched, """ + ", ".join(
    f"CAST({c} - lag({c}) OVER (ORDER BY id) AS DOUBLE) AS {c}_change"
    for c in ("rows_fetched", "rows_flagged", "rows_rejected", "duplicates_collapsed")
) + " FROM runs r"
ORACLES["last_day_totals"] = f"WITH {_RUNS} SELECT " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
    for c in (
        "rows_fetched",
        "rows_inserted",
        "rows_updated",
        "rows_rejected",
        "rows_flagged",
        "duplicates_collapsed",
    )
) + """, count(*) AS runs FROM runs
WHERE started_at > TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 24 HOUR"""
ORACLES["recent_runs"] = f"""WITH {_RUNS}
SELECT id, status, {_time("finished_at")} AS finished_at, rows_fetched FROM (
  SELECT * FROM runs ORDER BY started_at DESC LIMIT 10)"""


def _minutes(as_of: str) -> str:
    last = "(SELECT max(finished_at) FROM runs WHERE status = 'success')"
    return f"(epoch_us({as_of}) - epoch_us({last})) / 60000000.0"


_NOW = "TIMESTAMP '2024-01-30 18:30:00'"
ORACLES["freshness"] = f"""WITH {_RUNS},
d AS (
  SELECT CAST(coalesce(sum(rows_fetched), 0) AS BIGINT) AS rows_fetched, sum(rows_flagged) AS flagged,
    sum(duplicates_collapsed) AS dups
  FROM runs WHERE started_at > {_NOW} - INTERVAL 24 HOUR
),
l AS (SELECT status AS last_status FROM runs ORDER BY started_at DESC LIMIT 1)
SELECT rows_fetched, round(coalesce(100.0 * flagged / nullif(rows_fetched, 0), 0), 1) AS flag_rate_pct,
  round(coalesce(100.0 * dups / nullif(rows_fetched, 0), 0), 1) AS duplicate_rate_pct,
  round({_minutes(_NOW)}, 1) AS minutes_since_last_success, {_minutes(_NOW)} > 180 AS stale, last_status,
  CASE WHEN last_status IN ('failed', 'partial') THEN 'critical'
       WHEN {_minutes(_NOW)} > 180 THEN 'warning' ELSE 'good' END AS state
FROM d, l"""
ORACLES["run_status"] = f"""WITH {_RUNS}
SELECT id, status, {_time("finished_at")} AS finished_at,
  round({_minutes(AS_OF)}, 1) AS minutes_since_last_success
FROM (SELECT * FROM runs ORDER BY started_at DESC LIMIT 1)"""

ORACLES["ingest_stream_clean"] = f"""WITH {_CLEAN}
SELECT unique_key, {_time("c.created_date")} AS created_date, complaint_type_norm, borough, address_norm,
  defect_count, is_duplicate_of FROM clean c"""
ORACLES["ingest_stream_failures"] = f"""WITH {_FEED}
SELECT unique_key, rule, severity, detail, field_value FROM failures WHERE unique_key IS NOT NULL"""
ORACLES["ingest_stream_daily"] = ORACLES["daily_rollup"]
ORACLES["ingest_stream_raw"] = f"""WITH {_FEED}
SELECT unique_key, address_raw AS incident_address, {_time("b.source_updated_at")} AS source_updated_at,
  CAST(1 AS BIGINT) AS seen_count
FROM batch b WHERE unique_key IS NOT NULL AND failure_count > 0"""
ORACLES["ingest_stream_quality"] = f"""WITH {_DAILY}
SELECT 'success' AS status, (SELECT count(*) FROM feed) AS rows_fetched,
  (SELECT count(*) FROM accepted) AS rows_inserted, (SELECT count(*) FROM batch WHERE is_rejected) AS rows_rejected,
  (SELECT count(*) FROM accepted WHERE failure_count > 0) AS rows_flagged,
  (SELECT count(*) FROM clean) AS clean_rows,
  (SELECT count(*) FROM links) AS duplicate_rows,
  (SELECT count(*) FROM clean WHERE defect_count > 0) AS defective_rows,
  (SELECT count(*) FROM batch WHERE unique_key IS NOT NULL AND failure_count > 0) AS raw_rows,
  (SELECT count(*) FROM daily) AS agg_rows, (SELECT CAST(min(day) AS VARCHAR) FROM daily) AS agg_since"""

ORACLES["storage_rows"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations".split()
)

ORACLES["feed_probe"] = f"""WITH {_FEED}
SELECT count(*) AS rows_returned, coalesce(bool_or(source_updated_at IS NOT NULL), false) AS has_updated_at,
  {_time("max(source_updated_at)")} AS newest_updated_at,
  CAST(epoch_us(max(source_updated_at)) // 1000000 AS BIGINT) AS sample_updated_at
FROM feed"""

# Epochs are divided as whole numbers, ISO spellings are cut by date_trunc.
ORACLES["time_spellings"] = f"""
WITH e AS (SELECT event_id, ts, epoch_us(ts) // 1000000 AS s FROM events),
r AS (
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN make_timestamp(CAST(s * 1000000 + 500000 AS BIGINT))
    WHEN 1 THEN make_timestamp(CAST(s // 10 * 1000000 AS BIGINT))
    WHEN 2 THEN date_trunc('hour', ts) WHEN 3 THEN date_trunc('minute', ts)
    WHEN 4 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
    WHEN 5 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
    WHEN 6 THEN ts END AS at,
    CASE event_id % 9 WHEN 7
      THEN make_timestamp(CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 1000000) END AS short_epoch
  FROM e
)
SELECT event_id, {_time("r.at")} AS as_time, {_time("coalesce(r.at, r.short_epoch)")} AS as_update_time FROM r"""

# The feed with its revisions: accepted ones by update time, linked afresh as whole groups.
_REVISED = (
    _FEED.replace("feed AS (", "base AS (", 1).replace(
        "aliases(label",
        """feed AS (
  SELECT * FROM base UNION ALL
  SELECT * REPLACE (event_id + 1000000000000 AS event_id, source_updated_at + INTERVAL 1 DAY AS source_updated_at,
    CASE WHEN event_id % 35 <> 0 THEN created_date + INTERVAL 1 DAY END AS created_date)
  FROM base WHERE event_id % 5 = 0 UNION ALL
  SELECT * REPLACE (event_id + 2000000000000 AS event_id, source_updated_at - INTERVAL 1 DAY AS source_updated_at,
    '9 West 77th Street' AS address_raw)
  FROM base WHERE event_id % 3 = 0
),
aliases(label""",
        1,
    )
    + """,
latest AS (
  SELECT * FROM accepted
  QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY source_updated_at DESC) = 1
),"""
    + _links("links", "latest", "complaint_type_norm, address_norm", "created_date", "unique_key", 60)
    + f""",
clean AS (
  SELECT a.*, l.duplicate_of AS is_duplicate_of FROM latest a LEFT JOIN links l USING (unique_key)
),
kept AS (SELECT * FROM clean WHERE created_date >= {AS_OF} - INTERVAL {CLEAN_DAYS} DAY)"""
)
ORACLES["ingest_revisions_clean"] = f"""WITH {_REVISED}
SELECT unique_key, {_time("k.created_date")} AS created_date, {_time("k.source_updated_at")} AS source_updated_at,
  address_norm, defect_count, is_duplicate_of FROM kept k"""
ORACLES["ingest_revisions_daily"] = (
    f"WITH {_REVISED}, daily AS (" + _rollup("clean") + f") {_DAY_TEXT} daily"
)
ORACLES["ingest_revisions_runs"] = f"""WITH {_REVISED}
SELECT CAST(1 AS BIGINT) AS id, 'success' AS status, (SELECT count(*) FROM feed) AS rows_fetched,
  (SELECT count(*) FROM latest) AS rows_inserted, true AS any_updated,
  (SELECT count(*) FROM batch WHERE is_rejected) AS rows_rejected,
  (SELECT count(*) FROM accepted WHERE failure_count > 0) AS rows_flagged, 0 AS clean_pruned
UNION ALL
SELECT 2, 'success', 0, 0, false, 0, 0, (SELECT count(*) FROM clean) - (SELECT count(*) FROM kept)"""
