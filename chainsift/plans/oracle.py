"""DuckDB SQL computing each registered query straight from the test tables.

The SQL never sees JSON: it applies the fixture rules (block = base + key div
4, bad lines/elements by modulus, whitelist = BUILDING customers) directly.
"""

ADDR = "'0x' || lpad(lower(to_hex({n})), 40, '0')"

FILLS_CTE = """
fe AS (
  SELECT e.*, 696372899 + e.event_id // 4 AS block,
         CAST(row_number() OVER (PARTITION BY e.event_id // 4 ORDER BY e.event_id) - 1 AS INTEGER) AS event_pos,
         min(e.ts) OVER (PARTITION BY e.event_id // 4) AS block_time
  FROM events e
),
vf AS (
  SELECT * FROM fe
  WHERE NOT (block % 97 = 0 OR block % 89 = 0)
    AND NOT (event_id % 53 = 0 OR event_id % 59 = 0 OR (event_id % 67 = 0 AND event_id % 61 <> 0))
),
wl AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""

FILL_SELECT = f"""
  {ADDR.format(n='user_id')} AS "user", 'fill' AS event, block, event_pos,
  CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'purchase' THEN 'SUI' ELSE 'XRP' END AS coin,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS px,
  CAST(event_id % 1000 + 1 AS VARCHAR) AS sz,
  CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side,
  epoch_us(ts) // 1000 AS time, event_id AS oid, event_id % 3 = 0 AS crossed,
  CAST(320000000000000001 + event_id AS BIGINT) AS tid
"""

MISC_CTE = f"""
mo AS (
  SELECT o.*, 696372899 + o.o_orderkey // 4 AS block,
         CAST(row_number() OVER (PARTITION BY o.o_orderkey // 4 ORDER BY o.o_orderkey) - 1 AS INTEGER) AS event_pos,
         min(o.o_orderdate) OVER (PARTITION BY o.o_orderkey // 4) AS block_time
  FROM orders o
),
mu AS (
  SELECT block, event_pos, block_time, o_orderkey, o_orderdate, o_totalprice, 0 AS user_pos, o_custkey AS k
  FROM mo WHERE o_orderstatus IN ('F', 'O')
  UNION ALL
  SELECT block, event_pos, block_time, o_orderkey, o_orderdate, o_totalprice, 1 AS user_pos,
         CASE WHEN o_orderkey % 11 = 0 THEN o_custkey ELSE o_orderkey % (SELECT count(*) FROM customer) END AS k
  FROM mo WHERE o_orderstatus IN ('F', 'O')
),
wl AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""

MISC_SELECT = f"""
  {ADDR.format(n='k')} AS "user", 'misc' AS event, block, event_pos, CAST(user_pos AS INTEGER) AS user_pos,
  '0x' || CAST(o_orderkey AS VARCHAR) AS hash,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS time,
  'deposit' AS delta_type,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS usdc
"""

FILL_FILE = "'node_fills_by_block/hourly/' || strftime(block_time, '%Y%m%d') || '/' || CAST(hour(block_time) AS VARCHAR)"
MISC_FILE = "'misc_events_by_block/hourly/' || strftime(block_time, '%Y%m%d') || '/' || CAST(hour(block_time) AS VARCHAR)"

ALL_EVENTS_CTE = f"""{FILLS_CTE.rstrip()},
{MISC_CTE.strip().replace("wl AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "wl2 AS (SELECT 1)")},
ae AS (
  SELECT {ADDR.format(n='user_id')} AS "user", 'fill' AS event, block, {FILL_FILE} AS file, event_pos, 0 AS user_pos
  FROM vf WHERE user_id IN (SELECT c_custkey FROM wl)
  UNION ALL
  SELECT {ADDR.format(n='k')} AS "user", 'misc' AS event, block, {MISC_FILE} AS file, event_pos, CAST(user_pos AS INTEGER) AS user_pos
  FROM mu WHERE k IN (SELECT c_custkey FROM wl)
)
"""

BAD_BLOCKS = """
bb AS (
  SELECT 696372899 + event_id // 4 AS block, min(ts) AS block_time
  FROM events GROUP BY 1
)
"""

SQL = {
    "fill_events": f"WITH {FILLS_CTE} SELECT {FILL_SELECT} FROM vf",
    "whitelisted_fills": f"WITH {FILLS_CTE} SELECT {FILL_SELECT} FROM vf WHERE user_id IN (SELECT c_custkey FROM wl)",
    "misc_events": f"WITH {MISC_CTE} SELECT {MISC_SELECT} FROM mu",
    "whitelisted_misc": f"WITH {MISC_CTE} SELECT {MISC_SELECT} FROM mu WHERE k IN (SELECT c_custkey FROM wl)",
    "misc_events_any_user": f"""WITH {MISC_CTE}
      SELECT block, event_pos, count(*) AS watched_users FROM mu WHERE k IN (SELECT c_custkey FROM wl)
      GROUP BY block, event_pos""",
    "bad_lines": f"""WITH {BAD_BLOCKS}
      SELECT {FILL_FILE} AS file,
             CASE WHEN block % 97 = 0 THEN 'not_json' ELSE 'bad_block_number' END AS reason
      FROM bb WHERE block % 97 = 0 OR block % 89 = 0""",
    "all_events": f"WITH {ALL_EVENTS_CTE} SELECT * FROM ae",
    "events_by_block": f"""WITH {ALL_EVENTS_CTE}
      SELECT "user", event, block, event_pos, user_pos FROM ae
      WHERE block BETWEEN 696373000 AND 696375000
      ORDER BY block, event, event_pos, user_pos LIMIT 100 OFFSET 200""",
    "events_by_block_seek": f"""WITH {ALL_EVENTS_CTE}
      SELECT "user", event, block, event_pos, user_pos FROM ae
      WHERE block BETWEEN 696373000 AND 696375000
      ORDER BY block, event, event_pos, user_pos LIMIT 100 OFFSET 100""",
    "latest_height": f"""WITH {BAD_BLOCKS.rstrip()},
      v AS (SELECT block, date_trunc('hour', block_time) AS h FROM bb WHERE NOT (block % 97 = 0 OR block % 89 = 0))
      SELECT coalesce(min(block), 0) AS height FROM v WHERE h = (SELECT max(h) FROM v)""",
    "max_height": f"""WITH {BAD_BLOCKS}
      SELECT coalesce(max(block), 0) AS height FROM bb WHERE NOT (block % 97 = 0 OR block % 89 = 0)""",
}

WL_ADDR = ADDR.format(n="c_custkey")
SUBLOG = """
sublog AS (
  SELECT user_id AS client_id,
         CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'error' THEN 'unsubscribe' ELSE event_type END AS action,
         CASE event_id % 3 WHEN 0 THEN 'fill' WHEN 1 THEN 'misc' ELSE 'bogus' END AS event,
         epoch_us(ts) // 1000 AS ts_ms, event_id AS seq
  FROM events
),
active AS (
  SELECT client_id, event FROM (
    SELECT client_id, event, arg_max(action, (ts_ms, seq)) AS last_action FROM sublog
    WHERE action IN ('subscribe', 'unsubscribe') AND event IN ('fill', 'misc')
    GROUP BY client_id, event
  ) WHERE last_action = 'subscribe'
)
"""

MID_BLOCK = """
mid AS (
  SELECT min(block) AS b0 FROM (SELECT DISTINCT 696372899 + event_id // 4 AS block FROM events)
  WHERE NOT (block % 97 = 0 OR block % 89 = 0)
    AND block >= 696372899 + ((SELECT max(event_id) FROM events) // 4) // 2
)
"""

LINE_TEXT = f"""
lt_e AS (
  SELECT e.*, 696372899 + event_id // 4 AS block,
         min(ts) OVER (PARTITION BY event_id // 4) AS block_time,
         max(ts) OVER (PARTITION BY event_id // 4) AS local_time,
         {ADDR.format(n='user_id')} AS u,
         '{{"coin":"' || CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'purchase' THEN 'SUI' ELSE 'XRP' END
         || '","px":"' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
         || '","sz":"' || CAST(event_id % 1000 + 1 AS VARCHAR)
         || '","side":"' || CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END
         || '","time":' || CAST(epoch_us(ts) // 1000 AS VARCHAR)
         || ',"oid":' || CAST(event_id AS VARCHAR)
         || ',"crossed":' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END
         || ',"tid":' || CAST(320000000000000001 + event_id AS VARCHAR)
         || ',"twapId":null}}' AS payload
  FROM events e
),
lt_el AS (
  SELECT block, block_time, local_time, event_id,
         CASE WHEN event_id % 53 = 0 THEN '[7,' || payload || ']'
              WHEN event_id % 59 = 0 THEN '["' || u || '"]'
              WHEN event_id % 61 = 0 THEN '["' || u || '",' || payload || ',9]'
              WHEN event_id % 67 = 0 THEN '["' || u || '",[1]]'
              ELSE '["' || u || '",' || payload || ']' END AS elem
  FROM lt_e
),
lt_b AS (
  SELECT block, min(block_time) AS block_time, max(local_time) AS local_time,
         string_agg(elem, ',' ORDER BY event_id) AS evs
  FROM lt_el GROUP BY block
),
lt AS (
  SELECT {FILL_FILE} AS file, block,
         CASE WHEN block % 97 = 0 THEN 'junk {{'
              ELSE '{{"local_time":"' || strftime(local_time, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'
                   || '","block_time":"' || strftime(block_time, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'
                   || '","block_number":' || CASE WHEN block % 89 = 0 THEN '"x"' ELSE CAST(block AS VARCHAR) END
                   || ',"events":[' || evs || ']}}' END AS value
  FROM lt_b
)
"""

SQL.update({
    "retained_events": f"""SELECT {ADDR.format(n='user_id')} AS "user", 696372899 + event_id // 4 AS block, event_id AS oid
      FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""",
    "cleanup_count": "SELECT count(*) AS removed FROM events WHERE ts < TIMESTAMP '2024-01-24 00:00:00'",
    "whitelist_range": f"""SELECT {WL_ADDR} AS address, CAST(c_nationkey AS DOUBLE) AS score FROM customer
      WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 5 AND c_nationkey <= 10""",
    "whitelist_page": f"""SELECT address, score FROM (
        SELECT {WL_ADDR} AS address, CAST(c_nationkey AS DOUBLE) AS score FROM customer WHERE c_mktsegment = 'BUILDING')
      WHERE score > 7 OR (score = 7 AND address > '0x' || lpad(lower(to_hex(700)), 40, '0'))
      ORDER BY score, address LIMIT 50""",
    "whitelist_delta": f"""WITH d AS (
        SELECT {WL_ADDR} AS address, CAST(c_nationkey AS DOUBLE) AS score FROM customer
        WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 5 AND c_nationkey <= 12)
      SELECT address, score, coalesce((SELECT max(score) FROM d), 5.0) AS next_cursor FROM d""",
    "whitelist_merge": f"""WITH o AS (
        SELECT {WL_ADDR} AS address, CAST(c_nationkey AS DOUBLE) AS score FROM customer WHERE c_mktsegment = 'BUILDING'),
      d AS (SELECT {WL_ADDR} AS address, CAST(c_nationkey + 100 AS DOUBLE) AS score FROM customer
            WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000)
      SELECT * FROM d UNION ALL SELECT * FROM o WHERE address NOT IN (SELECT address FROM d)""",
    "whitelist_score": f"""WITH {FILLS_CTE}
      SELECT DISTINCT {ADDR.format(n='user_id')} AS address, CAST(c.c_nationkey AS DOUBLE) AS score
      FROM vf JOIN customer c ON c.c_custkey = vf.user_id AND c.c_mktsegment = 'BUILDING'""",
    "active_subscriptions": f"WITH {SUBLOG} SELECT client_id, event FROM active",
    "fan_out": f"""WITH {ALL_EVENTS_CTE.rstrip()}, {SUBLOG}
      SELECT a.client_id, ae."user", ae.event, ae.block, ae.event_pos, ae.user_pos
      FROM ae JOIN active a ON a.event = ae.event""",
    "temporal_delivery": f"""WITH {FILLS_CTE.rstrip()}, {SUBLOG.rstrip()},
      iv AS (
        SELECT client_id, event, action, ts_ms AS vf,
               lead(ts_ms) OVER (PARTITION BY client_id, event ORDER BY ts_ms, seq) AS vt
        FROM sublog WHERE action IN ('subscribe', 'unsubscribe') AND event IN ('fill', 'misc')
      ),
      w AS (SELECT vf.*, epoch_us(ts) // 1000 AS t_ms FROM vf WHERE user_id IN (SELECT c_custkey FROM wl))
      SELECT iv.client_id, {ADDR.format(n='w.user_id')} AS "user", 'fill' AS event, w.block, w.event_pos
      FROM w JOIN iv ON iv.event = 'fill' AND iv.action = 'subscribe'
       AND w.t_ms >= iv.vf AND (iv.vt IS NULL OR w.t_ms < iv.vt)""",
    "hour_paths": f"""WITH {BAD_BLOCKS.rstrip()},
      mb AS (SELECT 696372899 + o_orderkey // 4 AS block, min(o_orderdate) AS block_time FROM orders GROUP BY 1),
      p AS (
        SELECT DISTINCT {FILL_FILE} AS file, 'node_fills_by_block' AS log_type, strftime(block_time, '%Y%m%d') AS date,
               CAST(hour(block_time) AS INTEGER) AS hour FROM bb
        UNION
        SELECT DISTINCT {MISC_FILE}, 'misc_events_by_block', strftime(block_time, '%Y%m%d'),
               CAST(hour(block_time) AS INTEGER) FROM mb
      )
      SELECT file, log_type, date, hour, file AS rebuilt FROM p""",
    "files_between": f"""WITH {BAD_BLOCKS.rstrip()},
      f AS (SELECT DISTINCT {FILL_FILE} AS file FROM bb),
      h AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(block_time) FROM bb)),
                                          date_trunc('hour', (SELECT max(block_time) FROM bb)), INTERVAL 1 HOUR)) AS block_time)
      SELECT {FILL_FILE} AS file, {FILL_FILE} IN (SELECT file FROM f) AS exists FROM h""",
    "positions": f"""WITH {LINE_TEXT} SELECT file, CAST(sum(strlen(value) + 1) AS BIGINT) AS position FROM lt GROUP BY file""",
    "resume_from": f"""WITH {FILLS_CTE.rstrip()}, {MID_BLOCK} SELECT {FILL_SELECT} FROM vf WHERE block >= (SELECT b0 FROM mid)""",
    "dedupe_replay": f"WITH {FILLS_CTE} SELECT {FILL_SELECT} FROM vf WHERE user_id IN (SELECT c_custkey FROM wl)",
})

LIVE_FROM = """
live AS (
  SELECT date_trunc('hour', min(ts)) + INTERVAL 12 HOUR AS h FROM events
  WHERE 696372899 + event_id // 4 = (SELECT b0 FROM mid)
)
"""

SQL.update({
    "stream_fills": SQL["all_events"],
    "stream_delivery": SQL["fan_out"],
    "stream_catchup_delivery": f"""WITH {ALL_EVENTS_CTE.rstrip()}, {SUBLOG.rstrip()}, {MID_BLOCK.rstrip()}, {LIVE_FROM.rstrip()},
      bt AS (SELECT 696372899 + event_id // 4 AS block, min(ts) AS block_time FROM events GROUP BY 1)
      SELECT a.client_id, ae."user", ae.event, ae.block, ae.event_pos, ae.user_pos
      FROM ae JOIN active a ON a.event = ae.event JOIN bt ON bt.block = ae.block
      WHERE ae.event = 'fill' AND ae.block >= (SELECT b0 FROM mid)
        AND date_trunc('hour', bt.block_time) >= (SELECT h FROM live)""",
    "stream_whitelist_refresh": f"""WITH {ALL_EVENTS_CTE.rstrip()}, {MID_BLOCK.rstrip()},
      midh AS (SELECT date_trunc('hour', min(ts)) AS h FROM events WHERE 696372899 + event_id // 4 = (SELECT b0 FROM mid)),
      bt AS (SELECT 696372899 + event_id // 4 AS block, min(ts) AS block_time FROM events GROUP BY 1),
      v1 AS (SELECT {WL_ADDR} AS address FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <= 12)
      SELECT ae.* FROM ae JOIN bt ON bt.block = ae.block
      WHERE ae.event = 'fill'
        AND (date_trunc('hour', bt.block_time) >= (SELECT h FROM midh) OR ae."user" IN (SELECT address FROM v1))""",
    "stream_hourly_counts": f"""WITH {ALL_EVENTS_CTE.rstrip()},
      bt AS (SELECT 696372899 + event_id // 4 AS block, min(ts) AS block_time FROM events GROUP BY 1),
      mt AS (SELECT 696372899 + o_orderkey // 4 AS block, min(o_orderdate) AS block_time FROM orders GROUP BY 1)
      SELECT ae.event, strftime(CASE WHEN ae.event = 'fill' THEN bt.block_time ELSE mt.block_time END, '%Y%m%d%H') AS hour,
             count(*) AS n
      FROM ae LEFT JOIN bt ON bt.block = ae.block LEFT JOIN mt ON mt.block = ae.block
      GROUP BY 1, 2""",
})

SQL["text_fill_events"] = SQL["fill_events"]
SQL["stream_latest_height"] = SQL["latest_height"]

SQL["saved_positions"] = f"""WITH {LINE_TEXT.rstrip()},
  last AS (SELECT file FROM lt_b JOIN lt USING (block) ORDER BY lt_b.block_time DESC LIMIT 1)
  SELECT file, CAST(sum(strlen(value) + 1) AS BIGINT) AS position FROM lt WHERE file = (SELECT file FROM last) GROUP BY file"""
SQL["store_compaction"] = SQL["all_events"]


def _bloom(n: int, p: float = 0.01) -> tuple[str, str, int]:
    """(block of {0}, mask of {0}, bits) as SQL: MD5 digits, as chainsift.operators.bloom states them."""
    import math

    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    k = max(1, round(m / n * math.log(2)))
    block = f"(CAST('0x' || substr(md5({{0}}), 1, 12) AS BIGINT) % {max(1, -(-m // 64))})"
    bits = " | ".join(f"(CASE WHEN CAST('0x' || substr(md5({{0}}), {13 + 2 * i}, 2) AS BIGINT) % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(CAST('0x' || substr(md5({{0}}), {13 + 2 * i}, 2) AS BIGINT) % 64 AS INTEGER) END)" for i in range(min(k, 10)))
    return block, f"({bits})", m


def _bloom_sql(n: int) -> tuple[str, str]:
    block, mask, _ = _bloom(n)
    build = f"""SELECT block, bit_or(mask) AS bits FROM (
        SELECT {block.format('address')} AS block, {mask.format('address')} AS mask
        FROM (SELECT {WL_ADDR} AS address FROM customer WHERE c_mktsegment = 'BUILDING')) GROUP BY block"""
    probe = f"""WITH {FILLS_CTE.rstrip()}, bloom AS ({build}),
      users AS (SELECT user_id FROM (SELECT user_id, {ADDR.format(n='user_id')} AS a FROM (SELECT DISTINCT user_id FROM vf)) u
        JOIN bloom ON bloom.block = {block.format('u.a')} AND (bloom.bits & {mask.format('u.a')}) = {mask.format('u.a')})
      SELECT {FILL_SELECT} FROM vf WHERE user_id IN (SELECT user_id FROM users)"""
    return build, probe


SQL["bloom_build"], SQL["bloom_prefilter"] = _bloom_sql(100_000_000)
SQL["bloom_prefilter_small"] = _bloom_sql(250)[1]

SQL["page_json"] = f"""WITH {FILLS_CTE}
  SELECT {ADDR.format(n='user_id')} AS "user", 'fill' AS event, block,
         CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'purchase' THEN 'SUI' ELSE 'XRP' END AS coin,
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS px, event_id AS oid, CAST(320000000000000001 + event_id AS BIGINT) AS tid
  FROM vf WHERE user_id IN (SELECT c_custkey FROM wl) AND block BETWEEN 696373000 AND 696375000
  ORDER BY block, event_pos LIMIT 100 OFFSET 200"""
SQL["member_score"] = f"""SELECT {WL_ADDR} AS address, CAST(c_nationkey AS DOUBLE) AS score FROM customer
  WHERE c_mktsegment = 'BUILDING' ORDER BY address LIMIT 1"""
SQL["disconnect"] = f"""WITH {SUBLOG.rstrip()},
  m AS (
    SELECT client_id, event, action, ts_ms, seq FROM sublog
    WHERE action IN ('subscribe', 'unsubscribe') AND event IN ('fill', 'misc')
    UNION ALL SELECT client_id, t.event, 'unsubscribe', ts_ms, seq FROM sublog, (VALUES ('fill'), ('misc')) t(event) WHERE action = 'purchase')
  SELECT client_id, event FROM (SELECT client_id, event, arg_max(action, (ts_ms, seq)) AS last_action FROM m GROUP BY client_id, event)
  WHERE last_action = 'subscribe'"""
SQL["empty_store"] = "SELECT 'fill' AS event, count(*) AS n, max(696372899 + event_id // 4) AS top FROM events"
SQL["stream_resume_new_run"] = SQL["all_events"]
SQL["stream_bounded_backlog"] = f"WITH {ALL_EVENTS_CTE} SELECT * FROM ae WHERE event = 'fill'"
SQL["stream_bad_lines"] = SQL["bad_lines"]
SQL["stream_dedupe"] = SQL["dedupe_replay"]
SQL["bloom_incremental"] = SQL["bloom_build"]
SQL["stream_subscription_state"] = SQL["disconnect"]
SQL["stream_delivery_feed"] = SQL["fan_out"]
SQL["events_page_deep"] = f"""WITH {ALL_EVENTS_CTE.rstrip()},
  numbered AS (SELECT *, row_number() OVER (ORDER BY block, event, event_pos, user_pos) - 1 AS i, count(*) OVER () AS n FROM ae)
  SELECT "user", event, block, event_pos, user_pos FROM numbered WHERE i // 100 = n // 2 // 100"""
