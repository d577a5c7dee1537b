"""Queries of the general data problems (p1, p2, p5) and their SQL."""

from __future__ import annotations

from millrace.operators import changes, eager, near
from millrace.sources.tables import table


def p1_found(spark, root):
    return near.dispatch_relations(table(spark, root, "driver_messages"), table(spark, root, "blocks"))


def p1_match_candidates(spark, root):
    return near.match_candidates(table(spark, root, "driver_messages"))


def _totals(spark, root):
    return eager.field_totals(table(spark, root, "driver_messages"), table(spark, root, "q2"))


def p2_found(spark, root):
    return eager.heavy_keys(_totals(spark, root)).select("field_name", "key_value")


def p2_totals(spark, root):
    return _totals(spark, root).select("field_name", "key_value", "entries", "field_entries")


def p2_block_pairs(spark, root):
    return eager.pair_totals(table(spark, root, "driver_messages"))


def p5_found(spark, root):
    return changes.apply_changes(table(spark, root, "q4"), table(spark, root, "q4_actions")).where("named").select("tweetid", "text_seq", "favorite_seq", "retweet_seq")


def p5_tweets(spark, root):
    return changes.apply_changes(table(spark, root, "q4"), table(spark, root, "q4_actions")).select("tweetid", "uuid", "username", "text", "favorite_count", "retweet_count", "source")


QUERIES = {
    "p1_found": p1_found, "p1_match_candidates": p1_match_candidates,
    "p2_found": p2_found, "p2_totals": p2_totals, "p2_block_pairs": p2_block_pairs,
    "p5_found": p5_found, "p5_tweets": p5_tweets,
}

_POINTS = """
pts AS (
  SELECT DISTINCT msg_id AS id, msg_type, block_id, latitude AS lat, longitude AS lon, CAST(sent_at AS DATE) AS day
  FROM driver_messages
  WHERE msg_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
req AS (SELECT *, CAST(floor(lat * 3000) AS BIGINT) AS cy FROM pts WHERE msg_type = 'RIDE_REQUEST'),
drv AS (SELECT *, CAST(floor(lat * 3000) AS BIGINT) + s.d AS cy FROM pts, (VALUES (-1), (0), (1)) s(d) WHERE msg_type IN ('DRIVER_LOCATION', 'ENTERING_BLOCK')),
pairs AS (
  SELECT r.id AS rid, d.id AS did,
    2 * 6371008.8 * asin(sqrt(power(sin(radians(d.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(d.lat)) * power(sin(radians(d.lon - r.lon) / 2), 2))) AS m
  FROM req r JOIN drv d ON r.day = d.day AND r.cy = d.cy),
near AS (SELECT * FROM pairs WHERE m <= 30)"""

_ENTRIES = """
tags AS (
  SELECT nullif(lower(trim(keyword, ' \t\n\r')), '') AS word,
    trim(regexp_replace(lower(trim(unnest(string_split(hashtags, ',')), ' \t\n\r')), '^#', ''), ' \t\n\r') AS tag
  FROM q2),
entries AS (
  SELECT 'block_id' AS field_name, CAST(block_id AS VARCHAR) AS key_value, count(DISTINCT msg_id) AS n FROM driver_messages WHERE block_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY block_id
  UNION ALL SELECT 'hashtags', tag, count(*) FROM tags WHERE tag <> '' GROUP BY tag
  UNION ALL SELECT 'keyword', word, count(*) FROM tags WHERE tag <> '' AND word IS NOT NULL GROUP BY word),
totals AS (SELECT field_name, key_value, CAST(n AS BIGINT) AS entries, CAST(sum(n) OVER (PARTITION BY field_name) AS BIGINT) AS field_entries FROM entries)"""

_APPLIED = r"""
shaped AS (
  SELECT delivery_id, uuid, CAST(seq AS BIGINT) AS seq, op, tid, field_name, payload,
    CASE WHEN op IN ('set', 'write') THEN url_decode(payload) END AS value
  FROM q4_actions WHERE uuid IS NOT NULL AND seq IS NOT NULL AND op IN ('write', 'set', 'delete')),
docs AS (SELECT *, CASE WHEN op = 'write' AND json_valid(value) AND json_type(value) = 'OBJECT' THEN CAST(value AS JSON) END AS doc FROM shaped),
good AS (
  SELECT *, CASE WHEN op = 'write' THEN TRY_CAST(doc ->> '$.id' AS BIGINT) ELSE tid END AS tweet FROM docs
  WHERE (op = 'delete' AND tid IS NOT NULL)
    OR (op = 'set' AND tid IS NOT NULL AND payload IS NOT NULL AND (field_name = 'text' OR (field_name IN ('favorite_count', 'retweet_count') AND regexp_full_match(value, '[0-9]+'))))
    OR (op = 'write' AND json_exists(doc, '$.id') AND json_exists(doc, '$.created_at') AND json_exists(doc, '$.text') AND json_exists(doc, '$.favorite_count') AND json_exists(doc, '$.retweet_count') AND json_exists(doc, '$.user'))),
once AS (SELECT * FROM good WHERE tweet IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uuid, seq ORDER BY delivery_id) = 1),
marks AS (SELECT tweet, max(CASE WHEN op <> 'set' THEN seq END) AS row_seq FROM once GROUP BY tweet),
last_row AS (SELECT o.* FROM once o JOIN marks m ON o.tweet = m.tweet AND o.seq = m.row_seq AND o.op <> 'set'),
sets AS (
  SELECT o.tweet, o.field_name, o.seq, o.value FROM once o JOIN marks m ON o.tweet = m.tweet
  WHERE o.op = 'set' AND o.seq > coalesce(m.row_seq, -9000000000)
  QUALIFY row_number() OVER (PARTITION BY o.tweet, o.field_name ORDER BY o.seq DESC) = 1),
base AS (SELECT * FROM q4 WHERE tweetid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY crawled_at DESC NULLS LAST, favorite_count DESC NULLS LAST, retweet_count DESC NULLS LAST, text DESC NULLS LAST, username DESC NULLS LAST, uuid DESC NULLS LAST, source DESC NULLS LAST) = 1),
ids AS (SELECT tweetid AS id FROM base UNION SELECT tweet FROM marks),
alive AS (
  SELECT i.id, m.tweet IS NOT NULL AS named, coalesce(m.row_seq, 0) AS row_seq, r.op = 'write' AS written, r.doc, b.*
  FROM ids i LEFT JOIN marks m ON m.tweet = i.id LEFT JOIN last_row r ON r.tweet = i.id LEFT JOIN base b ON b.tweetid = i.id
  WHERE r.op = 'write' OR (m.row_seq IS NULL AND b.tweetid IS NOT NULL)),
after AS (
  SELECT a.*, t.seq AS t_seq, t.value AS t_value, f.seq AS f_seq, f.value AS f_value, w.seq AS r_seq, w.value AS r_value
  FROM alive a LEFT JOIN sets t ON t.tweet = a.id AND t.field_name = 'text'
  LEFT JOIN sets f ON f.tweet = a.id AND f.field_name = 'favorite_count' LEFT JOIN sets w ON w.tweet = a.id AND w.field_name = 'retweet_count')"""

_RINGS = """
box AS (SELECT block_id, ring_no, ring_lat, ring_lon, list_min(ring_lat) AS s, list_max(ring_lat) AS n, list_min(ring_lon) AS w, list_max(ring_lon) AS e FROM blocks),
cand AS (SELECT p.id, p.block_id AS own, p.lat, p.lon, b.block_id, b.ring_no, b.ring_lat, b.ring_lon FROM pts p JOIN box b ON p.lat BETWEEN s AND n AND p.lon BETWEEN w AND e),
sides AS (SELECT id, own, lat, lon, block_id, ring_no, ring_lat, ring_lon, unnest(range(1, len(ring_lat) + 1)) AS i FROM cand),
ends AS (SELECT *, ring_lat[i] AS y1, ring_lon[i] AS x1, ring_lat[i % len(ring_lat) + 1] AS y2, ring_lon[i % len(ring_lon) + 1] AS x2 FROM sides),
inside AS (
  SELECT id, own, block_id FROM ends GROUP BY id, own, lat, lon, block_id, ring_no
  HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"""

ORACLE = {
    "p1_found": f"""WITH {_POINTS}, {_RINGS}
SELECT DISTINCT 'near' AS relation, least(rid, did) AS id_a, greatest(rid, did) AS id_b FROM near WHERE rid <> did
UNION ALL SELECT DISTINCT 'block', CAST(block_id AS BIGINT), id FROM inside WHERE own IS NULL OR own <> block_id""",
    "p1_match_candidates": f"""WITH {_POINTS}
SELECT rid AS request_id, place, did AS driver_msg_id, round(m, 3) AS distance_m
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY m, did) AS INTEGER) AS place FROM near) WHERE place <= 3""",
    "p2_found": f"WITH {_ENTRIES} SELECT field_name, key_value FROM totals WHERE entries * 50 >= field_entries",
    "p2_totals": f"WITH {_ENTRIES} SELECT field_name, key_value, entries, field_entries FROM totals",
    "p2_block_pairs": """
WITH m AS (SELECT block_id, msg_id, msg_type, max(rating) AS rating FROM driver_messages WHERE block_id IS NOT NULL AND msg_id IS NOT NULL AND msg_type IS NOT NULL GROUP BY ALL),
r AS (SELECT block_id, count(*) AS requests FROM m WHERE msg_type = 'RIDE_REQUEST' GROUP BY block_id),
d AS (SELECT block_id, count(*) AS drivers, coalesce(sum(CAST(round(rating * 10) AS BIGINT)), 0) AS tenths FROM m WHERE msg_type IN ('DRIVER_LOCATION', 'ENTERING_BLOCK') GROUP BY block_id)
SELECT r.block_id, requests, coalesce(drivers, 0) AS drivers, CAST(requests * coalesce(drivers, 0) AS BIGINT) AS pairs, CAST(requests * coalesce(tenths, 0) AS BIGINT) / 10.0 AS rating_sum
FROM r LEFT JOIN d ON r.block_id = d.block_id""",
    "p5_found": f"""WITH {_APPLIED}
SELECT id AS tweetid, coalesce(t_seq, row_seq) AS text_seq, coalesce(f_seq, row_seq) AS favorite_seq, coalesce(r_seq, row_seq) AS retweet_seq FROM after WHERE named""",
    "p5_tweets": f"""WITH {_APPLIED}
SELECT id AS tweetid, CASE WHEN written THEN TRY_CAST(doc ->> '$.user.id' AS BIGINT) ELSE uuid END AS uuid, CASE WHEN written THEN doc ->> '$.user.screen_name' ELSE username END AS username,
  CASE WHEN t_seq IS NOT NULL THEN t_value WHEN written THEN doc ->> '$.text' ELSE text END AS text,
  CASE WHEN f_seq IS NOT NULL THEN TRY_CAST(f_value AS BIGINT) WHEN written THEN TRY_CAST(doc ->> '$.favorite_count' AS BIGINT) ELSE favorite_count END AS favorite_count,
  CASE WHEN r_seq IS NOT NULL THEN TRY_CAST(r_value AS BIGINT) WHEN written THEN TRY_CAST(doc ->> '$.retweet_count' AS BIGINT) ELSE retweet_count END AS retweet_count,
  CASE WHEN written THEN NULL ELSE source END AS source
FROM after""",
}
