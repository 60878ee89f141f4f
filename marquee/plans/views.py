"""DuckDB text of the adapter views, as CTEs the oracle queries start from."""

LISTINGS = """
li AS (SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk, max(l_shipdate) AS ms FROM lineitem GROUP BY l_orderkey),
listings AS (SELECT b.*, CASE WHEN id % 7 = 0 THEN NULL
    ELSE list_filter([trim(category), CASE WHEN id % 10 = 4 THEN 'LGBTQ' END], lambda x: x IS NOT NULL) END AS categories FROM (
SELECT o.o_orderkey AS id,
  concat(CASE o.o_orderkey % 10 WHEN 0 THEN 'Late Jazz Set' WHEN 1 THEN 'Stand-up Comedy Open Mic' WHEN 2 THEN 'Pottery Class'
    WHEN 3 THEN 'Hawks vs. Bears Hockey' WHEN 4 THEN 'Queer Film Screening' WHEN 5 THEN 'Beer Tasting' WHEN 6 THEN 'Vintage Market'
    WHEN 7 THEN 'Haunted Yoga' WHEN 8 THEN 'Astronomy Lecture' ELSE 'Gathering' END, ' ', coalesce(p.p_name, 'item')) AS name,
  CASE WHEN o.o_orderkey % 50 = 7 THEN NULL ELSE o.o_orderdate END AS date,
  CASE WHEN o.o_orderkey % 3 = 0 AND li.ms > o.o_orderdate THEN li.ms END AS date_end,
  CASE o.o_orderkey % 4 WHEN 0 THEN '7:30 PM' WHEN 1 THEN '8 pm' WHEN 2 THEN 'Doors 6:30PM' END AS time,
  CASE o.o_orderkey % 9 WHEN 0 THEN 'Music' WHEN 1 THEN 'music' WHEN 2 THEN 'Arts & Theatre' WHEN 3 THEN ' Comedy ' WHEN 4 THEN 'Events'
    WHEN 5 THEN 'Undefined' WHEN 6 THEN 'Arts & Crafts' WHEN 7 THEN 'LGBTQ' END AS category,
  concat('Venue: ', coalesce(s.s_name, 'TBA'), ' | Location: ', n.n_name, CASE o.o_orderkey % 5 WHEN 0 THEN ' | Tickets $10-25' WHEN 1 THEN ' | 21+ no cover, free parking'
    WHEN 2 THEN ' | Suggested donation' ELSE '' END) AS details,
  concat('http://listings.example/e/', CAST(o.o_orderkey - o.o_orderkey % 2 AS STRING)) AS page_url,
  concat('http://listings.example/e/', CAST(o.o_orderkey AS STRING)) AS origination_url,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'ticket_api' WHEN 1 THEN 'city_api' ELSE concat('chicago_venue_', CAST(coalesce(li.sk, 0) AS STRING)) END AS source,
  CASE o.o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Free' WHEN 2 THEN '' WHEN 3 THEN concat('$', CAST(coalesce(p.p_size, 15) AS STRING)) ELSE '$20-$25' END AS cost,
  concat(CAST(100 + o.o_orderkey % 900 AS STRING), ' N Main St, ', CASE o.o_orderkey % 8 WHEN 0 THEN 'Evanston, IL 60202' WHEN 1 THEN 'Suite 8, Naperville, IL' ELSE 'Chicago, IL 60601' END) AS address,
  s.s_name AS venue_name,
  CASE WHEN o.o_orderkey % 5 = 4 THEN NULL ELSE CAST(o.o_orderkey % 500 AS DOUBLE) / 100 END AS latitude,
  CASE WHEN o.o_orderkey % 5 = 4 THEN NULL ELSE CAST(o.o_custkey % 500 AS DOUBLE) / 100 END AS longitude,
  CASE WHEN o.o_orderkey % 6 = 5 THEN NULL ELSE CAST(c.c_nationkey AS BIGINT) END AS neighborhood_id
FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = li.pk
LEFT JOIN supplier s ON s.s_suppkey = li.sk LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey) b)"""

NEIGHBORHOODS = """
neighborhoods AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS region,
 CAST(n_nationkey % 5 AS DOUBLE) AS x0, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS x1,
 CAST(floor(n_nationkey / 5) AS DOUBLE) AS y0, CAST(floor(n_nationkey / 5) + 1 AS DOUBLE) AS y1
 FROM nation JOIN region ON r_regionkey = n_regionkey)"""

AUDIT = """
audit_logs AS (SELECT event_id AS id, user_id AS thread_id,
 CASE event_type WHEN 'error' THEN 'security_blocked' WHEN 'signup' THEN 'chat_created' WHEN 'click' THEN 'question_asked'
  WHEN 'view' THEN 'turn_completed' ELSE 'output_sanitized' END AS operation,
 CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, value AS duration_ms,
 CAST(floor(value) AS INT) AS tokens_used, props AS metadata, ts AS created_at FROM events)"""

MESSAGES = """
chat_messages AS (SELECT conv_id * 100 + turn AS id, conv_id AS thread_id, turn, role, text AS content,
 CAST(floor(length(text) / 4) AS INT) AS token_count,
 CAST(concat('2024-01-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), ' ', lpad(CAST(turn AS STRING), 2, '0'), ':00:00') AS TIMESTAMP) AS created_at
 FROM conversations)"""

THREADS = MESSAGES + """,
used_threads AS (SELECT thread_id AS id, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS turn_count,
 CAST(sum(token_count) AS BIGINT) AS total_tokens, max(created_at) AS updated_at FROM chat_messages GROUP BY thread_id),
chat_threads AS (SELECT id, turn_count, total_tokens, updated_at, CASE WHEN turn_count >= 3 THEN 'completed' ELSE 'active' END AS status FROM used_threads
 UNION ALL SELECT -1, 0, 0, TIMESTAMP '2024-01-30 23:00:00', 'active' UNION ALL SELECT -2, 0, 0, TIMESTAMP '2024-01-01 00:00:00', 'active')"""

PAGES = """
pages_events AS (SELECT o_orderkey AS page_id, concat('http://listings.example/e/', CAST(o_orderkey AS STRING)) AS url,
 concat('<html><head><script type="application/ld+json">{"@type":"Event","name":"Show ', CAST(o_orderkey AS STRING), '","startDate":"1998-06-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'),
 'T01:30:00Z","offers":[{"price":"', CAST(o_orderkey % 40 AS STRING), '"},{"price":"', CAST(o_orderkey % 40 + o_orderkey % 3 * 10 AS STRING), '"}]}</script></head><body><a href="/events/1998/06/', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'),
 '/show-', CAST(o_orderkey AS STRING), '/">Show ', CAST(o_orderkey AS STRING), '</a><p>Tickets: $', CAST(o_orderkey % 40 AS STRING), '</p></body></html>') AS html FROM orders)"""


def q(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def listing_query(body: str, *more: str) -> str:
    return with_views(LISTINGS, *more, body=body)


REPEATED = """
repeated AS (SELECT * FROM listings UNION ALL BY NAME SELECT * REPLACE (id + 10000000 AS id) FROM listings WHERE id % 40 = 0)"""
CONFIG = """
venue_config AS (SELECT s_suppkey AS id, CAST(s_suppkey AS STRING) AS name, n_name AS neighborhood,
 CASE s_suppkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'events' WHEN 2 THEN 'arts & crafts' ELSE 'comedy' END AS category, s_name AS venue_name
 FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def checks_view() -> str:
    from marquee.adapters import LINK_CODE, LINK_RECHECK
    return f"""
checks AS (SELECT origination_url AS url, source, 1 AS attempt, {LINK_CODE} AS code FROM listings
 UNION ALL SELECT origination_url, source, 2, {LINK_RECHECK} FROM listings)"""
