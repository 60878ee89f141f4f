"""Catalogue-shaped views over the test tables.

Each view takes the columns the caller wants and builds only the joins those columns need, so a query on
(id, date, category) reads one table and two columns of it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTINGS_AS_OF = "1998-06-06 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

CATALOG = ("id", "name", "date", "date_end", "time", "category", "categories", "details", "origination_url",
           "source", "cost", "address", "venue_name", "latitude", "longitude", "neighborhood_id")

# column -> (expression, tables it needs besides orders)
_LISTING = {
    "id": ("o_orderkey", ""),
    "name": ("""concat(CASE o_orderkey % 10 WHEN 0 THEN 'Late Jazz Set' WHEN 1 THEN 'Stand-up Comedy Open Mic'
        WHEN 2 THEN 'Pottery Class' WHEN 3 THEN 'Hawks vs. Bears Hockey' WHEN 4 THEN 'Queer Film Screening'
        WHEN 5 THEN 'Beer Tasting' WHEN 6 THEN 'Vintage Market' WHEN 7 THEN 'Haunted Yoga'
        WHEN 8 THEN 'Astronomy Lecture' ELSE 'Gathering' END, ' ', coalesce(p_name, 'item'))""", "part"),
    "date": ("CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderdate END", ""),
    "date_end": ("CASE WHEN o_orderkey % 3 = 0 AND ms > o_orderdate THEN ms END", "lineitem"),
    "time": ("CASE o_orderkey % 4 WHEN 0 THEN '7:30 PM' WHEN 1 THEN '8 pm' WHEN 2 THEN 'Doors 6:30PM' END", ""),
    "category": ("""CASE o_orderkey % 9 WHEN 0 THEN 'Music' WHEN 1 THEN 'music' WHEN 2 THEN 'Arts & Theatre'
        WHEN 3 THEN ' Comedy ' WHEN 4 THEN 'Events' WHEN 5 THEN 'Undefined' WHEN 6 THEN 'Arts & Crafts'
        WHEN 7 THEN 'LGBTQ' END""", ""),
    "details": ("""concat('Venue: ', coalesce(s_name, 'TBA'), ' | Location: ', coalesce(n_name, ''),
        CASE o_orderkey % 5 WHEN 0 THEN ' | Tickets $10-25' WHEN 1 THEN ' | 21+ no cover, free parking'
        WHEN 2 THEN ' | Suggested donation' ELSE '' END)""", "supplier nation"),
    "page_url": ("concat('http://listings.example/e/', CAST(o_orderkey - o_orderkey % 2 AS STRING))", ""),
    "origination_url": ("concat('http://listings.example/e/', CAST(o_orderkey AS STRING))", ""),
    "source": ("""CASE o_orderkey % 4 WHEN 0 THEN 'ticket_api' WHEN 1 THEN 'city_api'
        ELSE concat('chicago_venue_', CAST(coalesce(sk, 0) AS STRING)) END""", "lineitem"),
    "cost": ("""CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Free' WHEN 2 THEN ''
        WHEN 3 THEN concat('$', CAST(coalesce(p_size, 15) AS STRING)) ELSE '$20-$25' END""", "part"),
    "address": ("""concat(CAST(100 + o_orderkey % 900 AS STRING), ' N Main St, ', CASE o_orderkey % 8
        WHEN 0 THEN 'Evanston, IL 60202' WHEN 1 THEN 'Suite 8, Naperville, IL' ELSE 'Chicago, IL 60601' END)""", ""),
    "venue_name": ("s_name", "supplier"),
    "latitude": ("CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) / 100 END", ""),
    "longitude": ("CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_custkey % 500 AS DOUBLE) / 100 END", ""),
    "neighborhood_id": ("CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END", "customer"),
    "categories": ("""CASE WHEN o_orderkey % 7 = 0 THEN NULL
        ELSE filter(array(trim(CASE o_orderkey % 9 WHEN 0 THEN 'Music' WHEN 1 THEN 'music'
            WHEN 2 THEN 'Arts & Theatre' WHEN 3 THEN ' Comedy ' WHEN 4 THEN 'Events' WHEN 5 THEN 'Undefined'
            WHEN 6 THEN 'Arts & Crafts' WHEN 7 THEN 'LGBTQ' END),
            CASE WHEN o_orderkey % 10 = 4 THEN 'LGBTQ' END), x -> x IS NOT NULL) END""", ""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The `events` table of the catalogue, one row per order."""
    columns = columns or CATALOG
    needs = set(" ".join(_LISTING[c][1] for c in columns).split())
    if needs & {"part", "supplier"}:
        needs.add("lineitem")
    if "nation" in needs:
        needs.add("customer")
    out = table(spark, sf_dir, "orders")
    if "lineitem" in needs:
        lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.max("l_shipdate").alias("ms"))
        out = out.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if "part" in needs:
        out = out.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("pk"), "left")
    if "supplier" in needs:
        out = out.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("sk"), "left")
    if "customer" in needs:
        out = out.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    if "nation" in needs:
        out = out.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select(*[F.expr(_LISTING[c][0]).alias(c) for c in columns])


def neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 unit squares on a 5 x 5 grid; rows with an even id also have a hole."""
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    ).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "r_name AS region",
        "CAST(n_nationkey % 5 AS DOUBLE) AS x0", "CAST(n_nationkey % 5 + 1 AS DOUBLE) AS x1",
        "CAST(floor(n_nationkey / 5) AS DOUBLE) AS y0", "CAST(floor(n_nationkey / 5) + 1 AS DOUBLE) AS y1")


def boundary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighborhoods as polygons: array of rings of points, outer ring first."""
    ring = "array(struct({a} AS x, {b} AS y), struct({c} AS x, {b} AS y), struct({c} AS x, {d} AS y), struct({a} AS x, {d} AS y))"
    outer = ring.format(a="x0", b="y0", c="x1", d="y1")
    hole = ring.format(a="x0 + 0.25D", b="y0 + 0.25D", c="x0 + 0.5D", d="y0 + 0.5D")
    return neighborhoods(spark, sf_dir).selectExpr(
        "id AS ord", "name", "region",
        f"array(CASE WHEN id % 2 = 0 THEN array({outer}, {hole}) ELSE array({outer}) END) AS polygons")


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_view(table(spark, sf_dir, "events"))


def audit_view(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id", "user_id AS thread_id",
        """CASE event_type WHEN 'error' THEN 'security_blocked' WHEN 'signup' THEN 'chat_created'
           WHEN 'click' THEN 'question_asked' WHEN 'view' THEN 'turn_completed' ELSE 'output_sanitized' END AS operation""",
        "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status",
        "value AS duration_ms", "CAST(floor(value) AS INT) AS tokens_used", "props AS metadata", "ts AS created_at")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn AS id", "conv_id AS thread_id", "turn", "role", "text AS content",
        "CAST(floor(length(text) / 4) AS INT) AS token_count",
        "make_timestamp_ntz(2024, 1, CAST(1 + conv_id % 28 AS INT), 0, 0, 0) + make_dt_interval(0, CAST(turn AS INT)) AS created_at")


def chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per thread totals, plus two threads that were opened and never used."""
    used = chat_messages(spark, sf_dir).groupBy("thread_id").agg(
        F.sum(F.expr("CASE WHEN role = 'assistant' THEN 1 ELSE 0 END")).alias("turn_count"),
        F.sum("token_count").alias("total_tokens"), F.max("created_at").alias("updated_at"))
    used = used.selectExpr("thread_id AS id", "turn_count", "total_tokens", "updated_at",
                           "CASE WHEN turn_count >= 3 THEN 'completed' ELSE 'active' END AS status")
    unused = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 0L, TIMESTAMP_NTZ '2024-01-30 23:00:00', 'active'),
        (-2L, 0L, 0L, TIMESTAMP_NTZ '2024-01-01 00:00:00', 'active') AS t(id, turn_count, total_tokens, updated_at, status)""")
    return used.union(unused)


def pages_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed event page per order, with structured data, a dated link and a price in its text."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS page_id", "concat('http://listings.example/e/', CAST(o_orderkey AS STRING)) AS url",
        """concat('<html><head><script type="application/ld+json">{"@type":"Event","name":"Show ', CAST(o_orderkey AS STRING),
           '","startDate":"1998-06-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), 'T01:30:00Z","offers":[{"price":"',
           CAST(o_orderkey % 40 AS STRING), '"},{"price":"', CAST(o_orderkey % 40 + o_orderkey % 3 * 10 AS STRING),
           '"}]}</script></head><body><a href="/events/1998/06/', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'),
           '/show-', CAST(o_orderkey AS STRING), '/">Show ', CAST(o_orderkey AS STRING), '</a><p>Tickets: $',
           CAST(o_orderkey % 40 AS STRING), '</p></body></html>') AS html""")


# One text for both engines: titles that exercise the title and label predicates.
ODD_TITLE = """concat(CASE id % 13 WHEN 1 THEN 'Public events ' WHEN 2 THEN 'Events in Chicago: ' WHEN 4 THEN 'Show'
    WHEN 5 THEN 'and ' WHEN 7 THEN '$5 ' WHEN 8 THEN '  ' WHEN 10 THEN concat('Oct ', CAST(1 + id % 28 AS STRING), ' ') ELSE '' END,
    substr(name, 1, CASE id % 13 WHEN 4 THEN 0 WHEN 10 THEN 10 WHEN 11 THEN 20 ELSE 1000 END),
    CASE id % 13 WHEN 0 THEN ' | City Museum' WHEN 1 THEN ' | all' WHEN 3 THEN ' - link in bio' WHEN 6 THEN ' SOLD OUT'
    WHEN 8 THEN '   tonight ' WHEN 9 THEN ' search results' ELSE '' END)"""


def odd_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir, "id", "name").selectExpr("id", f"{ODD_TITLE} AS title")


def with_repeats(ev: DataFrame) -> DataFrame:
    """Every fortieth listing once more under a new id: guaranteed duplicates."""
    return ev.unionByName(ev.where("id % 40 = 0").withColumn("id", F.col("id") + 10000000))


def venue_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured venues: named like the sources the listings carry."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name AS neighborhood")
    return suppliers.join(nations, "s_nationkey").selectExpr(
        "s_suppkey AS id", "CAST(s_suppkey AS STRING) AS name", "neighborhood",
        "CASE s_suppkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'events' WHEN 2 THEN 'arts & crafts' ELSE 'comedy' END AS category",
        "s_name AS venue_name")


LINK_CODE = "CASE id % 12 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 301 WHEN 3 THEN 403 WHEN 4 THEN 429 WHEN 5 THEN 500 ELSE 200 END"
LINK_RECHECK = "CASE id % 12 WHEN 0 THEN CASE WHEN id % 5 = 0 THEN 200 ELSE 404 END WHEN 1 THEN 410 ELSE 200 END"


def link_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recorded checks per listing link."""
    rows = listings(spark, sf_dir, "id", "origination_url", "source").selectExpr(
        "origination_url AS url", "source", f"{LINK_CODE} AS first_code", f"{LINK_RECHECK} AS second_code")
    return rows.selectExpr("url", "source", "stack(2, 1, first_code, 2, second_code) AS (attempt, code)")


PARK_X = "CAST(s_suppkey * 7 % 48 AS DOUBLE) / 8"
PARK_Y = "CAST(s_suppkey * 11 % 44 AS DOUBLE) / 8"


def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square park per supplier; some lie outside every neighborhood."""
    corner = "struct({0} {2} 0.125D AS x, {1} {3} 0.125D AS y)"
    ring = ", ".join(corner.format(PARK_X, PARK_Y, a, b) for a, b in ("--", "+-", "++", "-+"))
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS ord", "concat(s_name, ' Park (North)') AS label", "concat('Field ', CAST(s_suppkey AS STRING)) AS park",
        "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat(CAST(100 + s_suppkey % 900 AS STRING), ' N. Main Street Chicago, IL 60608') END AS location",
        f"array(array(array({ring}))) AS polygons")


FEATURE_NAME = """CASE c_custkey % 5 WHEN 0 THEN 'Wrigleyville' WHEN 1 THEN ' Printers Row ' WHEN 3 THEN concat('NATION_', CAST(c_custkey % 30 AS STRING))
    WHEN 4 THEN concat('Area ', CAST(c_custkey % 40 AS STRING)) END"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed boundary features: one triangle per customer, a second one for every third."""
    ring = "array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(0D AS x, 1D AS y))"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS ord", f"{FEATURE_NAME} AS name",
        f"CASE WHEN c_custkey % 3 = 0 THEN array(array({ring}), array({ring}, {ring})) ELSE array(array({ring})) END AS polygons")


CACHE_ROWS = """SELECT mid AS id, concat(CASE WHEN mid % 4 = 1 THEN 'formerly ' ELSE '' END, lower(address), CASE WHEN address LIKE '%Chicago%' THEN '' ELSE ', chicago, il' END) AS query,
    CASE WHEN mid % 3 = 0 THEN NULL ELSE CAST(mid * 7 % 600 AS DOUBLE) / 100 END AS latitude,
    CASE WHEN mid % 3 = 0 THEN NULL ELSE CAST(mid * 11 % 600 AS DOUBLE) / 100 END AS longitude, mid % 3 <> 0 AS resolved
    FROM (SELECT address, min(id) AS mid FROM {rel} GROUP BY address) t"""


def geocode_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers for most addresses, a third of them misses."""
    rows = listings(spark, sf_dir, "id", "address").groupBy("address").agg(F.min("id").alias("mid"))
    return rows.selectExpr(
        "mid AS id", "concat(CASE WHEN mid % 4 = 1 THEN 'formerly ' ELSE '' END, lower(address), CASE WHEN address LIKE '%Chicago%' THEN '' ELSE ', chicago, il' END) AS query",
        "CASE WHEN mid % 3 = 0 THEN NULL ELSE CAST(mid * 7 % 600 AS DOUBLE) / 100 END AS latitude",
        "CASE WHEN mid % 3 = 0 THEN NULL ELSE CAST(mid * 11 % 600 AS DOUBLE) / 100 END AS longitude", "mid % 3 <> 0 AS resolved")


ODD_ADDRESS = """CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Come and see us! What a night' WHEN 2 THEN '  ' ELSE address END"""
WANTED_PLACE = """CASE id % 4 WHEN 0 THEN concat(' NATION_', CAST(id % 30 AS STRING)) WHEN 1 THEN 'Wrigleyville' WHEN 2 THEN ' '
    ELSE concat('Area ', CAST(id % 40 AS STRING)) END"""
