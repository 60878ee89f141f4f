"""Queries and oracles of places and lookups."""

from pyspark.sql import functions as F

from marquee.adapters import (CACHE_ROWS, FEATURE_NAME, LISTINGS_AS_OF, ODD_ADDRESS, PARK_X, PARK_Y, WANTED_PLACE,
                              boundary_features, features, geocode_cache, link_checks, listings, neighborhoods, parks,
                              table, venue_config)
from marquee.operators import places as J
from marquee.plans.predicates import UP
from marquee.plans.views import CONFIG, NEIGHBORHOODS, checks_view, listing_query, with_views

AS_OF = LISTINGS_AS_OF
CELL = 0.5


def _boundaries(s, d):
    return boundary_features(s, d).select("ord", "name", F.explode("polygons").alias("polygon"))


def _odd(s, d, *more):
    return listings(s, d, "id", "address", "venue_name", *more).withColumn("address", F.expr(ODD_ADDRESS))


def _resolve(s, d):
    ev = listings(s, d, "id", "latitude", "longitude", "address", "venue_name", "neighborhood_id").withColumn(
        "longitude", F.expr("CASE WHEN latitude IS NULL THEN NULL WHEN id % 3 = 0 THEN longitude + 5 ELSE longitude END"))
    config = venue_config(s, d).withColumn("name", F.expr("CASE WHEN id % 3 = 0 THEN venue_name ELSE concat('Hall ', name) END"))
    return J.resolve_neighborhood(ev, _boundaries(s, d), J.venue_to_neighborhood(config), geocode_cache(s, d), CELL).select(
        "id", "neighborhood", "how", "latitude", "longitude")


def _match(s, d):
    ev = listings(s, d, "id", "name", "source", "date")
    batch = ev.selectExpr(
        "id AS position", "CASE WHEN id % 2 = 0 THEN name ELSE concat(name, '!') END AS name", "source", "date")
    return J.match_existing(batch, ev, ["name", "source", "date"])


def _transit(s, d):
    lines = table(s, d, "nation").selectExpr(
        "n_name AS neighborhood", "CASE WHEN n_nationkey % 4 = 0 THEN concat('Line ', CAST(n_nationkey AS STRING)) END AS transit")
    return J.transit_hint(J.with_neighborhood(listings(s, d, "id", "neighborhood_id"), neighborhoods(s, d)), lines).select(
        "id", "neighborhood", "transit")


QUERIES = {
    "with_neighborhood": lambda s, d: J.with_neighborhood(listings(s, d, "id", "neighborhood_id"), neighborhoods(s, d)),
    "point_in_polygon": lambda s, d: J.point_in_polygon(
        listings(s, d, "id", "latitude", "longitude"), _boundaries(s, d), cell=CELL),
    "load_boundaries": lambda s, d: J.load_boundaries(features(s, d)).selectExpr(
        "name", "ord", "size(polygon) AS rings", "size(polygon[0]) AS points"),
    "boundary_report": lambda s, d: J.boundary_report(J.load_boundaries(features(s, d)), neighborhoods(s, d)),
    "polygon_centroid": lambda s, d: J.polygon_centroid(parks(s, d)).select("ord", "longitude", "latitude"),
    "place_by_park": lambda s, d: J.place_by_park(
        listings(s, d, "id", "address", "venue_name", "latitude", "longitude"),
        parks(s, d), _boundaries(s, d), CELL).select("id", "status", "neighborhood", "latitude", "longitude"),
    "geocode_lookup": lambda s, d: J.geocode_lookup(_odd(s, d), geocode_cache(s, d)).select(
        "id", "geocode_key", "geocode_state", "cached_latitude", "cached_longitude"),
    "geocode_worklist": lambda s, d: J.geocode_worklist(_odd(s, d), geocode_cache(s, d)),
    "resolve_neighborhood": _resolve,
    "get_or_create_dim": lambda s, d: J.get_or_create_dim(
        listings(s, d, "id").select(F.expr(WANTED_PLACE).alias("name")), neighborhoods(s, d)),
    "venue_to_neighborhood": lambda s, d: J.venue_to_neighborhood(
        venue_config(s, d).withColumn("name", F.expr("CASE WHEN id % 3 = 0 THEN upper(venue_name) ELSE concat('Hall ', CAST(id % 20 AS STRING)) END"))),
    "match_existing": _match,
    "prune_dead": lambda s, d: J.prune_dead(
        listings(s, d, "id", "date", "date_end", "origination_url"), link_checks(s, d), AS_OF).select("id", "origination_url"),
    "transit_hint": _transit,
}


def inside(x, y):
    return f"""({x} >= n.x0 AND {x} < n.x1 AND {y} >= n.y0 AND {y} < n.y1 AND NOT (n.id % 2 = 0
        AND {x} >= n.x0 + 0.25 AND {x} < n.x0 + 0.5 AND {y} >= n.y0 + 0.25 AND {y} < n.y0 + 0.5))"""


ALIASED = """CASE lower(trim(name)) WHEN 'wrigleyville' THEN 'Lake View' WHEN 'printers row' THEN 'Loop' ELSE nullif(trim(name), '') END"""
FEATURES = f"""
raw_features AS (SELECT c_custkey AS ord, {FEATURE_NAME} AS name, CASE WHEN c_custkey % 3 = 0 THEN [1, 2] ELSE [1] END AS rings FROM customer),
loaded AS (SELECT {ALIASED} AS name, ord, unnest(rings) AS rings, 3 AS points FROM raw_features WHERE {ALIASED} IS NOT NULL)"""
PARKS = f"""
parks AS (SELECT s_suppkey AS ord, {PARK_X} AS longitude, {PARK_Y} AS latitude, lower(replace(s_name, '#', ' ')) AS name_key,
  CASE WHEN s_suppkey % 4 <> 0 THEN (100 + s_suppkey % 900) || ' n main st' END AS address_key FROM supplier)"""
KEYED = f"""
odd AS (SELECT id, {ODD_ADDRESS} AS address, lower(trim(venue_name)) AS venue FROM listings),
keyed AS (SELECT id, CASE WHEN id % 7 IN (0, 1, 2) THEN venue || ', chicago, il'
  ELSE lower(address) || CASE WHEN contains(lower(address), 'chicago') THEN '' ELSE ', chicago, il' END END AS geocode_key FROM odd)"""
CACHE = "\ngeocode_cache AS (" + CACHE_ROWS.format(rel="listings") + ")"
DIM_NAME = "CASE lower(trim(name)) WHEN 'wrigleyville' THEN 'Lake View' ELSE trim(name) END"

ORACLES = {
    "with_neighborhood": listing_query("""SELECT l.id, neighborhood_id, n.name AS neighborhood FROM listings l
        LEFT JOIN neighborhoods n ON n.id = neighborhood_id""", NEIGHBORHOODS),
    "point_in_polygon": listing_query(f"""SELECT l.id, latitude, longitude, n.name AS neighborhood FROM listings l
        LEFT JOIN neighborhoods n ON {inside('longitude', 'latitude')}""", NEIGHBORHOODS),
    "load_boundaries": with_views(FEATURES, body="SELECT name, ord, rings, points FROM loaded"),
    "boundary_report": with_views(FEATURES, NEIGHBORHOODS, body="""
        , r AS (SELECT name, count(*) AS polygons, CAST(sum(rings * points) AS BIGINT) AS points FROM loaded GROUP BY name)
        SELECT coalesce(r.name, n.name) AS name, coalesce(polygons, 0) AS polygons, coalesce(points, 0) AS points,
          CASE WHEN polygons IS NULL THEN 'unchanged' WHEN n.name IS NOT NULL THEN 'updated' ELSE 'created' END AS status
        FROM r FULL JOIN neighborhoods n ON r.name = n.name"""),
    "polygon_centroid": with_views(PARKS, body="SELECT ord, longitude, latitude FROM parks"),
    "place_by_park": listing_query(f""", ka AS (SELECT address_key, min_by(longitude, ord) AS x, min_by(latitude, ord) AS y FROM parks WHERE address_key IS NOT NULL GROUP BY 1),
        kn AS (SELECT name_key, min_by(longitude, ord) AS x, min_by(latitude, ord) AS y FROM parks GROUP BY 1),
        e AS (SELECT id, latitude, longitude, coalesce(ka.x, kn.x) AS x, coalesce(ka.y, kn.y) AS y FROM listings l
          LEFT JOIN ka ON (CASE WHEN id % 8 > 1 THEN (100 + id % 900) || ' n main st' END) = ka.address_key
          LEFT JOIN kn ON lower(replace(venue_name, '#', ' ')) = kn.name_key)
        SELECT e.id, CASE WHEN x IS NULL THEN 'unmatched' WHEN n.name IS NULL THEN 'outside' ELSE 'placed' END AS status,
          n.name AS neighborhood, CASE WHEN n.name IS NOT NULL AND latitude IS NULL THEN y ELSE latitude END AS latitude,
          CASE WHEN n.name IS NOT NULL AND latitude IS NULL THEN x ELSE longitude END AS longitude
        FROM e LEFT JOIN neighborhoods n ON {inside('x', 'y')}""", NEIGHBORHOODS, PARKS),
    "geocode_lookup": listing_query("""SELECT k.id, geocode_key, CASE WHEN geocode_key IS NULL THEN 'not_a_place'
          WHEN c.query IS NULL THEN 'unknown' WHEN c.resolved THEN 'hit' ELSE 'known_miss' END AS geocode_state,
          c.latitude AS cached_latitude, c.longitude AS cached_longitude
        FROM keyed k LEFT JOIN geocode_cache c ON c.query = geocode_key""", KEYED, CACHE),
    "geocode_worklist": listing_query("""SELECT DISTINCT geocode_key AS query FROM keyed WHERE geocode_key IS NOT NULL
        AND geocode_key NOT IN (SELECT query FROM geocode_cache)""", KEYED, CACHE),
    "resolve_neighborhood": listing_query(f""", e AS (SELECT id, latitude, venue_name,
          CASE WHEN latitude IS NULL THEN NULL WHEN id % 3 = 0 THEN longitude + 5 ELSE longitude END AS longitude,
          lower(address) || CASE WHEN contains(lower(address), 'chicago') THEN '' ELSE ', chicago, il' END AS k
          FROM listings WHERE neighborhood_id IS NULL),
        pc AS (SELECT c.query, c.latitude, c.longitude, n.name AS place FROM geocode_cache c
          LEFT JOIN neighborhoods n ON {inside('c.longitude', 'c.latitude')} WHERE c.resolved),
        j AS (SELECT e.id, e.latitude, e.longitude, n.name AS own, v.neighborhood AS venue, pc.latitude AS clat, pc.longitude AS clon, pc.place,
            n.name IS NULL AND v.neighborhood IS NULL AND pc.query IS NOT NULL AS use_cache
          FROM e LEFT JOIN neighborhoods n ON {inside('e.longitude', 'e.latitude')}
          LEFT JOIN venue_config v ON v.id % 3 = 0 AND lower(v.venue_name) = lower(e.venue_name)
          LEFT JOIN pc ON pc.query = e.k)
        SELECT id, coalesce(own, venue, CASE WHEN use_cache THEN place END) AS neighborhood,
          CASE WHEN own IS NOT NULL THEN 'coordinates' WHEN venue IS NOT NULL THEN 'venue' WHEN use_cache AND place IS NOT NULL THEN 'geocoded'
            WHEN use_cache OR latitude IS NOT NULL THEN 'outside' ELSE 'unknown' END AS how,
          CASE WHEN use_cache AND latitude IS NULL THEN clat ELSE latitude END AS latitude,
          CASE WHEN use_cache AND latitude IS NULL THEN clon ELSE longitude END AS longitude FROM j""", NEIGHBORHOODS, CONFIG, CACHE),
    "get_or_create_dim": listing_query(f""", w AS (SELECT DISTINCT {DIM_NAME} AS name FROM (SELECT {WANTED_PLACE} AS name FROM listings) WHERE trim(name) <> '')
        SELECT name, n.id, false AS is_new FROM w JOIN neighborhoods n USING (name)
        UNION ALL SELECT name, (SELECT max(id) FROM neighborhoods) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name), true
        FROM w WHERE name NOT IN (SELECT name FROM neighborhoods)""", NEIGHBORHOODS),
    "venue_to_neighborhood": with_views(CONFIG, body="""SELECT venue_key, min_by(neighborhood, id) AS neighborhood FROM (
        SELECT lower(CASE WHEN id % 3 = 0 THEN upper(venue_name) ELSE concat('Hall ', CAST(id % 20 AS STRING)) END) AS venue_key, neighborhood, id FROM venue_config) GROUP BY 1"""),
    "match_existing": listing_query(""", f AS (SELECT name, source, date, min(id) AS existing_id FROM listings GROUP BY ALL),
        b AS (SELECT id AS position, CASE WHEN id % 2 = 0 THEN name ELSE concat(name, '!') END AS name, source, date FROM listings)
        SELECT position, b.name, b.source, b.date, existing_id FROM b LEFT JOIN f ON f.name = b.name AND f.source = b.source AND f.date = b.date"""),
    "prune_dead": listing_query(f"""SELECT id, origination_url FROM listings WHERE NOT coalesce({UP} AND origination_url IN (
        SELECT url FROM checks GROUP BY url HAVING count(*) >= 2 AND bool_and(code IN (404, 410))), false)""", checks_view()),
    "transit_hint": listing_query("""SELECT l.id, n.name AS neighborhood, CASE WHEN n.id % 4 = 0 THEN 'Line ' || n.id END AS transit
        FROM listings l LEFT JOIN neighborhoods n ON n.id = neighborhood_id""", NEIGHBORHOODS),
}
