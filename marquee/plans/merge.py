"""Queries and oracles of the merges."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import ODD_TITLE, listings
from marquee.operators import classify as K
from marquee.operators import merge as M
from marquee.plans.classify import _marked_ctes, _stored, STORED, labels_ctes
from marquee.plans.predicates import COLLAPSED, no_match
from marquee.plans.views import LISTINGS, listing_query, with_views

CATALOG = ("id", "name", "source", "date", "date_end", "time", "category", "cost", "neighborhood_id", "origination_url",
           "address", "venue_name", "latitude", "longitude")
OLD, NEW = "1998-06-01 00:00:00", "1998-06-06 00:00:00"

# one text for both engines: what the next run brings
VENUE_BATCH = """SELECT id AS position, CASE WHEN id % 3 = 0 THEN name ELSE concat('New ', name) END AS name, source, date, date + INTERVAL 3 DAY AS date_end, '9 pm' AS time,
    CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '$99' END AS cost,
    CASE WHEN id % 5 = 0 THEN neighborhood_id END AS neighborhood_id, category, CASE WHEN id % 2 = 0 THEN 'http://hot.example/' ELSE page_url END AS url FROM {rel}
  UNION ALL SELECT id + 40000000, concat('New ', name), source, date, NULL, '11 pm', CASE WHEN id % 3 = 0 THEN '$1' END, NULL, category,
    'http://hot.example/' FROM {rel}"""
URL_BATCH = """SELECT id AS position, CASE WHEN id % 3 = 0 THEN origination_url ELSE concat('http://new.example/', CAST(id - id % 2 AS STRING)) END AS origination_url, name, source, date + INTERVAL 1 DAY AS date, date + INTERVAL 3 DAY AS date_end,
    CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '$99' END AS cost, CASE WHEN id % 2 = 0 THEN 'New address' END AS address,
    'New venue' AS venue_name, CASE WHEN id % 5 = 4 THEN 1.5D ELSE NULL END AS latitude, CASE WHEN id % 5 = 4 THEN 2.5D ELSE NULL END AS longitude,
    CAST(7 AS BIGINT) AS neighborhood_id FROM {rel}"""
CARD_DATE = """CASE id % 5 WHEN 0 THEN 'June 6' WHEN 1 THEN '1998-06-13' WHEN 2 THEN '1998-06-13T19:30:00'
    WHEN 3 THEN '1998-06-13T19:30:00-05:00' ELSE '1998-12-13T01:30:00Z' END"""
CARDS = f"""SELECT id AS position, {ODD_TITLE} AS title, {CARD_DATE} AS date, address AS location, venue_name AS venue,
    CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN origination_url ELSE concat('http://new.example/', CAST(id - id % 2 AS STRING)) END AS url,
    CASE id % 4 WHEN 0 THEN 'Live jazz concert' WHEN 1 THEN 'Workshop' END AS type_hint FROM {{rel}}"""


def _view(s, text, df):
    """An adapter text over a DataFrame, without registering a view."""
    return s.sql(text.format(rel="{rel}"), rel=df)


def _table(s, d):
    return listings(s, d, *CATALOG).withColumn("date_retrieved", F.lit(OLD).cast("timestamp_ntz"))


def _venue_merge(s, d):
    batch = _view(s, VENUE_BATCH, listings(s, d, *CATALOG, "page_url")).withColumn(
        "date_retrieved", F.lit(NEW).cast("timestamp_ntz"))
    return M.merge_venue_batch(_table(s, d), batch).drop("latitude", "longitude")


def _url_merge(policy):
    def run(s, d):
        batch = _view(s, URL_BATCH, listings(s, d, *CATALOG)).withColumn("date_retrieved", F.lit(NEW).cast("timestamp_ntz"))
        return M.merge_by_url(_table(s, d), batch, M.POLICIES[policy])
    return run


def _cards(s, d):
    return _view(s, CARDS, listings(s, d, "id", "name", "address", "venue_name", "origination_url"))


def _inserts(s, d):
    out = M.insert_only(listings(s, d, "id", "origination_url"), _cards(s, d))
    return out.withColumn("categories", F.array_join("categories", "; "))


def _union(s, d):
    rows = listings(s, d, "id")
    sql_hits = rows.selectExpr("id % 20 AS query_id", "id", "id * 2 AS position")
    near = rows.selectExpr("(id + id % 2) % 20 AS query_id", "id", "id + 1 AS position")
    return M.candidate_union(sql_hits, near)


def _prices(s, d):
    found = listings(s, d, "id").selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('$', CAST(id % 90 AS STRING)) END AS cost")
    return M.fill_prices(listings(s, d, "id", "cost"), found)


def _apply(s, d):
    ev = _stored(s, d)
    out = M.apply_changes(ev, K.recategorize(ev, "parents", K.Context()))
    return out.select("id", "category", F.array_join("categories", "; ").alias("categories"),
                      F.array_join("subcategories", "; ").alias("subcategories"))


QUERIES = {
    "merge_venue_batch": _venue_merge,
    **{f"merge_by_url_{p}": _url_merge(p) for p in M.POLICIES},
    "insert_only": _inserts,
    "insert_counts": lambda s, d: M.insert_counts(_cards(s, d)),
    "candidate_union": _union,
    "fill_prices": _prices,
    "apply_changes": _apply,
}


def _url_merge_sql(policy):
    rules = {**M.POLICIES[policy], "date_retrieved": "overwrite"}
    text = {"cost", "address", "venue_name", "name", "source", "time", "category"}
    columns = []
    for c in [*CATALOG[1:], "date_retrieved"]:
        if c in ("time", "category", "origination_url"):
            columns.append(f"o.{c}" if c != "origination_url" else "coalesce(o.origination_url, n.origination_url) AS origination_url")
            continue
        new = f"nullif(n.{c}, '')" if c in text else f"n.{c}"
        old = f"nullif(o.{c}, '')" if c in text else f"o.{c}"
        both = {"overwrite": f"n.{c}", "overwrite_if_new": f"coalesce({new}, o.{c})",
                "fill_if_null": f"coalesce({old}, {new}, o.{c})", None: f"o.{c}"}[rules.get(c)]
        columns.append(f"CASE WHEN o.id IS NOT NULL AND n.position IS NOT NULL THEN {both} WHEN o.id IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}")
    return listing_query(f""", o AS (SELECT {', '.join(CATALOG)}, TIMESTAMP '{OLD}' AS date_retrieved FROM listings),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origination_url ORDER BY position) AS rn FROM (
          {URL_BATCH.format(rel='listings').replace('1.5D', '1.5').replace('2.5D', '2.5')})) WHERE rn = 1),
        n AS (SELECT *, TIMESTAMP '{NEW}' AS date_retrieved FROM b),
        j AS (SELECT o.id, {', '.join(columns)}, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.position IS NULL THEN 'kept' ELSE 'updated' END AS change
          FROM o FULL JOIN n ON o.origination_url = n.origination_url)
        SELECT * REPLACE (CASE WHEN id IS NULL THEN (SELECT max(id) FROM o) + row_number() OVER (
          PARTITION BY id IS NULL ORDER BY substr(md5(origination_url), 1, 3), origination_url) ELSE id END AS id) FROM j""")


CARD_STATUS = f"""cards AS (SELECT position, title, date, location, venue, url, type_hint, CASE
    WHEN NOT (length({COLLAPSED}) >= 10 AND contains({COLLAPSED}, ' ') AND {no_match(COLLAPSED, vocab.NOT_AN_EVENT)}) THEN 'not_an_event'
    WHEN coalesce(url, '') = '' THEN 'no_link' WHEN date = 'June 6' THEN 'undated' ELSE 'event' END AS status,
    CASE position % 5 WHEN 1 THEN TIMESTAMP '1998-06-13' WHEN 2 THEN TIMESTAMP '1998-06-13 19:30:00' WHEN 3 THEN TIMESTAMP '1998-06-13 19:30:00'
      WHEN 4 THEN TIMESTAMP '1998-12-12 19:30:00' END AS event_date FROM ({CARDS.format(rel='listings')}))"""

ORACLES = {
    "merge_venue_batch": listing_query(f""", o AS (SELECT {', '.join(c for c in CATALOG if c not in ('latitude', 'longitude'))}, TIMESTAMP '{OLD}' AS date_retrieved FROM listings),
      b AS ({VENUE_BATCH.format(rel='listings')}),
      f AS (SELECT name, source, date, min(position) AS position, last(date_end ORDER BY position) AS date_end, last(time ORDER BY position) AS time,
          last(cost ORDER BY position) FILTER (cost <> '') AS cost, last(neighborhood_id ORDER BY position) FILTER (neighborhood_id IS NOT NULL) AS neighborhood_id,
          first(category ORDER BY position) AS category, first(url ORDER BY position) AS url
        FROM b GROUP BY name, source, date, CASE WHEN date IS NULL OR source IS NULL THEN position END),
      h AS (SELECT min(o.id) AS id, f.position FROM o JOIN f ON o.name = f.name AND o.source = f.source AND o.date = f.date GROUP BY f.position),
      news AS (SELECT * FROM f WHERE position NOT IN (SELECT position FROM h)),
      c AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) = 1 AND url NOT IN (SELECT origination_url FROM o) AS keeps FROM news),
      e AS (SELECT *, url || '#' || source || '-' || coalesce(strftime(date, '%Y-%m-%d'), 'nodate') || '-' || coalesce(name, '') AS derived FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY keeps, derived ORDER BY position) AS n FROM e)
      SELECT o.id, o.name, o.source, o.date, CASE WHEN f.position IS NULL THEN o.date_end ELSE f.date_end END AS date_end,
        CASE WHEN f.position IS NULL THEN o.time ELSE f.time END AS time, o.category, coalesce(f.cost, o.cost) AS cost,
        coalesce(f.neighborhood_id, o.neighborhood_id) AS neighborhood_id, o.origination_url, o.address, o.venue_name,
        CASE WHEN f.position IS NULL THEN o.date_retrieved ELSE TIMESTAMP '{NEW}' END AS date_retrieved,
        CASE WHEN f.position IS NULL THEN 'kept' ELSE 'updated' END AS change
      FROM o LEFT JOIN h USING (id) LEFT JOIN f ON f.position = h.position
      UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY substr(md5(CAST(position AS VARCHAR)), 1, 3), position),
        name, source, date, date_end, time, category, cost, neighborhood_id,
        CASE WHEN keeps THEN url WHEN n = 1 THEN derived ELSE derived || '-' || position END, NULL, NULL, TIMESTAMP '{NEW}', 'inserted' FROM r"""),
    **{f"merge_by_url_{p}": _url_merge_sql(p) for p in M.POLICIES},
    "insert_only": with_views(LISTINGS, CARD_STATUS, """fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) AS rn FROM cards
          WHERE status = 'event' AND url NOT IN (SELECT origination_url FROM listings)) WHERE rn = 1)""",
        labels_ctes("fresh", "title", "'Events'", "type_hint", "lab"), body="""
        SELECT title AS name, event_date AS date, location AS address, venue AS venue_name, array_to_string(labels, '; ') AS categories,
          coalesce(labels[1], 'Events') AS category, url AS origination_url, 'web_search' AS source FROM lab"""),
    "insert_counts": with_views(LISTINGS, CARD_STATUS, body="SELECT status, count(*) AS n FROM cards GROUP BY status"),
    "candidate_union": listing_query("""SELECT id % 20 AS query_id, id, id * 2 AS position, 0 AS origin FROM listings
        UNION ALL SELECT (id + 1) % 20, id, id + 1, 1 FROM listings WHERE id % 2 = 1"""),
    "fill_prices": listing_query("""SELECT id, coalesce(nullif(cost, ''), CASE WHEN id % 3 = 2 THEN '$' || (id % 90) END, cost) AS cost FROM listings"""),
    "apply_changes": with_views(LISTINGS, STORED, _marked_ctes("parents", "stored", "m"), body="""
        SELECT id, CASE WHEN _changed THEN _parents[1] ELSE category END AS category,
          array_to_string(CASE WHEN _changed THEN _parents ELSE categories END, '; ') AS categories,
          array_to_string(CASE WHEN _changed THEN _finer ELSE subcategories END, '; ') AS subcategories FROM m"""),
}
