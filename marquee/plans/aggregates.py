"""Queries and oracles of the facets, counts and reports."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import (LISTINGS_AS_OF, audit_logs, chat_threads, link_checks, listings, neighborhoods,
                              venue_config, with_repeats)
from marquee.operators import aggregates as A
from marquee.plans.predicates import IN_WEEKEND, UP, has_label, no_match
from marquee.plans.views import (AUDIT, CONFIG, NEIGHBORHOODS, REPEATED, THREADS, checks_view, listing_query, q, with_views)

AS_OF = LISTINGS_AS_OF
SEASON = ("1998-06-13 00:00:00", "1998-09-14 23:59:59")
IN_SEASON = IN_WEEKEND.replace("1998-06-14 23", "1998-09-14 23")
AHEAD = "date >= TIMESTAMP '1998-06-06'"
PRIOR_VENUE = """CASE WHEN id % 5 = 0 OR venue_name IS NULL THEN NULL WHEN id % 2 = 0 THEN concat('The ', venue_name, ' Theatre')
    ELSE concat(venue_name, ' Theater - Chicago IL') END"""


LATER_DATE = "CASE WHEN id % 11 = 0 THEN NULL ELSE date END"


def _facets(s, d, *more):
    return listings(s, d, "id", "date", "date_end", "category", "categories", "neighborhood_id", *more)


def _after(s, d):
    cols = ("id", "date", "source", "neighborhood_id", "cost")
    return with_repeats(listings(s, d, *cols)).withColumn("date", F.expr(LATER_DATE))


def _priors(s, d):
    ev = listings(s, d, "id", "source", "category", "details", "venue_name").withColumn("venue_name", F.expr(PRIOR_VENUE))
    config = venue_config(s, d).withColumn("name", F.col("venue_name"))
    return A.venue_priors(ev, config)


def manifest_sql(rel):
    return f"""SELECT 'total' AS kind, 'all' AS key, count(*) AS n FROM {rel}
  UNION ALL SELECT 'total', 'upcoming', count(*) FROM {rel} WHERE {AHEAD}
  UNION ALL SELECT 'total', 'dated', count(*) FROM {rel} WHERE {AHEAD}
  UNION ALL SELECT 'total', 'placed', count(*) FROM {rel} WHERE {AHEAD} AND neighborhood_id IS NOT NULL
  UNION ALL SELECT 'source', source, count(*) FROM {rel} WHERE {AHEAD} GROUP BY source
  UNION ALL SELECT 'neighborhood', n.name, count(*) FROM {rel} e JOIN neighborhoods n ON n.id = e.neighborhood_id WHERE {AHEAD} GROUP BY n.name"""


def venue_key_sql(c):
    """The venue key in DuckDB."""
    key = rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', '', 'g'), '\btheatre\b', 'theater', 'g'), '^the\s+', '')"
    key = rf"regexp_replace({key}, '(?:\s*\b(?:il|illinois|chicago))+\s*$', '')"
    return rf"trim(regexp_replace({key}, '\s+', ' ', 'g'))"


QUERIES = {
    "facet_categories": lambda s, d: A.facet_categories(
        _facets(s, d), neighborhoods(s, d), AS_OF, "NATION_3", SEASON),
    "facet_neighborhoods": lambda s, d: A.facet_neighborhoods(_facets(s, d), neighborhoods(s, d), AS_OF, "LGBTQ", SEASON),
    "neighborhood_counts": lambda s, d: A.neighborhood_counts(
        listings(s, d, "date", "date_end", "neighborhood_id"), neighborhoods(s, d), AS_OF),
    "category_tiles": lambda s, d: A.category_tiles(listings(s, d, "date", "date_end", "category"), AS_OF),
    "all_categories": lambda s, d: A.all_categories(listings(s, d, "category")),
    "catalog_stats": lambda s, d: A.catalog_stats(listings(s, d, "date", "date_end", "category"), AS_OF),
    "catalog_facts": lambda s, d: A.catalog_facts(
        listings(s, d, "id", "date", "date_end", "source", "cost", "neighborhood_id"), neighborhoods(s, d), AS_OF),
    "session_summary": lambda s, d: A.session_summary(chat_threads(s, d), audit_logs(s, d)),
    "security_summary": lambda s, d: A.security_summary(audit_logs(s, d)),
    "threads_by_status": lambda s, d: A.threads_by_status(chat_threads(s, d)),
    "duplicate_groups": lambda s, d: A.duplicate_groups(with_repeats(listings(s, d, "id", "source", "name", "date", "time"))),
    "cross_source_duplicates": lambda s, d: A.cross_source_duplicates(listings(s, d, "name", "date", "source")),
    "catalog_manifest": lambda s, d: A.catalog_manifest(
        listings(s, d, "id", "date", "source", "neighborhood_id"), neighborhoods(s, d), AS_OF),
    "manifest_diff": lambda s, d: A.manifest_diff(
        A.catalog_manifest(listings(s, d, "id", "date", "source", "neighborhood_id"), neighborhoods(s, d), AS_OF),
        A.catalog_manifest(_after(s, d), neighborhoods(s, d), AS_OF)),
    "dated_share_by_source": lambda s, d: A.dated_share_by_source(listings(s, d, "source", "date")),
    "run_report": lambda s, d: A.run_report(listings(s, d, "venue_name", "date", "cost")),
    "run_totals": lambda s, d: A.run_totals(listings(s, d, "id", "date", "cost"), _after(s, d), AS_OF),
    "price_distribution": lambda s, d: A.price_distribution(listings(s, d, "source", "cost")),
    "venue_priors": _priors,
    "unmapped_labels": lambda s, d: A.unmapped_labels(
        listings(s, d, "id", "category", "categories", "name").withColumn("subcategories", F.array(F.expr("substr(name, 1, 9)")))),
    "links_by_source": lambda s, d: A.links_by_source(listings(s, d, "date", "date_end", "source", "origination_url"), AS_OF),
    "link_report": lambda s, d: A.link_report(link_checks(s, d)),
    "zero_output_venues": lambda s, d: A.zero_output_venues(venue_config(s, d), listings(s, d, "source", "date"), AS_OF),
}

_TAXONOMY_LABELS = ", ".join(q(x.lower()) for labels in vocab.TAXONOMY.values() for x in labels)

ORACLES = {
    "facet_categories": listing_query(f"""SELECT label, count(*) AS event_count FROM (
        SELECT unnest(coalesce(categories, [category])) AS label FROM listings l JOIN neighborhoods n ON n.id = l.neighborhood_id
        WHERE n.name = 'NATION_3' AND category IS NOT NULL AND {UP} AND {IN_SEASON}) GROUP BY label""", NEIGHBORHOODS),
    "facet_neighborhoods": listing_query(f"""SELECT n.name AS neighborhood, count(*) AS event_count FROM listings l
        JOIN neighborhoods n ON n.id = l.neighborhood_id WHERE {UP} AND {IN_SEASON} AND {has_label('LGBTQ')} GROUP BY n.name""", NEIGHBORHOODS),
    "neighborhood_counts": listing_query(f"""SELECT n.name AS neighborhood, count(*) AS event_count FROM listings l
        JOIN neighborhoods n ON n.id = l.neighborhood_id WHERE {UP} GROUP BY n.name HAVING count(*) >= 3""", NEIGHBORHOODS),
    "category_tiles": listing_query(f"""SELECT lower(trim(category)) AS key,
        coalesce(min(trim(category)) FILTER (regexp_matches(category, '^\\p{{Lu}}')), min(trim(category))) AS category
        FROM listings WHERE {UP} AND length(trim(category)) >= 3
        AND lower(category) NOT IN ('undefined', 'miscellaneous', 'events', 'other', 'online search')
        AND {no_match('lower(category)', vocab.CATEGORY_DATE_PATTERNS)} GROUP BY lower(trim(category))"""),
    "all_categories": listing_query("SELECT DISTINCT category FROM listings WHERE category IS NOT NULL"),
    "catalog_stats": listing_query(f"""SELECT count(*) AS total_events, count(DISTINCT category) AS unique_categories,
        min(date) AS earliest_event, max(date) AS latest_event FROM listings WHERE {UP}"""),
    "catalog_facts": listing_query(f""", up AS (SELECT * FROM listings WHERE {UP}),
      t AS (SELECT count(*) AS total, count(DISTINCT source) FILTER (source LIKE 'chicago\\_venue\\_%' ESCAPE '\\') AS venues,
        count(*) FILTER (lower(cost) = 'free') AS free, count(DISTINCT neighborhood_id) AS hoods FROM up)
      SELECT 'total' AS fact, NULL AS label, total AS value FROM t UNION ALL SELECT 'venues', NULL, venues FROM t
      UNION ALL SELECT 'free', NULL, free FROM t
      UNION ALL SELECT 'one_in', NULL, greatest(2, CAST(round_even(total / free, 0) AS BIGINT)) FROM t
      UNION ALL SELECT 'neighborhoods', NULL, hoods FROM t
      UNION ALL (SELECT 'top_neighborhood', n.name, count(*) FROM up JOIN neighborhoods n ON n.id = neighborhood_id GROUP BY n.name ORDER BY 3 DESC, 2 LIMIT 1)
      UNION ALL (SELECT 'busiest_day', strftime(date, '%Y-%m-%d'), count(*) FROM up GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""", NEIGHBORHOODS),
    "session_summary": with_views(THREADS, AUDIT, body="""
      , t AS (SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, sum(turn_count) AS turns, sum(total_tokens) AS tokens FROM chat_threads)
      SELECT 'session' AS kind, 'total_sessions' AS key, CAST(total AS DOUBLE) AS value FROM t
      UNION ALL SELECT 'session', 'completed_sessions', completed FROM t UNION ALL SELECT 'session', 'active_sessions', total - completed FROM t
      UNION ALL SELECT 'session', 'total_turns', turns FROM t UNION ALL SELECT 'session', 'total_tokens', tokens FROM t
      UNION ALL SELECT 'session', 'avg_tokens_per_session', round(tokens / completed, 2) FROM t
      UNION ALL SELECT 'session', 'avg_turns_per_session', round(turns / completed, 2) FROM t
      UNION ALL SELECT 'operation', operation, count(*) FROM audit_logs GROUP BY operation"""),
    "security_summary": with_views(AUDIT, body="""
      , b AS (SELECT * FROM audit_logs WHERE operation = 'security_blocked')
      SELECT 'count' AS kind, 'blocked_requests' AS key, count(*) AS n, CAST(NULL AS TIMESTAMP) AS at FROM b
      UNION ALL SELECT 'count', 'outputs_sanitized', count(*), NULL FROM audit_logs WHERE operation = 'output_sanitized'
      UNION ALL SELECT 'count', 'out_of_scope_questions', count(*), NULL FROM audit_logs WHERE operation = 'out_of_scope_question'
      UNION ALL SELECT 'blocked_session', CAST(thread_id AS VARCHAR), count(*), NULL FROM b GROUP BY thread_id HAVING count(*) >= 3
      UNION ALL (SELECT 'recent_block', CAST(thread_id AS VARCHAR), id, created_at FROM b ORDER BY created_at DESC, id DESC LIMIT 10)"""),
    "threads_by_status": with_views(THREADS, body="SELECT status, count(*) AS n FROM chat_threads GROUP BY status"),
    "duplicate_groups": listing_query("""SELECT id, source, lower(trim(name)) AS name, date, coalesce(time, '') AS time, copies, keep_id FROM (
        SELECT *, count(*) OVER w AS copies, min(id) OVER w AS keep_id FROM repeated WHERE date IS NOT NULL
        WINDOW w AS (PARTITION BY source, lower(trim(name)), date, coalesce(time, ''))) WHERE copies > 1""", REPEATED),
    "cross_source_duplicates": listing_query("""SELECT lower(trim(name)) AS name, date, count(DISTINCT source) AS sources
        FROM listings GROUP BY 1, 2 HAVING count(DISTINCT source) > 1"""),
    "catalog_manifest": listing_query(manifest_sql("listings"), NEIGHBORHOODS),
    "manifest_diff": listing_query(f""", later AS (SELECT * REPLACE ({LATER_DATE} AS date) FROM repeated),
        b AS ({manifest_sql('listings')}), a AS ({manifest_sql('later')})
        SELECT * FROM (SELECT kind, key, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after,
          coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, coalesce(a.n, 0) < coalesce(b.n, 0) AS lost
        FROM b FULL JOIN a USING (kind, key)) WHERE before <> after""", NEIGHBORHOODS, REPEATED),
    "dated_share_by_source": listing_query("""SELECT source, count(*) AS listings, count(date) AS dated,
        CAST(round_even(count(date) * 100 / count(*), 0) AS BIGINT) AS percent FROM listings
        WHERE source LIKE 'chicago\\_venue\\_%' ESCAPE '\\' GROUP BY source ORDER BY count(*) DESC, source LIMIT 15"""),
    "run_report": listing_query("""SELECT venue_name AS venue, count(*) AS events, count(date) AS dated,
        count(*) FILTER (cost <> '') AS priced FROM listings GROUP BY venue_name"""),
    "run_totals": listing_query(f""", a AS (SELECT count(*) AS u, count(cost) AS p FROM (SELECT * REPLACE ({LATER_DATE} AS date) FROM repeated) WHERE {AHEAD}),
        b AS (SELECT count(*) AS u, count(cost) AS p FROM listings WHERE {AHEAD})
        SELECT a.u AS upcoming, a.p AS priced, a.u - b.u AS upcoming_delta, a.p - b.p AS priced_delta FROM a, b""", REPEATED),
    "price_distribution": listing_query(""", c AS (SELECT source, cost, count(*) AS n FROM listings WHERE cost <> '' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, cost) AS rk FROM c)
        SELECT source, CAST(sum(n) AS BIGINT) AS priced, string_agg(cost || ' x' || n, ', ' ORDER BY rk) FILTER (rk <= 4) AS prices FROM r GROUP BY source"""),
    "venue_priors": listing_query(rf""", v AS (SELECT id, trim(category) AS category,
          coalesce(nullif(trim({PRIOR_VENUE}), ''), trim(regexp_extract(details, 'Venue:\s*([^|]+)', 1))) AS venue
          FROM listings WHERE source <> 'ticket_api'),
        t AS (SELECT {venue_key_sql('venue')} AS venue_key, category, count(*) AS n, min(id) AS first_id FROM v
          WHERE venue <> '' AND lower(category) NOT IN ('undefined', 'other', 'events', '') GROUP BY 1, 2),
        r AS (SELECT venue_key, category AS learned FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY n DESC, first_id) AS rn FROM t) WHERE rn = 1),
        c AS (SELECT {venue_key_sql('venue_name')} AS venue_key,
          CASE category WHEN 'music' THEN 'Music' WHEN 'arts & crafts' THEN 'Arts & Crafts' ELSE 'Comedy' END AS declared
          FROM venue_config WHERE category <> 'events')
        SELECT venue_key, coalesce(declared, learned) AS category FROM r FULL JOIN c USING (venue_key)""", CONFIG),
    "unmapped_labels": listing_query(f""", raw AS (SELECT DISTINCT trim(x) AS x FROM (
          SELECT unnest(list_concat([category, substr(name, 1, 9)], coalesce(categories, []))) AS x FROM listings) WHERE x IS NOT NULL),
        clean AS (SELECT DISTINCT array_to_string(list_transform(string_split(x, ' '), lambda w:
          CASE WHEN regexp_matches(substr(w, 2), '\\p{{Lu}}') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS label FROM raw)
        SELECT label FROM clean WHERE lower(label) NOT IN ({_TAXONOMY_LABELS})"""),
    "links_by_source": listing_query(f"SELECT source, min(origination_url) AS url FROM listings WHERE {UP} GROUP BY source"),
    "link_report": listing_query("""SELECT source, count(*) AS checked, count(*) FILTER (code BETWEEN 200 AND 399) AS usable,
        count(*) FILTER (code NOT BETWEEN 200 AND 399) AS broken FROM checks GROUP BY source""", checks_view()),
    "zero_output_venues": listing_query(f"""SELECT c.neighborhood, c.name, 'chicago_venue_' || c.name AS source,
        count(l.id) AS future_events, CASE WHEN count(l.id) > 0 THEN 'ok' ELSE 'ZERO' END AS flag
        FROM venue_config c LEFT JOIN listings l ON l.source = 'chicago_venue_' || c.name AND l.{AHEAD} GROUP BY ALL""", CONFIG),
}
