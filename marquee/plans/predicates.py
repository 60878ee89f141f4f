"""Queries and oracles of the filters and row predicates."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import (LISTINGS_AS_OF, ODD_TITLE, audit_logs, listings, neighborhoods, odd_titles)
from marquee.operators import predicates as P
from marquee.plans.views import AUDIT, NEIGHBORHOODS, listing_query, q, with_views

AS_OF = LISTINGS_AS_OF
WEEKEND = ("1998-06-13 00:00:00", "1998-06-14 23:59:59")
UP = "(date_end >= TIMESTAMP '1998-06-06' OR (date_end IS NULL AND date >= TIMESTAMP '1998-06-06'))"
IN_WEEKEND = ("(date <= TIMESTAMP '1998-06-14 23:59:59' AND (date_end >= TIMESTAMP '1998-06-13' "
              "OR (date_end IS NULL AND date >= TIMESTAMP '1998-06-13')))")
TITLES = f", titles AS (SELECT id, {ODD_TITLE} AS title FROM listings)"
CITY_LOCATION = "CASE id % 6 WHEN 0 THEN 'Virtual' WHEN 1 THEN 'online' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE address END"


def has_label(label):
    return f"(lower(trim(coalesce(category, ''))) = {q(label.lower())} OR coalesce(list_contains(list_transform(categories, lambda x: lower(x)), {q(label.lower())}), false))"


def concept_sql(concepts):
    parts = []
    for c in concepts:
        canonical, _, prefixes, labels = vocab.CONCEPTS[c]
        parts += [f"lower(category) LIKE {q(p + '%')}" for p in prefixes]
        parts += [f"lower(category) = {q(x.lower())}" for x in labels]
        parts += [f"list_contains(list_transform(categories, lambda x: lower(x)), {q(x.lower())})" for x in [canonical, *labels]]
    return "(" + " OR ".join(f"coalesce({p}, false)" for p in parts) + ")"


def no_match(column, patterns):
    return " AND ".join(f"NOT regexp_matches({column}, {q(p)})" for p in patterns)


COLLAPSED = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"


def _city(s, d):
    located = listings(s, d, "id", "address").selectExpr("id", f"{CITY_LOCATION} AS location")
    return P.in_city_only(located)


QUERIES = {
    "upcoming": lambda s, d: P.upcoming(listings(s, d, "id", "date", "date_end"), AS_OF),
    "overlaps": lambda s, d: P.overlaps(listings(s, d, "id", "date", "date_end"), *WEEKEND),
    "starts_within": lambda s, d: P.starts_within(listings(s, d, "id", "date"), *WEEKEND),
    "category_is": lambda s, d: P.category_is(listings(s, d, "id", "category", "categories"), "Comedy").select("id", "category"),
    "category_by_concepts": lambda s, d: P.category_by_concepts(
        listings(s, d, "id", "category", "categories"), ["theater", "art", "lgbtq"]).select("id", "category"),
    "keyword_any": lambda s, d: P.keyword_any(listings(s, d, "id", "name"), ["jazz", "YOGA", "ar"]),
    "in_neighborhoods": lambda s, d: P.in_neighborhoods(
        listings(s, d, "id", "neighborhood_id"), neighborhoods(s, d), ["NATION_3", "NATION_17"]),
    "event_by_id": lambda s, d: P.event_by_id(listings(s, d, "id", "name", "date", "cost"), 42),
    "audit_filter": lambda s, d: P.audit_filter(audit_logs(s, d), "security_blocked", "failure", 200),
    "unpriced_with_link": lambda s, d: P.unpriced_with_link(
        listings(s, d, "id", "date", "date_end", "cost", "origination_url", "source"), AS_OF, exclude_source="ticket_api"),
    "looks_like_event": lambda s, d: odd_titles(s, d).where(P.looks_like_event("title")),
    "reads_like_title": lambda s, d: odd_titles(s, d).where(P.reads_like_title("title")),
    "displayable_category": lambda s, d: listings(s, d, "id", "category", "name").withColumn(
        "category", F.expr("CASE WHEN id % 4 = 0 THEN category ELSE substr(name, 1, 12) END")).where(
        P.displayable_category("category")).select("id", "category"),
    "plausible_label": lambda s, d: odd_titles(s, d).select("id", P.plausible_label("title").alias("label")).where("label IS NOT NULL"),
    "in_city_only": _city,
    "display_fields": lambda s, d: P.display_fields(listings(s, d, "id", "date", "date_end", "time", "details")).select(
        "id", "date_label", "summary"),
}

ORACLES = {
    "upcoming": listing_query(f"SELECT id, date, date_end FROM listings WHERE {UP}"),
    "overlaps": listing_query(f"SELECT id, date, date_end FROM listings WHERE {IN_WEEKEND}"),
    "starts_within": listing_query(
        "SELECT id, date FROM listings WHERE date BETWEEN TIMESTAMP '1998-06-13' AND TIMESTAMP '1998-06-14 23:59:59'"),
    "category_is": listing_query(f"SELECT id, category FROM listings WHERE {has_label('Comedy')}"),
    "category_by_concepts": listing_query(f"SELECT id, category FROM listings WHERE {concept_sql(['theater', 'art', 'lgbtq'])}"),
    "keyword_any": listing_query(
        "SELECT id, name FROM listings WHERE contains(lower(name), 'jazz') OR contains(lower(name), 'yoga') OR contains(lower(name), 'ar')"),
    "in_neighborhoods": listing_query(
        "SELECT l.id, n.name AS neighborhood, neighborhood_id FROM listings l JOIN neighborhoods n ON n.id = neighborhood_id WHERE n.name IN ('NATION_3', 'NATION_17')",
        NEIGHBORHOODS),
    "event_by_id": listing_query("SELECT id, name, date, cost FROM listings WHERE id = 42"),
    "audit_filter": with_views(AUDIT, body="""SELECT * FROM audit_logs WHERE operation = 'security_blocked' AND status = 'failure'
        ORDER BY created_at DESC, id DESC LIMIT 200"""),
    "unpriced_with_link": listing_query(f"""SELECT id, date, date_end, cost, origination_url, source FROM listings
        WHERE {UP} AND (cost IS NULL OR cost = '') AND origination_url LIKE 'http%' AND source <> 'ticket_api'"""),
    "looks_like_event": listing_query(f"""{TITLES} SELECT id, title FROM titles WHERE length({COLLAPSED}) >= 10
        AND contains({COLLAPSED}, ' ') AND {no_match(COLLAPSED, vocab.NOT_AN_EVENT)}"""),
    "reads_like_title": listing_query(rf"""{TITLES} SELECT id, title FROM titles WHERE length(trim(title)) BETWEEN 4 AND 44
        AND len(string_split({COLLAPSED}, ' ')) >= 2 AND regexp_matches(trim(title), '^[\p{{L}}\p{{Nd}}]')
        AND {no_match('trim(title)', [vocab.TITLE_LEAD_WORDS, vocab.TITLE_STATUS])}"""),
    "displayable_category": listing_query(f""", c AS (SELECT id, CASE WHEN id % 4 = 0 THEN category ELSE substr(name, 1, 12) END AS category FROM listings)
        SELECT id, category FROM c WHERE length(trim(category)) >= 3
        AND lower(category) NOT IN ('undefined', 'miscellaneous', 'events', 'other', 'online search')
        AND {no_match('lower(category)', vocab.CATEGORY_DATE_PATTERNS)}"""),
    "plausible_label": listing_query(rf"""{TITLES}, c AS (SELECT id, {COLLAPSED} AS label, length(regexp_replace({COLLAPSED}, '[^\p{{L}}]', '', 'g')) AS letters FROM titles)
        SELECT id, label FROM c WHERE length(label) BETWEEN 2 AND 40 AND letters >= 2 AND letters * 2 >= length(label)
        AND {no_match('label', [vocab.LABEL_DATE_LIKE])}"""),
    "in_city_only": listing_query(f""", c AS (SELECT id, {CITY_LOCATION} AS location FROM listings)
        SELECT id, location FROM c WHERE lower(location) NOT IN ('virtual', 'online', '') AND contains(lower(location), 'chicago')"""),
    "display_fields": listing_query(r"""SELECT id, CASE WHEN date IS NULL THEN 'Date not listed'
        WHEN CAST(date_end AS DATE) <> CAST(date AS DATE) THEN strftime(date, '%a, %b %d, %Y') || ' through ' || strftime(date_end, '%a, %b %d, %Y')
        WHEN time IS NOT NULL THEN strftime(date, '%a, %b %d, %Y') || ' @ ' || trim(time) ELSE strftime(date, '%a, %b %d, %Y') END AS date_label,
        array_to_string(list_slice(string_split(details, ' '), 1, 10), ' ') || CASE WHEN len(string_split(details, ' ')) > 10 THEN '...' ELSE '' END AS summary
        FROM (SELECT id, date, date_end, time, trim(regexp_replace(details, '\s+', ' ', 'g')) AS details FROM listings)"""),
}
