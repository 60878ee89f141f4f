"""Queries and oracles of the enrichment jobs.

Texts are built per listing from one expression that runs on both engines. Where a column parses many shapes the
oracle states the value each shape has, instead of parsing it a second time.
"""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import listings, pages_events, venue_config
from marquee.functions import calendar as C
from marquee.functions import dates as D
from marquee.functions import enrichment as E
from marquee.functions import labels as L
from marquee.functions import money as Y
from marquee.operators import enrich as N
from marquee.plans.classify import finer_sql, labels_ctes, norm_sql, parents_sql, rule_sql
from marquee.plans.views import CONFIG, LISTINGS, PAGES, listing_query, q, with_views

SAID = """concat(CASE id % 14 WHEN 0 THEN 'Admission $10-20' WHEN 1 THEN 'No cover' WHEN 2 THEN 'free parking, $15 adv' WHEN 3 THEN 'Tickets from $12.50'
    WHEN 4 THEN '$20 to $25 at 8:30 PM' WHEN 5 THEN 'starting at $64.00' WHEN 6 THEN 'Suggested donation at the door' WHEN 7 THEN 'Doors 7:30pm'
    WHEN 8 THEN '$30-$10' WHEN 9 THEN 'pay what you can' WHEN 10 THEN 'a ticketed evening' WHEN 11 THEN 'Free w/ RSVP' WHEN 12 THEN 'only $ 5.75'
    ELSE concat('$0', CAST(id % 90 AS STRING)) END,
  '. ', CASE id % 9 WHEN 0 THEN '21+' WHEN 1 THEN '18 and over' WHEN 2 THEN 'ages 16 and up' WHEN 3 THEN '12 years old' WHEN 4 THEN 'minimum age: 19'
    WHEN 5 THEN 'All ages' WHEN 6 THEN 'for kids' WHEN 7 THEN '5 up, kid friendly' ELSE 'no limits' END,
  '. ', CASE id % 7 WHEN 0 THEN 'rooftop party' WHEN 1 THEN 'at the Arena' WHEN 2 THEN 'in the park' WHEN 3 THEN 'Chicago Loop' WHEN 4 THEN 'museum hall' ELSE 'somewhere' END,
  '. ', CASE id % 5 WHEN 0 THEN concat(CAST(id % 900 AS STRING), ' West Oak Ave. Apt 2, Chicago') WHEN 1 THEN 'located at 45 Lake Shore Drive' ELSE '' END)"""
BILLED = """CASE id % 6 WHEN 0 THEN concat(name, ' at the Blue Note - late') WHEN 1 THEN concat(name, ' at Sam''s Place') WHEN 2 THEN concat(name, ' at Chicago')
    WHEN 3 THEN concat(name, ' at O''Hare & Sons on Friday') WHEN 4 THEN concat('Free ', name, ' for kids') ELSE name END"""
DAY = "CAST(1 + id % 28 AS STRING)"
DAY2 = "lpad(CAST(1 + id % 28 AS STRING), 2, '0')"
DATES = f"""CASE id % 16 WHEN 0 THEN '1998-10-{{d2}}T19:30:00-05:00' WHEN 1 THEN '1998-11-{{d2}}' WHEN 2 THEN 'Oct {{d}} - 30, 1998' WHEN 3 THEN 'Oct {{d}} - Nov 4, 1998'
    WHEN 4 THEN 'October {{d}}, 1998' WHEN 5 THEN 'Oct {{d}}, 1998' WHEN 6 THEN 'Fri, Oct {{d}}, 1998' WHEN 7 THEN 'Oct {{d}} 1998' WHEN 8 THEN '10/{{d}}/1998'
    WHEN 9 THEN 'Mon October {{d}}' WHEN 10 THEN 'Oct {{d}}' WHEN 11 THEN 'Feb 30' WHEN 12 THEN 'soon' WHEN 13 THEN '1998-12-{{d2}}T01:30:00Z' WHEN 14 THEN 'October {{d}} - 30, 1998' END""".replace("{{d2}}", "{d2}").replace("{{d}}", "{d}")
RUNS = """CASE id % 10 WHEN 0 THEN 'SEP {d}-OCT 18, 1998' WHEN 1 THEN 'Oct 27-Mar {d}, 1999' WHEN 2 THEN 'Oct {d} - 30' WHEN 3 THEN 'Nov {d} - Feb 2' WHEN 4 THEN 'Monday, October 05 - Wednesday, October 07'
    WHEN 5 THEN 'Sept. {d}, 1999' WHEN 6 THEN 'Thu, Feb {d}' WHEN 7 THEN 'Thu, Jul {d} 8pm' WHEN 8 THEN 'no date' END"""
PROGRAMS = """CASE id % 8 WHEN 0 THEN 'April {d}, 1998 - October 31, 1998' WHEN 1 THEN 'October {d}, 1998' WHEN 2 THEN 'Apr {d} - Oct 31' WHEN 3 THEN 'Nov {d} - Feb 12' WHEN 4 THEN 'Jul {d}'
    WHEN 5 THEN 'Feb {d}' WHEN 6 THEN 'Some time {d}' END"""
SESSIONS = """CASE id % 6 WHEN 0 THEN 'Thursday | October {d}, 1998' WHEN 1 THEN 'Oct {d}th' WHEN 2 THEN 'Jan {d}th' WHEN 3 THEN 'June 6th' WHEN 4 THEN 'June 5th' ELSE 'tba' END"""
CLOCKS = """CASE id % 5 WHEN 0 THEN '6 00 PM - 9 00 PM UTC' WHEN 1 THEN '6:30 PM' WHEN 2 THEN '11:15am - 1:00PM' WHEN 3 THEN '12 AM' ELSE 'noon' END"""
CARD = """CASE id % 8 WHEN 0 THEN concat('OCT 7 - WEDNESDAY', chr(10), name, chr(10), 'Buy tickets') WHEN 1 THEN concat('Hall ', chr(10), 'October', chr(10), 'More info', chr(10), name, ' > DATE: soon')
    WHEN 2 THEN concat('Upcoming Events', chr(10), 'Today - Sun, Oct 18', chr(10), '7:00 pm', name, 'Wed') WHEN 3 THEN concat('Fri Oct 9 8pm', chr(10), 'Doors: 7', chr(10), ')', name, ' -')
    WHEN 4 THEN concat('Tickets', chr(10), 'abc', chr(10), 'Sold Out') WHEN 5 THEN concat(name, '  DATE: October 15 TIME: 6:00pm') WHEN 6 THEN concat('All', chr(10), chr(10), 'Select date', chr(10), name) ELSE name END"""


def _filled(text):
    """A text with the day put in by expression, so that it runs on both engines."""
    return f"replace(replace({text}, '{{d2}}', {DAY2}), '{{d}}', {DAY})"


STAMP = f"concat('1998-', CASE WHEN id % 2 = 0 THEN '06' ELSE '12' END, '-', {DAY2}, 'T01:30:00', CASE id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-06:00' ELSE '' END)"
AS_OF = "1998-06-06 15:00:00"


def _said(s, d):
    return listings(s, d, "id", "name").selectExpr("id", f"{BILLED} AS name", f"{SAID} AS details")


def _dated(s, d, text):
    return listings(s, d, "id").select("id", F.expr(_filled(text)).alias("text"))


def _pair(df, columns):
    return df.select("id", columns[0].alias("starts"), columns[1].alias("ends"))


def _prices(s, d):
    return listings(s, d, "id").selectExpr("id", """CASE id % 6 WHEN 0 THEN CAST(array() AS ARRAY<DOUBLE>) WHEN 1 THEN array(0D, 0D) WHEN 2 THEN array(0D, CAST(id % 40 + 1 AS DOUBLE))
        WHEN 3 THEN array(25.5D) WHEN 4 THEN array(30D, CAST(id % 10 AS DOUBLE) + 0.25D) ELSE array(CAST(id % 10 + 1 AS DOUBLE)) END AS prices""")


OFFERS = """CASE id % 8 WHEN 0 THEN '{"name":"a"}' WHEN 1 THEN concat('{"offers":{"price":', CAST(id % 40 AS STRING), '}}')
    WHEN 2 THEN concat('{"offers":[{"price":"$1,200.50"},{"lowPrice":', CAST(id % 90 AS STRING), '}]}') WHEN 3 THEN '{"offers":{"price":99,"priceSpecification":{"minPrice":10,"maxPrice":"20"}}}'
    WHEN 4 THEN '{"offers":[{"price":"TBA"},{"price":true}]}' WHEN 5 THEN '{"offers":[{"price":0}]}' WHEN 6 THEN '{"offers":"see site"}' ELSE '{"offers":[{"price":0,"highPrice":"40"}]}' END"""
RANGES = """CASE id % 6 WHEN 0 THEN concat('[{"type":"standard","min":', CAST(id % 40 AS STRING), ',"max":40},{"type":"resale","min":1,"max":900}]') WHEN 1 THEN '[{"min":12.5}]' WHEN 2 THEN '[]'
    WHEN 3 THEN '[{"min":0,"max":0}]' WHEN 4 THEN '[{"type":"vip","min":5,"max":6}]' ELSE '[{"min":"x","max":15}]' END"""
PAGE_SOURCE = """CASE page_id % 6 WHEN 0 THEN 'chicago_venue_den_theatre' WHEN 1 THEN 'chicago_venue_goodman_theatre' WHEN 2 THEN 'chicago_venue_sleeping_village' WHEN 3 THEN 'chicago_park_district'
    WHEN 4 THEN 'chicago_venue_den_theatre' ELSE 'unknown' END"""
PAGE_HTML = """CASE WHEN page_id % 4 = 0 THEN html ELSE concat('<html><script>Tickets: $1</script><body><p>', CASE page_id % 6 WHEN 1 THEN concat('$', CAST(page_id % 50 AS STRING), '.00 to $40.00')
    WHEN 2 THEN concat('TIER 1 $', CAST(page_id % 50 AS STRING), '.00 &amp; General Admission $40') WHEN 3 THEN 'Event Fee <b>$0.00</b>' ELSE concat('Rated R Tickets:&nbsp;$', CAST(page_id % 50 AS STRING)) END, '</p></body></html>') END"""


def _page_price(s, d):
    pages = pages_events(s, d).selectExpr("page_id", f"{PAGE_SOURCE} AS source", f"{PAGE_HTML} AS html")
    return N.page_price(pages).select("page_id", "cost")


CANON_LABEL = "CASE id % 5 WHEN 0 THEN 'arts & theatre' WHEN 1 THEN 'Events' WHEN 2 THEN 'parties & DJs' WHEN 3 THEN 'tech' ELSE 'Miscellaneous' END"


def _canonical(s, d):
    rows = listings(s, d, "id", "name", "address").selectExpr(
        "id", "name", "address", f"{CANON_LABEL} AS category", "CAST(NULL AS STRING) AS locality",
        "CASE WHEN id % 3 = 0 THEN 'Live jazz concert' END AS category_hint",
        "CASE WHEN id % 7 = 0 THEN array('Halloween', 'music') END AS categories", "CAST(NULL AS ARRAY<STRING>) AS subcategories")
    out = N.canonical_event(rows)
    return out.select("id", "locality", "category", F.array_join("categories", "; ").alias("categories"),
                      F.array_join("subcategories", "; ").alias("subcategories"))


def _localized(s, d):
    rows = listings(s, d, "id", "date").selectExpr("id", "date", f"{STAMP} AS stamp")
    return rows.select("id", D.iso_local("stamp").alias("local"), D.utc_to_local(F.col("date")).alias("repaired"))


QUERIES = {
    "extract_cost": lambda s, d: _said(s, d).select("id", E.extract_cost("name", "details").alias("cost")),
    "extract_age": lambda s, d: _said(s, d).select("id", E.extract_age("name", "details").alias("age_range")),
    "extract_setting": lambda s, d: _said(s, d).select("id", E.extract_setting("details").alias("setting")),
    "extract_address": lambda s, d: _said(s, d).select("id", E.extract_address("details").alias("address")),
    "extract_venue": lambda s, d: _said(s, d).select("id", E.extract_venue("name").alias("venue")),
    "enrich": lambda s, d: N.enrich(_said(s, d)).drop("name", "details"),
    "card_price": lambda s, d: _said(s, d).select("id", Y.card_price("details").alias("price")),
    "render_price": lambda s, d: _prices(s, d).select("id", Y.render_price("prices").alias("price")),
    "offer_price": lambda s, d: listings(s, d, "id").select("id", Y.offer_price(F.expr(OFFERS)).alias("price")),
    "page_price": _page_price,
    "range_price": lambda s, d: listings(s, d, "id").select("id", Y.range_price(F.expr(RANGES)).alias("price")),
    "locality": lambda s, d: listings(s, d, "id", "address").select("id", E.locality("address").alias("locality")),
    "to_local": _localized,
    "infer_year": lambda s, d: listings(s, d, "id").select("id", C.infer_year(F.expr("CAST(1 + id % 12 AS INT)"), AS_OF).alias("year")),
    "parse_date_range": lambda s, d: _pair(_dated(s, d, DATES), C.parse_date_range("text", AS_OF)),
    "run_or_single": lambda s, d: _pair(_dated(s, d, RUNS), C.run_or_single("text", AS_OF)),
    "program_dates": lambda s, d: _pair(_dated(s, d, PROGRAMS), C.program_dates("text", AS_OF)),
    "session_times": lambda s, d: _pair(listings(s, d, "id").selectExpr("id", f"{_filled(SESSIONS)} AS day_text", f"{CLOCKS} AS clock_text"),
                                        C.session_times("day_text", "clock_text", AS_OF)),
    "title_from_lines": lambda s, d: listings(s, d, "id", "name").selectExpr("id", f"{CARD} AS card").select(
        "id", C.title_from_lines(F.split("card", "\n"), F.lit("Hall!")).alias("title")),
    "source_slug": lambda s, d: venue_config(s, d).withColumn("name", F.expr("concat('Rosa''s ', name, ' Lounge')")).select(
        "id", L.source_slug("name").alias("source")),
    "canonical_event": _canonical,
}

SAID_CTE = f"said AS (SELECT id, {BILLED} AS name, {SAID} AS details FROM listings)"
FULL = "trim(name || ' ' || details)"


def cost_sql(t):
    return f"""CASE WHEN regexp_matches({t}, {q(vocab.COST_FREE)}) THEN 'Free' WHEN regexp_matches({t}, {q(vocab.COST_DONATION)}) THEN 'Donation'
      WHEN regexp_matches({t}, {q(vocab.COST_AMOUNT)}) THEN trim(regexp_extract({t}, {q(vocab.COST_AMOUNT)})) WHEN regexp_matches({t}, {q(vocab.COST_PAID)}) THEN 'Paid' END"""


def age_sql(t):
    numbers = ", ".join(f"nullif(regexp_extract({t}, {q(p)}, 1), '')" for p in vocab.AGE_NUMBER)
    return f"""coalesce(coalesce({numbers}) || '+', CASE WHEN regexp_matches({t}, {q(vocab.AGE_ALL)}) THEN 'All ages' WHEN regexp_matches({t}, {q(vocab.AGE_KIDS)}) THEN 'Kids friendly' END)"""


def setting_sql(t):
    return f"CASE WHEN regexp_matches({t}, {q(vocab.OUTDOOR)}) THEN 'outdoor' WHEN regexp_matches({t}, {q(vocab.INDOOR)}) THEN 'indoor' END"


ADDRESS = f"nullif(trim(regexp_extract({{}}, {q(vocab.STREET_ADDRESS)})), '')"
_V = f"trim(regexp_extract(name, {q(vocab.VENUE_AFTER_AT)}, 1))"
VENUE = f"CASE WHEN length({_V}) > 2 AND lower({_V}) NOT IN ('the', 'chicago') THEN {_V} END"


def money_sql(x):
    return f"CASE WHEN {x} = floor({x}) THEN '$' || CAST({x} AS BIGINT) ELSE printf('$%.2f', {x}) END"


def render_sql(x, free_span=True):
    lead = f"WHEN list_min({x}) = 0 THEN 'Free-' || {money_sql(f'list_max({x})')}" if free_span else ""
    return f"""CASE WHEN list_max({x}) = 0 AND list_min({x}) = 0 THEN 'Free' {lead} WHEN list_min({x}) = list_max({x}) THEN {money_sql(f'list_min({x})')}
      ELSE {money_sql(f'list_min({x})')} || '-' || {money_sql(f'list_max({x})')} END"""


def on_day(year, month):
    return f"make_timestamp({year}, {month}, 1 + id % 28, 0, 0, 0)"


def dates(starts, ends):
    return listing_query(f"SELECT id, CASE {starts} END AS starts, CASE {ends} ELSE CAST(NULL AS TIMESTAMP) END AS ends FROM listings")


ORACLES = {
    "extract_cost": listing_query(f"SELECT id, coalesce({cost_sql('name')}, {cost_sql(FULL)}) AS cost FROM said", SAID_CTE),
    "extract_age": listing_query(f"SELECT id, coalesce({age_sql('name')}, {age_sql(FULL)}) AS age_range FROM said", SAID_CTE),
    "extract_setting": listing_query(f"SELECT id, {setting_sql('details')} AS setting FROM said", SAID_CTE),
    "extract_address": listing_query(f"SELECT id, {ADDRESS.format('details')} AS address FROM said", SAID_CTE),
    "extract_venue": listing_query(f"SELECT id, {VENUE} AS venue FROM said", SAID_CTE),
    "enrich": listing_query(f"""SELECT id, coalesce({cost_sql('name')}, {cost_sql(FULL)}) AS cost, coalesce({age_sql('name')}, {age_sql(FULL)}) AS age_range,
        {setting_sql(FULL)} AS is_outdoor, {ADDRESS.format(FULL)} AS address, {VENUE} AS venue_name FROM said""", SAID_CTE),
    "card_price": listing_query("""SELECT id, CASE id % 14 WHEN 0 THEN '$10-$20' WHEN 1 THEN 'Free' WHEN 2 THEN '$15' WHEN 3 THEN 'From $12.50' WHEN 4 THEN '$20-$25'
        WHEN 5 THEN 'From $64' WHEN 6 THEN 'Donation' WHEN 8 THEN '$30' WHEN 9 THEN 'Donation' WHEN 11 THEN 'Free' WHEN 12 THEN '$5.75' WHEN 13 THEN '$' || (id % 90) END AS price FROM listings"""),
    "render_price": listing_query(f""", p AS (SELECT id, CASE id % 6 WHEN 0 THEN CAST([] AS DOUBLE[]) WHEN 1 THEN [0, 0] WHEN 2 THEN [0, id % 40 + 1] WHEN 3 THEN [25.5]
        WHEN 4 THEN [30, id % 10 + 0.25] ELSE [id % 10 + 1] END AS prices FROM listings) SELECT id, {render_sql('prices')} AS price FROM p"""),
    "offer_price": listing_query("""SELECT id, CASE id % 8 WHEN 1 THEN CASE WHEN id % 40 = 0 THEN 'Free' ELSE '$' || (id % 40) END
        WHEN 2 THEN CASE WHEN id % 90 = 0 THEN 'Free-$1200.50' ELSE '$' || (id % 90) || '-$1200.50' END WHEN 3 THEN '$10-$20' WHEN 5 THEN 'Free' WHEN 7 THEN 'Free-$40' END AS price FROM listings"""),
    "page_price": with_views(PAGES, body=f""", p AS (SELECT page_id, page_id % 50 AS v, page_id % 40 AS a, page_id % 40 + page_id % 3 * 10 AS b FROM pages_events)
        SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {render_sql('[a, b]')}
          WHEN page_id % 6 IN (0, 4) THEN {render_sql('[v]')} WHEN page_id % 6 = 1 AND v <= 40 THEN {render_sql('[v, 40]')}
          WHEN page_id % 6 = 2 THEN {render_sql('[v, 40]')} WHEN page_id % 6 = 3 THEN 'Free' END AS cost FROM p"""),
    "range_price": listing_query("""SELECT id, CASE id % 6 WHEN 0 THEN '$' || (id % 40) || '-$40' WHEN 1 THEN '$12.50' WHEN 3 THEN 'Free' WHEN 5 THEN '$15' END AS price FROM listings"""),
    "locality": listing_query("SELECT id, CASE id % 8 WHEN 0 THEN 'Evanston' WHEN 1 THEN 'Naperville' END AS locality FROM listings"),
    "to_local": listing_query(f""", z AS (SELECT id, date, make_timestamp(1998, CASE WHEN id % 2 = 0 THEN 6 ELSE 12 END, 1 + id % 28, 1, 30, 0) AS wall FROM listings),
        u AS (SELECT *, CASE id % 4 WHEN 0 THEN wall WHEN 1 THEN wall - INTERVAL 330 MINUTE WHEN 2 THEN wall + INTERVAL 6 HOUR END AS utc FROM z)
        SELECT id, CASE WHEN id % 4 = 3 THEN wall ELSE utc - CASE WHEN id % 2 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 6 HOUR END END AS local,
          timezone('America/Chicago', timezone('UTC', date)) AS repaired FROM u"""),
    "infer_year": listing_query("SELECT id, CAST(CASE WHEN 1 + id % 12 < 6 THEN 1999 ELSE 1998 END AS INTEGER) AS year FROM listings"),
    "parse_date_range": dates(
        f"""id % 16 WHEN 0 THEN {on_day(1998, 10)} + CASE WHEN id % 28 < 24 THEN INTERVAL 1170 MINUTE ELSE INTERVAL 1110 MINUTE END WHEN 1 THEN {on_day(1998, 11)}
          WHEN 9 THEN {on_day(1998, 10)} WHEN 10 THEN {on_day(1998, 10)} WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 15 THEN NULL WHEN 14 THEN NULL
          WHEN 13 THEN {on_day(1998, 12)} - INTERVAL 270 MINUTE ELSE {on_day(1998, 10)}""",
        "id % 16 WHEN 2 THEN TIMESTAMP '1998-10-30' WHEN 3 THEN TIMESTAMP '1998-11-04'"),
    "run_or_single": dates(
        f"""id % 10 WHEN 0 THEN {on_day(1998, 9)} WHEN 1 THEN TIMESTAMP '1998-10-27' WHEN 2 THEN {on_day(1998, 10)} WHEN 3 THEN {on_day(1998, 11)} WHEN 4 THEN TIMESTAMP '1998-10-05'
          WHEN 5 THEN {on_day(1999, 9)} WHEN 6 THEN {on_day(1999, 2)} WHEN 7 THEN {on_day(1998, 7)}""",
        f"""id % 10 WHEN 0 THEN TIMESTAMP '1998-10-18' WHEN 1 THEN {on_day(1999, 3)} WHEN 2 THEN TIMESTAMP '1998-10-30' WHEN 3 THEN TIMESTAMP '1999-02-02' WHEN 4 THEN TIMESTAMP '1998-10-07'"""),
    "program_dates": dates(
        f"""id % 8 WHEN 0 THEN {on_day(1998, 4)} WHEN 1 THEN {on_day(1998, 10)} WHEN 2 THEN {on_day(1998, 4)} WHEN 3 THEN {on_day(1998, 11)} WHEN 4 THEN {on_day(1998, 7)} WHEN 5 THEN {on_day(1999, 2)}""",
        "id % 8 WHEN 0 THEN TIMESTAMP '1998-10-31' WHEN 2 THEN TIMESTAMP '1998-10-31' WHEN 3 THEN TIMESTAMP '1999-02-12'"),
    "session_times": listing_query(f""", b AS (SELECT id, CASE id % 6 WHEN 0 THEN {on_day(1998, 10)} WHEN 1 THEN {on_day(1998, 10)} WHEN 2 THEN {on_day(1999, 1)}
          WHEN 3 THEN TIMESTAMP '1998-06-06' WHEN 4 THEN TIMESTAMP '1999-06-05' END AS base FROM listings)
        SELECT id, base + CASE id % 5 WHEN 0 THEN INTERVAL 18 HOUR WHEN 1 THEN INTERVAL 1110 MINUTE WHEN 2 THEN INTERVAL 675 MINUTE ELSE INTERVAL 0 HOUR END AS starts,
          base + CASE id % 5 WHEN 0 THEN INTERVAL 21 HOUR WHEN 2 THEN INTERVAL 13 HOUR END AS ends FROM b"""),
    "title_from_lines": listing_query("SELECT id, CASE id % 8 WHEN 1 THEN name || ' >' WHEN 4 THEN NULL ELSE name END AS title FROM listings"),
    "source_slug": with_views(CONFIG, body="SELECT id, 'chicago_venue_rosass_' || name || '_lounge' AS source FROM venue_config"),
    "canonical_event": with_views(LISTINGS, f"""raw_rows AS (SELECT id, name, address, {norm_sql(CANON_LABEL)} AS spelled,
          CASE WHEN id % 3 = 0 THEN 'Live jazz concert' END AS hint, CASE WHEN id % 7 = 0 THEN ['Halloween', 'music'] END AS given FROM listings),
        ruled AS (SELECT *, coalesce({rule_sql('name')}, spelled) AS category FROM raw_rows)""",
        labels_ctes("ruled", "name", "category", "hint", "lab"), body=f"""
        , p AS (SELECT *, {parents_sql('coalesce(given, labels)')} AS parents FROM lab)
        SELECT id, CASE id % 8 WHEN 0 THEN 'Evanston' WHEN 1 THEN 'Naperville' END AS locality, parents[1] AS category, array_to_string(parents, '; ') AS categories,
          nullif(array_to_string({finer_sql('coalesce(given, labels)', 'parents')}, '; '), '') AS subcategories FROM p"""),
}
