"""Queries and oracles of reading landed data.

Payloads and pages are built per listing by expression; the oracles state what each of them has to come out as.
"""

from functools import reduce

from pyspark.sql import functions as F

from marquee.adapters import audit_logs, chat_messages, chat_threads, geocode_cache, listings, neighborhoods, pages_events, table, venue_config
from marquee.lineage import checkpoint_root
from marquee.sources import catalog as C
from marquee.sources import feeds as S
from marquee.sources import pages as G
from marquee.plans.joins import CACHE
from marquee.plans.views import AUDIT, CONFIG as VENUE_CONFIG, LISTINGS, NEIGHBORHOODS, PAGES, THREADS, listing_query, with_views

AS_OF = "1998-06-10 12:00:00"
D2 = "lpad(CAST(1 + id % 28 AS STRING), 2, '0')"


def _json(*parts):
    return "concat(" + ", ".join(parts) + ")"


TICKETING = _json(
    """'{"_embedded":{"events":[{"id":"T'""", "CAST(id AS STRING)", """'","name":" '""", "name", """' ","dates":{"start":'""",
    f"""CASE id % 4 WHEN 0 THEN concat('{{"localDate":"1998-06-', {D2}, '","localTime":"19:30:00","dateTime":"1998-01-01T00:00:00Z"}}')
        WHEN 1 THEN concat('{{"localDate":"1998-06-', {D2}, '"}}') WHEN 2 THEN concat('{{"dateTime":"1998-12-', {D2}, 'T01:30:00Z"}}') ELSE '{{}}' END""",
    """'}'""", """CASE id % 3 WHEN 0 THEN ',"classifications":[{"segment":{"name":"Music"},"genre":{"name":"Jazz"},"subGenre":{"name":"Undefined"}}]'
        WHEN 1 THEN ',"classifications":[{"segment":{"name":"Undefined"},"genre":{"name":"Undefined undefined"}}]' ELSE '' END""",
    """CASE WHEN id % 2 = 0 THEN ',"info":" Tickets $10-25 "' ELSE '' END""", """CASE WHEN id % 5 = 0 THEN ',"pleaseNote":"21+ only"' ELSE '' END""",
    """CASE WHEN id % 6 = 0 THEN ',"priceRanges":[{"type":"standard","min":20,"max":40.5},{"type":"resale","max":900}]' ELSE '' END""",
    """CASE WHEN id % 7 = 0 THEN concat(',"url":"http://x.example/', CAST(id AS STRING), '"') ELSE '' END""",
    """CASE WHEN id % 8 = 7 THEN '' ELSE concat(',"_embedded":{"venues":[{"name":"Hall ', CAST(id % 40 AS STRING), '","city":{"name":"Chicago"},"state":{"name":"Illinois"},"address":{"line1":"1 Main St"}',
        CASE WHEN id % 5 = 4 THEN ',"location":{"latitude":"x"}' ELSE ',"location":{"latitude":"41.5","longitude":"-87.25"}' END, '}]}') END""",
    """'},{"name":"no id","dates":{"start":{"localDate":"1998-06-01"}}}]}}'""")
CITY = _json(
    """'{"title":"'""", "name", f"""concat('","tz_adjusted_begin_date":"1998-06-', {D2}, 'T19:00:00.000Z","begin_date":"1990-01-01T00:00:00Z"')""",
    f"""CASE id % 3 WHEN 0 THEN concat(',"tz_adjusted_end_date":"1998-07-', {D2}, 'T02:00:00Z"') WHEN 1 THEN concat(',"end_date":"1998-06-', {D2}, 'T23:00:00Z"') ELSE '' END""",
    """CASE WHEN id % 2 = 0 THEN ',"category":"Film"' ELSE '' END""", """CASE WHEN id % 5 = 0 THEN ',"excerpt":"Rooftop, all ages."' ELSE '' END""",
    """',"description":"Suggested donation at 12 West Oak Ave, Chicago"'""", """CASE WHEN id % 11 = 0 THEN '' ELSE concat(',"permalink":"/e/', CAST(id AS STRING), '"') END""",
    """CASE id % 4 WHEN 0 THEN ',"is_free":true' WHEN 1 THEN ',"is_free":false' ELSE '' END""",
    """CASE id % 3 WHEN 0 THEN ',"venue":{"title":"Room","full_address":"5 Elm St","latitude":41.25,"longitude":"-87.5"}' WHEN 1 THEN ',"venue":null' ELSE '' END""", "'}'")
TICKET_SEARCH = _json(
    """'{"id":"'""", "CAST(id AS STRING)", """'","name":{"text":"'""", "name", f"""concat('"}},"start":{{"utc":"1998-06-', {D2}, 'T01:30:00Z"}}')""",
    """CASE WHEN id % 2 = 0 THEN ',"category":{"name":"Arts"},"description":{"text":" No cover tonight "}' ELSE '' END""",
    """CASE WHEN id % 3 = 0 THEN ',"venue":{"name":"Loft"},"url":"http://y.example/"' ELSE '' END""", "'}'")
ARTIST = _json(
    """'{"id":"'""", "CAST(id AS STRING)", """'"'""", """CASE WHEN id % 5 = 4 THEN '' ELSE concat(',"artist":{"name":"', name, '"}') END""",
    f"""concat(',"datetime":"1998-06-', {D2}, 'T20:00:00"')""",
    """CASE id % 3 WHEN 0 THEN ',"venue":{"name":"Barn","city":"Evanston","region":"IL"},"description":" Ticketed show "' WHEN 1 THEN ',"venue":{"city":"Berwyn"}' ELSE '' END""", "'}'")
POST = _json(
    """CASE id % 3 WHEN 0 THEN concat('{"title":{"rendered":" ', name, ' "}') WHEN 1 THEN concat('{"title":"', name, '"') ELSE '{"title":{"rendered":"ab"}' END""",
    f"""concat(',"date":"1998-06-', {D2}, 'T09:00:00"')""", """CASE WHEN id % 2 = 0 THEN ',"excerpt":{"rendered":"<p>Free&nbsp;entry</p> "}' ELSE '' END""",
    """concat(',"link":"http://blog.example/', CAST(id AS STRING), '"}')""")
CARD = _json("""'{"events_results":['""", "array_join(transform(sequence(1, CAST(1 + id % 14 AS INT)), i -> concat('{\"link\":\"http://c.example/', CAST(i AS STRING), '\"', "
             "CASE i % 3 WHEN 0 THEN ',\"title\":\"A\",\"address\":[\" Bar \",\"\",\"5 Elm St\"],\"date\":\"Jun 6\"' WHEN 1 THEN ',\"title\":\"B\",\"address\":\"9 Oak Ave\",\"snippet\":\"soon\"' "
             "ELSE ',\"displayed_link\":\"c.example\",\"type\":\"Concert\"' END, '}')), ',')", """']}'""")


def _raw(s, d, payload):
    return listings(s, d, "id", "name").select("id", F.expr(payload).alias("payload"))


# a third of the general feed's links are ones no team feed has
GENERAL_URL = "CASE WHEN position % 3 = 0 THEN concat('http://general.example/', CAST(position AS STRING)) ELSE origination_url END"


def _feeds(s, d):
    rows = listings(s, d, "id", "name", "details", "page_url").selectExpr(
        "id AS position", "name", "CASE WHEN id % 9 = 0 THEN NULL ELSE details END AS details", "page_url AS origination_url")
    teams = rows.selectExpr("position", "name", "details", "origination_url", "concat('Team ', CAST(position % 5 AS STRING)) AS team")
    return S.union_tagged_feeds(rows.withColumn("origination_url", F.expr(GENERAL_URL)), teams)


def _stored(s, d):
    """Four of the tables written and read back with their fixed schemas."""
    root = checkpoint_root(s)
    ev = listings(s, d)
    C.coerce_table(ev, "events").write.parquet(f"{root}/events")
    C.coerce_table(neighborhoods(s, d), "neighborhoods").write.parquet(f"{root}/neighborhoods")
    return C.read_table(s, root, "events").join(
        C.read_table(s, root, "neighborhoods").selectExpr("id AS neighborhood_id", "name AS neighborhood"), "neighborhood_id", "left").select(
        "id", "name", "date", "date_end", "cost", "latitude", "neighborhood", F.array_join("categories", "; ").alias("categories"))


def _loose(s, d):
    """The tables as a loosely typed database hands them out: everything text."""
    ev = listings(s, d, "id", "name", "date", "date_end", "cost", "latitude", "neighborhood_id", "categories").selectExpr(
        "CAST(id AS STRING) AS id", "name", "CASE id % 3 WHEN 0 THEN date_format(date, 'yyyy-MM-dd') WHEN 1 THEN date_format(date, 'yyyy-MM-dd HH:mm:ss') ELSE date_format(date, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END AS date",
        "CASE WHEN id % 2 = 0 THEN 'unknown' END AS date_end", "cost", "CAST(latitude AS STRING) AS latitude", "neighborhood_id", "to_json(categories) AS categories")
    logs = audit_logs(s, d).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return {"events": ev, "audit_logs": logs, "neighborhoods": neighborhoods(s, d)}


def _copied(s, d):
    root = checkpoint_root(s)
    C.copy_tables(s, _loose(s, d), root)
    return C.read_table(s, root, "events").select("id", "date", "date_end", "latitude", F.array_join("categories", "; ").alias("categories"))


# All eight tables as text, with values here and there that are not of the declared type, and some references that lead nowhere.
LOOSE = {
    "neighborhoods": "CAST(id AS STRING) AS id, name, region AS description",
    "venues": """CAST(id AS STRING) AS id, CAST(CASE WHEN id % 8 = 0 THEN id + 5000 ELSE id % 25 END AS STRING) AS neighborhood_id, venue_name AS name, category,
        CASE WHEN id % 10 = 3 THEN 'about 200' ELSE CAST(id * 3 AS STRING) END AS capacity, CASE WHEN id % 6 = 0 THEN 'maybe' WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS is_active""",
    "geocode_cache": "CAST(id AS STRING) AS id, query, CASE WHEN id % 9 = 0 THEN '41,5' ELSE CAST(latitude AS STRING) END AS latitude, CAST(longitude AS STRING) AS longitude, CAST(resolved AS STRING) AS resolved",
    "events": """CAST(id AS STRING) AS id, name, CASE WHEN id % 11 = 0 THEN 'next Friday' ELSE date_format(date, 'yyyy-MM-dd HH:mm:ss') END AS date, cost,
        CAST(CASE WHEN id % 40 = 0 THEN 9000 + id % 3 ELSE neighborhood_id END AS STRING) AS neighborhood_id, to_json(categories) AS categories""",
    "chat_threads": "CAST(id AS STRING) AS id, date_format(updated_at, 'yyyy-MM-dd') AS updated_at, CASE WHEN id % 7 = 0 THEN '1e' ELSE CAST(total_tokens AS STRING) END AS total_tokens, status",
    "chat_messages": "CAST(id AS STRING) AS id, CAST(thread_id AS STRING) AS thread_id, role, content, CASE WHEN id % 19 = 0 THEN '?' ELSE CAST(token_count AS STRING) END AS token_count, date_format(created_at, 'yyyy-MM-dd HH:mm:ss') AS created_at",
    "audit_logs": "CAST(id AS STRING) AS id, CAST(thread_id AS STRING) AS thread_id, operation, CASE WHEN id % 13 = 0 THEN 'n/a' ELSE CAST(duration_ms AS STRING) END AS duration_ms, CASE WHEN id % 5 = 0 THEN 'now' ELSE date_format(created_at, 'yyyy-MM-dd HH:mm:ss') END AS created_at",
    "metrics": "CAST(id AS STRING) AS id, operation AS metric_name, CASE WHEN id % 17 = 0 THEN '-' ELSE CAST(duration_ms AS STRING) END AS value, date_format(created_at, 'yyyy-MM-dd HH:mm:ss') AS timestamp",
}


def _loose_catalog(s, d):
    ev = listings(s, d, "id", "name", "date", "cost", "neighborhood_id", "categories")
    whole = {"neighborhoods": neighborhoods(s, d), "venues": venue_config(s, d), "geocode_cache": geocode_cache(s, d), "events": ev,
             "chat_threads": chat_threads(s, d), "chat_messages": chat_messages(s, d), "audit_logs": audit_logs(s, d), "metrics": audit_logs(s, d)}
    return {name: whole[name].selectExpr(*_split(text)) for name, text in LOOSE.items()}


def _split(text):
    """The columns of a select list; commas inside brackets and quotes stay."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [part.strip() for part in out]


def _land(s, d):
    root = checkpoint_root(s)
    for name, rows in _loose_catalog(s, d).items():
        rows.write.parquet(f"{root}/{name}")
    return root


def _read_back(s, d):
    """All eight tables through the reader: rows, and rows that have an id and the values named, per table."""
    tables = C.read_catalog(s, _land(s, d))
    told = {"neighborhoods": "name", "venues": "capacity", "geocode_cache": "latitude", "events": "date", "chat_threads": "total_tokens",
            "chat_messages": "token_count", "audit_logs": "created_at", "metrics": "value"}
    return reduce(lambda a, b: a.unionAll(b), [tables[name].agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.count("id").alias("ids"), F.count(c).alias("values"))
                                               for name, c in told.items()])


def _rejected(s, d):
    return C.read_rejected(s, _land(s, d)).groupBy("table", "column").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min(F.col("id").cast("bigint")).alias("first_id"))


def _copied_whole(s, d):
    """Children named first; rows without a parent are copied with the rest here, `catalog_orphans` reports them."""
    loose = _loose_catalog(s, d)
    return C.copy_tables(s, {name: loose[name] for name in reversed(loose)}, checkpoint_root(s), keep_orphans=True)


def _orphans(s, d):
    return C.orphans({name: C.coerce_table(rows, name) for name, rows in _loose_catalog(s, d).items()})


def _written(s, d):
    path = f"{checkpoint_root(s)}/events"
    C.write_catalog(listings(s, d, "id", "name", "date"), path)
    return s.read.parquet(path).groupBy("event_month").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn(
        "event_month", F.col("event_month").cast("string"))


CONFIG = """SELECT concat('s', CAST(id AS STRING)) AS source, concat('Venue ', CAST(id AS STRING)) AS name, concat(CAST(id AS STRING), ' Elm St') AS address,
    'music' AS category, concat('http://v', CAST(id AS STRING), '.example/') AS website FROM range(5)"""


def _config(s):
    return s.sql(CONFIG)


JSONLD = """concat('<html><script type="application/ld+json">', CASE page_id % 5 WHEN 0 THEN concat('{"@type":"Event","name":" Show ', CAST(page_id AS STRING), '! ","startDate":"1998-06-10T01:30:00Z","endDate":"1998-06-11","offers":{"price":"0","highPrice":"40"}}')
    WHEN 1 THEN concat('{"@context":"x","@graph":[{"@type":"WebPage","name":"home"},{"@type":"Event","name":"Graph","url":"http://u.example/", "startDate":"1998-06-10T19:30:00-05:00","offers":[{"price":20},{"price":"25.50"}]}]}')
    WHEN 2 THEN '[{"@type":"Event","name":"A"},{"@type":"Event","name":"First"},{"@type":"Event","name":"Second","startDate":"soon"}]'
    WHEN 3 THEN '{"@type":"Place","name":"Barn","Events":[{"@type":"Event","name":"In Place","startDate":"1998-06-12"},{"@type":"Thing","name":"Not"}]}' ELSE 'not json' END, '</script><p>x</p></html>')"""
STATE = """concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"a":[{"b":{"__typename":"Event","name":" Night ', CAST(page_id AS STRING), ' ","status":"', CASE page_id % 4 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'CANCELED' WHEN 2 THEN '' ELSE 'active' END,
    '","eventDate":{"date":{"isoDateTime":"1998-06-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), CASE WHEN page_id % 2 = 0 THEN 'T20:30:00-05:00' ELSE 'T00:00:00' END, '"}},"ticketPriceRange":{"min":{"major":', CAST(page_id % 30 AS STRING), '}',
    CASE WHEN page_id % 3 = 0 THEN ',"max":{"major":45.5}' ELSE '' END, '}}},{"__typename":"Event","name":"night ', CAST(page_id AS STRING), '","eventDate":{"date":{"localDate":"1998-06-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), '"}}},{"__typename":"Event","name":"undated"}]}}}</script>')"""
LINKS = """concat('<a class="x" href="/events/1998/01/05/old/">An old one</a><a href="/events/2099/06/', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), '/x/"><img src="i"></a><a href="/events/2099/06/', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'),
    '/x/">Night <b>', CAST(page_id AS STRING), '</b> &amp; day</a><a href="/events/2099/06/', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), '/x/">Read more</a><a href="http://o.example/events/2099-07-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'),
    '">Other night</a><a href="http://o.example/events/2099-07-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), '">OTHER NIGHT</a><a href="/events/2099/13/40/">No such day</a><a href="/about">About us</a>')"""
TIMES = """concat('<ul><li class="event"><time datetime="14:00">2pm</time><time datetime="1998-06-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), 'T19:00">Jun</time><h3><a href="/e/', CAST(page_id AS STRING), '">Gig ', CAST(page_id AS STRING), '</a></h3><p>7:30 p.m. $',
    CAST(1 + page_id % 50 AS STRING), '</p></li><li class="event event--past"><time datetime="1998-06-01">x</time><h3>Gone</h3></li><li><h3>No date</h3></li></ul><article><time datetime="1998-07-01">July</time><p class="my-event-title">Fair</p> Free</article>')"""
BLOCKS = """concat('<div class="list"><div class="card"><div>Fri, Jul ', CAST(1 + page_id % 28 AS STRING), '</div><h4>Concert ', CAST(page_id AS STRING), '</h4><span>7:30 p.m. $15</span><a href="/e/', CAST(page_id AS STRING), '">Tickets</a></div>',
    '<div class="picker"><select><option>Jul 4</option></select> Some picker text</div><li>SUMMER FAIRAug 1-Aug 9Buy tickets</li><li>Read more about Jul 5</li></div><script>var a = "Jul 6 Something";</script>')"""
MEETING = """concat('<h1>Home</h1><h2>NEXT EVENT Group ', CAST(page_id AS STRING), ' Meeting</h2><p><b>When:</b> ', CASE WHEN page_id % 3 = 0 THEN 'to be told' ELSE concat('Oct. ', CAST(1 + page_id % 28 AS STRING), ', 1998, 6:15 p.m.') END,
    '</p><p><b>Where:</b> <i>Big Co</i><br>200 N. LaSalle<br>Floor 9<br>Topics:<br>things</p>')"""


def _pages(s, d, html):
    return table(s, d, "orders").selectExpr("o_orderkey AS page_id").selectExpr(
        "page_id", "concat('http://site', CAST(page_id % 5 AS STRING), '.example/p/', CAST(page_id AS STRING)) AS url",
        "concat('s', CAST(page_id % 5 AS STRING)) AS source", f"{html} AS html")


def _by_reader(s, d):
    html = f"CASE page_id % 5 WHEN 0 THEN {JSONLD} WHEN 1 THEN {STATE} WHEN 2 THEN {LINKS} WHEN 3 THEN {TIMES} ELSE {BLOCKS} END"
    reader = "CASE source WHEN 's0' THEN 'jsonld' WHEN 's1' THEN 'embedded_state' WHEN 's2' THEN 'dated_links' WHEN 's3' THEN 'time_tags' ELSE 'dated_blocks' END"
    return G.read_pages(_pages(s, d, html), _config(s).withColumn("reader", F.expr(reader)), AS_OF)


GEOJSON = """concat('{"type":"FeatureCollection","features":[{"properties":{"pri_neigh":"Area ', CAST(id % 40 AS STRING), '"},"geometry":{"type":"Polygon","coordinates":[[[',
    CAST(id % 9 AS STRING), ',0],[9.5,0],[9.5,2]],[[1,1],[2,1],[2,2]]]}},{"properties":{"name":"Twin"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,', CAST(id % 7 AS STRING), ']]]]}},{"properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')"""


def _geojson(s, d):
    rows = S.flatten_geojson(_raw(s, d, GEOJSON).withColumnRenamed("id", "source_id"))
    total = F.aggregate(F.flatten(F.flatten("polygons")), F.lit(0.0), lambda a, p: a + p["x"] + p["y"])
    return rows.select("source_id", "ord", "name", F.size("polygons").alias("parts"), F.size(F.flatten("polygons")).alias("rings"), total.alias("total"))


QUERIES = {
    "flatten_geojson": _geojson,
    "read_catalog": _stored,
    "read_whole_catalog": _read_back,
    "catalog_rejects": _rejected,
    "copy_catalog": _copied_whole,
    "catalog_orphans": _orphans,
    "copy_tables": lambda s, d: C.copy_tables(s, _loose(s, d), checkpoint_root(s)),
    "coerce_table": _copied,
    "flatten_ticketing_api": lambda s, d: S.flatten_ticketing_api(_raw(s, d, TICKETING)),
    "union_tagged_feeds": _feeds,
    "flatten_city_api": lambda s, d: S.flatten_city_api(_raw(s, d, CITY)),
    "flatten_ticket_search_api": lambda s, d: S.flatten_ticket_search_api(_raw(s, d, TICKET_SEARCH)),
    "flatten_artist_api": lambda s, d: S.flatten_artist_api(_raw(s, d, ARTIST)),
    "flatten_blog_posts": lambda s, d: S.flatten_blog_posts(_raw(s, d, POST)),
    "flatten_search_cards": lambda s, d: S.flatten_search_cards(_raw(s, d, CARD).withColumnRenamed("id", "query_id")),
    "pages_jsonld_events": lambda s, d: G.pages_jsonld_events(_pages(s, d, JSONLD), _config(s)),
    "pages_embedded_state_events": lambda s, d: G.pages_embedded_state_events(_pages(s, d, STATE)),
    "pages_dated_links": lambda s, d: G.pages_dated_links(_pages(s, d, LINKS), "2000-01-01 00:00:00"),
    "pages_time_tag_events": lambda s, d: G.pages_time_tag_events(_pages(s, d, TIMES)),
    "pages_dated_blocks": lambda s, d: G.pages_dated_blocks(_pages(s, d, BLOCKS), _config(s), AS_OF),
    "pages_labelled_meeting": lambda s, d: G.pages_labelled_meeting(_pages(s, d, MEETING), _config(s)),
    "read_pages": _by_reader,
    "page_visible_text": lambda s, d: G.page_visible_text(table(s, d, "pages")).select("page_id", "text"),
    "landed_page_text": lambda s, d: G.page_visible_text(pages_events(s, d)).select("page_id", "text"),
    "write_catalog": _written,
}

DAY = "1 + id % 28"
PDAY = "1 + page_id % 28"
SITE = "'http://site' || (page_id % 5) || '.example'"
PAGED = "p AS (SELECT o_orderkey AS page_id FROM orders)"
VENUE = "'Venue ' || (page_id % 5)"
PLACE = "'Venue ' || (page_id % 5) || ', ' || (page_id % 5) || ' Elm St'"


def _visible(html):
    text = html
    for tag in ("script", "style", "noscript", "nav", "footer", "svg"):
        text = f"regexp_replace({text}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#039;", "''"), ("&rsquo;", "’"),
                         ("&ndash;", "–"), ("&mdash;", "—"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({text}, '[\s\x{{a0}}]+', ' ', 'g'))"


def _reader_sql():
    """The readers' own oracles, each on the pages its source's reader is given."""
    names = {"jsonld": "pages_jsonld_events", "embedded_state": "pages_embedded_state_events", "dated_links": "pages_dated_links",
             "time_tags": "pages_time_tag_events", "dated_blocks": "pages_dated_blocks"}
    return " UNION ALL ".join(f"SELECT page_id, name, date, url, '{reader}' AS reader FROM ({ORACLES[query]}) WHERE page_id % 5 = {i}"
                              for i, (reader, query) in enumerate(names.items()))


_INFO = """concat_ws(' | ', CASE WHEN id % 2 = 0 THEN 'Tickets $10-25' END, CASE WHEN id % 5 = 0 THEN 'Note: 21+ only' END,
    CASE WHEN id % 8 <> 7 THEN 'Venue: Hall ' || (id % 40) || ' | Location: Chicago, Illinois' END)"""

EIGHT = (LISTINGS, AUDIT, NEIGHBORHOODS, VENUE_CONFIG, CACHE, THREADS)

ORACLES = {
    "flatten_geojson": listing_query("""SELECT id AS source_id, 0 AS ord, 'Area ' || (id % 40) AS name, 1 AS parts, 2 AS rings, CAST(id % 9 + 30 AS DOUBLE) AS total FROM listings
        UNION ALL SELECT id, 1, 'Twin', 2, 2, CAST(3 + 27 + id % 7 AS DOUBLE) FROM listings UNION ALL SELECT id, 2, NULL, NULL, NULL, NULL FROM listings"""),
    "read_catalog": listing_query("""SELECT l.id, l.name, date, date_end, cost, latitude, n.name AS neighborhood, array_to_string(categories, '; ') AS categories
        FROM listings l LEFT JOIN neighborhoods n ON n.id = l.neighborhood_id""", NEIGHBORHOODS),
    "read_whole_catalog": with_views(*EIGHT, body="""SELECT 'neighborhoods' AS "table", count(*) AS n, count(id) AS ids, count(name) AS values FROM neighborhoods
        UNION ALL SELECT 'venues', count(*), count(id), count(*) FILTER (id % 10 <> 3) FROM venue_config
        UNION ALL SELECT 'geocode_cache', count(*), count(id), count(latitude) FILTER (id % 9 <> 0) FROM geocode_cache
        UNION ALL SELECT 'events', count(*), count(id), count(date) FILTER (id % 11 <> 0) FROM listings
        UNION ALL SELECT 'chat_threads', count(*), count(id), count(*) FILTER (id % 7 <> 0) FROM chat_threads
        UNION ALL SELECT 'chat_messages', count(*), count(id), count(*) FILTER (id % 19 <> 0) FROM chat_messages
        UNION ALL SELECT 'audit_logs', count(*), count(id), count(*) FILTER (id % 5 <> 0) FROM audit_logs
        UNION ALL SELECT 'metrics', count(*), count(id), count(duration_ms) FILTER (id % 17 <> 0) FROM audit_logs"""),
    "catalog_rejects": with_views(*EIGHT, body="""SELECT * FROM (
        SELECT 'venues' AS "table", 'capacity' AS "column", count(*) AS n, 'about 200' AS text, min(id) AS first_id FROM venue_config WHERE id % 10 = 3
        UNION ALL SELECT 'venues', 'is_active', count(*), 'maybe', min(id) FROM venue_config WHERE id % 6 = 0
        UNION ALL SELECT 'geocode_cache', 'latitude', count(*), '41,5', min(id) FROM geocode_cache WHERE id % 9 = 0
        UNION ALL SELECT 'events', 'date', count(*), 'next Friday', min(id) FROM listings WHERE id % 11 = 0
        UNION ALL SELECT 'chat_threads', 'total_tokens', count(*), '1e', min(id) FROM chat_threads WHERE id % 7 = 0
        UNION ALL SELECT 'chat_messages', 'token_count', count(*), '?', min(id) FROM chat_messages WHERE id % 19 = 0
        UNION ALL SELECT 'audit_logs', 'duration_ms', count(*), 'n/a', min(id) FROM audit_logs WHERE id % 13 = 0
        UNION ALL SELECT 'audit_logs', 'created_at', count(*), 'now', min(id) FROM audit_logs WHERE id % 5 = 0
        UNION ALL SELECT 'metrics', 'value', count(*), '-', min(id) FROM audit_logs WHERE id % 17 = 0) WHERE n > 0"""),
    "copy_catalog": with_views(*EIGHT, body=" UNION ALL ".join(
        f"""SELECT '{name}' AS "table", count(*) AS source_rows, count(*) AS copied_rows FROM {rel}""" for name, rel in {
            "neighborhoods": "neighborhoods", "venues": "venue_config", "geocode_cache": "geocode_cache", "events": "listings", "chat_threads": "chat_threads",
            "chat_messages": "chat_messages", "audit_logs": "audit_logs", "metrics": "audit_logs"}.items())),
    "catalog_orphans": with_views(*EIGHT, body="""SELECT 'venues' AS "table", 'neighborhood_id' AS "column", 'neighborhoods' AS parent, count(*) AS rows, count(DISTINCT id) AS missing, min(CAST(id + 5000 AS VARCHAR)) AS example FROM venue_config WHERE id % 8 = 0
        UNION ALL SELECT 'events', 'neighborhood_id', 'neighborhoods', count(*), count(DISTINCT id % 3), min(CAST(9000 + id % 3 AS VARCHAR)) FROM listings WHERE id % 40 = 0
        UNION ALL SELECT 'events', 'venue_id', 'venues', 0, 0, NULL
        UNION ALL SELECT 'chat_messages', 'thread_id', 'chat_threads', 0, 0, NULL
        UNION ALL SELECT 'audit_logs', 'thread_id', 'chat_threads', count(*), count(DISTINCT thread_id), min(CAST(thread_id AS VARCHAR)) FROM audit_logs WHERE thread_id NOT IN (SELECT id FROM chat_threads)"""),
    "copy_tables": with_views(LISTINGS, AUDIT, NEIGHBORHOODS, body="""SELECT 'events' AS "table", count(*) AS source_rows, count(*) AS copied_rows FROM listings
        UNION ALL SELECT 'audit_logs', count(*), count(*) FROM audit_logs UNION ALL SELECT 'neighborhoods', count(*), count(*) FROM neighborhoods"""),
    "coerce_table": listing_query("SELECT id, date, CAST(NULL AS TIMESTAMP) AS date_end, latitude, array_to_string(categories, '; ') AS categories FROM listings"),
    "flatten_ticketing_api": listing_query(f"""SELECT trim(name) AS name,
        CASE id % 4 WHEN 0 THEN make_timestamp(1998, 6, {DAY}, 19, 30, 0) WHEN 1 THEN make_timestamp(1998, 6, {DAY}, 0, 0, 0) ELSE make_timestamp(1998, 12, {DAY}, 1, 30, 0) - INTERVAL 6 HOUR END AS date,
        CASE WHEN id % 3 = 0 THEN 'Music' ELSE 'Other' END AS category, CASE WHEN id % 3 = 0 THEN 'Jazz' END AS category_hint, nullif({_INFO}, '') AS details,
        CASE WHEN id % 7 = 0 THEN 'http://x.example/' || id ELSE 'https://tickets.example/event/T' || id END AS origination_url,
        CASE WHEN id % 8 <> 7 THEN 'Hall ' || (id % 40) END AS venue_name, CASE WHEN id % 8 <> 7 THEN '1 Main St, Chicago, Illinois' END AS address,
        CASE WHEN id % 8 <> 7 AND id % 5 <> 4 THEN 41.5 END::DOUBLE AS latitude, CASE WHEN id % 8 <> 7 AND id % 5 <> 4 THEN -87.25 END::DOUBLE AS longitude,
        CASE WHEN id % 6 = 0 THEN '$20-$40.50' WHEN id % 2 = 0 THEN '$10-25' END AS cost, CASE WHEN id % 5 = 0 THEN '21+' END AS age_range
        FROM listings WHERE id % 4 <> 3"""),
    "union_tagged_feeds": listing_query("""SELECT position, name, details, origination_url FROM (SELECT *, row_number() OVER (PARTITION BY origination_url ORDER BY feed, position) AS rn FROM (
        SELECT id AS position, name, CASE WHEN id % 9 = 0 THEN NULL ELSE details END AS details,
          CASE WHEN id % 3 = 0 THEN 'http://general.example/' || id ELSE page_url END AS origination_url, 0 AS feed FROM listings
        UNION ALL SELECT id, name, CASE WHEN id % 9 = 0 THEN 'Team ' || (id % 5) ELSE 'Team ' || (id % 5) || ' | ' || details END, page_url, 1 FROM listings)) WHERE rn = 1"""),
    "flatten_city_api": listing_query(f"""SELECT name, make_timestamp(1998, 6, {DAY}, 19, 0, 0) AS date, CASE WHEN id % 3 = 0 THEN make_timestamp(1998, 7, {DAY}, 2, 0, 0) END AS date_end,
        CASE WHEN id % 2 = 0 THEN 'Film' ELSE 'Other' END AS category, CASE WHEN id % 5 = 0 THEN 'Rooftop, all ages. ' ELSE '' END || 'Suggested donation at 12 West Oak Ave, Chicago' AS details,
        'https://city.example/e/' || id AS origination_url, CASE WHEN id % 3 = 0 THEN 41.25 END::DOUBLE AS latitude, CASE WHEN id % 3 = 0 THEN -87.5 END::DOUBLE AS longitude,
        CASE WHEN id % 5 = 0 THEN 'outdoor' END AS is_outdoor, CASE WHEN id % 3 = 0 THEN 'Room' END AS venue_name, CASE WHEN id % 3 = 0 THEN '5 Elm St' ELSE '12 West Oak Ave' END AS address,
        CASE WHEN id % 4 = 0 THEN 'Free' ELSE 'Donation' END AS cost, CASE WHEN id % 5 = 0 THEN 'All ages' END AS age_range FROM listings WHERE id % 11 <> 0"""),
    "flatten_ticket_search_api": listing_query(f"""SELECT name, make_timestamp(1998, 6, {DAY}, 1, 30, 0) AS date, CASE WHEN id % 2 = 0 THEN 'Arts' ELSE 'Other' END AS category,
        nullif(concat_ws(' | ', CASE WHEN id % 2 = 0 THEN 'No cover tonight' END, CASE WHEN id % 3 = 0 THEN 'Venue: Loft' END), '') AS details,
        CASE WHEN id % 3 = 0 THEN 'http://y.example/' ELSE 'https://search.example/e/' || id END AS origination_url, CAST(NULL AS VARCHAR) AS cost, CAST(NULL AS VARCHAR) AS age_range FROM listings"""),
    "flatten_artist_api": listing_query(f"""SELECT name || CASE id % 3 WHEN 0 THEN ' at Barn' WHEN 1 THEN ' at Unknown Venue' ELSE '' END AS name, make_timestamp(1998, 6, {DAY}, 20, 0, 0) AS date, 'Music' AS category,
        CASE id % 3 WHEN 0 THEN 'Venue: Barn | Location: Evanston, IL | Ticketed show' WHEN 1 THEN 'Location: Berwyn' END AS details, 'https://artists.example/e/' || id AS origination_url,
        CASE WHEN id % 3 = 0 THEN 'Paid' END AS cost, CAST(NULL AS VARCHAR) AS age_range FROM listings WHERE id % 5 <> 4"""),
    "flatten_blog_posts": listing_query(f"""SELECT name, make_timestamp(1998, 6, {DAY}, 9, 0, 0) AS date, 'Events' AS category, CASE WHEN id % 2 = 0 THEN 'Free entry' END AS details,
        'http://blog.example/' || id AS origination_url, CASE WHEN id % 2 = 0 THEN 'Free' END AS cost, CAST(NULL AS VARCHAR) AS age_range FROM listings WHERE id % 3 <> 2"""),
    "flatten_search_cards": listing_query("""SELECT id AS query_id, CAST(i - 1 AS INTEGER) AS position, CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Untitled' END AS title,
        CASE i % 3 WHEN 0 THEN 'Jun 6' WHEN 1 THEN 'soon' END AS date, CASE i % 3 WHEN 0 THEN 'Bar, 5 Elm St' WHEN 1 THEN '9 Oak Ave' ELSE 'c.example' END AS location,
        CASE WHEN i % 3 = 0 THEN 'Bar' END AS venue, 'http://c.example/' || i AS url, CASE WHEN i % 3 = 2 THEN 'Concert' END AS type_hint
        FROM (SELECT id, unnest(range(1, 1 + id % 14 + 1)) AS i FROM listings)"""),
    "pages_jsonld_events": with_views(PAGED, body=f"""
        , e AS (SELECT *, 0 AS item, 0 AS place, 'Show ' || page_id || '!' AS name, TIMESTAMP '1998-06-09 20:30:00' AS date, TIMESTAMP '1998-06-11' AS date_end, 'http://v0.example#show-' || page_id AS url, '$0-$40' AS cost FROM p WHERE page_id % 5 = 0
          UNION ALL SELECT *, 1, 0, 'Graph', TIMESTAMP '1998-06-10 19:30:00', NULL, 'http://u.example/', '$20-$25.50' FROM p WHERE page_id % 5 = 1
          UNION ALL SELECT *, 1, 0, 'First', NULL, NULL, 'http://v2.example#first', NULL FROM p WHERE page_id % 5 = 2
          UNION ALL SELECT *, 2, 0, 'Second', NULL, NULL, 'http://v2.example#second', NULL FROM p WHERE page_id % 5 = 2
          UNION ALL SELECT *, 0, 0, 'In Place', TIMESTAMP '1998-06-12', NULL, 'http://v3.example/', NULL FROM p WHERE page_id % 5 = 3)
        SELECT page_id, 0 AS block, item, place, name, date, date_end, {PLACE} AS location, url, {VENUE} AS venue_name, 'music' AS category, cost FROM e"""),
    "pages_embedded_state_events": with_views(PAGED, body=f"""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS position,
        CASE WHEN page_id % 4 = 1 THEN 'night ' ELSE 'Night ' END || page_id AS name, make_timestamp(1998, 6, {PDAY}, 0, 0, 0) AS date, {SITE} || '/p/' || page_id AS url,
        CASE WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 3 = 0 THEN '$' || (page_id % 30) || '-$45.5' WHEN page_id % 30 = 0 THEN 'Free' ELSE 'From $' || (page_id % 30) END AS cost,
        CASE WHEN page_id % 2 = 0 THEN '8:30 PM' END AS time FROM p"""),
    "pages_dated_links": with_views(PAGED, body=f"""SELECT page_id, 2 AS position, 'Night ' || page_id || ' & day' AS name, make_timestamp(2099, 6, {PDAY}, 0, 0, 0) AS date,
        {SITE} || '/events/2099/06/' || lpad(CAST({PDAY} AS VARCHAR), 2, '0') || '/x/' AS url FROM p
        UNION ALL SELECT page_id, 4, 'Other night', make_timestamp(2099, 7, {PDAY}, 0, 0, 0), 'http://o.example/events/2099-07-' || lpad(CAST({PDAY} AS VARCHAR), 2, '0') FROM p"""),
    "pages_time_tag_events": with_views(PAGED, body=f"""SELECT page_id, 0 AS position, 'Gig ' || page_id AS name, make_timestamp(1998, 6, {PDAY}, 0, 0, 0) AS date, '2PM' AS time, '$' || (1 + page_id % 50) AS cost, {SITE} || '/e/' || page_id AS url FROM p
        UNION ALL SELECT page_id, 3, 'Fair', TIMESTAMP '1998-07-01', NULL, 'Free', {SITE} || '/p/' || page_id FROM p"""),
    "pages_dated_blocks": with_views(PAGED, body=f"""SELECT page_id, 1 AS position, 'Concert ' || page_id AS name, make_timestamp(1998, 7, {PDAY}, 0, 0, 0) AS date, CAST(NULL AS TIMESTAMP) AS date_end, '7:30 PM' AS time,
          {PLACE} AS location, {SITE} || '/e/' || page_id AS url, {VENUE} AS venue_name, 'music' AS category, '$15' AS cost FROM p
        UNION ALL SELECT page_id, 3, 'SUMMER FAIR', TIMESTAMP '1998-08-01', TIMESTAMP '1998-08-09', NULL, {PLACE}, {SITE} || '/p/' || page_id, {VENUE}, 'music', NULL FROM p"""),
    "pages_labelled_meeting": with_views(PAGED, body=f"""SELECT page_id, 'Group ' || page_id || ' Meeting' AS name, make_timestamp(1998, 10, {PDAY}, 0, 0, 0) AS date, '6:15 PM' AS time,
        'Big Co, 200 N. LaSalle Floor 9' AS location, {SITE} || '/p/' || page_id AS url, 'Big Co' AS venue_name, 'music' AS category FROM p WHERE page_id % 3 <> 0"""),
    "page_visible_text": f"SELECT page_id, {_visible('html')} AS text FROM pages",
    "landed_page_text": with_views(PAGES, body="SELECT page_id, 'Show ' || page_id || ' Tickets: $' || (page_id % 40) AS text FROM pages_events"),
    "write_catalog": listing_query("SELECT coalesce(strftime(date, '%Y-%m'), 'undated') AS event_month, count(*) AS n, min(id) AS first_id FROM listings GROUP BY 1"),
}
ORACLES["read_pages"] = _reader_sql()
