"""Landed API payloads flattened to listings.

Each function takes (payload STRING) rows of raw JSON with an explicit schema, so a field the source adds or drops
never changes the result's shape. Site addresses that complete a relative link are arguments.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import iso_local
from marquee.functions.enrichment import (extract_address, extract_age, extract_cost, extract_setting, extract_venue,
                                          name_and_details)
from marquee.functions.money import range_price
from marquee.functions.text import blank_as_null, each, keep_present
from marquee.operators.ordering import top_rows

TICKETING = """STRUCT<_embedded: STRUCT<events: ARRAY<STRUCT<id: STRING, name: STRING, url: STRING, info: STRING, pleaseNote: STRING,
  dates: STRUCT<start: STRUCT<localDate: STRING, localTime: STRING, dateTime: STRING>>,
  classifications: ARRAY<STRUCT<segment: STRUCT<name: STRING>, genre: STRUCT<name: STRING>, subGenre: STRUCT<name: STRING>>>,
  priceRanges: STRING, _embedded: STRUCT<venues: ARRAY<STRUCT<name: STRING, city: STRUCT<name: STRING>, state: STRUCT<name: STRING>,
    address: STRUCT<line1: STRING>, location: STRUCT<latitude: STRING, longitude: STRING>>>>>>>>"""
CITY = """STRUCT<title: STRING, tz_adjusted_begin_date: STRING, begin_date: STRING, tz_adjusted_end_date: STRING, end_date: STRING,
  category: STRING, excerpt: STRING, description: STRING, permalink: STRING, is_free: BOOLEAN,
  venue: STRUCT<title: STRING, full_address: STRING, address: STRING, latitude: STRING, longitude: STRING>>"""
TICKET_SEARCH = """STRUCT<id: STRING, name: STRUCT<text: STRING>, start: STRUCT<utc: STRING>, category: STRUCT<name: STRING>,
  description: STRUCT<text: STRING>, url: STRING, venue: STRUCT<name: STRING>>"""
ARTIST = """STRUCT<id: STRING, artist: STRUCT<name: STRING>, datetime: STRING, description: STRING, url: STRING,
  venue: STRUCT<name: STRING, city: STRING, region: STRING>>"""
POST = "STRUCT<title: STRING, date: STRING, excerpt: STRING, link: STRING>"
CARDS = """STRUCT<events_results: ARRAY<STRUCT<title: STRING, date: STRING, snippet: STRING, address: STRING, displayed_link: STRING,
  link: STRING, type: STRING>>>"""


def _text(c) -> Column:
    """A present, non-empty text."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _trimmed(c) -> Column:
    return F.trim(_text(c))


def _labelled(label: str, c) -> Column:
    return F.concat(F.lit(f"{label}: "), _text(c))


def _place(city, state) -> Column:
    """"city, state", or the one that is there."""
    return F.nullif(F.concat_ws(", ", _text(city), _text(state)), F.lit(""))


def _joined(*parts: Column, by: str = " | ") -> Column:
    return F.nullif(F.concat_ws(by, *parts), F.lit(""))


def _meaningful(c) -> Column:
    """A classification level's name, null when it is a placeholder."""
    clean = blank_as_null(c)
    return F.when(F.trim(F.replace(F.lower(clean), F.lit("undefined"), F.lit(""))) != "", clean)


def _priced(df: DataFrame, cost=None) -> DataFrame:
    """Price and age from the text, a price the payload states outright first."""
    text = extract_cost("name", "details")
    return df.withColumns({"cost": F.coalesce(cost, text) if cost is not None else text,
                           "age_range": extract_age("name", "details")})


def flatten_ticketing_api(raw: DataFrame, event_url: str = "https://tickets.example/event/") -> DataFrame:
    body = F.from_json("payload", TICKETING)
    e = each(raw, [], body["_embedded"]["events"])
    start = F.col("e.dates.start")
    local = iso_local(F.concat(_text(start["localDate"]), F.lit("T"), F.coalesce(_text(start["localTime"]), F.lit("00:00:00"))))
    first, venue = F.get("e.classifications", F.lit(0)), F.get("e._embedded.venues", F.lit(0))
    note = _labelled("Note", _trimmed("e.pleaseNote"))
    rows = e.select(
        F.col("e.id").alias("source_id"), F.trim("e.name").alias("name"),
        F.coalesce(local, iso_local(start["dateTime"])).alias("date"),
        F.coalesce(_meaningful(first["segment"]["name"]), F.lit("Other")).alias("category"),
        _joined(_meaningful(first["genre"]["name"]), _meaningful(first["subGenre"]["name"]), by=" ").alias("category_hint"),
        _joined(_trimmed("e.info"), note, _labelled("Venue", venue["name"]),
                _labelled("Location", _place(venue["city"]["name"], venue["state"]["name"]))).alias("details"),
        F.coalesce(_text("e.url"), F.concat(F.lit(event_url), F.col("e.id"))).alias("origination_url"),
        venue["name"].alias("venue_name"),
        _joined(_text(venue["address"]["line1"]), _text(venue["city"]["name"]), _text(venue["state"]["name"]), by=", ").alias("address"),
        venue["location"]["latitude"].try_cast("double").alias("_lat"),
        venue["location"]["longitude"].try_cast("double").alias("_lon"), F.col("e.priceRanges").alias("_ranges"))
    both = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    rows = keep_present(rows.where((F.col("name") != "") & (F.col("source_id") != "")), "date").withColumns({
        "latitude": F.when(both, F.col("_lat")), "longitude": F.when(both, F.col("_lon"))})
    return _priced(rows, range_price("_ranges")).drop("_lat", "_lon", "_ranges", "source_id")


def union_tagged_feeds(general: DataFrame, teams: DataFrame) -> DataFrame:
    """The general feed and the team feeds as one; the first row per URL counts, general before teams.

    `general` has a position, `teams` a position and a team, whose name goes in front of the details.
    """
    tagged = teams.withColumn("details", F.concat_ws(" | ", "team", "details")).drop("team")
    both = general.withColumn("_feed", F.lit(0)).unionByName(tagged.withColumn("_feed", F.lit(1)))
    return top_rows(both, ["origination_url"], [F.asc("_feed"), F.asc("position")], 1, "_n").drop("_n", "_feed")


def _plain_stamp(c) -> Column:
    """A stamp whose zone letter and fraction say nothing: the wall clock counts."""
    return iso_local(F.substring_index(F.replace(c, F.lit("Z"), F.lit("")), ".", 1))


def flatten_city_api(raw: DataFrame, site: str = "https://city.example") -> DataFrame:
    rows = raw.select(F.from_json("payload", CITY).alias("e")).select("e.*")
    begin = _plain_stamp(F.coalesce(_text("tz_adjusted_begin_date"), _text("begin_date")))
    end = _plain_stamp(F.coalesce(_text("tz_adjusted_end_date"), _text("end_date")))
    lat, lon = F.col("venue.latitude").try_cast("double"), F.col("venue.longitude").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    flat = rows.select(
        F.trim("title").alias("name"), begin.alias("date"), end.alias("_end"), F.coalesce("category", F.lit("Other")).alias("category"),
        _joined(_text("excerpt"), _text("description"), by=" ").alias("details"),
        F.concat(F.lit(site), _text("permalink")).alias("origination_url"), "is_free", "venue",
        F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"))
    flat = keep_present(flat.where((F.col("name") != "") & F.col("origination_url").isNotNull()), "date")
    text = name_and_details("name", "details")
    flat = flat.withColumns({
        "date_end": F.when(F.to_date("_end") > F.to_date("date"), F.col("_end")),
        "is_outdoor": extract_setting(text),
        "venue_name": F.coalesce(_text("venue.title"), extract_venue("name")),
        "address": F.coalesce(_text("venue.full_address"), _text("venue.address"), extract_address(text))})
    return _priced(flat, F.when(F.col("is_free"), "Free")).drop("_end", "is_free", "venue")


def flatten_ticket_search_api(raw: DataFrame, event_url: str = "https://search.example/e/") -> DataFrame:
    """The date stays the UTC wall clock the source gives; utc_to_local repairs it."""
    e = raw.select(F.from_json("payload", TICKET_SEARCH).alias("e")).select("e.*")
    stamp = F.regexp_replace(F.col("start.utc"), "(?:Z|[+]00:?00)$", "")
    rows = e.where(F.col("id") != "").select(
        F.trim("name.text").alias("name"), iso_local(stamp).alias("date"),
        F.coalesce("category.name", F.lit("Other")).alias("category"),
        _joined(_trimmed("description.text"), _labelled("Venue", F.col("venue.name"))).alias("details"),
        F.coalesce(_text("url"), F.concat(F.lit(event_url), F.col("id"))).alias("origination_url"))
    return _priced(keep_present(rows.where(F.col("name") != ""), "date"))


def flatten_artist_api(raw: DataFrame, event_url: str = "https://artists.example/e/") -> DataFrame:
    e = raw.select(F.from_json("payload", ARTIST).alias("e")).select("e.*")
    artist, venue = _text("artist.name"), F.coalesce("venue.name", F.lit("Unknown Venue"))
    rows = e.select(
        F.when(F.col("venue").isNotNull(), F.concat(artist, F.lit(" at "), venue)).otherwise(artist).alias("name"),
        iso_local("datetime").alias("date"), F.lit("Music").alias("category"),
        _joined(_labelled("Venue", F.col("venue.name")), _labelled("Location", _place("venue.city", "venue.region")),
                _trimmed("description")).alias("details"),
        F.coalesce(_text("url"), F.concat(F.lit(event_url), F.col("id"))).alias("origination_url"))
    return _priced(keep_present(rows.where(F.col("name").isNotNull()), "date"))


def _rendered(c: str) -> Column:
    """A field that is either an object with `rendered` or plain text."""
    return F.when(F.col(c).startswith("{"), F.get_json_object(c, "$.rendered")).otherwise(F.col(c))


def flatten_blog_posts(raw: DataFrame) -> DataFrame:
    e = raw.select(F.from_json("payload", POST).alias("e")).select("e.*")
    excerpt = F.trim(_rendered("excerpt"))
    for tag, text in (("<p>", ""), ("</p>", ""), ("&nbsp;", " ")):
        excerpt = F.replace(excerpt, F.lit(tag), F.lit(text))
    rows = e.select(F.trim(_rendered("title")).alias("name"), iso_local("date").alias("date"), F.lit("Events").alias("category"),
                    F.nullif(F.trim(excerpt), F.lit("")).alias("details"), _text("link").alias("origination_url"))
    return _priced(keep_present(rows.where((F.length("name") >= 3) & F.col("origination_url").isNotNull()), "date"))


def flatten_search_cards(raw: DataFrame, top: int | None = None) -> DataFrame:
    """The cards of each search answer, or the first `top`; an address list starts with the venue."""
    cards = F.from_json("payload", CARDS)["events_results"]
    cards = F.slice(cards, 1, top) if top else cards
    e = each(raw, ["query_id"], cards).select("query_id", "position", "e.*")
    listed = F.col("address").startswith("[")
    parts = F.filter(F.transform(F.from_json("address", "ARRAY<STRING>"), lambda x: F.trim(x)), lambda x: x != "")
    address = F.when(listed, F.array_join(parts, ", ")).otherwise(F.col("address"))
    return e.select(
        "query_id", "position", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce(_text("date"), F.col("snippet")).alias("date"), F.coalesce(_text(address), F.col("displayed_link")).alias("location"),
        F.when(listed, F.get(parts, F.lit(0))).alias("venue"), F.coalesce("link", F.lit("")).alias("url"),
        F.col("type").alias("type_hint"))


FEATURES = """STRUCT<features: ARRAY<STRUCT<properties: STRUCT<pri_neigh: STRING, name: STRING>,
  geometry: STRUCT<type: STRING, coordinates: STRING>>>>"""


def flatten_geojson(raw: DataFrame) -> DataFrame:
    """Boundary features of landed feature collections as (ord, name, polygons); points and lines have no polygons."""
    e = each(raw, ["source_id"], F.from_json("payload", FEATURES)["features"])
    kind, text = F.col("e.geometry.type"), F.col("e.geometry.coordinates")
    depth = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, depth))).when(
        kind == "MultiPolygon", F.from_json(text, f"ARRAY<{depth}>"))
    shaped = F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    return e.select("source_id", F.col("position").alias("ord"),
                    F.coalesce("e.properties.pri_neigh", "e.properties.name").alias("name"), shaped.alias("polygons"))
