"""Queries and oracles of search."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import LISTINGS_AS_OF, listings, neighborhoods, table
from marquee.functions import query as Q
from marquee.lineage import settled
from marquee.operators import merge as M
from marquee.operators import search as S
from marquee.plans.classify import COSINE, NO_LIST, concepts_sql, distinct_sql, words_sql
from marquee.plans.ordering import FEED_DAY
from marquee.plans.predicates import UP, concept_sql
from marquee.plans.views import NEIGHBORHOODS, listing_query, q

AS_OF = LISTINGS_AS_OF
DIMS = 8

# One text for both engines: requests as long as the catalogue, for the columns that read them.
TEXT = """CASE id % 9 WHEN 0 THEN concat('What''s happening this weekend near NATION_', CAST(id % 30 AS STRING), '? I''d like ', lower(name))
    WHEN 1 THEN concat('find me ', name, ' tonight!') WHEN 2 THEN 'Show Jazz, jazz and more (free) events this sunday'
    WHEN 3 THEN concat(name, ' in the Wrigleyville area this week') WHEN 4 THEN 'don''t want comedy; yoga classes next week, south side'
    WHEN 5 THEN 'Any LGBTQ drag shows this month in downtown Chicago?' WHEN 6 THEN concat('can''t find ', name, ' in NATION_12 or NATION_1 today')
    WHEN 7 THEN concat('  ', upper(name), '   what''ve chicago''s dancers''d planned tomorrow?') ELSE name END"""

# A fixed set of requests put to the whole catalogue: (query_id, text, places, category).
REQUESTS = """(VALUES (1, 'late jazz this month', '', NULL), (2, 'comedy open mic', 'NATION_3;NATION_7', NULL), (3, 'yoga next week', '', NULL),
    (4, 'anything this weekend', '', NULL), (5, 'queer film', 'NATION_1', 'LGBTQ'), (6, 'vintage market tonight', '', NULL),
    (7, 'pottery class', '', 'Arts & Crafts'), (8, 'hockey game', 'NATION_12', NULL), (9, 'lecture on astronomy this month', '', NULL),
    (10, 'widget', '', 'music'), (11, 'events', 'NATION_20', 'music'), (12, 'beer tasting and theatre', '', NULL),
    (13, 'no such thing zzzz', '', NULL), (14, 'ring gear bolt gizmo panel', 'NATION_5;NATION_6;NATION_9', NULL))"""


def _requests(s):
    rows = s.sql(f"SELECT * FROM {REQUESTS} AS t(query_id, text, place_list, category)")
    places = F.when(F.col("place_list") == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split("place_list", ";"))
    rows = rows.withColumn("query_id", F.col("query_id").cast("bigint"))
    return S.understand(rows, AS_OF).withColumn("places", places).drop("place_list")


def _texts(s, d):
    return listings(s, d, "id", "name").selectExpr("id", f"{TEXT} AS text")


def _catalog(s, d, *more):
    return listings(s, d, "id", "name", "date", "date_end", "category", "categories", "neighborhood_id", *more)


def _documents(s, d):
    return listings(s, d, "id", "name", "category", "venue_name", "date", "date_end").withColumn("text", S.event_document())


def _index(s, d):
    docs = settled(_documents(s, d).select("id", "text"))
    words = docs.select(F.explode(S.tokens_of("text")).alias("token"))
    return S.embed_static(docs, S.token_vectors(words, DIMS), DIMS)


def _vectors(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id AS id", "embedding")


def _all_query_vectors(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id AS query_id", "embedding")


def _query_vectors(s, d):
    """A share of the table as the requests, so that they grow with it."""
    return _all_query_vectors(s, d).where("query_id % 50 = 0")


def _windowed(s, d):
    """The same requests, some placed, some with a period."""
    return _query_vectors(s, d).selectExpr("query_id", "query_id DIV 50 AS id").selectExpr(
        "query_id", "CASE WHEN id % 3 = 0 THEN array('NATION_3', 'NATION_7', 'NATION_11') ELSE CAST(array() AS ARRAY<STRING>) END AS places",
        "CASE WHEN id % 2 = 0 THEN TIMESTAMP_NTZ '1998-06-06 15:00:00' END AS window_start",
        "CASE WHEN id % 2 = 0 THEN TIMESTAMP_NTZ '1999-12-31 23:59:59' END AS window_end")


def _semantic(s, d):
    matches = S.nearest(_query_vectors(s, d), _vectors(s, d), 20, 0.1)
    return S.semantic_candidates(_catalog(s, d), neighborhoods(s, d), _windowed(s, d), matches, AS_OF)


def _pairs(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id AS id", "vec_id % 25 AS query_id")


def _ranked(s, d):
    """Structured candidates of every request, scored with the similarity of a stored vector where there is one."""
    found = S.structured_candidates(_catalog(s, d), neighborhoods(s, d), _requests(s), AS_OF)
    near = found.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    scored = S.scores_for(found.select("query_id", "id"), _all_query_vectors(s, d), _vectors(s, d))
    candidates = M.candidate_union(found.join(scored, ["query_id", "id"], "left"), near)
    return S.rank_candidates(candidates, AS_OF)


def _named():
    return F.expr("array(concat('NATION_', CAST(id % 30 AS STRING)), 'Lake View')")


def _window(s, d):
    start, end = Q.extract_window("text", "1998-06-06 15:30:00")
    return _texts(s, d).select("id", start.alias("window_start"), end.alias("window_end"))


INTENTS = """SELECT id, CASE id % 5 WHEN 0 THEN 'farewell' WHEN 1 THEN 'chicago_events' WHEN 2 THEN 'chicago_info' WHEN 3 THEN 'events_general' ELSE 'out_of_scope' END AS intent,
    CAST(id % 101 AS DOUBLE) / 100 AS confidence FROM {rel}"""

QUERIES = {
    "extract_keywords": lambda s, d: _texts(s, d).select("id", F.array_join(Q.extract_keywords("text"), " ").alias("keywords")),
    "extract_places": lambda s, d: Q.extract_places(
        _texts(s, d), "text", neighborhoods(s, d), "places", {**vocab.PLACE_ALIASES, "wrigleyville": "NATION_4"},
        {"downtown": ["NATION_2", "NATION_9", "Loop"], "south side": ["NATION_8"]}).select(
        "id", F.array_join("places", "; ").alias("places")),
    "strip_places": lambda s, d: _texts(s, d).select(
        "id", F.array_join(Q.strip_places(Q.extract_keywords("text"), _named(), "text"), " ").alias("keywords")),
    "extract_window": _window,
    "search_feed": lambda s, d: S.search_feed(_catalog(s, d), neighborhoods(s, d), _requests(s), AS_OF, 5, 40).select(
        "query_id", "id", "name", "position"),
    "structured_candidates": lambda s, d: S.structured_candidates(
        _catalog(s, d), neighborhoods(s, d), _requests(s), AS_OF).select("query_id", "id", "neighborhood", "position"),
    "event_document": lambda s, d: _documents(s, d).select("id", "text"),
    "embed_static": lambda s, d: _index(s, d).selectExpr(
        "id", "CAST(round(embedding[0], 5) AS DOUBLE) AS e0", f"CAST(round(embedding[{DIMS - 1}], 5) AS DOUBLE) AS e_last"),
    "nearest": lambda s, d: S.nearest(_query_vectors(s, d), _vectors(s, d)),
    "scores_for": lambda s, d: S.scores_for(_pairs(s, d), _all_query_vectors(s, d), _vectors(s, d)),
    "semantic_candidates": lambda s, d: _semantic(s, d).select("query_id", "id", "similarity", "position"),
    "relevance": lambda s, d: S.structured_candidates(_catalog(s, d), neighborhoods(s, d), _requests(s), AS_OF).withColumn(
        "similarity", F.expr("CAST(id % 60 AS DOUBLE) / 100 - 0.1")).select(
        "query_id", "id", S.relevance(AS_OF).alias("confidence")),
    "rank_candidates": lambda s, d: _ranked(s, d).select("query_id", "id", "confidence", "rank"),
    "route_search": lambda s, d: S.route_search(_requests(s), _ranked(s, d)),
    "explicit_request": lambda s, d: _texts(s, d).select("id", Q.explicit_request("text").alias("explicit")),
    "route_intent": lambda s, d: S.route_intent(s.sql(INTENTS.format(rel="{rel}"), rel=listings(s, d, "id"))),
}

_EDGE = q(Q._EDGE)
_ENDING = q(Q._ENDING)


def keywords_sql(t):
    words = f"string_split(trim(regexp_replace(lower({t}), '\\s+', ' ', 'g')), ' ')"
    bare = f"list_transform({words}, lambda w: regexp_replace(regexp_replace(w, {_EDGE}, '', 'g'), {_ENDING}, '\\1'))"
    stop = ", ".join(q(w) for w in vocab.STOP_WORDS)
    return f"{distinct_sql(f'list_filter({bare}, lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))')}"


def window_sql(t, clock, day):
    """The period a request names on Saturday 1998-06-06."""
    def pick(i):
        cases = [(f"contains({t}, 'this weekend') OR contains({t}, 'this saturday')", f"1998-06-13 {clock}", "1998-06-14 23:59:59"),
                 (f"contains({t}, 'this sunday')", f"1998-06-14 {clock}", "1998-06-14 23:59:59"),
                 (f"contains({t}, 'this week')", f"1998-06-06 {clock}", f"1998-06-13 {clock}"),
                 (f"contains({t}, 'this month')", f"1998-06-06 {clock}", "1998-06-30 23:59:59"),
                 (f"contains({t}, 'next week')", f"1998-06-13 {clock}", f"1998-06-20 {clock}"),
                 (f"contains({t}, 'tonight') OR contains({t}, 'today')", f"1998-06-06 {clock}", "1998-06-06 23:59:59")]
        return "CASE " + " ".join(f"WHEN {c[0]} THEN TIMESTAMP '{c[i]}'" for c in cases) + " END"
    return pick(1), pick(2)


TEXTS = f"texts AS (SELECT id, {TEXT} AS text FROM listings)"
_W = window_sql("lower(text)", "00:00:00", "")
ASKED = f"""
requests AS (SELECT CAST(query_id AS BIGINT) AS query_id, text, category AS want, CASE WHEN place_list = '' THEN {NO_LIST} ELSE string_split(place_list, ';') END AS places,
  {keywords_sql('text')} AS keywords, {concepts_sql(words_sql('text'))} AS concepts, {_W[0]} AS ws, {_W[1]} AS we
  FROM {REQUESTS} AS t(query_id, text, place_list, category)),
rows_ AS (SELECT l.*, n.name AS neighborhood, list_filter([{', '.join(f'CASE WHEN {concept_sql([c])} THEN {q(c)} END' for c in vocab.CONCEPTS)}], lambda x: x IS NOT NULL) AS row_concepts
  FROM listings l LEFT JOIN neighborhoods n ON n.id = l.neighborhood_id WHERE {UP}),
hits AS (SELECT r.*, l.*, {FEED_DAY.replace('date', 'l.date')} AS feed_day FROM requests r, rows_ l WHERE
  (len(list_filter(keywords, lambda k: contains(lower(l.name), k))) > 0 OR list_has_any(concepts, row_concepts) OR (len(keywords) = 0 AND len(concepts) = 0))
  AND (want IS NULL OR lower(trim(coalesce(category, ''))) = lower(want) OR coalesce(list_contains(list_transform(categories, lambda c: lower(c)), lower(want)), false))
  AND (len(places) = 0 OR coalesce(list_contains(places, neighborhood), false))
  AND (ws IS NULL OR (date <= we AND (date_end >= date_trunc('day', ws) OR (date_end IS NULL AND date >= date_trunc('day', ws)))))),
placed_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY feed_day NULLS LAST, lower(name), id) AS position FROM hits),
candidates AS (SELECT * FROM placed_hits WHERE position <= CASE WHEN len(places) > 0 THEN 100 ELSE 50 END)"""


def relevance_sql(similarity):
    words = r"list_transform(string_split(trim(regexp_replace(lower(concat_ws(' ', name, coalesce(category, ''))), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, " + q(S._STRIP) + ", '', 'g'))"
    stems = f"list_transform(list_filter({words}, lambda w: w <> ''), lambda w: rtrim(w, 's'))"
    hits = f"len(list_filter(keywords, lambda k: list_contains({words}, k) OR list_contains({stems}, rtrim(k, 's'))))"
    return f"""round(least(1.0, CASE WHEN {hits} > 0 THEN least(CAST(0.4 AS DOUBLE), CAST(0.15 AS DOUBLE) + {hits} / greatest(len(keywords), 1) * CAST(0.25 AS DOUBLE)) ELSE 0 END
      + CASE WHEN {similarity} > 0 THEN least(CAST(0.4 AS DOUBLE), {similarity} * CAST(0.9 AS DOUBLE)) ELSE 0 END
      + CASE WHEN category <> '' AND list_contains(concepts, lower(category)) THEN CAST(0.15 AS DOUBLE) ELSE 0 END
      + CASE WHEN date >= TIMESTAMP '1998-06-06' THEN CASE WHEN date < TIMESTAMP '1998-06-14' THEN CAST(0.05 AS DOUBLE) WHEN date < TIMESTAMP '1998-07-07' THEN CAST(0.03 AS DOUBLE) ELSE CAST(0.01 AS DOUBLE) END ELSE 0 END), 6)"""


PAIR_SIM = f"round({COSINE.format('e.embedding', 'v.embedding')}, 6)"
RANKED = f"""
sims AS (SELECT c.query_id, c.id, {PAIR_SIM} AS similarity FROM candidates c JOIN embeddings e ON e.vec_id = c.id JOIN embeddings v ON v.vec_id = c.query_id),
scored AS (SELECT c.query_id, c.id, position, {relevance_sql('similarity')} AS confidence FROM candidates c LEFT JOIN sims USING (query_id, id)),
ranked AS (SELECT * FROM (SELECT query_id, id, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, position, id) AS rank FROM scored) WHERE rank <= 5)"""


def near_sql(k, floor):
    return f"""SELECT query_id, id, similarity, position FROM (SELECT v.vec_id AS query_id, e.vec_id AS id, {PAIR_SIM} AS similarity,
      row_number() OVER (PARTITION BY v.vec_id ORDER BY {PAIR_SIM} DESC, e.vec_id) AS position
      FROM embeddings e, embeddings v WHERE v.vec_id % 50 = 0 AND {PAIR_SIM} >= {floor}) WHERE position <= {k}"""


_DOC = "concat_ws('. ', nullif(name, ''), nullif(category, ''), nullif(venue_name, ''))"
_WQ = window_sql("lower(text)", "15:30:00", "")
_ELEMENT = "avg(CAST('0x' || substr(md5(token || ':{}:0'), 1, 4) AS INTEGER) / 32768.0 - 1.0)"
_NEEDLES = " OR ".join(f"contains(t, {q(' ' + r + ' ')}) AND w IN ({', '.join(q(x) for x in r.split())})" for r in vocab.REGIONS)

ORACLES = {
    "extract_keywords": listing_query(f"SELECT id, array_to_string({keywords_sql('text')}, ' ') AS keywords FROM texts", TEXTS),
    "extract_places": listing_query("""SELECT id, CASE WHEN id % 9 = 0 AND id % 30 < 25 THEN 'NATION_' || (id % 30) WHEN id % 9 = 3 THEN 'NATION_4'
        WHEN id % 9 = 4 THEN 'NATION_8' WHEN id % 9 = 5 THEN 'NATION_2; NATION_9' WHEN id % 9 = 6 THEN 'NATION_12; NATION_1' ELSE '' END AS places FROM listings"""),
    "strip_places": listing_query(rf""", k AS (SELECT id, {keywords_sql('text')} AS kw,
          ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9& ]', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS t FROM texts)
        SELECT id, array_to_string(list_filter(kw, lambda w: w NOT IN ('nation', CAST(id % 30 AS VARCHAR), 'lake', 'view', 'lakeview', 'wrigleyville', 'boystown', 'northalsted')
          AND NOT ({_NEEDLES})), ' ') AS keywords FROM k""", TEXTS),
    "extract_window": listing_query(f"SELECT id, {_WQ[0]} AS window_start, {_WQ[1]} AS window_end FROM texts", TEXTS),
    "search_feed": listing_query("SELECT query_id, id, name, position FROM placed_hits WHERE position > 5 AND position <= 45", NEIGHBORHOODS, ASKED),
    "structured_candidates": listing_query("SELECT query_id, id, neighborhood, position FROM candidates", NEIGHBORHOODS, ASKED),
    "event_document": listing_query(f"SELECT id, {_DOC} AS text FROM listings"),
    "embed_static": listing_query(rf""", w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower({_DOC}), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM listings),
        p AS (SELECT id, {', '.join(f"{_ELEMENT.format(j)} AS d{j}" for j in range(DIMS))} FROM w GROUP BY id),
        n AS (SELECT *, greatest(sqrt({' + '.join(f'd{j} * d{j}' for j in range(DIMS))}), 1e-12) AS l FROM p)
        SELECT id, round(d0 / l, 5) AS e0, round(d{DIMS - 1} / l, 5) AS e_last FROM n"""),
    "nearest": near_sql(20, 0.25),
    "scores_for": f"""SELECT e.vec_id AS id, v.vec_id AS query_id, {PAIR_SIM} AS similarity FROM embeddings e JOIN embeddings v
        ON v.vec_id = e.vec_id % 25""",
    "semantic_candidates": listing_query(f""", m AS ({near_sql(20, 0.1)})
        SELECT query_id, m.id, similarity, position FROM m JOIN listings l ON l.id = m.id LEFT JOIN neighborhoods n ON n.id = l.neighborhood_id
        WHERE {UP} AND (query_id // 50 % 3 <> 0 OR coalesce(n.name IN ('NATION_3', 'NATION_7', 'NATION_11'), false))
          AND (query_id // 50 % 2 <> 0 OR date BETWEEN TIMESTAMP '1998-06-06' AND TIMESTAMP '1999-12-31 23:59:59')""", NEIGHBORHOODS),
    "relevance": listing_query(f"""SELECT query_id, id, {relevance_sql('(CAST(id % 60 AS DOUBLE) / 100 - 0.1)')} AS confidence FROM candidates""", NEIGHBORHOODS, ASKED),
    "rank_candidates": listing_query("SELECT query_id, id, confidence, rank FROM ranked", NEIGHBORHOODS, ASKED, RANKED),
    "route_search": listing_query("""SELECT query_id, count(id) AS results, coalesce(max(confidence), 0.0) AS best_confidence,
        CASE WHEN count(id) = 0 THEN 'NO_RESULTS' WHEN max(confidence) < 0.3 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS route,
        count(id) < 5 OR coalesce(max(confidence), 0) < 0.3 AS may_go_external FROM requests LEFT JOIN ranked USING (query_id) GROUP BY query_id""",
        NEIGHBORHOODS, ASKED, RANKED),
    "explicit_request": listing_query(rf"""SELECT id, regexp_matches(text, '(?i)\bchicago\b.*\b{vocab.EVENT_REQUEST_WORDS}\b')
        OR regexp_matches(text, '(?i)\b{vocab.EVENT_REQUEST_WORDS}\b.*\bchicago\b') AS explicit FROM texts""", TEXTS),
    "route_intent": listing_query(f""", i AS ({INTENTS.format(rel='listings')})
        SELECT id, intent, confidence, CASE WHEN intent = 'farewell' THEN 'end' WHEN intent <> 'chicago_events' AND confidence >= 0.85 THEN 'redirect'
          WHEN intent <> 'chicago_events' AND confidence >= 0.65 THEN 'clarify' ELSE 'run' END AS route FROM i"""),
}
