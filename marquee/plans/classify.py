"""Queries and oracles of the classification jobs, and the SQL text of the rules other oracles use."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import ODD_TITLE, listings, table, venue_config
from marquee.functions import labels as L
from marquee.operators import aggregates as A
from marquee.operators import classify as K
from marquee.operators.ordering import top_rows
from marquee.plans.views import CONFIG, LISTINGS, listing_query, q, with_views

HINT = "CASE id % 4 WHEN 0 THEN 'Live jazz concert' WHEN 1 THEN 'Cultural workshop' WHEN 2 THEN '' END"
RAW_LABEL = "CASE id % 6 WHEN 0 THEN 'lgbtq' WHEN 1 THEN '  arts   &  culture ' WHEN 2 THEN 'Parties & DJs' WHEN 3 THEN 'tv & film' WHEN 4 THEN 'karaoke/trivia/open mics' ELSE category END"
NO_LIST = "CAST([] AS VARCHAR[])"


def norm_sql(x):
    """One label's spelling in DuckDB, null when blank."""
    word = f"""CASE WHEN regexp_matches(substr(p, 2), '\\p{{Lu}}') THEN p WHEN list_contains([{', '.join(q(a) for a in vocab.ACRONYMS)}], upper(p))
      THEN upper(p) ELSE upper(substr(p, 1, 1)) || lower(substr(p, 2)) END"""
    words = f"string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ')"
    return (f"nullif(array_to_string(list_transform({words}, lambda w: array_to_string(list_transform(string_split(w, '/'), "
            f"lambda p: {word}), '/')), ' '), '')")


def rule_sql(t):
    cases = f"WHEN regexp_matches({t}, {q(vocab.FIXTURE_TEAM)}) AND regexp_matches({t}, {q(vocab.FIXTURE_VERSUS)}) THEN 'Sports' "
    cases += " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {q(label)}" for label, p in vocab.TITLE_RULES)
    return f"CASE {cases} END"


def words_sql(t):
    return f"regexp_replace(' ' || regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9 -]', ' ', 'g') || ' ', '\\s+', ' ', 'g')"


def concepts_sql(words, value=lambda c: c):
    parts = []
    for c, (_, spoken, _, _) in vocab.CONCEPTS.items():
        tests = " OR ".join(f"contains({words}, {q(f' {w} ')}) OR contains({words}, {q(f' {w}s ')})" for w in spoken)
        parts.append(f"CASE WHEN {tests} THEN {q(value(c))} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def canon(c):
    return vocab.CONCEPTS[c][0]


def distinct_sql(x):
    """Distinct values of a list in first-seen order."""
    return f"list_filter({x}, lambda v, i: v IS NOT NULL AND list_position({x}, v) = i)"


def labels_ctes(rel, title, fallback, hint, out):
    """CTEs ending in `out`: every column of rel plus labels."""
    text = f"concat_ws(' ', nullif({title}, ''), nullif({hint}, ''))"
    return f"""
{out}_1 AS (SELECT *, {fallback} AS _fall, {rule_sql(title)} AS _rule, {words_sql(text)} AS _text FROM {rel}),
{out}_2 AS (SELECT *, {concepts_sql('_text', canon)} AS _named, coalesce(_rule, _fall) AS _ruled FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN _ruled = 'Events' THEN coalesce(_named[1], _ruled) ELSE _ruled END AS _primary,
  _rule IS NOT NULL AND _rule IS DISTINCT FROM _fall AS _over FROM {out}_2),
{out}_4 AS (SELECT *, list_filter(list_transform(list_concat([_primary], _named, CASE WHEN _fall <> '' AND NOT _over
    AND (_fall <> 'Events' OR _primary IS NOT DISTINCT FROM _fall) THEN [_fall] ELSE {NO_LIST} END), lambda l: {norm_sql('l')}), lambda l: l IS NOT NULL) AS _clean FROM {out}_3),
{out} AS (SELECT * EXCLUDE (_fall, _rule, _text, _named, _ruled, _primary, _over, _clean),
  CASE WHEN _primary = 'Sports' AND _primary IS DISTINCT FROM _fall THEN ['Sports'] ELSE {distinct_sql('_clean')} END AS labels FROM {out}_4)"""


def parents_sql(x):
    """Parents of a list of labels."""
    owners: dict[str, list[str]] = {}
    for parent, labels in vocab.TAXONOMY.items():
        for label in labels:
            owners.setdefault(label.lower(), []).append(parent)
    cases = " ".join(f"WHEN {q(label)} THEN [{', '.join(q(p) for p in ps)}]" for label, ps in owners.items())
    flat = f"flatten(list_transform(list_filter(list_transform({x}, lambda l: {norm_sql('l')}), lambda l: l IS NOT NULL), lambda l: CASE lower(l) {cases} ELSE [l] END))"
    return distinct_sql(flat)


def finer_sql(x, parents):
    silent = ", ".join(q(u) for u in vocab.UNINFORMATIVE)
    clean = f"list_filter(list_transform({x}, lambda l: {norm_sql('l')}), lambda l: l IS NOT NULL AND lower(l) NOT IN ({silent}) AND NOT list_contains({parents}, l))"
    return distinct_sql(clean)


CLAIMS = distinct_sql(f"list_filter(list_concat([category], coalesce(categories, {NO_LIST}), coalesce(subcategories, {NO_LIST})), lambda x: x <> '')")
SUBS = "CASE WHEN id % 6 = 0 THEN ['Theatre & Performing Arts'] WHEN id % 6 = 1 THEN ['Poetry & Literary', 'Other'] END"
SUBS_SPARK = "CASE WHEN id % 6 = 0 THEN array('Theatre & Performing Arts') WHEN id % 6 = 1 THEN array('Poetry & Literary', 'Other') END"


def _titled(s, d):
    return listings(s, d, "id", "name", "category").selectExpr("id", f"{ODD_TITLE} AS title", f"{HINT} AS hint", f"{RAW_LABEL} AS label")


def _stored(s, d):
    return listings(s, d, "id", "name", "category", "categories", "source", "venue_name", "details").withColumn(
        "subcategories", F.expr(SUBS_SPARK))


def _context(s, d):
    config = venue_config(s, d)
    by_name = config.withColumn("name", F.col("venue_name"))
    priors = A.venue_priors(listings(s, d, "id", "source", "category", "details", "venue_name"), by_name)
    guesses = listings(s, d, "id").selectExpr("id", "CASE id % 8 WHEN 0 THEN 'Film' WHEN 4 THEN 'Other' END AS label")
    return K.Context(K.declared_labels(config), priors, guesses)


def _joined(df, *cols):
    return df.withColumns({c: F.array_join(c, "; ") for c in cols})


def _pass(name):
    return lambda s, d: _joined(K.recategorize(_stored(s, d), name, _context(s, d)), "categories", "subcategories")


def _vectors(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id AS id", "embedding", "label")


def _exemplars(s, d):
    return top_rows(_vectors(s, d), ["label"], [F.asc("id")], 3, "n").selectExpr(
        "id AS ord", "concat('Label ', CAST(label AS STRING)) AS parent", "embedding")


def _semantic(s, d):
    return K.semantic_category(_vectors(s, d), _exemplars(s, d))


QUERIES = {
    "normalize_label": lambda s, d: _titled(s, d).select("id", L.normalize_label("label").alias("label")),
    "labels_to_parents": lambda s, d: _titled(s, d).select(
        "id", F.array_join(L.labels_to_parents(F.array("label", F.lit("Arts & Theatre"), F.lit("tech"))), "; ").alias("parents")),
    "informative_subtags": lambda s, d: _titled(s, d).withColumn("labels", F.array("label", F.lit("Arts & Theatre"), F.lit("Events"))).select(
        "id", F.array_join(L.informative_subtags("labels", L.labels_to_parents("labels")), "; ").alias("subtags")),
    "title_rule": lambda s, d: _titled(s, d).select("id", L.title_rule("title").alias("rule")),
    "concepts_in": lambda s, d: _titled(s, d).select(
        "id", F.array_join(L.concepts_in(L.with_hint("title", "hint")), "; ").alias("concepts")),
    "classify_single": lambda s, d: _titled(s, d).select(
        "id", L.classify_single("title", F.lit("Events"), "hint").alias("category")),
    "classify_labels": lambda s, d: L.with_labels(_titled(s, d), "title", "label", "hint").select(
        "id", F.array_join("labels", "; ").alias("labels")),
    **{f"recategorize_{p}": _pass(p) for p in K.ALL_PASSES},
    "recategorize": lambda s, d: _joined(K.recategorize_all(_stored(s, d), _context(s, d)).select(
        "id", "category", "categories", "subcategories"), "categories", "subcategories"),
    "label_moves": lambda s, d: A.label_moves(K.recategorize(_stored(s, d), "parents", K.Context())),
    "semantic_category": _semantic,
    "hybrid_category": lambda s, d: K.hybrid_category(
        listings(s, d, "id", "name"), _semantic(s, d).where("label IS NOT NULL").select("id", "label")).select("id", "ruled", "guess", "category"),
}

TITLED = f"titled AS (SELECT id, {ODD_TITLE} AS title, {HINT} AS hint, {RAW_LABEL} AS label FROM listings)"
STORED = f"stored AS (SELECT *, {SUBS} AS subcategories FROM listings)"


def _ctx_sql():
    from marquee.plans.aggregates import venue_key_sql
    venue = r"coalesce(nullif(trim(venue_name), ''), trim(regexp_extract(coalesce(details, ''), 'Venue:\s*([^|]+)', 1)))"
    declared = "CASE category WHEN 'music' THEN 'Music' WHEN 'arts & crafts' THEN 'Arts & Crafts' ELSE 'Comedy' END"
    return f"""
declared AS (SELECT 'chicago_venue_' || name AS source, {declared} AS declared FROM venue_config WHERE category <> 'events'),
votes AS (SELECT {venue_key_sql(venue)} AS venue_key, trim(category) AS category, count(*) AS n, min(id) AS f FROM listings
  WHERE source <> 'ticket_api' AND {venue} <> '' AND lower(trim(category)) NOT IN ('undefined', 'other', 'events', '') GROUP BY 1, 2),
priors AS (SELECT venue_key, coalesce(c.declared, l.category) AS prior FROM
  (SELECT venue_key, category FROM (SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY n DESC, f) AS rn FROM votes) WHERE rn = 1) l
  FULL JOIN (SELECT {venue_key_sql('venue_name')} AS venue_key, {declared} AS declared FROM venue_config WHERE category <> 'events') c USING (venue_key)),
guesses AS (SELECT id, CASE id % 8 WHEN 0 THEN 'Film' WHEN 4 THEN 'Other' END AS guess FROM listings)"""


def _pass_ctes(name, rel, out):
    """CTEs that add _labels to rel for one pass."""
    if name == "normalize":
        return labels_ctes(rel, "name", f"coalesce({norm_sql('category')}, 'Events')", "NULL", f"{out}_l") + f""",
{out} AS (SELECT * EXCLUDE (labels), {distinct_sql(f"list_concat(labels, coalesce(subcategories, {NO_LIST}))")} AS _labels FROM {out}_l)"""
    if name == "venue":
        return f"{out}_j AS (SELECT r.*, declared FROM {rel} r LEFT JOIN declared USING (source))," + labels_ctes(
            f"{out}_j", "name", "declared", "NULL", f"{out}_l") + f""",
{out} AS (SELECT * EXCLUDE (labels, declared), CASE WHEN declared IS NOT NULL THEN labels END AS _labels FROM {out}_l)"""
    if name == "undefined":
        from marquee.plans.aggregates import venue_key_sql
        venue = r"coalesce(nullif(trim(venue_name), ''), trim(regexp_extract(coalesce(details, ''), 'Venue:\s*([^|]+)', 1)))"
        guessed = f"coalesce({rule_sql('_venue')}, {concepts_sql(words_sql('_venue'), canon)}[1], 'Events')"
        return f"""{out}_v AS (SELECT *, {venue} AS _venue FROM {rel}),
{out}_j AS (SELECT v.*, coalesce(prior, {guessed}) AS prior FROM {out}_v v LEFT JOIN priors ON {venue_key_sql('_venue')} = priors.venue_key),""" + labels_ctes(
            f"{out}_j", "name", "prior", "NULL", f"{out}_l") + f""",
{out} AS (SELECT * EXCLUDE (labels, prior, _venue), CASE WHEN len(list_filter({CLAIMS}, lambda x: lower(trim(x)) = 'undefined')) > 0 THEN labels END AS _labels FROM {out}_l)"""
    if name == "generic":
        return f"{out}_j AS (SELECT r.*, guess FROM {rel} r LEFT JOIN guesses USING (id))," + labels_ctes(
            f"{out}_j", "name", "'Events'", "NULL", f"{out}_l") + f""",
{out} AS (SELECT * EXCLUDE (labels, guess), CASE WHEN len(list_filter({CLAIMS}, lambda x: x NOT IN ('Other', 'Events'))) = 0 THEN
  CASE WHEN len(list_filter({parents_sql('labels')}, lambda x: x <> 'Other')) > 0 THEN labels WHEN guess IS NOT NULL THEN [guess] END END AS _labels FROM {out}_l)"""
    return f"{out} AS (SELECT *, {CLAIMS} AS _labels FROM {rel})"


def _marked_ctes(name, rel, out):
    generic = " AND _parents <> ['Other']" if name == "generic" else ""
    return _pass_ctes(name, rel, f"{out}_p") + f""",
{out}_q AS (SELECT *, {parents_sql('_labels')} AS _parents FROM {out}_p),
{out}_r AS (SELECT *, CASE WHEN len({finer_sql('_labels', '_parents')}) > 0 THEN {finer_sql('_labels', '_parents')} END AS _finer FROM {out}_q),
{out} AS (SELECT *, coalesce(len(_parents) > 0{generic} AND NOT (category IS NOT DISTINCT FROM _parents[1]
  AND coalesce(categories, {NO_LIST}) = _parents AND CASE WHEN len(subcategories) > 0 THEN subcategories END IS NOT DISTINCT FROM _finer), false) AS _changed FROM {out}_r)"""


def _pass_oracle(name):
    return with_views(LISTINGS, CONFIG, STORED, _ctx_sql(), _marked_ctes(name, "stored", "m"), body="""
        SELECT id, category AS old_category, _parents[1] AS category, array_to_string(_parents, '; ') AS categories,
          array_to_string(_finer, '; ') AS subcategories FROM m WHERE _changed""")


def _all_oracle():
    parts, rel = [], "stored"
    for i, name in enumerate(K.ALL_PASSES):
        parts.append(_marked_ctes(name, rel, f"m{i}"))
        parts.append(f"""s{i} AS (SELECT * EXCLUDE (_labels, _parents, _finer, _changed)
          REPLACE (CASE WHEN _changed THEN _parents[1] ELSE category END AS category,
            CASE WHEN _changed THEN _parents ELSE categories END AS categories,
            CASE WHEN _changed THEN _finer ELSE subcategories END AS subcategories) FROM m{i})""")
        rel = f"s{i}"
    return with_views(LISTINGS, CONFIG, STORED, _ctx_sql(), *parts, body=f"""
        SELECT id, category, array_to_string(categories, '; ') AS categories, array_to_string(subcategories, '; ') AS subcategories FROM {rel}""")


COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
SEMANTIC = f"""
ex AS (SELECT vec_id AS ord, 'Label ' || label AS parent, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3),
sem AS (SELECT id, parent, similarity, CASE WHEN similarity >= 0.45 THEN parent END AS label FROM (
  SELECT v.vec_id AS id, ex.parent, round({COSINE.format('v.embedding', 'ex.embedding')}, 6) AS similarity,
    row_number() OVER (PARTITION BY v.vec_id ORDER BY round({COSINE.format('v.embedding', 'ex.embedding')}, 6) DESC, ex.ord) AS n
  FROM embeddings v, ex) WHERE n = 1)"""

ORACLES = {
    "normalize_label": listing_query(f"SELECT id, {norm_sql('label')} AS label FROM titled", TITLED),
    "labels_to_parents": listing_query(
        f"SELECT id, array_to_string({parents_sql(chr(91) + 'label, ' + q('Arts & Theatre') + ', ' + q('tech') + chr(93))}, '; ') AS parents FROM titled", TITLED),
    "informative_subtags": listing_query(f""", t AS (SELECT id, [label, 'Arts & Theatre', 'Events'] AS labels FROM titled),
        p AS (SELECT *, {parents_sql('labels')} AS parents FROM t) SELECT id, array_to_string({finer_sql('labels', 'parents')}, '; ') AS subtags FROM p""", TITLED),
    "title_rule": listing_query(f"SELECT id, {rule_sql('title')} AS rule FROM titled", TITLED),
    "concepts_in": listing_query(f""", w AS (SELECT id, {words_sql("concat_ws(' ', nullif(title, ''), nullif(hint, ''))")} AS t FROM titled)
        SELECT id, array_to_string({concepts_sql('t')}, '; ') AS concepts FROM w""", TITLED),
    "classify_single": listing_query(f""", w AS (SELECT id, title, {words_sql("concat_ws(' ', nullif(title, ''), nullif(hint, ''))")} AS t FROM titled)
        SELECT id, coalesce({rule_sql('title')}, {concepts_sql('t', canon)}[1], 'Events') AS category FROM w""", TITLED),
    "classify_labels": with_views(LISTINGS, TITLED, labels_ctes("titled", "title", "label", "hint", "lab"),
                                  body="SELECT id, array_to_string(labels, '; ') AS labels FROM lab"),
    **{f"recategorize_{p}": _pass_oracle(p) for p in K.ALL_PASSES},
    "recategorize": _all_oracle(),
    "label_moves": with_views(LISTINGS, STORED, _marked_ctes("parents", "stored", "m"), body="""
        SELECT coalesce(nullif(category, ''), '-') || ' -> ' || _parents[1] AS move, count(*) AS n FROM m
        WHERE _changed AND category IS DISTINCT FROM _parents[1] GROUP BY 1 ORDER BY n DESC, move LIMIT 12"""),
    "semantic_category": with_views(SEMANTIC, body="SELECT id, parent, similarity, label FROM sem"),
    "hybrid_category": with_views(LISTINGS, SEMANTIC, labels_ctes("listings", "name", "'Events'", "NULL", "lab"), body=f"""
        , r AS (SELECT id, list_filter({parents_sql('labels')}, lambda x: x <> 'Other')[1] AS ruled FROM lab)
        SELECT id, ruled, label AS guess, coalesce(ruled, label) AS category FROM r LEFT JOIN (SELECT id, label FROM sem WHERE label IS NOT NULL) g USING (id)"""),
}
