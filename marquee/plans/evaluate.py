"""Queries and oracles of the evaluations."""

from pyspark.sql import functions as F

from marquee.adapters import listings, table
from marquee.operators import classify as K
from marquee.operators import evaluate as V
from marquee.plans.classify import SEMANTIC, _semantic, labels_ctes, parents_sql
from marquee.plans.search import ASKED, RANKED, _ranked
from marquee.plans.views import LISTINGS, NEIGHBORHOODS, listing_query, with_views

GOLD = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN quality = 1 THEN 'good' ELSE 'bad' END"
RULE = "CASE WHEN n_chars > 9000 THEN 'good' WHEN n_chars < 300 THEN 'bad' END"
GUESS = "CASE WHEN n_chars % 3 = 0 THEN 'bad' ELSE 'good' END"
EXPECTED = """(VALUES (1, 'jazz;nation_3', '', 1), (2, 'comedy', 'jazz', 1), (3, 'yoga', '', 1), (4, '', '', 1), (5, 'film', 'yoga', 0), (6, 'market', '', 0), (7, 'crafts', '', 3),
    (8, 'hockey', 'item', 1), (9, 'lecture', '', 1), (10, 'widget', 'ring', 1), (11, '', 'zzz', 0), (12, 'beer;theatre', '', 2), (13, '', '', 0), (14, 'nation_5', '', 1))"""


# The classifier itself: what each kind of title is, said by hand, and what the nearest exemplars' labels stand for.
TITLE_GOLD = """CASE WHEN name LIKE 'Late Jazz%' THEN 'Music' WHEN name LIKE 'Stand-up%' THEN 'Comedy' WHEN name LIKE 'Pottery%' THEN 'Arts' WHEN name LIKE 'Hawks vs%' THEN 'Sports'
    WHEN name LIKE 'Queer Film%' THEN 'LGBTQ' WHEN name LIKE 'Beer%' THEN 'Food & Drink' WHEN name LIKE 'Vintage%' THEN 'Shopping' WHEN name LIKE 'Haunted%' THEN 'Health & Wellness'
    WHEN name LIKE 'Astronomy%' THEN 'Tech / Educational' END"""
KINDS = ["Music", "Comedy", "Arts", "Sports", "Film", "Food & Drink", "Shopping", "Health & Wellness", "Tech / Educational", "Community"]
MEANT = "CASE parent " + " ".join(f"WHEN 'Label {i}' THEN '{kind}'" for i, kind in enumerate(KINDS)) + " END"


def _titles(s, d):
    return listings(s, d, "id", "name")


def _title_gold(s, d):
    return _titles(s, d).selectExpr("id", f"{TITLE_GOLD} AS expected")


def _classified(s, d):
    """Titles through the hybrid classifier, guesses at its own floor."""
    guesses = _semantic(s, d).where("label IS NOT NULL").selectExpr("id", f"{MEANT} AS label")
    return K.hybrid_category(_titles(s, d), guesses).selectExpr("id", "category AS label")


def _classified_at_any_floor(s, d):
    near = _semantic(s, d).selectExpr("id", f"{MEANT} AS guess", "similarity")
    ruled = K.hybrid_category(_titles(s, d), near.selectExpr("id", "CAST(NULL AS STRING) AS label")).select("id", "ruled")
    return ruled.join(near, "id", "left")


def _gold(s, d):
    return table(s, d, "labels").selectExpr("doc_id AS id", f"{GOLD} AS expected")


def _pred(s, d):
    return table(s, d, "documents").selectExpr("doc_id AS id", f"{RULE} AS label")


def _scored(s, d):
    return table(s, d, "documents").selectExpr(
        "doc_id AS id", f"{RULE} AS ruled", f"{GUESS} AS guess", "CAST(n_chars AS DOUBLE) / 20000 AS similarity")


def _judged(s, d):
    words = lambda c: F.when(F.col(c) == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split(c, ";"))
    wanted = s.sql(f"SELECT * FROM {EXPECTED} AS t(query_id, must_list, not_list, min_results)").select(
        F.col("query_id").cast("bigint").alias("query_id"), words("must_list").alias("must"), words("not_list").alias("must_not"), "min_results")
    return V.judge_retrieval(_ranked(s, d), wanted)


QUERIES = {
    "score_labels": lambda s, d: V.score_labels(_pred(s, d), _gold(s, d)),
    "sweep_floor": lambda s, d: V.sweep_floor(_scored(s, d), _gold(s, d)),
    "label_errors": lambda s, d: V.label_errors(_pred(s, d), _gold(s, d)),
    "classifier_scores": lambda s, d: V.score_labels(_classified(s, d), _title_gold(s, d)),
    "classifier_sweep": lambda s, d: V.sweep_floor(_classified_at_any_floor(s, d), _title_gold(s, d)),
    "classifier_errors": lambda s, d: V.label_errors(_classified(s, d), _title_gold(s, d)),
    "judge_retrieval": lambda s, d: _judged(s, d).select("query_id", "results", "reason", "passed"),
    "retrieval_pass_rate": lambda s, d: V.retrieval_pass_rate(_judged(s, d)),
}

SCORES = """count(*) AS n_total, count(label) AS n_labelled, count(*) FILTER (label = expected) AS n_right"""
SHARES = """round(coalesce(n_labelled / nullif(n_total, 0), 0), 6) AS coverage, round(coalesce(n_right / nullif(n_labelled, 0), 0), 6) AS precision,
  round(coalesce(n_right / nullif(n_total, 0), 0), 6) AS correct"""
ITEMS = f"""WITH gold AS (SELECT doc_id AS id, {GOLD} AS expected FROM labels),
  docs AS (SELECT doc_id AS id, {RULE} AS label, {GUESS} AS guess, n_chars / 20000 AS similarity FROM documents),
  items AS (SELECT g.id, expected, label, guess, similarity FROM gold g LEFT JOIN docs USING (id) WHERE expected IS NOT NULL)"""
JUDGED = f"""
expected AS (SELECT CAST(query_id AS BIGINT) AS query_id, must_list, not_list, min_results FROM {EXPECTED} AS t(query_id, must_list, not_list, min_results)),
shown AS (SELECT r.query_id, lower(concat_ws(' ', c.name, coalesce(c.category, ''))) AS title, lower(coalesce(c.neighborhood, '')) AS hood
  FROM ranked r JOIN candidates c USING (query_id, id)),
j AS (SELECT e.query_id, min_results, must_list, count(title) AS results,
  coalesce(bool_or(not_list <> '' AND len(list_filter(string_split(not_list, ';'), lambda w: contains(title, w))) > 0), false) AS forbidden,
  coalesce(bool_or(must_list <> '' AND len(list_filter(string_split(must_list, ';'), lambda w: contains(title || ' ' || hood, w))) > 0), false) AS matched
  FROM expected e LEFT JOIN shown s USING (query_id) GROUP BY ALL),
judged AS (SELECT query_id, results, CASE WHEN results < min_results THEN 'too few results' WHEN results = 0 THEN 'nothing expected, nothing found'
  WHEN forbidden THEN 'forbidden word' WHEN must_list = '' THEN 'no word required' WHEN matched THEN 'matched' ELSE 'no result matched' END AS reason FROM j)"""
PASSED = "reason IN ('nothing expected, nothing found', 'no word required', 'matched')"

CLASSIFIED = (LISTINGS, SEMANTIC, labels_ctes("listings", "name", "'Events'", "NULL", "lab"), f"""
  r AS (SELECT id, name, list_filter({parents_sql('labels')}, lambda x: x <> 'Other')[1] AS ruled FROM lab),
  tried AS (SELECT id, {TITLE_GOLD} AS expected, ruled, guess, similarity, coalesce(ruled, CASE WHEN similarity >= 0.45 THEN guess END) AS label
    FROM r LEFT JOIN (SELECT id, {MEANT} AS guess, similarity FROM sem) g USING (id)),
  items AS (SELECT * FROM tried WHERE expected IS NOT NULL)""")
SWEPT = f"""f AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in V.FLOORS)}]) AS floor),
        floored AS (SELECT 'semantic' AS strategy, floor, expected, CASE WHEN similarity >= floor THEN guess END AS label FROM items, f
          UNION ALL SELECT 'hybrid', floor, expected, coalesce(ruled, CASE WHEN similarity >= floor THEN guess END) FROM items, f),
        t AS (SELECT strategy, floor, {SCORES} FROM floored GROUP BY ALL), s AS (SELECT *, {SHARES} FROM t)"""

ORACLES = {
    "classifier_scores": with_views(*CLASSIFIED, f"t AS (SELECT {SCORES} FROM items)", body=f"SELECT *, {SHARES} FROM t"),
    "classifier_sweep": with_views(*CLASSIFIED, SWEPT, body="""
        SELECT *, strategy = 'hybrid' AND floor = (SELECT floor FROM s WHERE strategy = 'hybrid' ORDER BY correct DESC, floor LIMIT 1) AS best FROM s"""),
    "classifier_errors": with_views(*CLASSIFIED, body="""SELECT id, expected, label, CASE WHEN label IS NULL THEN 'declined' ELSE 'wrong' END AS error
        FROM items WHERE label IS DISTINCT FROM expected"""),
    "score_labels": f"{ITEMS}, t AS (SELECT {SCORES} FROM items) SELECT *, {SHARES} FROM t",
    "sweep_floor": f"""{ITEMS}, f AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in V.FLOORS)}]) AS floor),
        tried AS (SELECT 'semantic' AS strategy, floor, expected, CASE WHEN similarity >= floor THEN guess END AS label FROM items, f
          UNION ALL SELECT 'hybrid', floor, expected, coalesce(label, CASE WHEN similarity >= floor THEN guess END) FROM items, f),
        t AS (SELECT strategy, floor, {SCORES} FROM tried GROUP BY ALL), s AS (SELECT *, {SHARES} FROM t)
        SELECT *, strategy = 'hybrid' AND floor = (SELECT floor FROM s WHERE strategy = 'hybrid' ORDER BY correct DESC, floor LIMIT 1) AS best FROM s""",
    "label_errors": f"""{ITEMS} SELECT id, expected, label, CASE WHEN label IS NULL THEN 'declined' ELSE 'wrong' END AS error FROM items
        WHERE label IS DISTINCT FROM expected""",
    "judge_retrieval": listing_query(f"SELECT query_id, results, reason, {PASSED} AS passed FROM judged", NEIGHBORHOODS, ASKED, RANKED, JUDGED),
    "retrieval_pass_rate": listing_query(f"""SELECT count(*) FILTER ({PASSED}) AS passed, count(*) AS total, 100 * count(*) FILTER ({PASSED}) // count(*) AS percent FROM judged""",
                                         NEIGHBORHOODS, ASKED, RANKED, JUDGED),
}
