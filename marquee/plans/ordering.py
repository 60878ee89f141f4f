"""Queries and oracles of feeds, duplicates, conversations."""

from pyspark.sql import functions as F

from marquee import vocab
from marquee.adapters import LISTINGS_AS_OF, chat_messages, listings, with_repeats
from marquee.operators import ordering as R
from marquee.plans.predicates import UP, no_match
from marquee.plans.views import MESSAGES, REPEATED, listing_query, q, with_views

AS_OF = LISTINGS_AS_OF
FEED_DAY = "CASE WHEN date < TIMESTAMP '1998-06-06' THEN TIMESTAMP '1998-06-06' ELSE date END"
# a third of the batch wants one free link, a third links the table holds, the rest new ones shared by pairs
HOT_URL = "CASE id % 3 WHEN 0 THEN 'http://hot.example/' WHEN 1 THEN page_url ELSE replace(page_url, 'listings', 'new') END"
BATCH_NAME = "CASE WHEN id > 10000000 THEN upper(name) ELSE name END"


def _batch(s, d):
    rows = with_repeats(listings(s, d, "id", "name", "date", "time", "page_url", "source")).selectExpr(
        "id AS position", "name", "date", "time", "source", f"{HOT_URL} AS url")
    return rows


def _current(messages):
    return messages.where("role = 'user'").groupBy("thread_id").agg(F.max_by("content", "id").alias("current_text"))


QUERIES = {
    "feed_order": lambda s, d: R.feed_order(listings(s, d, "id", "name", "date"), AS_OF).withColumn("feed_day", F.expr(
        "CASE WHEN date < TIMESTAMP_NTZ '1998-06-06' THEN TIMESTAMP_NTZ '1998-06-06' ELSE date END")).select("id", "feed_day"),
    "feed_page": lambda s, d: R.feed_page(listings(s, d, "id", "name", "date", "date_end"), AS_OF, 40, 100),
    "dedupe_keep_first": lambda s, d: R.dedupe_keep_first(with_repeats(listings(s, d, "id", "source", "name", "date", "time"))),
    "dedupe_batch": lambda s, d: R.dedupe_batch(
        with_repeats(listings(s, d, "id", "name", "date", "time")).selectExpr(
            "id AS position", f"{BATCH_NAME} AS name", "date_format(date, 'yyyy-MM-dd') AS date_text", "time")),
    "pick_per_category": lambda s, d: R.pick_per_category(
        listings(s, d, "id", "name", "date", "date_end", "category"), AS_OF, 3, 7).select("id", "category", "priority"),
    "recent_messages": lambda s, d: R.recent_messages(
        chat_messages(s, d), _current(chat_messages(s, d))).select("thread_id", "id", "role", "content", "position"),
    "transcript": lambda s, d: R.transcript(chat_messages(s, d)),
    "unique_urls": lambda s, d: R.unique_urls(_batch(s, d), listings(s, d, "id", "origination_url")).select(
        "position", "origination_url"),
    "conversation_budget": lambda s, d: R.conversation_budget(chat_messages(s, d)).select(
        "thread_id", "id", "tokens", "turns", "remaining_tokens", "remaining_turns", "warning", "complete"),
}

ORACLES = {
    "feed_order": listing_query(f"SELECT id, {FEED_DAY} AS feed_day FROM listings ORDER BY 2 NULLS LAST, lower(name), id"),
    "feed_page": listing_query(f"""SELECT id, name, date, date_end FROM listings WHERE {UP}
        ORDER BY {FEED_DAY} NULLS LAST, lower(name), id LIMIT 100 OFFSET 40"""),
    "dedupe_keep_first": listing_query("""SELECT id, source, name, date, time FROM (SELECT *, row_number() OVER (
        PARTITION BY source, lower(trim(name)), date, coalesce(time, '') ORDER BY id) AS n FROM repeated) WHERE n = 1 OR date IS NULL""", REPEATED),
    "dedupe_batch": listing_query(f""", b AS (SELECT id AS position, {BATCH_NAME} AS name, strftime(date, '%Y-%m-%d') AS date_text, time FROM repeated)
        SELECT position, name, date_text, time FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)), coalesce(date_text, ''),
        lower(trim(coalesce(time, ''))) ORDER BY position) AS n FROM b) WHERE n = 1""", REPEATED),
    "pick_per_category": listing_query(rf""", head AS (SELECT * FROM listings WHERE {UP}),
        fit AS (SELECT *, list_position([{', '.join(q(c) for c in vocab.GREETING_CATEGORIES)}], category) AS priority FROM head
          WHERE length(trim(name)) BETWEEN 4 AND 44 AND contains(trim(name), ' ') AND regexp_matches(trim(name), '^[\p{{L}}\p{{Nd}}]')
          AND {no_match('trim(name)', [vocab.TITLE_LEAD_WORDS, vocab.TITLE_STATUS])})
        SELECT id, category, priority FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(id || ':7'), id) AS n FROM fit
          WHERE priority > 0) WHERE n = 1 ORDER BY priority LIMIT 3"""),
    "recent_messages": with_views(MESSAGES, body="""
        , cur AS (SELECT thread_id, max_by(content, id) AS current_text FROM chat_messages WHERE role = 'user' GROUP BY 1),
        newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS n FROM chat_messages) WHERE n <= 7),
        kept AS (SELECT m.thread_id, m.id, role, trim(content) AS content, created_at FROM newest m LEFT JOIN cur USING (thread_id)
          WHERE trim(content) <> '' AND NOT (role = 'user' AND trim(content) IS NOT DISTINCT FROM trim(current_text))),
        f AS (SELECT thread_id, min(id) AS first_user FROM kept WHERE role = 'user' GROUP BY 1)
        SELECT thread_id, id, role, content, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) AS position
        FROM kept JOIN f USING (thread_id) WHERE id >= first_user"""),
    "transcript": with_views(MESSAGES, body="""SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY id) AS position, upper(role) || ': ' || content AS line FROM chat_messages"""),
    "unique_urls": listing_query(f""", b AS (SELECT id AS position, name, date, source, {HOT_URL} AS url FROM repeated),
        taken AS (SELECT origination_url FROM listings),
        c AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position) = 1 AND url NOT IN (SELECT * FROM taken) AS keeps FROM b),
        e AS (SELECT *, url || '#' || source || '-' || coalesce(strftime(date, '%Y-%m-%d'), 'nodate') || '-' || coalesce(name, '') AS derived FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY keeps, derived ORDER BY position) AS n FROM e)
        SELECT position, CASE WHEN keeps THEN url WHEN n = 1 THEN derived ELSE derived || '-' || position END AS origination_url FROM r""", REPEATED),
    "conversation_budget": with_views(MESSAGES, body="""
        , r AS (SELECT thread_id, id, role, CAST(sum(token_count) OVER w AS BIGINT) AS tokens,
          CAST(count(*) FILTER (role = 'assistant') OVER w AS BIGINT) AS turns FROM chat_messages
          WINDOW w AS (PARTITION BY thread_id ORDER BY id ROWS UNBOUNDED PRECEDING))
        SELECT thread_id, id, tokens, turns, greatest(0, 20000 - tokens) AS remaining_tokens, greatest(0, 12 - turns) AS remaining_turns,
          20000 - tokens < 5000 AS warning, tokens >= 20000 OR turns >= 12 AS complete FROM r WHERE role = 'assistant'"""),
}
