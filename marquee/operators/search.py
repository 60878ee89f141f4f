"""Search: a table of requests joined to the catalogue, retrieved, scored, ranked and routed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.dates import days_later, ntz
from marquee.functions.labels import concepts_in
from marquee.functions.query import extract_keywords, extract_places, extract_window, strip_places
from marquee.functions.text import col, each, let
from marquee.functions.vectors import cosine, nearest_in_blocks, norm, unit
from marquee.lineage import settled
from marquee.operators.ordering import feed_keys, top_rows
from marquee.operators.places import with_neighborhood
from marquee.operators.predicates import concept_match, upcoming

#: Letters of the pieces names and keywords meet on.
PIECE = 3
#: Shares of the listings where requests without words are asked for all their hits.
SALTS = 32
#: Tokens at most that are common enough to meet their vectors by broadcast.
COMMON = 4096


def understand(queries: DataFrame, as_of, nb: DataFrame | None = None, text: str = "text", most: int | None = None) -> DataFrame:
    """What each request asks for. With `nb` the places it names become filters and leave the keywords, of which the first `most` count."""
    start, end = extract_window(text, as_of)
    out = queries.withColumns({"keywords": extract_keywords(text, most), "concepts": concepts_in(text),
                               "window_start": start, "window_end": end})
    if nb is None:
        return out.withColumn("places", F.expr("CAST(array() AS ARRAY<STRING>)"))
    out = extract_places(out, text, nb)
    return out.withColumn("keywords", strip_places("keywords", "places", text))


def _row_concepts() -> Column:
    return F.array_compact(F.array(*[F.when(concept_match(c), F.lit(c)) for c in vocab.CONCEPTS]))


def _asked(queries: DataFrame) -> DataFrame:
    named = queries.withColumnsRenamed({"category": "_category"}) if "category" in queries.columns else queries.withColumn(
        "_category", F.lit(None).cast("string"))
    return named.select("query_id", "keywords", "concepts", "places", "window_start", "window_end", "_category")


def _silent() -> Column:
    """A request without words or concepts, which every listing answers that meets its constraints."""
    return (F.size("keywords") == 0) & (F.size("concepts") == 0)


def _met() -> Column:
    """The constraints of a request, over a pair."""
    want = F.lower(F.trim("_category"))
    labelled = F.col("_category").isNull() | F.coalesce(F.lower(F.trim("category")) == want, F.lit(False)) | F.coalesce(
        F.exists("categories", lambda c: F.lower(c) == want), F.lit(False))
    placed = (F.size("places") == 0) | F.coalesce(F.array_contains("places", F.col("neighborhood")), F.lit(False))
    opens = F.date_trunc("day", F.col("window_start")).cast("timestamp_ntz")
    within = F.col("window_start").isNull() | ((F.col("date") <= F.col("window_end")) & (
        (F.col("date_end") >= opens) | (F.col("date_end").isNull() & (F.col("date") >= opens))))
    return labelled & placed & within


def _spoken_hits(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of requests that say something: a keyword in the name or a concept, and all the constraints.

    Substring matching as an equi-join: a listing offers the pieces of its name, of three letters and of fewer where a keyword has
    fewer, and its concepts as tokens, a request the first piece of each keyword and its concepts. Only (id, token) is exploded and
    meets the requests; the distinct (request, id) pairs then take the listing and the request along and are checked in full.
    """
    spoken = asked.where(~_silent())
    first = F.transform("keywords", lambda k: F.substring(k, 1, PIECE))
    lengths = spoken.select(F.explode(F.array_union(F.transform(first, F.length), F.array(F.lit(PIECE)))).alias("n")).where("n > 0").agg(
        F.collect_set("n").alias("n")).scalar()  # up to three numbers
    low = F.lower("name")
    pieces = F.flatten(F.transform(F.col("_lengths"), lambda n: F.when(F.length(low) >= n, F.transform(
        F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))))

    def marks(concepts) -> Column:
        return F.transform(concepts, lambda c: F.concat(F.lit("#"), c))

    tokens = spoken.select("query_id", F.explode(F.array_distinct(F.concat(first, marks("concepts")))).alias("_token"))
    offers = F.array_distinct(F.concat(F.coalesce(pieces, F.array().cast("array<string>")), marks(_row_concepts())))
    offered = each(rows.withColumn("_lengths", lengths), ["id"], offers, "_at", "_token").drop("_at")
    met = offered.join(tokens, "_token").select("query_id", "id").distinct()
    said = F.exists("keywords", lambda k: F.lower("name").contains(k)) | F.arrays_overlap("concepts", _row_concepts())
    return rows.join(met, "id").join(spoken, "query_id").where(_met()).where(said)


def search_hits(ev: DataFrame, nb: DataFrame, queries: DataFrame, as_of) -> DataFrame:
    """Every (request, listing) pair that matches. Requests that say nothing meet all listings, in `SALTS` shares of them, as that is their
    result; `search_feed` and `structured_candidates` give the first of them without."""
    rows, asked = with_neighborhood(upcoming(ev, as_of), nb), _asked(queries)
    share = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_share")
    everywhere = rows.withColumn("_share", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(
        asked.where(_silent()).select("*", share), "_share").drop("_share").where(_met())
    return _spoken_hits(rows, asked).unionByName(everywhere).drop("_category")


def _first_hits(ev: DataFrame, nb: DataFrame, queries: DataFrame, as_of, k: int) -> DataFrame:
    """The first k hits of every request in feed order, with their position.

    Requests that say nothing are told apart by which constraints they have, eight kinds at most. Of listings that are alike in all a kind
    looks at, only the first k can be among any request's first k; they are cut to those before the shuffle, and only what is left
    meets the requests of that kind.
    """
    rows, asked = with_neighborhood(upcoming(ev, as_of), nb), _asked(queries)
    kind = F.concat(F.when(F.size("places") > 0, "p").otherwise(""), F.when(F.col("_category").isNotNull(), "c").otherwise(""),
                    F.when(F.col("window_start").isNotNull(), "w").otherwise(""))
    silent = asked.where(_silent()).withColumn("_kind", kind)
    kinds = silent.agg(F.collect_set("_kind").alias("k")).scalar()

    def seen(letter: str, value: Column) -> Column:
        return F.when(F.col("_kind").contains(letter), value)

    alike = each(rows.withColumn("_kinds", kinds), rows.columns, F.col("_kinds"), "_at", "_kind").drop("_at").withColumns({
        "_p": seen("p", F.col("neighborhood")), "_c": seen("c", F.struct("category", "categories")), "_w": seen("w", F.struct("date", "date_end"))})
    head = top_rows(alike, ["_kind", "_p", "_c", "_w"], feed_keys(as_of), k, "_n").drop("_n", "_p", "_c", "_w")
    told = head.join(silent, "_kind").drop("_kind").where(_met())
    hits = _spoken_hits(rows, asked).unionByName(told).drop("_category")
    return top_rows(hits, ["query_id"], feed_keys(as_of), k)


def search_feed(ev: DataFrame, nb: DataFrame, queries: DataFrame, as_of, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of feed-ordered hits per request."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be >= 0 and limit between 1 and 100")
    return _first_hits(ev, nb, queries, as_of, skip + limit).where(F.col("position") > skip)


def structured_candidates(ev: DataFrame, nb: DataFrame, queries: DataFrame, as_of, placed: int = vocab.CEILING_PLACED,
                          unplaced: int = vocab.CEILING_OPEN) -> DataFrame:
    """The head of the feed per request: `placed` rows when it names a place, else `unplaced`."""
    head = _first_hits(ev, nb, queries, as_of, max(placed, unplaced))
    return head.where(F.col("position") <= F.when(F.size("places") > 0, placed).otherwise(unplaced))


def event_document(name="name", category="category", venue="venue_name") -> Column:
    """The text a listing is indexed under."""
    return F.concat_ws(". ", *[F.nullif(col(c), F.lit("")) for c in (name, category, venue)])


def token_vectors(tokens: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """A vector per distinct token by seeded hashing, each element in [-1, 1). Stands in for a fetched token table."""
    def element(j: int) -> Column:
        digest = F.md5(F.concat_ws(":", "token", F.lit(str(j)), F.lit(str(seed))))
        return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 32768.0 - 1.0

    return tokens.select("token").distinct().withColumn("vector", F.array(*[element(j) for j in range(dims)]))


def tokens_of(text) -> Column:
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda w: w != "")


def embed_static(docs: DataFrame, vectors: DataFrame, dims: int, text: str = "text", most: int = COMMON) -> DataFrame:
    """Documents as the unit-length mean of their tokens' vectors.

    The mean is one sum per dimension, combined map-side. Documents are split once and stored. Tokens that make up a share of 1 / `most` of
    all occurrences, `most` of them at most, meet their vectors by broadcast, without a shuffle; only the rarer ones are shuffled to
    theirs, and none of them fills a task.
    """
    split = settled(docs.select("id", tokens_of(text).alias("tokens")))
    tokens = each(split, ["id"], F.col("tokens"), "_at", "token").drop("_at")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    least = split.agg(F.sum(F.size("tokens")) / most).scalar()
    common = [r["token"] for r in counts.where(F.col("n") >= least).select("token").collect()]  # `most` at most
    known = F.col("token").isin(common)
    met = tokens.where(~known).join(vectors, "token").unionByName(tokens.where(known).join(F.broadcast(vectors.where(known)), "token"))
    pooled = met.groupBy("id").agg(*[F.avg(F.get("vector", F.lit(j))).alias(f"d{j}") for j in range(dims)])
    return pooled.select("id", unit(F.array(*[F.col(f"d{j}") for j in range(dims)])).alias("embedding"))


def nearest(queries: DataFrame, index: DataFrame, k: int = vocab.SEMANTIC_K, floor: float = vocab.SEMANTIC_FLOOR) -> DataFrame:
    """The k most similar rows of each request at or above the floor, exact.

    Cutting at the floor first leaves the same rows as cutting after the top k. Each block of the index keeps its own
    best k per request, so what is shuffled after the products is k rows per request and block.
    """
    found = nearest_in_blocks(queries, index, k, floor)
    return top_rows(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def scores_for(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """Similarity of given (query_id, id) pairs; listings the index lacks are left out."""
    asked = queries.where(norm("embedding") > 0).select("query_id", F.col("embedding").alias("_q"))
    return pairs.join(index.select("id", "embedding"), "id").join(asked, "query_id").withColumn(
        "similarity", F.round(cosine("embedding", "_q"), 6)).drop("embedding", "_q")


def semantic_candidates(ev: DataFrame, nb: DataFrame, queries: DataFrame, matches: DataFrame, as_of) -> DataFrame:
    """Similar listings that are upcoming, in the places named and starting in the window; running events drop out."""
    asked = queries.select("query_id", "places", "window_start", "window_end")
    near = matches.select("query_id", "id", "similarity", "position").join(asked, "query_id")
    rows = with_neighborhood(upcoming(ev, as_of), nb).join(near, "id")
    opens = F.date_trunc("day", F.col("window_start")).cast("timestamp_ntz")
    placed = (F.size("places") == 0) | F.coalesce(F.array_contains("places", F.col("neighborhood")), F.lit(False))
    within = F.col("window_start").isNull() | F.col("date").between(opens, F.col("window_end"))
    return rows.where(placed & F.coalesce(within, F.lit(False)))


_STRIP = r"^[.,!?;:'\"()-]+|[.,!?;:'\"()-]+$"


def relevance(as_of, name="name", category="category", keywords="keywords", concepts="concepts",
              similarity="similarity", date="date") -> Column:
    """Score of a listing for a request, 0 to 1: words, meaning, category and how soon."""
    stored = F.coalesce(col(category), F.lit(""))
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", col(name), stored)), r"\s+", " ")), " "),
                        lambda w: F.regexp_replace(w, _STRIP, ""))
    both = let(words, lambda ws: F.struct(ws.alias("words"), F.transform(
        F.filter(ws, lambda w: w != ""), lambda w: F.regexp_replace(w, "s+$", "")).alias("stems")))
    hits = let(both, lambda b: F.size(F.filter(col(keywords), lambda k: F.array_contains(b["words"], k) | F.array_contains(
        b["stems"], F.regexp_replace(k, "s+$", "")))))
    by_word = F.when(hits > 0, F.least(F.lit(0.4), F.lit(0.15) + hits / F.greatest(F.size(col(keywords)), F.lit(1)) * 0.25))
    by_meaning = F.when(col(similarity) > 0, F.least(F.lit(0.4), col(similarity) * 0.9))
    # concept keys, not labels: the label "Arts" does not equal the key "art"
    by_label = F.when((stored != "") & F.array_contains(col(concepts), F.lower(stored)), F.lit(0.15))
    when = col(date)
    soon = F.when(when >= ntz(as_of), F.when(when < ntz(days_later(as_of, 8)), 0.05).when(
        when < ntz(days_later(as_of, 31)), 0.03).otherwise(0.01))
    parts = [F.coalesce(p, F.lit(0.0)) for p in (by_word, by_meaning, by_label, soon)]
    return F.round(F.least(F.lit(1.0), parts[0] + parts[1] + parts[2] + parts[3]), 6)


def rank_candidates(candidates: DataFrame, as_of, k: int = vocab.TOP_RESULTS) -> DataFrame:
    """The best k candidates per request; equals keep candidate order (origin, position, id)."""
    scored = candidates.withColumn("confidence", relevance(as_of))
    return top_rows(scored, ["query_id"], [F.desc("confidence"), F.asc("origin"), F.asc("position"), F.asc("id")], k, "rank")


def route_search(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """What to answer per request, and whether to look outside the catalogue."""
    found = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    out = queries.select("query_id").join(found, "query_id", "left").withColumns({
        "results": F.coalesce("n", F.lit(0)), "best_confidence": F.coalesce("best", F.lit(0.0))}).drop("n", "best")
    low = F.col("best_confidence") < vocab.CONFIDENCE_FLOOR
    return out.withColumns({
        "route": F.when(F.col("results") == 0, "NO_RESULTS").when(low, "LOW_CONFIDENCE").otherwise("OK"),
        "may_go_external": (F.col("results") < vocab.TOP_RESULTS) | low})


def route_intent(df: DataFrame, intent: str = "intent", confidence: str = "confidence") -> DataFrame:
    """What to do with a classified message."""
    events = F.col(intent).isin("chicago_events")
    return df.withColumn("route", F.when(F.col(intent) == "farewell", "end").when(
        ~events & (F.col(confidence) >= 0.85), "redirect").when(
        ~events & (F.col(confidence) >= 0.65), "clarify").otherwise("run"))
