"""Facets, counts and reports. Every one is a partial aggregate before its shuffle; listings of what is inside a
group come back as rows, never as one collected value that grows with the group."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.dates import midnight, ntz
from marquee.functions.labels import (normalize_label, parents_map, source_labels, source_slug, venue_key, venue_of)
from marquee.functions.text import each, folded
from marquee.operators.ordering import top_rows
from marquee.operators.predicates import (displayable_category, has_label, overlaps, upcoming)

VENUE_SOURCE = "chicago_venue_"


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def facet_categories(ev: DataFrame, nb: DataFrame, as_of, neighborhood=None, window=None) -> DataFrame:
    """Listings per label, over every label of a listing; narrowed by place and time but not by category."""
    rows = upcoming(ev, as_of).where(F.col("category").isNotNull())
    if window:
        rows = overlaps(rows, *window)
    if neighborhood:
        rows = rows.join(nb.where(F.col("name") == neighborhood).select(F.col("id").alias("neighborhood_id")),
                         "neighborhood_id", "left_semi")
    label = F.explode(F.coalesce("categories", F.array("category")))
    return rows.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("event_count")).orderBy(
        F.desc("event_count"), "label")


def facet_neighborhoods(ev: DataFrame, nb: DataFrame, as_of, category=None, window=None) -> DataFrame:
    """Listings per neighborhood; narrowed by category and time but not by place."""
    rows = upcoming(ev, as_of)
    if window:
        rows = overlaps(rows, *window)
    if category:
        rows = rows.where(has_label(category))
    return _per_neighborhood(rows, nb)


def _per_neighborhood(rows: DataFrame, nb: DataFrame) -> DataFrame:
    counts = rows.where(F.col("neighborhood_id").isNotNull()).groupBy("neighborhood_id").agg(
        F.count("*").alias("event_count"))
    return counts.join(nb.select(F.col("id").alias("neighborhood_id"), F.col("name").alias("neighborhood")),
                       "neighborhood_id").select("neighborhood", "event_count").orderBy(F.desc("event_count"), "neighborhood")


def neighborhood_counts(ev: DataFrame, nb: DataFrame, as_of, min_events: int = 3) -> DataFrame:
    return _per_neighborhood(upcoming(ev, as_of), nb).where(F.col("event_count") >= min_events)


def category_tiles(ev: DataFrame, as_of) -> DataFrame:
    """One tile per category whatever its casing, in its tidiest spelling."""
    stored = upcoming(ev, as_of).select("category").distinct().where(displayable_category("category"))
    first = F.substring("category", 1, 1)
    spelling = F.struct((~first.rlike(r"\p{Lu}")).alias("plain"), F.trim("category").alias("label"))
    return stored.groupBy(folded("category").alias("key")).agg(F.min(spelling)["label"].alias("category")).orderBy("key")


def all_categories(ev: DataFrame) -> DataFrame:
    return ev.select("category").where(F.col("category").isNotNull()).distinct()


def catalog_stats(ev: DataFrame, as_of, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return upcoming(ev, as_of).agg(
        F.count("*").alias("total_events"), distinct(F.col("category")).alias("unique_categories"),
        F.min("date").alias("earliest_event"), F.max("date").alias("latest_event"))


def catalog_facts(ev: DataFrame, nb: DataFrame, as_of) -> DataFrame:
    """What can be said about the catalogue: (fact, label, value)."""
    rows = upcoming(ev, as_of)
    totals = rows.agg(
        F.count("*").alias("total"),
        F.count_distinct(F.when(F.col("source").startswith(VENUE_SOURCE), F.col("source"))).alias("venues"),
        _count_if(F.lower("cost") == "free").alias("free"),
        F.count_distinct("neighborhood_id").alias("neighborhoods"))
    one_in = "CASE WHEN free > 0 THEN greatest(2L, CAST(bround(total / free) AS BIGINT)) END"
    lines = totals.selectExpr(
        f"""stack(5, 'total', total, 'venues', venues, 'free', free, 'one_in', {one_in},
            'neighborhoods', neighborhoods) AS (fact, value)""").selectExpr("fact", "CAST(NULL AS STRING) AS label", "value")
    top_place = _per_neighborhood(rows, nb).limit(1).select(
        F.lit("top_neighborhood").alias("fact"), F.col("neighborhood").alias("label"), F.col("event_count").alias("value"))
    day = F.date_format("date", "yyyy-MM-dd")
    busiest = rows.groupBy(day.alias("label")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(
        1).where("value > 1").select(F.lit("busiest_day").alias("fact"), "label", "value")
    return _union([lines, top_place, busiest])


def session_summary(threads: DataFrame, logs: DataFrame) -> DataFrame:
    """Conversation totals and audit operations as (kind, key, value). Averages are over completed sessions."""
    t = threads.agg(F.count("*").alias("total"), _count_if(F.col("status") == "completed").alias("completed"),
                    F.coalesce(F.sum("turn_count"), F.lit(0)).alias("turns"),
                    F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
    avg = "CASE WHEN completed > 0 THEN round({} / completed, 2) ELSE 0D END"
    totals = t.selectExpr(f"""stack(7, 'total_sessions', CAST(total AS DOUBLE), 'completed_sessions', CAST(completed AS DOUBLE),
        'active_sessions', CAST(total - completed AS DOUBLE), 'total_turns', CAST(turns AS DOUBLE),
        'total_tokens', CAST(tokens AS DOUBLE), 'avg_tokens_per_session', {avg.format('tokens')},
        'avg_turns_per_session', {avg.format('turns')}) AS (key, value)""").select(F.lit("session").alias("kind"), "key", "value")
    operations = logs.groupBy("operation").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("operation").alias("kind"), F.col("operation").alias("key"), "value")
    return _union([totals, operations])


def security_summary(logs: DataFrame, recent: int = 10, block_after: int = vocab.BLOCK_AFTER) -> DataFrame:
    """Counts of the three security operations, sessions with enough blocks to be shut out, and the newest blocks."""
    watched = [("security_blocked", "blocked_requests"), ("output_sanitized", "outputs_sanitized"),
               ("out_of_scope_question", "out_of_scope_questions")]
    none = F.lit(None).cast("timestamp_ntz").alias("at")
    counts = logs.where(F.col("operation").isin([o for o, _ in watched])).agg(
        *[_count_if(F.col("operation") == o).alias(name) for o, name in watched])
    counts = counts.selectExpr("stack(3, " + ", ".join(f"'{n}', {n}" for _, n in watched) + ") AS (key, n)").select(
        F.lit("count").alias("kind"), "key", "n", none)
    blocks = logs.where(F.col("operation") == "security_blocked")
    sessions = blocks.groupBy("thread_id").agg(F.count("*").alias("n")).where(F.col("n") >= block_after).select(
        F.lit("blocked_session").alias("kind"), F.col("thread_id").cast("string").alias("key"), "n", none)
    newest = blocks.orderBy(F.desc("created_at"), F.desc("id")).limit(recent).select(
        F.lit("recent_block").alias("kind"), F.col("thread_id").cast("string").alias("key"),
        F.col("id").alias("n"), F.col("created_at").alias("at"))
    return _union([counts, sessions, newest])


def threads_by_status(threads: DataFrame) -> DataFrame:
    return threads.groupBy("status").agg(F.count("*").alias("n"))


def _duplicate_keys(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("date").isNotNull()).select(
        "id", "source", folded("name").alias("name"), "date", F.coalesce("time", F.lit("")).alias("time"))


def duplicate_groups(ev: DataFrame) -> DataFrame:
    """Every listing that shares (source, name, date, time) with another, with the size of its group.

    One row per listing, not one list per group: a group may hold a large share of the table. The count per key
    combines map-side, and AQE splits the listing side of the join where a key is hot.
    """
    keyed = _duplicate_keys(ev)
    keys = ["source", "name", "date", "time"]
    repeated = keyed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count("*").alias("copies"), F.min("id").alias("keep_id")).where(F.col("copies") > 1)
    # rows without source or name are copies of each other too, as for `dedupe_keep_first`
    return keyed.join(repeated, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def cross_source_duplicates(ev: DataFrame) -> DataFrame:
    """Names and dates more than one source lists: reported, never merged."""
    return ev.groupBy(folded("name").alias("name"), "date").agg(
        F.count_distinct("source").alias("sources")).where(F.col("sources") > 1)


def catalog_manifest(ev: DataFrame, nb: DataFrame, as_of) -> DataFrame:
    """Counts worth noticing a change in, as (kind, key, n). Here a listing counts by its start date alone."""
    ahead = F.col("date") >= ntz(midnight(as_of))
    totals = ev.agg(F.count("*").alias("all"), _count_if(ahead).alias("upcoming"), _count_if(ahead).alias("dated"),
                    _count_if(ahead & F.col("neighborhood_id").isNotNull()).alias("placed"))
    totals = totals.selectExpr("stack(4, 'all', `all`, 'upcoming', upcoming, 'dated', dated, 'placed', placed) AS (key, n)").select(
        F.lit("total").alias("kind"), "key", "n")
    by_source = ev.where(ahead).groupBy("source").agg(F.count("*").alias("n")).select(
        F.lit("source").alias("kind"), F.col("source").alias("key"), "n")
    by_place = _per_neighborhood(ev.where(ahead), nb).select(
        F.lit("neighborhood").alias("kind"), F.col("neighborhood").alias("key"), F.col("event_count").alias("n"))
    return _union([totals, by_source, by_place])


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose count changed, losses first; a key missing on one side counts 0."""
    b = before.select("kind", "key", F.col("n").alias("before"))
    a = after.select("kind", "key", F.col("n").alias("after"))
    both = b.join(a, ["kind", "key"], "full").fillna(0, ["before", "after"])
    return both.where(F.col("before") != F.col("after")).withColumns({
        "delta": F.col("after") - F.col("before"), "lost": F.col("after") < F.col("before")}).orderBy("delta", "kind", "key")


def dated_share_by_source(ev: DataFrame, top: int = 15) -> DataFrame:
    mine = ev.where(F.col("source").startswith(VENUE_SOURCE) | (F.col("source") == "chicago_venues"))
    return mine.groupBy("source").agg(F.count("*").alias("listings"), F.count("date").alias("dated")).withColumn(
        "percent", F.bround(F.col("dated") * 100 / F.col("listings")).cast("bigint")).orderBy(
        F.desc("listings"), "source").limit(top)


def run_report(batch: DataFrame, venue: str = "venue_name") -> DataFrame:
    """What one run brought per venue."""
    return batch.groupBy(F.col(venue).alias("venue")).agg(
        F.count("*").alias("events"), F.count("date").alias("dated"),
        _count_if(F.col("cost") != "").alias("priced"))


def run_totals(before: DataFrame, after: DataFrame, as_of) -> DataFrame:
    """Upcoming and priced rows before and after a run, with the deltas."""
    def snapshot(ev: DataFrame, sign: int) -> DataFrame:
        return ev.where(F.col("date") >= ntz(midnight(as_of))).agg(
            F.count("*").alias("upcoming"), F.count("cost").alias("priced")).withColumn("side", F.lit(sign))

    sides = snapshot(before, 0).unionByName(snapshot(after, 1))
    def at(side, c):
        return F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0))

    return sides.agg(*[at(1, c).alias(c) for c in ("upcoming", "priced")],
                     *[(at(1, c) - at(0, c)).alias(f"{c}_delta") for c in ("upcoming", "priced")])


def price_distribution(ev: DataFrame, top: int = 4) -> DataFrame:
    """Priced listings per source and its commonest prices."""
    counts = ev.where(F.col("cost") != "").groupBy("source", "cost").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("priced"))
    best = top_rows(counts, ["source"], [F.desc("n"), F.asc("cost")], top, "place")
    shown = best.groupBy("source").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "cost", "n"))),
        lambda x: F.concat(x["cost"], F.lit(" x"), x["n"].cast("string"))), ", ").alias("prices"))
    return totals.join(shown, "source")


def venue_priors(ev: DataFrame, config: DataFrame, excluded_source: str = "ticket_api") -> DataFrame:
    """The category a venue's listings usually carry; a configured category overrides the tally."""
    silent = [vocab.PLACEHOLDER, "other", vocab.GENERIC_CATEGORY.lower(), ""]
    label = F.trim("category")
    voted = ev.where(F.col("source").isNull() | (F.col("source") != excluded_source)).select(
        "id", venue_of("venue_name", "details").alias("venue"), label.alias("category")).where(
        (F.col("venue") != "") & ~F.lower("category").isin(silent))
    tally = voted.groupBy(venue_key("venue").alias("venue_key"), "category").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"))
    learned = top_rows(tally, ["venue_key"], [F.desc("n"), F.asc("first_id")], 1, "_n").select(
        "venue_key", F.col("category").alias("learned"))
    declared = config.select(venue_key("name").alias("venue_key"), normalize_label("category").alias("declared"),
                             F.col("id").alias("_id")).where(~F.lower("declared").isin(silent))
    declared = declared.groupBy("venue_key").agg(F.max_by("declared", "_id").alias("declared"))
    return learned.join(declared, "venue_key", "full").select(
        "venue_key", F.coalesce("declared", "learned").alias("category"))


def unmapped_labels(ev: DataFrame, taxonomy=vocab.TAXONOMY) -> DataFrame:
    """Labels in use that the taxonomy does not place."""
    labels = each(ev, [], source_labels("category", "categories", "subcategories"), "_at", "label").select("label").distinct()
    clean = labels.select(normalize_label("label").alias("label")).where("label IS NOT NULL").distinct()
    return clean.where(F.try_element_at(parents_map(taxonomy), F.lower("label")).isNull())


def label_moves(changes: DataFrame, top: int = 12) -> DataFrame:
    """Counts of primary label changes, commonest first; `changes` has old_category and category."""
    moved = changes.where(~F.col("old_category").eqNullSafe(F.col("category")))
    move = F.concat(F.coalesce(F.nullif("old_category", F.lit("")), F.lit("-")), F.lit(" -> "), F.col("category"))
    return moved.groupBy(move.alias("move")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "move").limit(top)


def links_by_source(ev: DataFrame, as_of) -> DataFrame:
    """One link per source to try, so a source whose links all broke shows up."""
    return upcoming(ev, as_of).where(F.col("origination_url").startswith("http")).groupBy("source").agg(
        F.min("origination_url").alias("url"))


def link_report(checks: DataFrame) -> DataFrame:
    """Usable and broken links per source; a link is usable on any 2xx or 3xx answer."""
    usable = F.col("code").between(200, 399)
    return checks.groupBy("source").agg(F.count("*").alias("checked"), _count_if(usable).alias("usable"),
                                        _count_if(~usable).alias("broken"))


def zero_output_venues(config: DataFrame, ev: DataFrame, as_of) -> DataFrame:
    """Every configured venue with what it has coming up; a venue with nothing is flagged."""
    ahead = ev.where((F.col("date") >= ntz(midnight(as_of))) & F.col("source").startswith(VENUE_SOURCE)).groupBy(
        "source").agg(F.count("*").alias("n"))
    out = config.withColumn("source", source_slug("name")).join(ahead, "source", "left")
    return out.select("neighborhood", "name", "source", F.coalesce("n", F.lit(0)).alias("future_events"),
                      F.when(F.coalesce("n", F.lit(0)) > 0, "ok").otherwise("ZERO").alias("flag"))
