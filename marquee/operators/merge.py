"""Merges of new rows into the catalogue.

A merge reads the table and returns the new table; the caller writes it to a new path and swaps. The batch is
folded to one row per key first (map-side), so both sides of every join are unique on it and no key is hot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.dates import iso_local
from marquee.functions.labels import with_labels
from marquee.functions.text import keep_flagged
from marquee.lineage import settled
from marquee.operators.ordering import stored_matches, top_rows, unique_urls
from marquee.operators.places import dense_ids
from marquee.operators.predicates import looks_like_event

# Column policies per kind of source: overwrite always, overwrite_if_new when the batch has a value,
# fill_if_null only where the table has none. Columns without a policy keep what is stored.
POLICIES = {
    "ticket_api": {"latitude": "overwrite_if_new", "longitude": "overwrite_if_new", "cost": "overwrite_if_new",
                   "address": "fill_if_null", "venue_name": "fill_if_null", "neighborhood_id": "fill_if_null"},
    "city_api": {"latitude": "overwrite_if_new", "longitude": "overwrite_if_new", "address": "fill_if_null",
                 "venue_name": "fill_if_null", "date_end": "fill_if_null", "cost": "fill_if_null",
                 "neighborhood_id": "fill_if_null"},
    "programmes": {"date": "overwrite", "date_end": "overwrite", "venue_name": "fill_if_null",
                   "address": "fill_if_null", "neighborhood_id": "fill_if_null"},
    "touch": {},
}


def _present(c: Column, kind: str) -> Column:
    """The value when there is one; blank text is no value."""
    return F.nullif(c, F.lit("")) if kind == "string" else c


def _settle(policy: str, old: Column, new: Column, kind: str) -> Column:
    if policy == "overwrite":
        return new
    if policy == "overwrite_if_new":
        return F.coalesce(_present(new, kind), old)
    if policy == "fill_if_null":
        return F.coalesce(_present(old, kind), _present(new, kind), old)
    raise ValueError(f"unknown policy {policy}")


def merge_by_url(ev: DataFrame, batch: DataFrame, policy: dict[str, str], position: str = "position", highest: Column | None = None) -> DataFrame:
    """The table with a batch merged in by URL; `change` says what happened to each row.

    The first batch row per URL counts. A stored row takes the batch's `date_retrieved` and the columns the policy
    names; an unknown URL is inserted under the ids after `highest` (the table's own, unless `ev` is a part of one). A row without URL matches nothing and is not inserted;
    `merge_rejects` counts what a batch leaves out.
    """
    linked = batch.where(F.col("origination_url").isNotNull())
    first = top_rows(linked, ["origination_url"], [F.asc(position)], 1, "_n").drop("_n", position)
    known = stored_matches(ev.select("origination_url"), first, ["origination_url"]).distinct().withColumn("_known", F.lit(True))
    tagged = settled(first.join(known, "origination_url", "left"))
    new = tagged.where(F.col("_known")).drop("_known").alias("new")
    old = ev.alias("old")
    arrived = F.col("new.origination_url").isNotNull()
    columns = []
    for field in ev.schema:
        c = field.name
        rule = "overwrite" if c == "date_retrieved" else policy.get(c)
        value = F.col(f"old.{c}")
        if rule and c in first.columns:
            value = F.when(arrived, _settle(rule, value, F.col(f"new.{c}"), field.dataType.typeName())).otherwise(value)
        columns.append(value.alias(c))
    stored = old.join(new, F.col("old.origination_url") == F.col("new.origination_url"), "left").select(
        *columns, F.when(arrived, "updated").otherwise("kept").alias("change"))
    return stored.unionByName(_inserted(tagged.where(F.col("_known").isNull()), ev, "origination_url", highest))


def merge_rejects(batch: DataFrame) -> DataFrame:
    """(reason, n): batch rows `merge_by_url` leaves out, because they have no URL or repeat an earlier row's."""
    counts = batch.agg(F.count_if(F.col("origination_url").isNull()).alias("no_url"),
                       (F.count("origination_url") - F.count_distinct("origination_url")).alias("repeated"))
    return counts.selectExpr("stack(2, 'no_url', no_url, 'repeated', repeated) AS (reason, n)")


def _inserted(rows: DataFrame, ev: DataFrame, key: str, highest: Column | None = None) -> DataFrame:
    """New rows in the shape of the table, under ids after its highest."""
    placed = dense_ids(rows, key, _highest(ev) if highest is None else highest).withColumn("change", F.lit("inserted"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ev.schema if f.name not in placed.columns}
    return placed.withColumns(missing).select(*ev.columns, "change")


def _highest(ev: DataFrame) -> Column:
    return ev.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()


def fold_venue_batch(batch: DataFrame, position: str = "position") -> DataFrame:
    """One row per (name, source, date): what the batch's rows leave behind when applied in order.

    Times come from the last row; price and place from the last row that has one; the rest from the first. A row
    with a null in its key equals nothing and stays alone.
    """
    keys = ["name", "source", "date"]
    lone = F.when(F.col("name").isNull() | F.col("source").isNull() | F.col("date").isNull(), F.col(position))
    last = ["date_end", "time", "time_end", "date_retrieved"]
    latest_value = ["cost", "neighborhood_id"]
    present = {c: _present(F.col(c), batch.schema[c].dataType.typeName()) for c in latest_value}
    rest = [c for c in batch.columns if c not in [*keys, *last, *latest_value, position]]
    return batch.withColumn("_lone", lone).groupBy(*keys, "_lone").agg(
        F.min(position).alias(position),
        *[F.max_by(c, position).alias(c) for c in last if c in batch.columns],
        *[F.max_by(present[c], F.when(present[c].isNotNull(), F.col(position))).alias(c) for c in latest_value],
        *[F.min_by(c, position).alias(c) for c in rest]).drop("_lone")


def merge_venue_batch(ev: DataFrame, batch: DataFrame, position: str = "position") -> DataFrame:
    """The table with one venue run merged in by (name, source, date).

    A stored listing takes the run's times; its price and place are only ever filled or replaced, never blanked.
    The rest is inserted under a URL no one else holds. `batch` has the catalogue's columns with `url` in place of
    `origination_url`.
    """
    keys = ["name", "source", "date"]
    folded = fold_venue_batch(batch, position)
    hits = stored_matches(ev.select("id", *keys), folded, keys).groupBy(*keys).agg(F.min("id").alias("_id"))
    tagged = settled(folded.join(hits, keys, "left"))
    fields = [c for c in ("date_end", "time", "time_end", "date_retrieved") if c in batch.columns]
    filled = ["cost", "neighborhood_id"]
    updates = tagged.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in (*fields, *filled)])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    stored = ev.join(updates, "id", "left").withColumns({
        **{c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields},
        **{c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in filled},
        "change": F.when(hit, "updated").otherwise("kept"),
    }).select(*ev.columns, "change")
    news = settled(unique_urls(tagged.where(F.col("_id").isNull()), ev, position))
    return stored.unionByName(_inserted(news, ev, position))


def _card_status(cards: DataFrame) -> DataFrame:
    when = iso_local("date")
    status = (F.when(~looks_like_event("title"), "not_an_event")
              .when(F.col("url").isNull() | (F.col("url") == ""), "no_link")
              .when(when.isNull(), "undated").otherwise("event"))
    return cards.withColumns({"_status": status, "event_date": when})


def insert_only(ev: DataFrame, cards: DataFrame, position: str = "position", source: str = "web_search") -> DataFrame:
    """Rows to append from search cards: real events with a link and a date whose URL is not stored yet."""
    real = settled(top_rows(keep_flagged(_card_status(cards).withColumn("_event", F.col("_status") == "event"), "_event"),
                            ["url"], [F.asc(position)], 1, "_n"))
    known = stored_matches(ev.select(F.col("origination_url").alias("url")), real, ["url"])
    once = with_labels(real.join(known, "url", "left_anti"), "title", F.lit(vocab.GENERIC_CATEGORY), "type_hint")
    return once.select(
        F.col("title").alias("name"), F.col("event_date").alias("date"), F.col("location").alias("address"),
        F.col("venue").alias("venue_name"), F.col("labels").alias("categories"), F.col("url").alias("origination_url"),
        F.lit(source).alias("source")).withColumn(
        "category", F.coalesce(F.get("categories", F.lit(0)), F.lit(vocab.GENERIC_CATEGORY)))


def insert_counts(cards: DataFrame) -> DataFrame:
    """Cards per outcome before the lookup of stored links."""
    return _card_status(cards).groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("n"))


def candidate_union(sql_hits: DataFrame, semantic_hits: DataFrame, keys=("query_id",)) -> DataFrame:
    """Both candidate lists as one, structured rows first, every listing once."""
    both = sql_hits.withColumn("origin", F.lit(0)).unionByName(semantic_hits.withColumn("origin", F.lit(1)))
    return top_rows(both, [*keys, "id"], [F.asc("origin"), F.asc("position")], 1, "_n").drop("_n")


def fill_prices(ev: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices read elsewhere, set only where the listing has none; `prices` has one row per id."""
    found = prices.select("id", F.col("cost").alias("_found"))
    return ev.join(found, "id", "left").withColumn("cost", F.coalesce(
        F.nullif("cost", F.lit("")), F.nullif("_found", F.lit("")), F.col("cost"))).drop("_found")


def apply_changes(ev: DataFrame, changes: DataFrame) -> DataFrame:
    """The three label columns of changed rows rewritten, every other row as it is."""
    labels = ["category", "categories", "subcategories"]
    new = changes.select("id", F.lit(True).alias("_changed"), *[F.col(c).alias(f"_{c}") for c in labels])
    changed = F.coalesce(F.col("_changed"), F.lit(False))
    joined = ev.join(new, "id", "left")
    return joined.withColumns({c: F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)) for c in labels}).select(*ev.columns)
