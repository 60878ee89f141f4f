"""Feeds, top-k, duplicates, running totals.

Groups may be arbitrarily hot. Three rules keep that safe: a `row_number() <= k` window is cut to k rows per
group before the shuffle (Spark's window group limit), a "first of the group" is a `min` that combines map-side
and is joined back on the unique row id, and running totals go through fixed-width blocks of the order column,
so no task ever holds a whole group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.dates import midnight, ntz
from marquee.functions.text import folded
from marquee.operators.predicates import reads_like_title, upcoming


def feed_keys(as_of) -> list[Column]:
    """A run already under way sorts as today; names then ids make the order total."""
    day = ntz(midnight(as_of))
    return [F.when(F.col("date") < day, day).otherwise(F.col("date")).asc_nulls_last(),
            F.lower("name").asc_nulls_last(), F.col("id").asc()]


def feed_order(ev: DataFrame, as_of) -> DataFrame:
    return ev.orderBy(*feed_keys(as_of))


def feed_page(ev: DataFrame, as_of, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of the upcoming feed; past the end it is empty. Plans as a top-(skip + limit), not a full sort."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be >= 0 and limit between 1 and 100")
    return feed_order(upcoming(ev, as_of), as_of).offset(skip).limit(limit)


def top_rows(df: DataFrame, keys, order, k: int, rank: str = "position") -> DataFrame:
    """The first k rows of each group by a total order."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def stored_matches(ev: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """The stored rows a batch is about.

    Written with the batch as the side a semi join builds from: while the batch is small it is broadcast and the table
    is only scanned, where looking the batch up in the table would shuffle the table's keys.
    """
    keys = list(keys)
    return ev.join(batch.select(*keys), keys, "left_semi")


def dedupe_keep_first(ev: DataFrame) -> DataFrame:
    """Lowest id of each (source, name, date, time) group. An undated row is a group of its own, so it stays."""
    own = F.when(F.col("date").isNull(), F.col("id"))
    keyed = ev.withColumns({"_name": folded("name"), "_time": F.coalesce("time", F.lit("")), "_own": own})
    return top_rows(keyed, ["source", "_name", "date", "_time", "_own"], [F.asc("id")], 1, "_n").drop(
        "_name", "_time", "_own", "_n")


def dedupe_batch(batch: DataFrame, position: str = "position") -> DataFrame:
    """First row of the batch per (name, date text, time)."""
    keyed = batch.withColumns({"_name": F.coalesce(folded("name"), F.lit("")),
                               "_date": F.coalesce(F.trim("date_text"), F.lit("")),
                               "_time": F.coalesce(folded("time"), F.lit(""))})
    return top_rows(keyed, ["_name", "_date", "_time"], [F.asc(position)], 1, "_n").drop("_name", "_date", "_time", "_n")


def pick_per_category(ev: DataFrame, as_of, k: int = 3, seed: int = 0, pool: int | None = None,
                      priority=tuple(vocab.GREETING_CATEGORIES)) -> DataFrame:
    """A few things, each of another kind: one pseudo-random pick per category among the feed, or its first `pool` rows where that is given."""
    feed = upcoming(ev, as_of).where(F.col("name").isNotNull())
    head = feed_order(feed, as_of).limit(pool) if pool else feed
    fit = head.where(F.col("category").isin(list(priority)) & reads_like_title("name"))
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    one = top_rows(fit, ["category"], [draw.asc(), F.asc("id")], 1, "_n").drop("_n")
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("category"))
    return one.withColumn("priority", rank).orderBy("priority").limit(k)


def running(df: DataFrame, keys, order: str, sums: dict[str, Column], width: int = 100_000) -> DataFrame:
    """Inclusive running sums per group, in the order of a unique integer column.

    Rows are windowed inside blocks of `width` consecutive order values, so a window partition never holds more
    than `width` rows; each block then adds the total of the group's earlier blocks, which are summed map-side.
    """
    keys = list(keys)
    block = F.floor(F.col(order) / F.lit(width))
    terms = {f"_s_{name}": expr for name, expr in sums.items()}
    valued = df.withColumns({"_block": block, **terms})
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.groupBy(*keys, "_block").agg(*[F.sum(t).alias(t) for t in terms])
    offsets = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_o{t}") for t in terms])
    local = valued.withColumns({t: F.sum(t).over(inside) for t in terms})
    own = {k: f"_k{i}" for i, k in enumerate([*keys, "_block"])}
    offsets = offsets.withColumnsRenamed(own)
    # null keys are a group like any other
    out = local.join(offsets, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]).drop(*own.values())
    return out.withColumns({name: F.col(f"_s_{name}") + F.col(f"_o_s_{name}") for name in sums}).drop(
        "_block", *terms, *[f"_o{t}" for t in terms])


def recent_messages(messages: DataFrame, current: DataFrame, n: int = 6) -> DataFrame:
    """The newest n messages before the current one, oldest first, never opening with a reply.

    `current` holds (thread_id, current_text); a user row repeating it is the message being answered.
    """
    newest = top_rows(messages, ["thread_id"], [F.desc("created_at"), F.desc("id")], n + 1, "_n").drop("_n")
    told = newest.withColumn("content", F.trim("content")).where(F.col("content") != "")
    told = told.join(current, "thread_id", "left").where(
        ~((F.col("role") == "user") & F.col("content").eqNullSafe(F.trim("current_text")))).drop("current_text")
    in_order = Window.partitionBy("thread_id").orderBy("created_at", "id")
    asked = F.max(F.col("role") == "user").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumns({"_asked": asked}).where("_asked").withColumn(
        "position", F.row_number().over(in_order)).drop("_asked")


def transcript(messages: DataFrame) -> DataFrame:
    """(thread_id, position, line): "ROLE: text" lines per thread, numbered in arrival order (ids are handed out on arrival).

    One row per line, whole, so a thread of any length is never one value. Messages without a thread are one of their own.
    """
    placed = running(messages, ["thread_id"], "id", {"position": F.lit(1)})
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    return placed.select("thread_id", "position", line.alias("line"))


def unique_urls(batch: DataFrame, ev: DataFrame, position: str = "position") -> DataFrame:
    """A free URL for every new row of a batch.

    The first row of the batch to ask for a URL gets it if the table does not hold it. The others get one derived
    from source, date and name; whoever finds that one claimed too, in the batch or the table, appends its position. First claims
    are `min`s joined back on the row's position, so one URL shared by most of the batch does not gather in a task.
    """
    claims = batch.groupBy(F.col("url").alias("_url")).agg(F.min(position).alias("_pos"))
    taken = stored_matches(ev.select(F.col("origination_url").alias("_url")), claims, ["_url"])
    free = claims.join(taken, "_url", "left_anti").select(
        F.col("_pos"), F.lit(True).alias("_first"))
    named = batch.join(free, F.col(position) == F.col("_pos"), "left").drop("_pos")
    derived = F.concat(F.col("url"), F.lit("#"), F.col("source"), F.lit("-"),
                       F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("nodate")), F.lit("-"),
                       F.coalesce("name", F.lit("")))
    named = named.withColumn("_derived", F.when(F.col("_first").isNull(), derived))
    wanted = named.where(F.col("_derived").isNotNull()).groupBy("_derived").agg(F.min(position).alias("_pos"))
    held = stored_matches(ev.select(F.col("origination_url").alias("_derived")), wanted, ["_derived"])
    second = wanted.join(held, "_derived", "left_anti").select(F.col("_pos"), F.lit(True).alias("_second"))
    out = named.join(second, F.col(position) == F.col("_pos"), "left").drop("_pos")
    return out.withColumn(
        "origination_url",
        F.when(F.col("_first"), F.col("url")).when(F.col("_second"), F.col("_derived"))
        .otherwise(F.concat(F.col("_derived"), F.lit("-"), F.col(position).cast("string")))
    ).drop("_first", "_second", "_derived")


def budget_columns() -> dict[str, Column]:
    """What is left of a conversation's budget, from its running tokens and turns."""
    tokens_left = F.lit(vocab.TOKEN_BUDGET) - F.col("tokens")
    turns_left = F.lit(vocab.TURN_BUDGET) - F.col("turns")
    return {
        "remaining_tokens": F.greatest(F.lit(0), tokens_left),
        "remaining_turns": F.greatest(F.lit(0), turns_left),
        "warning": tokens_left < vocab.TOKEN_BUDGET * vocab.WARN_SHARE,
        "complete": (tokens_left <= 0) | (turns_left <= 0),
    }


def conversation_budget(messages: DataFrame) -> DataFrame:
    """Budget status after every assistant turn."""
    summed = running(messages, ["thread_id"], "id", {
        "tokens": F.col("token_count").cast("bigint"),
        "turns": F.when(F.col("role") == "assistant", 1).otherwise(0)})
    return summed.where(F.col("role") == "assistant").withColumns(budget_columns())
