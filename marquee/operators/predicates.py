"""Filters and row predicates over the catalogue. All are narrow: no shuffle, and the date and equality
comparisons are on bare columns so they reach the scan."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.dates import midnight, ntz
from marquee.functions.text import any_match, blank_as_null, col, collapse, first_words, folded


def runs_on_or_after(day) -> Column:
    """A run counts until its last day; a row without an end is a single day; undated rows never count."""
    at = ntz(midnight(day))
    return (F.col("date_end") >= at) | (F.col("date_end").isNull() & (F.col("date") >= at))


def upcoming(ev: DataFrame, as_of) -> DataFrame:
    return ev.where(runs_on_or_after(as_of))


def overlaps(ev: DataFrame, start, end) -> DataFrame:
    return ev.where((F.col("date") <= ntz(end)) & runs_on_or_after(start))


def starts_within(ev: DataFrame, start, end) -> DataFrame:
    """Containment of the start only, so a run already under way drops out."""
    return ev.where(F.col("date").between(ntz(start), ntz(end)))


def has_label(label: str) -> Column:
    want = label.strip().lower()
    return F.coalesce(folded("category") == want, F.lit(False)) | F.coalesce(
        F.exists("categories", lambda c: F.lower(c) == want), F.lit(False))


def category_is(ev: DataFrame, label: str) -> DataFrame:
    return ev.where(has_label(label))


def concept_match(concept: str, vocabulary=vocab.CONCEPTS) -> Column:
    """Whether a row's stored labels answer one concept."""
    canonical, _, prefixes, labels = vocabulary[concept]
    primary = F.lower("category")
    wanted = [canonical.lower(), *[x.lower() for x in labels]]
    tests = [primary.startswith(p) for p in prefixes]
    if labels:
        tests.append(primary.isin([x.lower() for x in labels]))
    tests.append(F.exists("categories", lambda c: F.lower(c).isin(wanted)))
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def category_by_concepts(ev: DataFrame, concepts, vocabulary=vocab.CONCEPTS) -> DataFrame:
    """Any of the concepts; naming no concept is no constraint, which differs from matching nothing."""
    if not concepts:
        return ev
    return ev.where(reduce(or_, [concept_match(c, vocabulary) for c in concepts]))


def keyword_any(ev: DataFrame, keywords) -> DataFrame:
    name = F.lower("name")
    return ev.where(reduce(or_, [name.contains(k.lower()) for k in keywords]))


def in_neighborhoods(ev: DataFrame, nb: DataFrame, names) -> DataFrame:
    chosen = nb.where(F.col("name").isin(list(names))).select(
        F.col("id").alias("neighborhood_id"), F.col("name").alias("neighborhood"))
    return ev.join(chosen, "neighborhood_id")


def event_by_id(ev: DataFrame, event_id: int) -> DataFrame:
    return ev.where(F.col("id") == event_id)


def audit_filter(logs: DataFrame, operation=None, status=None, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if operation:
        logs = logs.where(F.col("operation") == operation)
    if status:
        logs = logs.where(F.col("status") == status)
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def unpriced_with_link(ev: DataFrame, as_of, source=None, exclude_source=None) -> DataFrame:
    out = upcoming(ev, as_of).where(
        (F.col("cost").isNull() | (F.col("cost") == "")) & F.col("origination_url").startswith("http"))
    if source:
        out = out.where(F.col("source") == source)
    if exclude_source:
        out = out.where(F.col("source") != exclude_source)
    return out


def looks_like_event(title) -> Column:
    """Long enough to be a title, and not a page heading, a search result or a social post."""
    text = collapse(title)
    return F.coalesce((F.length(text) >= 10) & text.contains(" ") & ~any_match(text, vocab.NOT_AN_EVENT),
                      F.lit(False))


def reads_like_title(name) -> Column:
    text = F.trim(F.coalesce(col(name), F.lit("")))
    return (F.length(text).between(4, 44) & (F.size(F.split(collapse(text), " ")) >= 2)
            & text.rlike(r"^[\p{L}\p{Nd}]") & ~text.rlike(vocab.TITLE_LEAD_WORDS) & ~text.rlike(vocab.TITLE_STATUS))


def displayable_category(category) -> Column:
    """Not a placeholder and not a date. The month fragments are unanchored on purpose: "Market" fails."""
    low = F.lower(F.coalesce(col(category), F.lit("")))
    return ((F.length(F.trim(low)) >= 3) & ~low.isin(vocab.JUNK_CATEGORIES)
            & ~any_match(low, vocab.CATEGORY_DATE_PATTERNS))


def plausible_label(label) -> Column:
    """The collapsed label when it reads like one, else null."""
    text = collapse(label)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(F.length(text).between(2, 40) & ~text.rlike(vocab.LABEL_DATE_LIKE)
                  & (letters >= 2) & (letters * 2 >= F.length(text)), text)


def in_city_only(df: DataFrame, location: str = "location") -> DataFrame:
    where = F.lower(location)
    return df.where(~where.isin("virtual", "online", "") & where.contains("chicago"))


def display_fields(ev: DataFrame) -> DataFrame:
    """The label of the date and the short text a result card prints."""
    day = "EEE, MMM dd, yyyy"
    label = F.date_format("date", day)
    runs = F.col("date_end").isNotNull() & (F.to_date("date_end") != F.to_date("date"))
    clock = blank_as_null("time")
    return ev.withColumns({
        "date_label": F.when(F.col("date").isNull(), "Date not listed")
        .when(runs, F.concat(label, F.lit(" through "), F.date_format("date_end", day)))
        .when(clock.isNotNull(), F.concat(label, F.lit(" @ "), clock))
        .otherwise(label),
        "summary": first_words("details", 10),
    })
