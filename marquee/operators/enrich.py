"""Enrichment jobs: a listing table in, the same rows with more columns out. All narrow."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.enrichment import enriched, locality
from marquee.functions.labels import (informative_subtags, labels_to_parents, normalize_label, title_rule, with_labels)
from marquee.functions.money import (jsonld_blocks, offer_amounts, offers_in_blocks, render_price, rule_price,
                                     visible_text)


def enrich(df: DataFrame) -> DataFrame:
    """Price, age, setting, address and venue read from the text; a column is only set where something is found."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(found, F.col(c)) if c in have else found
                           for c, found in enriched("name", "details").items()})


def page_price(pages: DataFrame, source: str = "source") -> DataFrame:
    """The price on a listing's own page: structured data first, then the sentence its source prints it in."""
    blocks = jsonld_blocks("html")
    relevant = F.when(F.exists(blocks, lambda b: b.contains('"offers"')), blocks)
    amounts = F.transform(offers_in_blocks(relevant), offer_amounts)
    first = F.get(F.filter(F.transform(amounts, render_price), lambda p: p.isNotNull()), F.lit(0))
    staged = pages.withColumns({"_structured": first, "_text": visible_text("html")})
    return staged.withColumn("cost", F.coalesce("_structured", rule_price(source, "_text"))).drop("_structured", "_text")


def canonical_event(df: DataFrame) -> DataFrame:
    """The boundary every source passes: locality, spelling, title rule, labels, parents and finer labels.

    `df` has name, category, address, locality, category_hint, categories, subcategories.
    """
    spelled = F.coalesce(normalize_label("category"), F.col("category"))
    ruled = df.withColumn("category", F.coalesce(title_rule("name"), spelled))
    labelled = with_labels(ruled, "name", "category", "category_hint", "_labels").withColumn(
        "_labels", F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.col("_labels")))
    rolled = labelled.withColumn("_parents", labels_to_parents("_labels"))
    finer = informative_subtags("_labels", "_parents")
    known = F.size("_parents") > 0
    return rolled.withColumns({
        "locality": F.coalesce("locality", locality("address")),
        "category": F.when(known, F.get("_parents", F.lit(0))).otherwise(F.col("category")),
        "categories": F.when(known, F.col("_parents")).otherwise(F.col("categories")),
        "subcategories": F.coalesce("subcategories", F.when(F.size(finer) > 0, finer)),
    }).drop("_labels", "_parents")
