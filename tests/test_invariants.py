"""What has to hold over a whole catalogue."""

from pyspark.sql import functions as F

from marquee.adapters import LISTINGS_AS_OF, listings, neighborhoods
from marquee.operators import aggregates as A
from marquee.operators import ordering as R
from marquee.operators import predicates as P
from marquee.plans import registry

AS_OF = LISTINGS_AS_OF


def catalog(spark, sf_dir):
    return listings(spark, sf_dir, "id", "name", "date", "date_end", "category", "categories", "neighborhood_id")


def test_facet_counts_equal_what_the_filter_returns(spark, sf_dir):
    ev, nb = catalog(spark, sf_dir).withColumn("categories", F.array_distinct("categories")), neighborhoods(spark, sf_dir)
    for r in A.facet_neighborhoods(ev, nb, AS_OF).limit(3).collect():
        assert P.in_neighborhoods(P.upcoming(ev, AS_OF), nb, [r["neighborhood"]]).count() == r["event_count"]
    total = {r["label"]: r["event_count"] for r in A.facet_categories(ev, nb, AS_OF).collect()}
    assert total["LGBTQ"] == P.category_is(P.upcoming(ev, AS_OF).where("category IS NOT NULL"), "LGBTQ").count()


def test_pages_do_not_overlap_and_cover_the_feed(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    pages = [[r["id"] for r in R.feed_page(ev, AS_OF, skip, 50).collect()] for skip in (0, 50, 100)]
    whole = [r["id"] for r in R.feed_order(P.upcoming(ev, AS_OF), AS_OF).limit(150).collect()]
    assert sum(pages, []) == whole
    assert R.feed_page(ev, AS_OF, 10_000_000, 50).count() == 0


def test_a_run_already_under_way_counts_as_today(spark):
    rows = [(1, "b", "2026-10-01", "2026-10-30"), (2, "a", "2026-10-07", None), (3, "c", "2026-10-06", None), (4, "d", None, None), (5, "e", "2026-10-08", None)]
    ev = spark.createDataFrame(rows, "id BIGINT, name STRING, d STRING, e STRING").selectExpr(
        "id", "name", "CAST(d AS TIMESTAMP_NTZ) AS date", "CAST(e AS TIMESTAMP_NTZ) AS date_end")
    assert [r["id"] for r in R.feed_page(ev, "2026-10-07 18:00:00").collect()] == [2, 1, 5]


def test_no_concept_is_no_constraint(spark, sf_dir):
    ev = catalog(spark, sf_dir)
    assert P.category_by_concepts(ev, []).count() == ev.count()


def test_dedupe_leaves_no_duplicates(spark, sf_dir):
    from marquee.adapters import with_repeats
    ev = with_repeats(listings(spark, sf_dir, "id", "source", "name", "date", "time"))
    left = R.dedupe_keep_first(ev)
    assert A.duplicate_groups(left).count() == 0
    assert left.where("date IS NULL").count() == ev.where("date IS NULL").count()


def test_entry_and_registry(spark, sf_dir):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["label", "event_count"]
    assert len(entry.queries()) > 150
    more = set(entry.queries()) - set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries())
    assert all(name == "pipeline" or name.startswith("op") for name in more)
