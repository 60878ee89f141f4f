"""The plans the operators are meant to have."""

import pytest

from marquee.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()

# Queries whose core reads a document of unknown depth or multiplies matrices, on Arrow batches.
PYTHON = {"page_price", "pages_embedded_state_events", "pages_dated_blocks", "read_pages", "semantic_category",
          "hybrid_category", "classifier_scores", "classifier_sweep", "classifier_errors", "nearest", "semantic_candidates"}
# Streams and written results are read back from files; their plans say nothing about the operator.
WRITTEN = {n for n in QUERIES if n.startswith("stream_")} | {
    "write_catalog", "copy_tables", "coerce_table", "read_catalog", "read_whole_catalog", "catalog_rejects", "copy_catalog", "merge_venue_batch", "insert_only", "get_or_create_dim",
    *[n for n in QUERIES if n.startswith("merge_by_url")]}


def plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITTEN])
def test_no_nested_loops_and_no_python(name, spark, sf_dir):
    text = plan(spark, QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = any(node in text for node in ("EvalPython", "MapInArrow", "MapInPandas", "PythonUDF"))
    assert python == (name in PYTHON)


@pytest.mark.parametrize("name", ["dedupe_keep_first", "dedupe_batch", "recent_messages", "search_feed", "structured_candidates",
                                  "union_tagged_feeds", "candidate_union", "venue_priors", "price_distribution", "nearest", "rank_candidates"])
def test_top_rows_are_cut_before_the_shuffle(name, spark, sf_dir):
    assert "Partial" in plan(spark, QUERIES[name](spark, sf_dir)).split("WindowGroupLimit", 1)[1]


def test_scans_read_what_the_query_needs(spark, sf_dir):
    text = plan(spark, QUERIES["upcoming"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    assert "part.parquet" not in text and "customer.parquet" not in text
    one = plan(spark, QUERIES["event_by_id"](spark, sf_dir))
    assert "EqualTo(o_orderkey,42)" in one


def test_a_page_of_the_feed_is_not_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(spark, QUERIES["feed_page"](spark, sf_dir))
