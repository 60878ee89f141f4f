"""Tables in their declared types, what does not fit, and copies that follow the references."""

import itertools

import pytest

from marquee.model import REFERENCES, TABLES
from marquee.sources import catalog as C


def test_parents_come_first_in_any_order():
    for names in itertools.islice(itertools.permutations(TABLES), 0, 40320, 97):
        order = C.copy_order(names)
        assert sorted(order) == sorted(TABLES)
        assert all(order.index(parent) < order.index(child) for child, columns in REFERENCES.items() for parent in columns.values())
    assert C.copy_order(["events", "metrics"]) == C.copy_order(["metrics", "events"])
    with pytest.raises(ValueError):
        C.copy_order(["a", "b"], {"a": {"b_id": "b"}, "b": {"a_id": "a"}})


def small(spark):
    return {
        "events": spark.createDataFrame([("1", "a", "7", "2"), ("2", "b", None, None), ("3", "c", "8", None)], "id STRING, name STRING, neighborhood_id STRING, venue_id STRING"),
        "venues": spark.createDataFrame([("2", "7", "12x")], "id STRING, neighborhood_id STRING, capacity STRING"),
        "neighborhoods": spark.createDataFrame([(7, "Loop"), (8, "Hyde Park")], "id BIGINT, name STRING"),
    }


def test_shuffled_tables_copy_alike(spark, tmp_path):
    tables = small(spark)
    read = []
    for k, names in enumerate((["events", "venues", "neighborhoods"], ["neighborhoods", "events", "venues"])):
        counts = C.copy_tables(spark, {n: tables[n] for n in names}, str(tmp_path / str(k)))
        assert [(r["table"], r["source_rows"], r["copied_rows"]) for r in counts.collect()] == [("neighborhoods", 2, 2), ("venues", 1, 1), ("events", 3, 3)]
        read.append([sorted(map(tuple, C.read_table(spark, str(tmp_path / str(k)), n).collect()), key=str) for n in sorted(names)])
    assert read[0] == read[1]


def test_an_orphan_stops_the_copy_before_anything_is_written(spark, tmp_path):
    tables = small(spark)
    tables["venues"] = tables["venues"].unionAll(spark.createDataFrame([("3", "99", None), ("4", "99", "5")], tables["venues"].schema))
    with pytest.raises(ValueError, match="venues.neighborhood_id: 2, such as 99"):
        C.copy_tables(spark, tables, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    found = {(r["table"], r["column"]): (r["rows"], r["missing"], r["example"]) for r in C.orphans(tables).collect()}
    assert found == {("venues", "neighborhood_id"): (2, 1, "99"), ("events", "neighborhood_id"): (0, 0, None), ("events", "venue_id"): (0, 0, None)}
    assert C.copy_tables(spark, tables, str(tmp_path / "out"), keep_orphans=True).count() == 3
    assert C.orphans({"metrics": spark.createDataFrame([(1,)], "id BIGINT")}).count() == 0


def test_values_that_do_not_fit_are_listed(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2026-01-02", "41.5", '["a"]', "x"), ("two", "soon", "north", "oops", None), (None, None, None, None, None)],
                                 "id STRING, date STRING, latitude STRING, categories STRING, extra STRING")
    lost = sorted((r["table"], r["id"], r["column"], r["text"]) for r in C.rejected(rows, "events").collect())
    assert lost == [("events", "two", "categories", "oops"), ("events", "two", "date", "soon"), ("events", "two", "id", "two"), ("events", "two", "latitude", "north")]
    rows.write.parquet(str(tmp_path / "events"))
    typed = C.read_table(spark, str(tmp_path), "events")
    assert typed.schema == C.schema_of("events") and typed.where("latitude = 41.5").count() == 1
    assert C.rejected(typed, "events").count() == 0


def test_filters_reach_typed_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id BIGINT, name STRING").write.parquet(str(tmp_path / "events"))
    plan = C.read_table(spark, str(tmp_path), "events").where("id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan
