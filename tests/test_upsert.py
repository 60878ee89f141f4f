"""The catalogue stream against the same batches merged one after the other."""

from marquee.operators.merge import POLICIES, merge_by_url
from marquee.session import SETTINGS
from marquee.streaming import jobs as T
from marquee.streaming import upsert as U

ROWS = "id BIGINT, name STRING, date TIMESTAMP_NTZ, date_end TIMESTAMP_NTZ, cost STRING, neighborhood_id BIGINT, origination_url STRING, address STRING, venue_name STRING, date_retrieved TIMESTAMP_NTZ"
POLICY = POLICIES["programmes"] | {"cost": "overwrite_if_new"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "position INT, origination_url STRING, name STRING, date STRING, cost STRING, date_retrieved STRING").selectExpr(
        "position", "origination_url", "name", "CAST(date AS TIMESTAMP_NTZ) AS date", "CAST(NULL AS TIMESTAMP_NTZ) AS date_end", "cost",
        "CAST(NULL AS BIGINT) AS neighborhood_id", "'a' AS address", "CAST(NULL AS STRING) AS venue_name", "CAST(date_retrieved AS TIMESTAMP_NTZ) AS date_retrieved")


def batches(spark):
    one = [(i, f"http://x/{i}", f"n{i}", f"2026-0{1 + i % 4}-1{i % 7}", "$1", "2026-01-01") for i in range(0, 24, 2)]
    two = [(1, "http://x/0", "moved to another month", "2026-09-01", "", "2026-01-02"), (2, "http://x/100", "new", None, "$5", "2026-01-02"),
           (3, "http://x/100", "repeated", "2026-01-01", "$6", "2026-01-02"), (4, None, "no url", "2026-01-01", "$7", "2026-01-02"), (5, "http://x/3", "known", None, None, "2026-01-02")]
    three = [(1, "http://x/100", "dated now", "2026-02-03", "$8", "2026-01-03"), (2, "http://x/0", "again", "2026-09-02", "$9", "2026-01-03"), (3, "http://x/101", "last", "2026-12-31", "$2", "2026-01-03")]
    return [frame(spark, rows) for rows in (one, two, three)]


def table(spark):
    rows = [(i + 1, f"old {i}", f"2026-0{1 + i % 5}-05" if i % 6 else None, f"http://x/{i}") for i in range(20)] + [(50, "no url", "2026-01-01", None)]
    return spark.createDataFrame(rows, "id BIGINT, name STRING, date STRING, origination_url STRING").selectExpr(
        "id", "name", "CAST(date AS TIMESTAMP_NTZ) AS date", "CAST(NULL AS TIMESTAMP_NTZ) AS date_end", "CAST(NULL AS STRING) AS cost", "CAST(NULL AS BIGINT) AS neighborhood_id",
        "origination_url", "CAST(NULL AS STRING) AS address", "CAST(NULL AS STRING) AS venue_name", "CAST('2025-12-01' AS TIMESTAMP_NTZ) AS date_retrieved")


def seen(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in ROWS.split(", ")]).collect()), key=str)


def test_stream_equals_batches_one_after_the_other(spark, tmp_path):
    own = spark.newSession()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming"):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stored, some = table(own), batches(own)
    want = stored
    for batch in some:
        want = merge_by_url(want, batch, POLICY).drop("change")
    path, landed = str(tmp_path / "catalog"), str(tmp_path / "landed")
    U.start_catalog(stored, path)
    assert seen(U.read_version(own, path, stored.schema)) == seen(stored)

    def run(checkpoint):
        stream = own.readStream.schema(some[0].schema).option("maxFilesPerTrigger", 1).parquet(landed)
        query = U.stream_upsert(stream, path, stored.schema, POLICY, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        return T.late_rows(query)

    for batch in some:
        batch.coalesce(1).write.mode("append").parquet(landed)
        run("one")
    assert U.current_version(own, path) == 3
    assert seen(U.read_version(own, path, stored.schema)) == seen(want)
    some[2].coalesce(1).write.mode("append").parquet(landed)  # delivered again
    run("one")
    assert U.current_version(own, path) == 3
    run("two")  # a new checkpoint replays everything
    assert seen(U.read_version(own, path, stored.schema)) == seen(want)
    assert seen(U.read_version(own, path, stored.schema, 0)) == seen(stored)


def test_only_touched_months_are_rewritten(spark, tmp_path):
    stored, some, path = table(spark), batches(spark), str(tmp_path / "catalog")
    U.start_catalog(stored, path)
    assert U.upsert_batch(some[1], path, stored.schema, POLICY, "run", 7)
    assert not U.upsert_batch(some[1], path, stored.schema, POLICY, "run", 7)  # run again after a failure
    assert not U.upsert_batch(some[1].limit(0), path, stored.schema, POLICY, "run", 8)
    listed = U._published(spark, path).collect()
    before, after = ({(r["month"], r["folder"]) for r in listed if r["version"] == v} for v in (0, 1))
    kept = {m for m, _ in before & after}
    assert kept and {m for m, _ in before} - kept == {"undated", "2026-04"}  # of the batch's known listings
    assert seen(U.read_version(spark, path, stored.schema)) == seen(merge_by_url(stored, some[1], POLICY).drop("change"))
