"""A catalogue kept up to date by a stream of landed batches.

The rows lie in month folders of the listing's date. A version is a list of folders, and a batch publishes the next one by writing that
list last: before, nobody sees what it wrote; after, it is done. A version also names the run and batch it came from, so a batch that is
run again after a failure is recognised and left out, whatever number a new checkpoint gives its first batch.

A batch rewrites the months that hold a listing it knows; rows for other months are added as folders of their own, which the next
rewrite of that month takes in. All else keeps its folders.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.lineage import settled
from marquee.operators.merge import merge_by_url
from marquee.operators.ordering import stored_matches

LISTED = "run STRING, batch LONG, highest LONG, month STRING, folder STRING"
#: The folder of listings without a date.
UNDATED = "undated"


def month_of(date: str = "date") -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def _publish(spark: SparkSession, path: str, version: int, run: str, batch: int, highest: int, folders: list[tuple[str, str]]) -> None:
    """The list of folders as one file, so it is there whole or not at all."""
    rows = [(run, batch, highest, month, folder) for month, folder in folders] or [(run, batch, highest, None, None)]
    spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def _published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LISTED}, version LONG").parquet(f"{path}/versions")


def _write(rows: DataFrame, path: str) -> tuple[list[tuple[str, str]], int]:
    """The rows in folders by month, and the highest id among them."""
    folder = uuid.uuid4().hex
    # rebalancing splits a month of many rows and puts small ones together, by what was measured
    rows.withColumn("month", month_of()).hint("rebalance", "month").write.partitionBy("month").parquet(f"{path}/rows/{folder}")
    written = rows.sparkSession.read.schema("id LONG, month STRING").parquet(f"{path}/rows/{folder}")
    months = written.groupBy("month").agg(F.max("id").alias("id")).collect()  # a row per month
    return [(m["month"], folder) for m in months], max([m["id"] for m in months if m["id"] is not None], default=0)


def _rows(spark: SparkSession, path: str, folders: list[tuple[str, str]], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{folder}/month={month}" for month, folder in folders])


def start_catalog(ev: DataFrame, path: str) -> None:
    """Version 0 of a catalogue that a stream will keep up to date."""
    folders, highest = _write(ev, path)
    _publish(ev.sparkSession, path, 0, "start", 0, highest, folders)


def current_version(spark: SparkSession, path: str) -> int:
    return _published(spark, path).agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, path: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The catalogue as it was published last, or at a version."""
    number = current_version(spark, path) if version is None else version
    listed = _published(spark, path).where(F.col("version") == number).where("folder IS NOT NULL").select("month", "folder").collect()
    return _rows(spark, path, [tuple(r) for r in listed], schema)


def upsert_batch(batch: DataFrame, path: str, schema: StructType, policy: dict[str, str], run: str, batch_id: int) -> bool:
    """One batch merged into the catalogue as `merge_by_url` does, and published. False if it brings nothing or is published already."""
    spark = batch.sparkSession
    listed = _published(spark, path)
    if listed.where((F.col("run") == run) & (F.col("batch") == batch_id)).limit(1).count():
        return False
    batch = settled(batch)
    if batch.isEmpty():
        return False
    number = current_version(spark, path)
    now = listed.where(F.col("version") == number).collect()
    folders, highest = [(r["month"], r["folder"]) for r in now if r["folder"]], now[0]["highest"]
    every = _rows(spark, path, folders, schema)
    known = stored_matches(every.select("origination_url", month_of().alias("month")), batch.where("origination_url IS NOT NULL"), ["origination_url"])
    touched = {r["month"] for r in known.select("month").distinct().collect()}
    stored = _rows(spark, path, [f for f in folders if f[0] in touched], schema)
    merged = merge_by_url(stored, batch, policy, highest=F.lit(highest).cast("long")).drop("change")
    written, top = _write(merged, path)
    _publish(spark, path, number + 1, run, batch_id, max(highest, top), [f for f in folders if f[0] not in touched] + written)
    return True


def stream_upsert(batches: DataFrame, path: str, schema: StructType, policy: dict[str, str], checkpoint: str, delay: str = "30 days"):
    """Every micro-batch merged into the catalogue under `path`; returns the writer, ready to start.

    A row that is delivered again (same URL, position and time of retrieval) within `delay` is left out; rows that were retrieved
    longer before the newest one than that are dropped as late, `late_rows` counts them. One stream writes to a catalogue at a time.
    A new checkpoint replays the source: the same rows are merged again, which changes nothing where the policy lets later batches win.
    """
    seen = batches.withColumn("_seen", F.col("date_retrieved").cast("timestamp")).withWatermark("_seen", delay)
    once = seen.dropDuplicatesWithinWatermark(["origination_url", "date_retrieved", "position"]).drop("_seen")

    def merge(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert_batch(batch, path, schema, policy, run, batch_id)

    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
