"""Monitoring and upkeep as Structured Streaming jobs.

The window jobs are plain functions of a DataFrame: given a stream with a watermark they emit closed windows, given
a table they compute all of them, which is what the tests compare.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.lineage import checkpoint_root

STALE_HOURS = 6


def event_time(df: DataFrame, column: str = "created_at", delay: str | None = None) -> DataFrame:
    """The event time as an instant, which watermarks need; zoneless times count as the session's."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def _window(width: str, slide: str | None) -> Column:
    return F.window("created_at", width, slide) if slide else F.window("created_at", width)


def _bounds() -> list[Column]:
    return [F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end")]


#: Size of a quantile sketch; the rank of what it answers is off by less than `RANK_ERROR`, as a share of the values.
SKETCH, RANK_ERROR = 400, 0.02


def points(logs: DataFrame) -> DataFrame:
    """(created_at, metric, value): what a log adds to each series. A row without any stays, so that it still moves a stream's watermark."""
    def series(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")))

    one, op = F.lit(1.0), F.col("operation")
    some = F.array_compact(F.array(
        series("sessions.created", op == "chat_created", one),
        series("questions.asked", op == "question_asked", one),
        series("turns.completed", op == "turn_completed", one),
        series("tokens.used", F.col("tokens_used") > 0, F.col("tokens_used")),
        series("latency.ms", op == "turn_completed", F.col("duration_ms"))))
    return logs.select("created_at", F.inline_outer(some))


def metrics(logs: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counters and histograms per window: how often, how much, and the extremes of each series."""
    return points(logs).groupBy(_window(width, slide), "metric").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"),
        F.max("value").alias("high")).where("metric IS NOT NULL").select(
        *_bounds(), "metric", "n", F.round("total", 4).alias("total"), "low", "high")


def sketches(logs: DataFrame, width: str = "1 hour", slide: str | None = None, k: int = SKETCH) -> DataFrame:
    """The same with a quantile sketch per window, (window, metric, n, total, low, high, sketch), for `with_percentiles`.

    A sketch is a few kilobytes whatever it has seen. Sliding windows put together those of their slides in a second aggregation, so a
    value is sketched once; `rolled_up` puts stored ones together to longer windows without the logs.
    """
    out = points(logs).groupBy(_window(slide or width, None), "metric").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", k).alias("sketch")).where("metric IS NOT NULL")
    return _merged(out, F.window("window", width, slide)) if slide else out


def _merged(rows: DataFrame, window: Column) -> DataFrame:
    return rows.groupBy(window.alias("window"), "metric").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def rolled_up(rows: DataFrame, width: str) -> DataFrame:
    """Sketches of windows that `width` is a multiple of, put together."""
    return _merged(rows, F.window(F.col("window.start"), width))


def with_percentiles(rows: DataFrame, percentiles: dict[str, float]) -> DataFrame:
    """Sketches as rows of numbers: window_start, window_end, metric, n, total, low, high, and a column per percentile."""
    return rows.select(*_bounds(), "metric", "n", F.round("total", 4).alias("total"), "low", "high", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in percentiles.items()])


def security_alerts(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Blocked requests per window, with the newest of them.

    All logs are aggregated and windows without a block dropped afterwards, so that any log closes a stream's window.
    """
    blocked = F.col("operation") == "security_blocked"
    return logs.groupBy(_window(width, None)).agg(
        F.count_if(blocked).alias("blocked"), F.max_by("id", F.when(blocked, F.struct("created_at", "id"))).alias("newest_id")).where(
        F.col("blocked") > 0).select(*_bounds(), "blocked", "newest_id")


def hours(messages: DataFrame, hour: Column) -> DataFrame:
    """Messages of one hour are always one session, so each (thread, hour) is summed up first, map-side."""
    return messages.groupBy(hour.alias("hour"), "thread_id").agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count("*").alias("messages"),
        F.count_if(F.col("role") == "assistant").alias("turns"), F.sum("token_count").alias("tokens"))


def sessions(messages: DataFrame, gap_hours: int = STALE_HOURS) -> DataFrame:
    """Bursts of a conversation in a stored table, closed once nothing came for the gap, for a thread of any length: only hourly
    rows are put in order."""
    summed = hours(messages, F.date_trunc("hour", "created_at"))
    order = Window.partitionBy("thread_id").orderBy("hour")
    gap = F.make_dt_interval(F.lit(0), F.lit(gap_hours))
    starts = F.when(F.col("first") > F.lag("last").over(order) + gap, 1).otherwise(0)
    numbered = summed.withColumn("_new", starts).withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy("thread_id", "_session").agg(
        F.min("first").cast("timestamp_ntz").alias("session_start"),
        (F.max("last") + gap).cast("timestamp_ntz").alias("session_end"), F.sum("messages").alias("messages"),
        F.sum("turns").alias("turns"), F.sum("tokens").alias("tokens")).drop("_session")


def sweep_threads(threads: DataFrame, as_of, hours: int = STALE_HOURS) -> DataFrame:
    """Active conversations nobody came back to, or that were never used, are abandoned."""
    cutoff = F.lit(str(as_of)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    stale = (F.col("status") == "active") & ((F.col("updated_at") < cutoff) | (F.col("turn_count") == 0))
    return threads.withColumn("status", F.when(stale, "abandoned").otherwise(F.col("status")))


def close_threads(threads: DataFrame, ids: DataFrame, status: str = "closed") -> DataFrame:
    """Named conversations closed where they are still active; unknown ids change nothing."""
    named = ids.select("id", F.lit(True).alias("_named")).distinct()
    out = threads.join(named, "id", "left")
    change = F.coalesce(F.col("_named"), F.lit(False)) & (F.col("status") == "active")
    return out.withColumns({"changed": change, "status": F.when(change, status).otherwise(F.col("status"))}).drop("_named")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything available put through a stream into files, and those files read back."""
    return run_counted(stream, mode)[0]


def run_counted(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """The same with the number of rows that came too late to count."""
    spark = stream.sparkSession
    root = checkpoint_root(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").option(
        "path", f"{root}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows"), late_rows(query)


def late_rows(query) -> int:
    """Rows a stream dropped because they came after the watermark, over its recent progress."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
