"""Percentiles from sketches that are merged, in tables and streams, and rows that come too late."""

import numpy as np
from pyspark.sql import functions as F

from marquee.session import SETTINGS
from marquee.streaming import jobs as T

LOGS = "id BIGINT, operation STRING, tokens_used BIGINT, duration_ms DOUBLE, second BIGINT"


def logs(session, rows):
    return session.createDataFrame(rows, LOGS).withColumn("created_at", F.timestamp_seconds("second")).drop("second")


def turns(n, seed=3):
    draw = np.random.default_rng(seed)
    return [(i, "turn_completed", None, float(round(v, 3)), int(s)) for i, (v, s) in enumerate(zip(draw.lognormal(4, 1, n), np.sort(draw.integers(0, 4 * 3600, n))))]


def off_by(values, answer, p):
    """How far the answer's ranks are from the share asked for."""
    low, high = np.searchsorted(values, answer, "left") / len(values), np.searchsorted(values, answer, "right") / len(values)
    return max(0.0, low - p, p - high)


def test_merged_sketches_stay_within_their_error(spark):
    rows = turns(40_000)
    hourly = T.sketches(logs(spark, rows).repartition(7))
    for made, hours in ((hourly, 1), (T.rolled_up(hourly, "4 hours"), 4)):
        for r in T.with_percentiles(made, {"p5": 0.05, "p50": 0.5, "p99": 0.99}).where("metric = 'latency.ms'").collect():
            start = r["window_start"].hour * 3600
            values = np.sort([v for _, _, _, v, s in rows if start <= s < start + hours * 3600])
            assert r["n"] == len(values)
            assert max(off_by(values, r[c], p) for c, p in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99))) < T.RANK_ERROR


def test_few_values_are_exact(spark):
    rows = [(i, "turn_completed", None, float(i), 60 * i) for i in range(1, 10)] + [(20, "other", None, None, 100)]
    made = T.with_percentiles(T.sketches(logs(spark, rows)), {"p50": 0.5}).where("metric = 'latency.ms'").collect()
    assert [(r["n"], r["low"], r["p50"], r["high"]) for r in made] == [(9, 1.0, 5.0, 9.0)]
    assert T.with_percentiles(T.sketches(logs(spark, [])), {"p50": 0.5}).count() == 0


def test_stream_over_batches_and_late_rows(spark, tmp_path):
    own = spark.newSession()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming"):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    rows = turns(3000) + [(9000, "turn_completed", None, 5.0, 4 * 3600 + 30 * 60)]
    late = [(9001 + i, "turn_completed", None, 1.0, 60) for i in range(3)]
    for part in (rows[:1500], rows[1500:], late):
        logs(own, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(logs(own, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("created_at", "10 minutes")
    out, dropped = T.run_counted(T.with_percentiles(T.sketches(stream, "1 hour", "30 minutes"), {"p50": 0.5}))
    got = {(r["window_start"], r["metric"]): r for r in out.collect()}
    table = T.with_percentiles(T.sketches(logs(own, rows), "1 hour", "30 minutes"), {"p50": 0.5}).collect()
    closed = [r for r in table if r["window_end"].timestamp() <= 4 * 3600 + 20 * 60]
    assert len(closed) > 10 and set(got) == {(r["window_start"], r["metric"]) for r in closed}
    assert all(got[r["window_start"], r["metric"]]["n"] == r["n"] for r in closed)
    assert dropped > 0
