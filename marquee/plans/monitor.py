"""Queries and oracles of monitoring: the batch form of each window job, and the streams themselves.

A stream query reads the same table as a file stream, runs until nothing is left and reads back what it wrote. A
window still open at the watermark is not emitted, so its oracle keeps closed windows only.
"""

from pyspark.sql import functions as F

from marquee.adapters import audit_logs, audit_view, chat_messages, chat_threads, listings, table
from marquee.lineage import checkpoint_root
from marquee.operators.merge import POLICIES
from marquee.operators.safety import injection_pattern, rate_limit
from marquee.plans.merge import CATALOG, NEW, URL_BATCH, _table, _url_merge_sql
from marquee.plans.safety import LEAD, PATTERN
from marquee.plans.views import AUDIT, MESSAGES, THREADS, with_views
from marquee.session import SETTINGS
from marquee.streaming import jobs as T
from marquee.streaming import state as ST
from marquee.streaming import upsert as U

AS_OF = "2024-01-31 00:00:00"
DELAY_MINUTES = 10


def _stream(s, d, name):
    """A table as a file stream, whether it is one file or a folder of them: only a path with a pattern may be either."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.[p]arquet")


def _stream_session(s):
    """A session of its own for a stream: RocksDB state, and on one machine no more state stores than cores."""
    own = s.newSession()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming"):
            own.conf.set(key, value)
    if s.sparkContext.master.startswith("local"):
        stores = min(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism)
        own.conf.set("spark.sql.shuffle.partitions", str(stores))
    return own


def _log_stream(s, d):
    s = _stream_session(s)
    return T.event_time(audit_view(_stream(s, d, "events")), delay=f"{DELAY_MINUTES} minutes")


def _message_columns(rows):
    """chat_messages of a stream of conversations, in a handful of long sessions."""
    return rows.selectExpr(
        "conv_id * 100 + turn AS id", "conv_id % 7 AS thread_id", "role", f"concat({LEAD.format(id='(conv_id * 100 + turn)')}, text) AS content",
        "CAST(floor(length(text) / 4) AS INT) AS token_count",
        "make_timestamp(2024, 1, CAST(1 + conv_id % 28 AS INT), 0, 0, 0) + make_dt_interval(0, CAST(turn AS INT)) AS created_at")


def _session_stream(s, d):
    s = _stream_session(s)
    rows = _message_columns(_stream(s, d, "conversations")).withWatermark("created_at", "10 minutes")
    return T.run_available(ST.stream_sessions(rows))


def _limits(s, d):
    s = _stream_session(s)
    rows = _message_columns(_stream(s, d, "conversations")).withWatermark("created_at", "10 minutes")
    return T.run_available(ST.stream_rate_limit(rows.withColumn("suspicious", injection_pattern("content").isNotNull())))


def _limits_of_table(s, d):
    rows = _message_columns(table(s, d, "conversations")).withColumn("suspicious", injection_pattern("content").isNotNull())
    return rate_limit(rows)


def _budgets(s, d):
    s = _stream_session(s)
    return T.run_available(ST.stream_budget(_message_columns(_stream(s, d, "conversations")).withWatermark("created_at", "10 minutes")))


def _upsert(s, d):
    """A catalogue kept up to date by a stream of landed batches: one lands, is delivered again, and is replayed by a new checkpoint."""
    s, root = _stream_session(s), checkpoint_root(s)
    stored = _table(s, d)
    U.start_catalog(stored, f"{root}/catalog")
    batch = s.sql(URL_BATCH.format(rel="{rel}"), rel=listings(s, d, *CATALOG)).withColumn("date_retrieved", F.lit(NEW).cast("timestamp_ntz"))
    for state in ("state", "state", "replayed"):
        if state == "state":
            batch.write.mode("append").parquet(f"{root}/landed")
        landed = s.readStream.schema(batch.schema).parquet(f"{root}/landed")
        query = U.stream_upsert(landed, f"{root}/catalog", stored.schema, POLICIES["city_api"], f"{root}/{state}").trigger(availableNow=True).start()
        query.awaitTermination()
    return U.read_version(s, f"{root}/catalog", stored.schema)


PERCENTILES = {"p50": 0.5, "p95": 0.95}


def _held(sketched, logs, width, slide=None):
    """Whether the sketches' percentiles lie between the exact ones of the ranks their error allows."""
    ranks = {f"{name}_{side}": min(1.0, max(0.0, p + e)) for name, p in PERCENTILES.items() for side, e in (("least", -T.RANK_ERROR), ("most", T.RANK_ERROR))}
    exact = T.points(logs).where("metric IS NOT NULL").groupBy(
        F.window("created_at", width, slide or width).alias("w"), F.col("metric").alias("of")).agg(*[
            F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(name) for name, p in ranks.items()])
    rows = T.with_percentiles(sketched, PERCENTILES)
    met = rows.join(exact, (F.col("window_start") == F.col("w.start").cast("timestamp_ntz")) & (F.col("metric") == F.col("of")))
    return met.select("window_start", "window_end", "metric", "n", "total", *[
        F.col(name).between(F.col(f"{name}_least"), F.col(f"{name}_most")).alias(f"{name}_holds") for name in PERCENTILES])


def _percentiles(s, d):
    logs = T.event_time(audit_logs(s, d))
    return _held(T.sketches(logs), logs, "1 hour")


def _percentiles_sliding(s, d):
    logs = T.event_time(audit_logs(s, d))
    return _held(T.sketches(logs, "1 hour", "30 minutes"), logs, "1 hour", "30 minutes")


def _percentiles_of_days(s, d):
    logs = T.event_time(audit_logs(s, d))
    return _held(T.rolled_up(T.sketches(logs), "1 day"), logs, "1 day")


def _stream_percentiles(s, d):
    return T.run_available(T.with_percentiles(T.sketches(_log_stream(s, d), "1 hour", "30 minutes"), PERCENTILES)).select(
        "window_start", "window_end", "metric", "n", "total", "low", "high", *[F.col(p).between(F.col("low"), F.col("high")).alias(f"{p}_holds") for p in PERCENTILES])


def _close(s, d):
    ids = s.range(0, 60, 2).union(s.range(100000, 100002))
    return T.close_threads(chat_threads(s, d), ids).select("id", "status", "changed")


QUERIES = {
    "metrics": lambda s, d: T.metrics(T.event_time(audit_logs(s, d))),
    "metrics_sliding": lambda s, d: T.metrics(T.event_time(audit_logs(s, d)), "1 hour", "30 minutes"),
    "metric_percentiles": _percentiles,
    "metric_percentiles_sliding": _percentiles_sliding,
    "metric_percentiles_of_days": _percentiles_of_days,
    "stream_percentiles": _stream_percentiles,
    "stream_metrics": lambda s, d: T.run_available(T.metrics(_log_stream(s, d))),
    "sessions": lambda s, d: T.sessions(T.event_time(chat_messages(s, d))),
    "stream_sessions": _session_stream,
    "sweep_threads": lambda s, d: T.sweep_threads(chat_threads(s, d), AS_OF),
    "close_threads": _close,
    "rate_limit": _limits_of_table,
    "stream_rate_limit": _limits,
    "stream_budget": _budgets,
    "stream_upsert": _upsert,
    "security_alerts": lambda s, d: T.security_alerts(T.event_time(audit_logs(s, d))),
    "stream_security_alerts": lambda s, d: T.run_available(T.security_alerts(_log_stream(s, d))),
}

POINTS = """points AS (
  SELECT created_at, 'sessions.created' AS metric, 1.0 AS value FROM audit_logs WHERE operation = 'chat_created'
  UNION ALL SELECT created_at, 'questions.asked', 1.0 FROM audit_logs WHERE operation = 'question_asked'
  UNION ALL SELECT created_at, 'turns.completed', 1.0 FROM audit_logs WHERE operation = 'turn_completed'
  UNION ALL SELECT created_at, 'tokens.used', tokens_used FROM audit_logs WHERE tokens_used > 0
  UNION ALL SELECT created_at, 'latency.ms', duration_ms FROM audit_logs WHERE operation = 'turn_completed')"""
HOUR = "time_bucket(INTERVAL 1 HOUR, created_at)"


def metrics_sql(start, rel="points"):
    return f"""SELECT {start} AS window_start, {start} + INTERVAL 1 HOUR AS window_end, metric, count(*) AS n,
      round(CAST(sum(value) AS DOUBLE), 4) AS total, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high FROM {rel} GROUP BY ALL"""


HOLDS = ", ".join(f"true AS {p}_holds" for p in PERCENTILES)
SLID = "slid AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, created_at), time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS start FROM points)"
CLOSED = f"window_end <= (SELECT max(created_at) FROM audit_logs) - INTERVAL {DELAY_MINUTES} MINUTE"
ALERTS = f"""SELECT {HOUR} AS window_start, {HOUR} + INTERVAL 1 HOUR AS window_end, count(*) AS blocked, max_by(id, (created_at, id)) AS newest_id
  FROM audit_logs WHERE operation = 'security_blocked' GROUP BY ALL"""


def sessions_sql(rel):
    return f"""WITH_ marked AS (SELECT *, CASE WHEN created_at > lag(created_at) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM {rel} WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY thread_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS n FROM marked)
  SELECT thread_id, min(created_at) AS session_start, max(created_at) + INTERVAL 6 HOUR AS session_end, count(*) AS messages,
    count(*) FILTER (role = 'assistant') AS turns, CAST(sum(token_count) AS BIGINT) AS tokens FROM numbered GROUP BY thread_id, n""".replace("WITH_ ", ", ")


LIMITS = with_views(MESSAGES, body=f"""
    , m AS (SELECT id, thread_id % 7 AS thread_id, created_at, concat({LEAD.format(id='id')}, content) AS content FROM chat_messages),
    n AS (SELECT id, thread_id, coalesce({PATTERN} IS NOT NULL, false) AS bad, row_number() OVER w AS n, coalesce(created_at > lag(created_at) OVER w + INTERVAL 24 HOUR, true) AS fresh
      FROM m WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id))
    SELECT * FROM (WITH RECURSIVE f AS (SELECT DISTINCT thread_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS verdict, 0 AS attempts FROM n
      UNION ALL SELECT thread_id, n, id, CASE WHEN was >= 3 THEN 'blocked' WHEN bad AND was = 2 THEN 'too_many_attempts' WHEN bad THEN 'injection' ELSE 'clean' END,
        CASE WHEN was >= 3 THEN was WHEN bad THEN was + 1 ELSE greatest(0, was - 1) END
      FROM (SELECT f.thread_id, n.n, n.id, bad, CASE WHEN fresh THEN 0 ELSE f.attempts END AS was FROM f JOIN n ON n.thread_id = f.thread_id AND n.n = f.n + 1))
    SELECT thread_id, id, verdict, attempts FROM f WHERE id IS NOT NULL)""")

ORACLES = {
    "metrics": with_views(AUDIT, POINTS, body=metrics_sql(HOUR)),
    "metrics_sliding": with_views(AUDIT, POINTS, SLID, body=metrics_sql("start", "slid")),
    "metric_percentiles": with_views(AUDIT, POINTS, f"m AS ({metrics_sql(HOUR)})", body=f"SELECT * EXCLUDE (low, high), {HOLDS} FROM m"),
    "metric_percentiles_sliding": with_views(AUDIT, POINTS, SLID, f"m AS ({metrics_sql('start', 'slid')})", body=f"SELECT * EXCLUDE (low, high), {HOLDS} FROM m"),
    "metric_percentiles_of_days": with_views(AUDIT, POINTS, f"m AS ({metrics_sql('CAST(date_trunc(\'day\', created_at) AS TIMESTAMP)').replace('INTERVAL 1 HOUR', 'INTERVAL 1 DAY')})",
                                             body=f"SELECT * EXCLUDE (low, high), {HOLDS} FROM m"),
    "stream_percentiles": with_views(AUDIT, POINTS, SLID, f"m AS ({metrics_sql('start', 'slid')})", body=f"SELECT *, {HOLDS} FROM m WHERE {CLOSED}"),
    "stream_metrics": with_views(AUDIT, POINTS, f"m AS ({metrics_sql(HOUR)})", body=f"SELECT * FROM m WHERE {CLOSED}"),
    "sessions": with_views(MESSAGES, body=sessions_sql("chat_messages")),
    "stream_sessions": with_views(MESSAGES, "grouped AS (SELECT id, thread_id % 7 AS thread_id, role, token_count, created_at FROM chat_messages)",
                                  "s AS (" + sessions_sql("grouped").replace(", marked", "WITH marked", 1) + ")",
                                  body="SELECT * FROM s WHERE session_end <= (SELECT max(created_at) FROM chat_messages) - INTERVAL 10 MINUTE"),
    "sweep_threads": with_views(THREADS, body="""SELECT id, turn_count, total_tokens, updated_at, CASE WHEN status = 'active'
        AND (updated_at < TIMESTAMP '2024-01-30 18:00:00' OR turn_count = 0) THEN 'abandoned' ELSE status END AS status FROM chat_threads"""),
    "close_threads": with_views(THREADS, body="""SELECT id, CASE WHEN status = 'active' AND id >= 0 AND id < 60 AND id % 2 = 0 THEN 'closed' ELSE status END AS status,
        status = 'active' AND id >= 0 AND id < 60 AND id % 2 = 0 AS changed FROM chat_threads"""),
    "rate_limit": LIMITS,
    "stream_rate_limit": LIMITS,
    "stream_budget": with_views(MESSAGES, body=f"""
        , m AS (SELECT id, thread_id % 7 AS thread_id, role, CAST(floor(length(content) / 4) AS INT) AS token_count, created_at FROM chat_messages),
        r AS (SELECT thread_id, id, role, 20000 - CAST(sum(token_count) OVER w AS BIGINT) AS tokens, 12 - count(*) FILTER (role = 'assistant') OVER w AS turns FROM m
          WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))
        SELECT thread_id, id, CASE WHEN tokens <= 0 OR turns <= 0 THEN 'ended' ELSE 'limit_approaching' END AS status, greatest(0, tokens) AS remaining_tokens, greatest(0, turns) AS remaining_turns
        FROM r WHERE role = 'assistant' AND (tokens < 5000 OR turns <= 0)"""),
    "stream_upsert": "SELECT * EXCLUDE (change) FROM (" + _url_merge_sql("city_api") + ")",
    "security_alerts": with_views(AUDIT, body=ALERTS),
    "stream_security_alerts": with_views(AUDIT, f"a AS ({ALERTS})", body=f"SELECT * FROM a WHERE {CLOSED}"),
}
