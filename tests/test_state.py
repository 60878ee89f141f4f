"""Streams with state against counting row by row, over several batches and pauses, and against their batch twins."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee import vocab
from marquee.operators.safety import rate_limit
from marquee.plans.monitor import QUERIES
from marquee.session import SETTINGS
from marquee.streaming import jobs as T
from marquee.streaming import state as ST

MESSAGES = "thread_id BIGINT, id BIGINT, minute INT, suspicious BOOLEAN, role STRING, token_count INT"


@pytest.fixture
def own(spark):
    session = spark.newSession()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql.streaming"):
            session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def messages(seed=8, n=240):
    """In order of time, with pauses longer than an hour in between."""
    draw, minute, rows = random.Random(seed), 0, []
    for i in range(n):
        minute += draw.choice([0, 1, 2, 5, 200])
        rows.append((draw.randrange(4), i, minute, draw.random() < 0.5, draw.choice(["user", "assistant"]), draw.randrange(2500)))
    return rows


def frame(session, rows):
    return session.createDataFrame(rows, MESSAGES).withColumn("created_at", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")


def counted(rows, forgive, idle_minutes):
    count, last, want = defaultdict(int), {}, {}
    for thread, i, minute, bad, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        if minute - last.get(thread, minute) > idle_minutes:
            count[thread] = 0
        last[thread] = minute
        if count[thread] >= 3:
            want[i] = ("blocked", 3)
            continue
        if bad:
            count[thread] += 1
        elif forgive:
            count[thread] = max(0, count[thread] - 1)
        want[i] = ("clean" if not bad else "too_many_attempts" if count[thread] >= 3 else "injection", count[thread])
    return want


def streamed(own, rows, parts, job, tmp_path):
    """The rows landed as so many files, taken one by one."""
    size = -(-len(rows) // parts)
    for at in range(0, len(rows), size):
        frame(own, rows[at:at + size]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(frame(own, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return T.run_available(job(stream.withWatermark("created_at", "10 minutes")))


@pytest.mark.parametrize("forgive", [True, False])
def test_table_equals_counting(spark, forgive):
    rows = messages(3, 600)
    rows += [(9, 1000 + i, 7, i % 3 > 0, "user", 1) for i in range(30)]  # all at one time
    got = {r["id"]: (r["verdict"], r["attempts"]) for r in rate_limit(frame(spark, rows), forgive=forgive, idle_hours=1).collect()}
    assert got == counted(rows, forgive, 60)


def test_null_threads_and_empty_tables(spark):
    rows = [(None, i, i, True, "user", 1) for i in range(5)]
    assert sorted(r["verdict"] for r in rate_limit(frame(spark, rows)).collect()) == sorted(["injection", "injection", "too_many_attempts", "blocked", "blocked"])
    assert rate_limit(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_table(own, tmp_path, parts):
    rows = messages()
    out = streamed(own, rows, parts, lambda s: ST.stream_rate_limit(s, idle_hours=1), tmp_path)
    got = {r["id"]: (r["verdict"], r["attempts"]) for r in out.collect()}
    assert got == counted(rows, True, 60)
    assert got == {r["id"]: (r["verdict"], r["attempts"]) for r in rate_limit(frame(own, rows), idle_hours=1).collect()}


def test_budget_over_batches(own, tmp_path):
    rows, tokens, turns, want = messages(4), defaultdict(int), defaultdict(int), {}
    for thread, i, _, _, role, n in rows:
        tokens[thread] += n
        if role == "assistant":
            turns[thread] += 1
            left, turns_left = vocab.TOKEN_BUDGET - tokens[thread], vocab.TURN_BUDGET - turns[thread]
            if left <= 0 or turns_left <= 0 or left < vocab.TOKEN_BUDGET * vocab.WARN_SHARE:
                want[i] = ("ended" if left <= 0 or turns_left <= 0 else "limit_approaching", max(left, 0), max(turns_left, 0))
    out = streamed(own, rows, 3, ST.stream_budget, tmp_path)
    assert {r["id"]: (r["status"], r["remaining_tokens"], r["remaining_turns"]) for r in out.collect()} == want


def test_state_is_gone_after_the_pause(own, tmp_path):
    """Idle conversations leave no state behind once the watermark is past their pause."""
    rows = [(thread, thread * 10 + i, i, True, "user", 1) for thread in range(5) for i in range(3)] + [(7, 100, 500, True, "user", 1)] + [(8, 101, 900, False, "user", 1)]
    for some in (rows[:15], rows[15:16], rows[16:]):
        frame(own, some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(frame(own, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("created_at", "10 minutes")
    query = ST.stream_rate_limit(stream, idle_hours=1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = own.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "state"))
    assert {r["key"][0] for r in kept.collect()} == {8}


def burst_rows(rows, gap=360):
    """(thread, start minute, end minute, messages, turns, tokens) of every burst."""
    by_thread, out = defaultdict(list), []
    for thread, i, minute, _, role, n in rows:
        by_thread[thread].append((minute, role, n))
    for thread, some in by_thread.items():
        bursts = []
        for minute, role, n in sorted(some):
            if bursts and minute <= bursts[-1][1] + gap:
                b = bursts[-1]
                bursts[-1] = (b[0], minute, b[2] + 1, b[3] + (role == "assistant"), b[4] + n)
            else:
                bursts.append((minute, minute, 1, int(role == "assistant"), n))
        out += [(thread, a, b + gap, *rest) for a, b, *rest in bursts]
    return sorted(out)


def got_bursts(df):
    return sorted(tuple(r) for r in df.selectExpr(
        "thread_id", "unix_micros(CAST(session_start AS TIMESTAMP)) div 60000000", "unix_micros(CAST(session_end AS TIMESTAMP)) div 60000000", "messages", "turns", "tokens").collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_sessions_of_stream_and_table(own, tmp_path, parts):
    draw, minute, rows = random.Random(5), 0, []
    for i in range(300):
        minute += draw.choice([0, 7, 30, 60, 360, 361])
        rows.append((0 if i % 3 else draw.randrange(1, 4), i, minute, False, draw.choice(["user", "assistant"]), draw.randrange(90)))
    want = burst_rows(rows)
    assert got_bursts(T.sessions(frame(own, rows))) == want
    got = got_bursts(streamed(own, rows, parts, ST.stream_sessions, tmp_path))
    closed = [w for w in want if -(-w[2] // 60) * 60 <= minute - 10]
    assert got == closed and len(got) > 20


def test_hours_are_summed_before_sessions(own, tmp_path):
    frame(own, messages()).write.parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(frame(own, messages()[:1]).schema).parquet(str(tmp_path / "in")).withWatermark("created_at", "10 minutes")
    plan = ST.stream_sessions(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "Aggregate [window#" in plan


@pytest.mark.parametrize("name", ["stream_budget", "stream_rate_limit", "stream_sessions"])
def test_a_stream_reads_a_table_in_one_file_and_in_a_folder_of_files(spark, sf_dir, tmp_path, name):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.repeat("text", F.lit(40)))
    rows = rows.unionByName(rows.withColumn("turn", F.col("turn") + 30))  # later than the day's last hour
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    whole, dealt = (sorted(QUERIES[name](spark, f"{tmp_path}/{d}").collect()) for d in ("file", "folder"))
    assert whole and whole == dealt
