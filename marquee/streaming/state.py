"""Streams with state per conversation: sessions, the attempt counter and the token budget.

State is a few numbers per conversation and the time of its last message. An event-time timer removes it once the conversation was
idle for long enough, and a message that comes later starts anew, whether or not the timer has run yet; so the results do not depend on
how a stream is cut into batches. Rows of one conversation are taken in (event time, id) order inside each micro-batch. The jobs
need a watermark on `created_at` and the RocksDB state store.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marquee import vocab
from marquee.operators.safety import IDLE_HOURS
from marquee.streaming.jobs import STALE_HOURS, hours

#: Hours after which a conversation's budget starts anew.
BUDGET_HOURS = 30 * 24
SECOND = 1_000_000
HOUR = 3600 * SECOND


class Conversation(StatefulProcessor):
    """Two numbers per conversation, kept until it was idle for some hours. Subclasses say what an uninterrupted run of rows does."""

    schema = ["thread_id", "id"]

    def __init__(self, idle_hours: int):
        self.idle = idle_hours * 3600 * SECOND

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "first LONG, second LONG, last LONG", None)

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.assign(at=rows["created_at"].to_numpy("datetime64[us]").astype(np.int64)).sort_values(["at", "id"], kind="stable")
        first, second, last = self.state.get() if self.state.exists() else (0, 0, None)
        at = rows["at"].to_numpy()
        gaps = np.diff(at, prepend=at[0] if last is None else last) > self.idle
        runs = np.split(np.arange(len(rows)), np.flatnonzero(gaps)) if len(rows) else []
        for number, run in enumerate(runs):
            if not len(run):
                continue
            if number or gaps[0]:
                first, second = 0, 0
            first, second, out = self.follow(rows.iloc[run], first, second)
            if len(out):
                yield out.assign(thread_id=key[0])[self.schema]
        last = max(int(at[-1]), last or 0)
        self.state.update((int(first), int(second), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self):
        pass


class RateLimiter(Conversation):
    """Counts injection attempts of a conversation; a clean turn takes one back, a blocked one stays blocked."""

    schema = ["thread_id", "id", "verdict", "attempts"]

    def __init__(self, limit: int, forgive: bool, idle_hours: int):
        super().__init__(idle_hours)
        self.limit, self.back = limit, -1 if forgive else 0

    def follow(self, rows, count, _):
        bad = rows["suspicious"].fillna(False).to_numpy(bool)
        walk = count + np.cumsum(np.where(bad, 1, self.back))
        counts = walk - np.minimum(np.minimum.accumulate(walk), 0)
        over = counts >= self.limit
        blocked = np.full(len(rows), count >= self.limit) | (np.cumsum(over) - over > 0)
        counts = np.where(blocked, self.limit, counts)
        verdict = np.select([blocked, bad & over, bad], ["blocked", "too_many_attempts", "injection"], "clean")
        out = pd.DataFrame({"id": rows["id"].to_numpy(), "verdict": verdict, "attempts": counts.astype(np.int32)})
        return int(counts[-1]), 0, out


class Budget(Conversation):
    """Running tokens and turns of a conversation; a row when little is left and one when it is over."""

    schema = ["thread_id", "id", "status", "remaining_tokens", "remaining_turns"]

    def __init__(self, tokens: int, turns: int, warn_share: float, idle_hours: int):
        super().__init__(idle_hours)
        self.token_budget, self.turn_budget, self.warn_share = tokens, turns, warn_share

    def follow(self, rows, tokens, turns):
        replies = (rows["role"] == "assistant").to_numpy(bool)
        used = tokens + np.cumsum(rows["token_count"].fillna(0).to_numpy(np.int64))
        taken = turns + np.cumsum(replies)
        left, turns_left = self.token_budget - used, self.turn_budget - taken
        ended = (left <= 0) | (turns_left <= 0)
        told = replies & (ended | (left < self.token_budget * self.warn_share))
        out = pd.DataFrame({"id": rows["id"].to_numpy(), "status": np.where(ended, "ended", "limit_approaching"),
                            "remaining_tokens": np.maximum(left, 0), "remaining_turns": np.maximum(turns_left, 0)})[told]
        return int(used[-1]), int(taken[-1]), out


class Sessions(StatefulProcessor):
    """Bursts of a conversation from its hourly rows: an hour that begins within the gap goes on with the session. A session is given
    out when an hour begins after its end, or when the watermark has passed the hour its end falls into, which could still bring a row."""

    schema = ["thread_id", "session_start", "session_end", "messages", "turns", "tokens"]

    def __init__(self, gap_hours: int):
        self.gap = gap_hours * HOUR

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("open", "first LONG, last LONG, messages LONG, turns LONG, tokens LONG", None)

    def _closed(self, key, sessions):
        rows = [(key[0], np.datetime64(a, "us"), np.datetime64(b + self.gap, "us"), m, t, n) for a, b, m, t, n in sessions]
        out = pd.DataFrame(rows, columns=self.schema)
        return out.astype({"session_start": "datetime64[us]", "session_end": "datetime64[us]"})

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        first, last = (rows[c].to_numpy("datetime64[us]").astype(np.int64) for c in ("first", "last"))
        sums = [rows[c].fillna(0).to_numpy(np.int64) for c in ("messages", "turns", "tokens")]
        some = sorted(zip(first.tolist(), last.tolist(), *(s.tolist() for s in sums)))  # an hour each
        closed, now = [], self.state.get() if self.state.exists() else None
        for hour in some:
            if now and hour[0] <= now[1] + self.gap:
                now = (now[0], hour[1], *(a + b for a, b in zip(now[2:], hour[2:])))
            else:
                closed += [now] if now else []
                now = hour
        self.state.update(tuple(now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(now[1] + self.gap) // HOUR) * HOUR // 1000)
        if closed:
            yield self._closed(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = self.state.get()
        self.state.clear()
        yield self._closed(key, [now])

    def close(self):
        pass


def stream_sessions(messages: DataFrame, gap_hours: int = STALE_HOURS) -> DataFrame:
    """Bursts of a conversation, closed once nothing came for the gap; `jobs.sessions` is the same of a table.

    Two stateful operators in a chain: hourly sums per thread, combined before the shuffle, then sessions over those, so that a thread of
    any length sends an hour's row at most.
    """
    summed = hours(messages, F.window("created_at", "1 hour"))
    return summed.groupBy("thread_id").transformWithStateInPandas(
        Sessions(gap_hours), "thread_id BIGINT, session_start TIMESTAMP_NTZ, session_end TIMESTAMP_NTZ, messages BIGINT, turns BIGINT, tokens BIGINT", "Append", "EventTime")


def stream_rate_limit(messages: DataFrame, limit: int = vocab.BLOCK_AFTER, forgive: bool = True, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """A verdict per message; `messages` has (thread_id, id, created_at, suspicious). `operators.safety.rate_limit` is the same of a table."""
    return messages.select("thread_id", "id", "created_at", "suspicious").groupBy("thread_id").transformWithStateInPandas(
        RateLimiter(limit, forgive, idle_hours), "thread_id BIGINT, id BIGINT, verdict STRING, attempts INT", "Append", "EventTime")


def stream_budget(messages: DataFrame, idle_hours: int = BUDGET_HOURS) -> DataFrame:
    """Status rows of conversations close to or past their budget."""
    rows = messages.select("thread_id", "id", "created_at", "role", F.col("token_count").cast("bigint").alias("token_count"))
    return rows.groupBy("thread_id").transformWithStateInPandas(
        Budget(vocab.TOKEN_BUDGET, vocab.TURN_BUDGET, vocab.WARN_SHARE, idle_hours),
        "thread_id BIGINT, id BIGINT, status STRING, remaining_tokens BIGINT, remaining_turns BIGINT", "Append", "EventTime")
