"""Text safety: injection and leak patterns, redaction, input cleaning, and the per-session verdict on messages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import vocab
from marquee.functions.text import col
from marquee.operators.ordering import running


def _lines(pattern: str) -> str:
    """Only a newline ends a line, whatever other separators a text holds."""
    return "(?d)" + pattern


def first_pattern(text, patterns) -> Column:
    """1-based position of the first pattern found, null when none is."""
    hit = None
    for i, p in enumerate(patterns, 1):
        test = col(text).rlike(_lines(p))
        hit = F.when(test, i) if hit is None else hit.when(test, i)
    return hit


def injection_pattern(text) -> Column:
    allowed = col(text).rlike(_lines("|".join(f"(?:{p})" for p in vocab.INJECTION_ALLOW)))
    return F.when(~allowed, first_pattern(text, vocab.INJECTION))


def flag_injection(messages: DataFrame, text: str = "content") -> DataFrame:
    """Which injection pattern a message shows; the allow list is asked first."""
    return messages.withColumn("pattern", injection_pattern(text)).withColumn("suspicious", F.col("pattern").isNotNull())


def flag_leak(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("pattern", first_pattern(text, vocab.LEAKS)).withColumn("leaks", F.col("pattern").isNotNull())


def redact(text) -> Column:
    """Secrets first, then what follows a mention of prompts, instructions or rules on its line."""
    gone = F.lit("[REDACTED]")
    return F.regexp_replace(F.regexp_replace(col(text), F.lit(vocab.SECRET_ASSIGNMENT), gone), F.lit(vocab.PROMPT_LINE), gone)


def sanitize_input(text) -> Column:
    """The input without control characters, whatever its length."""
    return F.regexp_replace(col(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def acceptable(text) -> Column:
    return F.length(col(text)) <= vocab.MAX_SAFE_INPUT


def validate_messages(messages: DataFrame) -> DataFrame:
    """The verdict on each message in arrival order (ids): blocked session, invalid, injection or clean.

    A session is blocked from its third injection on, so what matters is how many came before: a running count in
    blocks of ids, safe for a session of any length.
    """
    rows = messages.withColumn("_pattern", injection_pattern("content"))
    suspicious = acceptable("content") & F.col("_pattern").isNotNull()
    rows = rows.withColumn("_suspicious", F.when(suspicious, 1).otherwise(0))
    counted = running(rows, ["thread_id"], "id", {"_attempts": F.col("_suspicious")})
    before = F.col("_attempts") - F.col("_suspicious")
    limit = vocab.BLOCK_AFTER
    verdict = (F.when(before >= limit, "blocked").when(~acceptable("content"), "invalid")
               .when((F.col("_suspicious") == 1) & (F.col("_attempts") >= limit), "too_many_attempts")
               .when(F.col("_suspicious") == 1, "injection").otherwise("clean"))
    return counted.withColumns({"verdict": verdict, "attempts": F.least(F.col("_attempts"), F.lit(limit))}).withColumn(
        "sanitized", F.when(F.col("verdict") == "clean", sanitize_input("content")).otherwise("")).drop(
        "_pattern", "_suspicious", "_attempts")


#: Hours after which a conversation's attempts are forgotten, and the width of the blocks its messages are counted in.
IDLE_HOURS = 24


def rate_limit(messages: DataFrame, limit: int = vocab.BLOCK_AFTER, forgive: bool = True, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """(thread_id, id, verdict, attempts): the verdict on each message (thread_id, id, created_at, suspicious) in (time, id) order.

    A suspicious message counts one attempt, a clean one takes one back, not below zero (with `forgive`), and from `limit` attempts on
    the conversation is blocked. After `idle_hours` without a message it starts anew.

    A count that adds steps of one and never falls below zero is s - min(0, least s so far), s being the sum of steps. So a
    thread's messages are summed hour by hour: within an hour from zero, with four numbers for the hour as a whole (sum, least sum, highest
    sum, highest rise); a window over hours gives what each begins with. No task holds more than a thread's hour, or its hours. A null thread is a
    thread like any other.
    """
    rows = messages.select("thread_id", "id", "created_at", F.coalesce("suspicious", F.lit(False)).alias("suspicious")).withColumns({
        "hour": F.date_trunc("hour", "created_at"), "step": F.when(F.col("suspicious"), 1).otherwise(-1 if forgive else 0)})
    inside = Window.partitionBy("thread_id", "hour").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("step").over(inside)).withColumn("least", F.min("sum").over(inside))
    told = rows.groupBy("thread_id", "hour").agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.sum("step").alias("total"), F.min("sum").alias("low"),
        F.max("sum").alias("top"), F.max(F.col("sum") - F.col("least")).alias("rise"))
    order = Window.partitionBy("thread_id").orderBy("hour")
    gap = F.make_dt_interval(F.lit(0), F.lit(idle_hours))
    fresh = F.when(F.col("first") > F.lag("last").over(order) + gap, 1).otherwise(0)
    told = told.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order))
    session = Window.partitionBy("thread_id", "session").orderBy("hour")
    before = session.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("so_far", F.coalesce(F.sum("total").over(before), F.lit(0)))
    lowest = F.least(F.lit(0), F.coalesce(F.min(F.col("so_far") + F.col("low")).over(before), F.lit(0)))
    told = told.withColumn("begin", F.col("so_far") - lowest)
    reached = F.greatest(F.col("begin") + F.col("top"), F.col("rise")) >= limit
    told = told.withColumn("over", F.coalesce(F.max(reached).over(before), F.lit(False)))
    starts = told.select(F.col("thread_id").alias("_thread"), F.col("hour").alias("_hour"), "begin", "over")
    out = rows.join(starts, F.col("thread_id").eqNullSafe(F.col("_thread")) & F.col("hour").eqNullSafe(F.col("_hour")))
    out = out.withColumn("count", F.greatest(F.col("begin") + F.col("sum"), F.col("sum") - F.col("least")))
    earlier = Window.partitionBy("thread_id", "hour").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.col("over") | F.coalesce(F.max(F.col("count") >= limit).over(earlier), F.lit(False))
    out = out.withColumn("blocked", blocked)
    verdict = (F.when(F.col("blocked"), "blocked").when(F.col("suspicious") & (F.col("count") >= limit), "too_many_attempts")
               .when(F.col("suspicious"), "injection").otherwise("clean"))
    attempts = F.when(F.col("blocked"), limit).otherwise(F.col("count"))
    return out.select("thread_id", "id", verdict.alias("verdict"), attempts.cast("int").alias("attempts"))
