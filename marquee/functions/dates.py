"""Date and time columns. No expression here reads the wall clock: `as_of` is always an argument."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import let


def moment(as_of) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))


def midnight(as_of) -> datetime:
    return moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def ntz(value) -> Column:
    """A zoneless timestamp literal; folded before the scan, so comparisons with it push down."""
    return F.lit(moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


def days_later(as_of, days: int) -> datetime:
    return moment(as_of) + timedelta(days=days)


def to_local(c: Column, offset: Column) -> Column:
    """A wall clock time at a UTC offset ("Z", "+05:30", "-0600") as naive Chicago time."""
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    hours = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    return utc_to_local(c - F.make_dt_interval(F.lit(0), sign * hours, sign * minutes))


def utc_to_local(c: Column) -> Column:
    """A naive value that is really UTC as naive Chicago time, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), c)


ISO_STAMP = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
OFFSET = r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def iso_local(c) -> Column:
    """An ISO date or stamp as naive Chicago time: aware values converted, naive ones untouched, else null."""

    def read(text: Column) -> Column:
        wall = text.try_cast("timestamp_ntz")
        local = F.when(text.rlike(OFFSET), let(F.regexp_extract(text, OFFSET, 1), lambda o: to_local(wall, o))).otherwise(wall)
        return F.when(text.rlike(ISO_STAMP), local)

    return let(F.trim(F.col(c) if isinstance(c, str) else c), read)
