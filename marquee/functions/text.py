"""Text columns shared by several operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def folded(c) -> Column:
    """The lower-cased, trimmed form names are compared in."""
    return F.lower(F.trim(col(c)))


def any_match(c, patterns) -> Column:
    """One alternation, so the text expression is evaluated once and not once per pattern."""
    return col(c).rlike("|".join(f"(?:{p})" for p in patterns))


def found(c, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null when there is none or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(col(c), pattern, group)), F.lit(""))


def first_group(c, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null when there is none. For groups that cannot match nothing."""
    return F.get(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.lit(0))


def let(value, body) -> Column:
    """body(value) with the value computed once.

    Inside a lambda or a conditional branch Spark computes an expression again at every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_as_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_words(c, n: int) -> Column:
    """The first n words, with dots when something was cut; empty text for null."""
    words = F.split(collapse(F.coalesce(col(c), F.lit(""))), " ")
    return F.concat(F.array_join(F.slice(words, 1, n), " "),
                    F.when(F.size(words) > n, F.lit("...")).otherwise(F.lit("")))


def each(df: DataFrame, keep, array, position: str = "position", value: str = "e") -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer add a filter on the array's size, which computes the array a second time; the
    outer form does not, and rows without elements are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


def keep_present(df: DataFrame, c: str) -> DataFrame:
    """Rows that have a computed value, see keep_flagged."""
    return keep_flagged(df.withColumn("_has", F.col(c).isNotNull()), "_has").drop("_has")


def keep_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose computed flag is true.

    A plain filter would be pushed below the columns the flag is made of and repeat their expressions, once per
    mention; read back through a one-element explode the flag is evaluated where it was computed.
    """
    return df.withColumn("_kept", F.explode(F.array(F.col(flag)))).where("_kept").drop("_kept")
