"""Reading, copying and writing the catalogue's tables."""

from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, TimestampNTZType

from marquee.functions.text import each
from marquee.model import REFERENCES, TABLES


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def read_loose(spark: SparkSession, location: str, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """One table as it is stored: a parquet folder, or a database table when JDBC options are given.

    The options pass through to Spark's reader; partitionColumn, lowerBound, upperBound and numPartitions split the
    read of a large table over the executors.
    """
    if jdbc:
        return spark.read.format("jdbc").option("url", location).option("dbtable", name).options(**jdbc).load()
    return spark.read.parquet(f"{location}/{name}")


def read_table(spark: SparkSession, location: str, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """One table in its declared schema, wherever it comes from. A column that is stored in its type is read as it is, so filters reach
    the scan; another one is cast, a missing one is null. `rejected` tells which values did not survive."""
    return coerce_table(read_loose(spark, location, name, jdbc), name)


def read_catalog(spark: SparkSession, location: str, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    return {name: read_table(spark, location, name, jdbc) for name in TABLES}


def read_rejected(spark: SparkSession, location: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """`rejected` of all tables of a stored catalogue."""
    return reduce(DataFrame.unionAll, [rejected(read_loose(spark, location, name, jdbc), name) for name in TABLES])


def _coerced(name: str, have: DataType, want: DataType) -> Column:
    value = F.col(name)
    if have == want:
        return value
    if isinstance(want, ArrayType) and isinstance(have, StringType):
        return F.from_json(value, want)
    if isinstance(want, TimestampNTZType) and isinstance(have, StringType):
        # "2026-10-06 19:30:00.000000", "2026-10-06 19:30:00" and "2026-10-06"
        shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2}(?:\.\d+)?)?$")
        return F.when(shaped, value.try_cast(want))
    return value.try_cast(want)


def coerce_table(df: DataFrame, name: str) -> DataFrame:
    """Rows of a table as they come out of a loosely typed database, in the table's types; missing columns are null."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        (_coerced(f.name, have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema_of(name)])


def rejected(df: DataFrame, name: str) -> DataFrame:
    """(table, id, column, text): the values of a loosely typed table that are not of the declared type and so read as null. One pass;
    columns that are stored in their type have none and are not read."""
    have = {f.name: f.dataType for f in df.schema}
    checked = [f for f in schema_of(name) if f.name in have and have[f.name] != f.dataType]
    lost = F.array(*[F.when(F.col(f.name).isNotNull() & _coerced(f.name, have[f.name], f.dataType).isNull(), F.struct(
        F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("text"))) for f in checked]) if checked else F.expr(
        "CAST(array() AS array<struct<column:string,text:string>>)")
    key = F.col("id").cast("string") if "id" in have else F.lit(None).cast("string")
    return each(df, [F.lit(name).alias("table"), key.alias("id")], F.array_compact(lost), "_at", "lost").select("table", "id", "lost.column", "lost.text")


def copy_order(names, references: dict[str, dict[str, str]] = REFERENCES) -> list[str]:
    """The tables with parents before children, whatever order they are given in. References in a circle are an error."""
    names = sorted(names)
    parents = {name: {p for p in references.get(name, {}).values() if p in names and p != name} for name in names}
    return list(TopologicalSorter(parents).static_order())


def orphans(tables: dict[str, DataFrame], references: dict[str, dict[str, str]] = REFERENCES) -> DataFrame:
    """(table, column, parent, rows, missing, example): per reference between the tables given, how many rows point at no row of the
    parent, how many different ids they name, and the least of these.

    Rows are counted per id before they meet the parent's ids, so an id that many rows name is one row in the join. A null refers to nothing.
    """
    found = []
    for child, columns in references.items():
        for column, parent in columns.items():
            if child in tables and parent in tables:
                named = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
                known = tables[parent].select(F.col("id").cast("string").alias("key"))
                found.append(named.join(known, "key", "left_anti").agg(
                    F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("missing"), F.min("key").alias("example")).select(
                    F.lit(child).alias("table"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "rows", "missing", "example"))
    if not found:
        return next(iter(tables.values())).sparkSession.createDataFrame(
            [], "table STRING, column STRING, parent STRING, rows BIGINT, missing BIGINT, example STRING")
    return reduce(DataFrame.unionAll, found)


def copy_tables(spark: SparkSession, source: dict[str, DataFrame], target: str, references: dict[str, dict[str, str]] = REFERENCES,
                keep_orphans: bool = False) -> DataFrame:
    """Tables copied parents first; returns (table, source_rows, copied_rows) read back from what was written.

    Nothing is written if a row refers to a parent that the source does not have, unless `keep_orphans`.
    """
    typed = {name: coerce_table(source[name], name) for name in copy_order(source, references)}
    if not keep_orphans:
        if lost := orphans(typed, references).where("rows > 0").collect():  # a row per reference
            raise ValueError("rows without a parent: " + "; ".join(f"{r['table']}.{r['column']}: {r['rows']}, such as {r['example']}" for r in lost))
    counts = []
    for name, rows in typed.items():
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
        both = source[name].select(F.lit(1).alias("s"), F.lit(0).alias("c")).unionAll(
            spark.read.schema(schema_of(name)).parquet(f"{target}/{name}").select(F.lit(0), F.lit(1)))
        counts.append(both.agg(F.lit(name).alias("table"), F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
                               F.coalesce(F.sum("c"), F.lit(0)).alias("copied_rows")))
    return reduce(DataFrame.unionAll, counts)


def write_catalog(ev: DataFrame, path: str) -> None:
    """A snapshot of the listings, one folder per month of the start date, undated rows in their own.

    The rebalance lets AQE cut a month that holds much of the table into several even files and merge small months,
    instead of every task writing a sliver of every month.
    """
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("undated"))
    ev.withColumn("event_month", month).hint("rebalance", "event_month").write.mode("overwrite").partitionBy(
        "event_month").parquet(path)
