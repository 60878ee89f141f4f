"""What several operators of this folder share: written intermediate tables and connected components."""

import gc
import re
import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.lineage import checkpoint_root


#: White space, letters and numbers up to U+00FF, as the public tokenizers' libraries see them.
LATIN = {r"\s": r"\t\n\x0b\x0c\r \x85\xa0", r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾"}


def with_classes(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its classes spelled out."""
    for name, members in classes.items():
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{members}]")
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, pattern)
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, pattern)
        pattern = pattern.replace(name, f"[{members}]")
    return pattern


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once in each worker process: functions travel by value, so their globals don't last. Workers serve one
    stage after the other; only the last key's value is kept, and what the one before took up is given back first."""
    kept = sys.modules.setdefault("_marquee_kept", types.ModuleType("_marquee_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        kept[key] = make()
    return kept[key]


class Remembered:
    """Values of text pieces seen before, bounded by their bytes. Pieces that come up again outlive those that don't: when the younger
    half is full it becomes the older one, and what is asked for from there moves back."""

    #: Bytes that a piece and its value take up besides their own.
    OVERHEAD = 200

    def __init__(self, most: int):
        self.half, self.held = most // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, piece: str, value: bytes) -> None:
        self.young[piece] = value
        self.held += len(piece) + len(value) + self.OVERHEAD

    def joined(self, split: list[list[str]], learn: Callable[[list[str]], None]) -> list[bytes]:
        """For each list of pieces their values, one after the other; `learn` puts those of unknown pieces."""
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        out: list = [None] * len(split)
        young, get, rest = self.young, self.young.__getitem__, []
        for at, pieces in enumerate(split):
            try:
                out[at] = b"".join(map(get, pieces))
            except KeyError:
                rest.append(at)
        if rest:
            missing = set().union(*(split[at] for at in rest)).difference(young)
            for piece in missing.intersection(self.old):
                self.put(piece, self.old[piece])
            learn(list(missing.difference(young)))
            for at in rest:
                out[at] = b"".join(map(get, split[at]))
        return out


#: With it Spark deletes the shuffle files of a query when the query ends; else they stay until the driver collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet under the shared checkpoint folder, and read from there by every later branch.
    A lost executor costs nothing that is written already, and the shuffle files behind the rows go."""
    spark = df.sparkSession
    path, before = f"{checkpoint_root(spark)}/{name}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stored` returned, once what was made of them is stored itself."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not use yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node in `links`, root being the least node it is connected with.

    Alternating large-star and small-star rounds: every round points nodes at the least neighbour they know, and keeps
    at most one row per node and neighbour. A hub of any size is only ever aggregated with `min` before the shuffle or
    joined to one row, which AQE splits. Each round is written to the shared folder; the driver sees a count and a checksum.
    """
    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("u > v").distinct()

    edges = stored(tidy(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stored(tidy(small.union(low.select("u", F.col("m").alias("v")))), "links")
        forget(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
