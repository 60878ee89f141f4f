"""Near copies by 64-bit SimHash: fingerprints, links through pigeonhole blocks, and connected groups.

A text's bytes A-Z are lower-cased; words are runs of bytes other than space and 09-0D; shingles are `width` words, repeats
counted, joined by one space (fewer words: one shingle of all of them). A fingerprint bit is 1 if it is set in over half of
the shingles' XXH64 (seed 42). No words, or a null text: fingerprint zero, which links like any other.

Two fingerprints within `radius` bits differ in at most `radius` of the blocks the 64 bits are cut into, so they agree in at
least `BLOCKS - radius` of them: one key per choice of that many blocks brings every such pair together at least once.
Links are looked for between distinct fingerprints only. The members of one key are compared inside one task, which returns
a spanning forest of them (at most one row per member), never all pairs; keys with more than `CHUNK` members are cut into
pieces, and every pair of pieces is compared in a task of its own, so memory is bounded and no link is lost.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, free_name, quoted, stored

WIDTH = 4
RADIUS = 4
BLOCKS = 6
#: Members of one key that meet in one task, at most twice this.
CHUNK = 8192


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words] if words else []
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(s), 42) for s in runs], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view("<i8")[0])


def simhash(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    return majority(shingles(text, width))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return prints(text)


def block_keys(fp: Column, radius: int = RADIUS) -> Column:
    """One long per choice of blocks that must agree: the choice's number above the bits of its blocks."""
    if not 0 < radius < BLOCKS:
        raise ValueError(f"radius must be 1 to {BLOCKS - 1}")
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        if sum(edges[i + 1] - edges[i] for i in chosen) > 58:
            raise ValueError("the radius leaves too many bits in one key")
        key = F.lit(number).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            bits = F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect whatever members are connected by steps of at most `radius` bits among these members."""
    rest, links = values, []
    while rest.size > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and rest.size:
            here = reached.pop()
            close = np.bitwise_count((rest ^ here).view(np.uint64)) <= radius  # of signed numbers it counts the absolute value's bits
            if close.any():
                found = rest[close]
                links += [(int(here), int(f)) for f in found]
                reached += list(found)
                rest = rest[~close]
    return links


def links_between(prints: DataFrame, fp: str, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links among the distinct values of column `fp`, enough to connect all that is connected."""
    keyed = prints.select(F.col(fp).alias("fp"), F.explode(block_keys(F.col(fp), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = (keyed.join(sizes, "key").select("key", "fp", parts.alias("parts"))
           .select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
           .groupBy("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
           .agg(F.collect_list("fp").alias("fps")))
    apart = (F.size("fps") == 2) & (F.bit_count(F.get("fps", F.lit(0)).bitwiseXOR(F.get("fps", F.lit(1)))) > radius)

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def linked(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in forest(np.asarray(g, dtype=np.int64), radius)] for g in groups])

    return (met.where((F.size("fps") > 1) & ~apart).select(F.explode(linked("fps")).alias("link"))
            .select("link.a", "link.b").distinct())


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs` (doc_id, text and any others): doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id reachable over links, its own included.

    Null texts count as empty. Rows without doc_id get a fingerprint and the component of their group's smallest doc_id
    (null if there is none). Repeated rows stay, each with its own result. An empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links_between(first, "fp", radius, chunk), "a", "b")
    grouped = (first.join(roots, first.fp == roots.node, "left")
               .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(known, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The columns and rows of `docs`, one row of each near-copy group: the one with the smallest doc_id. Rows without a doc_id
    stay. Of repeated rows with the group's smallest doc_id one stays."""
    groups = near_groups(docs, **options).where("doc_id is not null")
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    mark = free_name(docs, "kept_id")
    named = docs.where(F.col("doc_id").isNotNull())
    stay = named.join(kept.select(F.col("doc_id").alias(mark)), F.col("doc_id") == quoted(mark), "left_semi")
    return stay.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
