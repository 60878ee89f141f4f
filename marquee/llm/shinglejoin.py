"""Near copies by the exact Jaccard similarity of their word shingles, for the pipeline's near-dedup stage.

Words and shingles are those of `simhash`, five words wide; a text's set holds the 64-bit hashes of its distinct shingles. Two texts are
linked if their sets are equal or have a Jaccard similarity of at least `SIMILARITY`; of each connected group one row stays. Every link is
verified on whole sets; no pair at the border is lost:

1. Texts with the same set are one set. Texts without words share the empty one.
2. First candidates, in proportion to the sets: SimHash links within `simhash.RADIUS` bits, and each set with the first of those that
   share a prefix shingle with it. They connect most of a crowd of near copies.
3. All other candidates: similar sets share one of their first |x| - ceil(0.8 |x|) + 1 shingles in any total order (prefix filter); rarest
   first is the order here. Prefix rows meet on the shingle where their sets are not connected yet, under length and positional filters.

Before texts are read again, a sketch of `BITS` bits, each turned over by every shingle that falls on it, rules out pairs: sketches
differ in no more bits than the sets do in shingles. Of sets with more than `BITS` shingles it says nothing; these have their shingles
counted in buckets, four to eight a bucket, whose counts differ by no more than the sets do. Prefixes are never shuffled whole, and
neither are texts that no candidate needs.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm import simhash
from marquee.llm.common import components, forget, free_name, quoted, stored

WIDTH = 5
#: Similarity as a fraction.
SIMILARITY = (4, 5)
#: Hash buckets that shingles are counted in, for the order only.
BUCKETS = 1 << 18
BITS = 1024
#: The most a bucket of a large set counts to.
FULL = 255


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(simhash.shingles(text, width))


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """For each hash bucket how many shingles fall on it. Every one counts for the order: a bucket holds many rare ones, and a common one
    stands out by far less than their number. Spark sums the counts per bucket; `BUCKETS` numbers are collected."""
    def counted(parts):
        seen, some, held = np.zeros(BUCKETS, np.int64), [], 0
        for part in parts:
            for text in part["text"]:
                some.append((shingle_set(text, width) % np.uint64(BUCKETS)).astype(np.int32))
                held += len(some[-1])
                if held >= BUCKETS:
                    seen += np.bincount(np.concatenate(some), minlength=BUCKETS)
                    some, held = [], 0
        if some:
            seen += np.bincount(np.concatenate(some), minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "seen": seen[some]})

    total = np.zeros(BUCKETS, np.int64)
    sums = texts.select("text").mapInPandas(counted, "bucket INT, seen LONG").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    total[sums["bucket"].to_numpy()] = sums["seen"].to_numpy()
    return np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)


def bucketed(own: np.ndarray) -> bytes | None:
    """How many shingles of a large set fall on each of a power of two of buckets, a byte each."""
    if len(own) <= BITS:
        return None
    buckets = 1 << (len(own) // 4).bit_length() - 1
    return np.minimum(np.bincount((own % np.uint64(buckets)).astype(np.int64), minlength=buckets), FULL).astype(np.uint8).tobytes()


def spread(x: bytes, y: bytes) -> int:
    """By how much the counts of two sets differ; the finer ones are folded until they have as many buckets."""
    a, b = (np.frombuffer(z, np.uint8).astype(np.int32) for z in (x, y))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = np.minimum(a[:len(a) // 2] + a[len(a) // 2:], FULL)
    return int(np.abs(a - b).sum())


def described(text: Column, width: int, similarity: tuple[int, int], seen: np.ndarray) -> Column:
    """A struct: the set's hash, its size, a fingerprint, its prefix, its sketch and, of a large set, its counts."""
    above, below = similarity

    @F.pandas_udf("struct<set:long,n:int,fp:long,prefix:array<long>,sketch:array<long>,counts:binary>")
    def struct(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            held = simhash.shingles(t, width)
            own = np.unique(held)
            short = len(own) - -(-len(own) * above // below) + 1 if len(own) else 0
            order = np.lexsort((own, seen[(own % np.uint64(BUCKETS)).astype(np.int64)]))[:short]
            name = np.uint64(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 42)).astype(np.int64)
            odd = np.bincount((own >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
            out.append((name, len(own), simhash.majority(held), own[order].view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64),
                        bucketed(own)))
        return pd.DataFrame(out, columns=["set", "n", "fp", "prefix", "sketch", "counts"])

    return struct(text)


def _needed(n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    """The least overlap of sets of n and m shingles that are similar."""
    above, below = similarity
    return F.floor(((n + m) * above + (above + below - 1)) / F.lit(above + below)).cast("int")


def _likely(sets: DataFrame, pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that sizes, sketches and counts leave."""
    @F.pandas_udf("long")
    def between(some: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([spread(x, y) if x is not None and y is not None else 0 for x, y in zip(some, others)], dtype="int64")

    a = sets.select(F.col("set").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("z1"))
    b = sets.select(F.col("set").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("z2"))
    needed = _needed(F.col("n1"), F.col("n2"), similarity)
    most = F.col("n1") + F.col("n2") - 2 * needed
    bits = F.aggregate(F.zip_with("z1", "z2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    close = (pairs.join(a, "a").join(b, "b").where((F.least("n1", "n2") >= needed) & (bits <= most))
             .select("a", "b", most.alias("most")))
    large = sets.where("counts IS NOT NULL")
    return (close.join(large.select(F.col("set").alias("a"), F.col("counts").alias("c1")), "a", "left")
            .join(large.select(F.col("set").alias("b"), F.col("counts").alias("c2")), "b", "left")
            .where(between("c1", "c2") <= F.col("most")).select("a", "b"))


def verified(texts: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for, stored; only the texts of sets in `pairs` are read."""
    above, below = similarity

    @F.pandas_udf("array<long>")
    def hashes(some: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in some])

    pairs = stored(_likely(sets, pairs, similarity), "likely")
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    # stored, so that their size is known beforehand and texts are not shuffled to meet a few rows
    rows = stored(sets.join(wanted, "set", "left_semi").select("set", F.col("first.row").alias("row")), "wanted")
    held = stored(texts.join(rows, "row").select("set", hashes("text").alias("held")), "held")
    a, b = held.select(F.col("set").alias("a"), F.col("held").alias("x")), held.select(F.col("set").alias("b"), F.col("held").alias("y"))
    met = F.size(F.array_intersect("x", "y"))
    out = stored(pairs.select("a", "b").join(a, "a").join(b, "b")
                 .where(met * (above + below) >= (F.size("x") + F.size("y")) * above).select("a", "b"), "verified")
    forget(pairs, rows, held)
    return out


def links(texts: DataFrame, rows: DataFrame, sets: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): pairs of similar sets, enough to connect all that is connected, stored."""
    every = rows.select("set", "n", F.posexplode("prefix").alias("at", "token"))
    crowds = every.groupBy("token").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low < high")
    crowds = stored(crowds.select("token", F.col("low").alias("head")), "crowds")
    shared = stored(every.join(crowds, "token").select("token", "set", "n", "at", "head").distinct(), "shared")

    def fits(x, y) -> Column:
        """Length and positional filters: as many shingles as needed must be left from the common one on."""
        return F.least(x("n") - x("at"), y("n") - y("at")) >= _needed(x("n"), y("n"), similarity)

    def side(name: str):
        return lambda c: F.col(f"{name}.{c}")

    first = shared.where("set = head")
    led = (shared.alias("x").join(first.alias("y"), (F.col("x.token") == F.col("y.token")) & fits(side("x"), side("y")))
           .select("y.set", "x.set"))
    heads = sets.groupBy("fp").agg(F.min("set").alias("a"))
    same = sets.join(heads, "fp").select("a", F.col("set").alias("b"))
    near = simhash.links_between(heads, "fp").alias("l")
    near = (near.join(heads.select(F.col("fp").alias("fa"), F.col("a").alias("sa")), F.col("l.a") == F.col("fa"))
            .join(heads.select(F.col("fp").alias("fb"), F.col("a").alias("sb")), F.col("l.b") == F.col("fb")).select("sa", "sb"))
    tried = stored(same.union(near).union(led).where("a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    forget(crowds)
    known = verified(texts, sets, tried, width, similarity)

    roots = components(known, "a", "b")
    placed = stored(shared.join(roots, F.col("set") == F.col("node"), "left")
                    .select("token", "set", "n", "at", F.coalesce("root", "set").alias("root")), "placed")
    forget(shared)
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    apart = placed.join(mixed, "token", "left_semi")
    x, y = apart.alias("x"), apart.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & fits(side("x"), side("y")))
    rest = (met.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    rest = stored(rest, "rest")
    forget(placed, tried)
    more = verified(texts, sets, rest, width, similarity)
    out = stored(known.union(more), "linked")
    forget(rest, known, more)
    return out


def _placed(docs: DataFrame, row: str) -> DataFrame | None:
    """`docs` with a column `row`, the place of each row in the files that `docs` reads; none if it is anything but Parquet files as they are."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in map(str.lower, docs.columns):
        return None
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("no"))
    try:
        return docs.withColumn(row, place)
    except AnalysisException:
        return None


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The columns and rows of `docs`, one row of each group of near copies: the one with the smallest doc_id, or of a group without
    doc_ids the one read first. Null texts count as empty. Rows are told apart by their place in the Parquet files they come from, or else
    by a number stored with them, whether or not they share a doc_id."""
    row = free_name(docs, "row_no")
    numbered = _placed(docs, row)
    if numbered is None:
        numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(quoted(row).alias("row"), "doc_id", "text")
    rows = stored(texts.select("row", F.monotonically_increasing_id().alias("turn"), "doc_id",
                               described(F.col("text"), width, similarity, rarity(texts, width)).alias("s"))
                  .select("row", "turn", "doc_id", "s.*"), "shingled")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "turn", "row")
    sets = stored(rows.groupBy("set").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"),
                                          F.first("sketch").alias("sketch"), F.first("counts").alias("counts")), "sets")
    linked = links(texts.select("row", "text"), rows, sets, width, similarity)
    roots = components(linked, "a", "b")
    grouped = (sets.join(roots, F.col("set") == F.col("node"), "left")
               .select("set", "first", F.coalesce("root", "set").alias("root")))
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    kept = grouped.join(best, "root").select("set", F.col("best.row").alias("kept"))
    gone = stored(rows.join(kept, "set").where("row <> kept").select("row"), "gone")
    forget(rows, sets, linked)
    return numbered.join(gone, quoted(row) == F.col("row"), "left_anti").select(*[quoted(c) for c in docs.columns])
