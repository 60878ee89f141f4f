"""Near copies by one-permutation hashing: densified signatures, banded buckets, star-shaped candidates, exact confirmation.

Words and shingles are those of `simhash`, five words wide; a text's set holds the 64-bit hashes of its distinct shingles (fewer words: the
whole sequence is the one shingle). Texts are linked if 100 * intersection >= 85 * union; sets without shingles are linked with nothing.

1. One permutation: the hash of a shingle falls into one of `BANDS * ROWS` bins, the least hash of a bin is its value. An empty bin
   takes over the value of the first filled bin in a random order of its own (optimal densification), so that two sets agree in a bin
   with a probability of their similarity, however small they are, and independently of other bins. `ROWS` bins make a band's key.
2. Texts with equal sets are one set from here on. Two sets at a similarity of 0.85 share none of the 40 keys with a probability
   of (1 - 0.85^5)^40 = 6e-11; that is all that can be lost, and more bands make it less.
3. Stars: each set under a key is held against the key's first set only, so there are as many candidates as members. The first
   round does so for the first `FIRST` bands; what its links connect is not looked at again. The second goes over the keys of all
   bands that still hold sets of several components, with another centre.
4. The last round holds sets of one key against each other where their components still differ, so that no link is lost to the star's
   shape; size and sketch are conditions of that join. A sketch has `BITS` bits, each turned over by every shingle that falls on it: two
   differ in no more bits than the sets do in shingles.
5. Candidates that size and sketch allow are confirmed on their full sets, hashed from the texts again.

Joins on keys and centres are split by AQE; nothing collects the members of a key.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, stored
from marquee.llm.simhash import shingles

WIDTH = 5
#: Least similarity, as a fraction.
SIMILARITY = (85, 100)
BANDS, ROWS = 40, 5
#: Bands of the first round.
FIRST = 8
#: Bits of a sketch.
BITS = 1024
#: What stands for a missing doc_id where texts are looked up.
NO_ID = -(1 << 63)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(shingles(text, width))


class Signer:
    """Signatures of sets and the keys of their bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        draw = np.random.default_rng(seed)
        self.turns = draw.permuted(np.tile(np.arange(self.bins), (self.bins, 1)), axis=1)
        self.seeds = draw.integers(1 << 63, size=bands, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """One value per bin, of ascending hashes (one at least)."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        least = np.flatnonzero(np.diff(bins, prepend=-1))  # bins ascend as the hashes do
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[least]], filled[bins[least]] = hashes[least], True
        if not filled.all():
            empty = np.flatnonzero(~filled)
            turns = self.turns[empty]
            out[empty] = out[turns[np.arange(len(empty)), filled[turns].argmax(axis=1)]]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One key per band."""
        values, out = self.signature(hashes).reshape(self.bands, self.rows), self.seeds.copy()
        for column in values.T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def sketch(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def described(text: Column, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> Column:
    """A struct: the set's name and a second one, its size, its keys and its sketch; a set without shingles has none of the last two."""
    signer, none = Signer(bands, rows), np.empty(0, np.int64)

    @F.pandas_udf("struct<set:long,check:long,n:long,keys:array<long>,sketch:array<long>>")
    def struct(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            own = shingle_set(text, width)
            data = own.astype("<u8").tobytes()
            names = np.array([xxhash.xxh64_intdigest(data, 42), xxhash.xxh64_intdigest(data, 7)], dtype=np.uint64).view(np.int64)
            out.append((*names, len(own), signer.keys(own) if len(own) else none, sketch(own) if len(own) else none))
        return pd.DataFrame(out, columns=["set", "check", "n", "keys", "sketch"])

    return struct(text)


def _text_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key_id"), F.xxhash64("text").alias("key_text")]


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per set with shingles: its least doc_id, the key of one of its texts, size, keys and sketch."""
    sets = stored(rows.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("key_id", "key_text")).alias("of"), F.min("check").alias("low"), F.max("check").alias("high"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "sets")
    if sets.where("low <> high").limit(1).count():
        raise ValueError("two different sets have the same 64-bit name")
    return sets.drop("low", "high")


def _fit(x: str, y: str, similarity: tuple[int, int]) -> Column:
    """Whether sizes and sketches of two rows, named x and y, allow the similarity: |x & y| >= s / (1 + s) * (|x| + |y|)."""
    above, below = similarity
    needed = f"((({x}.n + {y}.n) * {above} + {above + below - 1}) div {above + below})"
    bits = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(BITS // 64))
    return F.expr(f"least({x}.n, {y}.n) >= {needed} AND {bits} <= {x}.n + {y}.n - 2 * {needed}")


class Confirmed:
    """The links confirmed so far, over rounds of candidates."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, similarity: tuple[int, int]):
        self.docs, self.sets, self.width, self.similarity = docs, sets, width, similarity
        self.tried = self.held = self.links = self.roots = None

    def add(self, pairs: DataFrame, likely: bool = False) -> None:
        """Confirms pairs (a, b) of sets, a < b, that were not tried before; `likely` ones passed sizes and sketches already."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        if not likely:
            x, y = (self.sets.select(F.col("set").alias(c), "n", "sketch").alias(f"of_{c}") for c in "ab")
            pairs = pairs.join(x, "a").join(y, "b").where(_fit("of_a", "of_b", self.similarity)).select("a", "b")
        pairs = stored(pairs, "likely")
        wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
        if self.held is not None:
            wanted = wanted.join(self.held.select("set"), "set", "left_anti")
        held = stored(self._full(wanted), "held")
        self.held = held if self.held is None else self.held.union(held)
        above, below = self.similarity
        x, y = (self.held.select(F.col("set").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
        met, total = F.size(F.array_intersect("hashes_a", "hashes_b")), F.size("hashes_a") + F.size("hashes_b")
        links = stored(pairs.join(x, "a").join(y, "b").where(met * below >= (total - met) * above).select("a", "b"), "confirmed")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.links = links if self.links is None else self.links.union(links)
        self.roots = components(self.links, "a", "b")

    def _full(self, wanted: DataFrame) -> DataFrame:
        """(set, hashes) of the wanted sets, from one text each."""
        width = self.width

        @F.pandas_udf("struct<set:long,hashes:array<long>>")
        def full(texts: pd.Series) -> pd.DataFrame:
            own = [shingle_set(t, width) for t in texts]
            names = np.array([xxhash.xxh64_intdigest(o.astype("<u8").tobytes(), 42) for o in own], dtype=np.uint64).view(np.int64)
            return pd.DataFrame({"set": names, "hashes": [o.view(np.int64) for o in own]})

        of = self.sets.join(wanted, "set", "left_semi").select("of.*")
        texts = self.docs.select(*_text_key(), "text").join(of, ["key_id", "key_text"], "left_semi")
        return texts.select(full("text").alias("s")).groupBy("s.set").agg(F.first("s.hashes").alias("hashes"))

    def open_keys(self, bands: int | None = None) -> DataFrame:
        """(key, set, root, centre): the sets of all keys that hold several components, and one set of each key."""
        sets = self.sets.select("set", F.slice("keys", 1, bands).alias("keys") if bands else "keys")
        if self.roots is None:
            placed = sets.withColumn("root", F.col("set"))
        else:
            placed = sets.join(self.roots, F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "keys")
        every = placed.select("set", "root", F.explode("keys").alias("key"))
        turn = F.min("set") if self.roots is None else F.min_by("set", F.xxhash64("set"))
        mixed = every.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), turn.alias("centre")).where("low < high")
        return every.join(mixed.select("key", "centre"), "key")


def linked_sets(docs: DataFrame, sets: DataFrame, width: int, similarity: tuple[int, int], first: int) -> DataFrame:
    """(node, root) of every set that is linked with another one."""
    known = Confirmed(docs, sets, width, similarity)
    for bands in (first, None):
        star = known.open_keys(bands).where("set <> centre")
        known.add(star.select(F.least("set", "centre").alias("a"), F.greatest("set", "centre").alias("b")).distinct())
    apart = stored(known.open_keys().select("key", "set", "root").join(sets.select("set", "n", "sketch"), "set"), "apart")
    x, y = apart.alias("x"), apart.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _fit("x", "y", similarity))
    known.add(met.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct(), likely=True)
    return known.roots


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                first: int = FIRST) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included) and kept
    (doc_id = component_id).

    Null or empty texts and texts without words have no shingles and stay alone. Rows without doc_id are linked like others; their
    component is the smallest doc_id of the group (null if it has none), their kept is null. Repeated rows stay, each with the same
    result. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described_rows = told.select("doc_id", *_text_key(), described(F.col("text"), width, bands, rows).alias("s")).select("doc_id", "key_id", "key_text", "s.*")
    rows_of = stored(described_rows, "described")
    sets = distinct_sets(rows_of)
    roots = linked_sets(told, sets, width, similarity, first)
    grouped = (sets.select("set", "first").join(roots, F.col("set") == F.col("node"), "left")
               .select("set", "first", F.coalesce("root", "set").alias("root")))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    known = grouped.join(least, "root").select("set", "least")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (rows_of.select("doc_id", "set", "n").join(known, "set", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id")))
