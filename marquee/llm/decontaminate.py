"""Benchmark passages inside documents: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters, digits and underscores of the lower-cased text; shingles are five words, and their weight in a text or
window is how often they occur there. A window is as many words as the item it is held against (a shorter document is one
window). Its 64-bit fingerprint has the weighted majority of each bit of its shingles' hashes. Items of the window's size whose
fingerprint agrees with it up to `RADIUS` bits are found through blocks: 64 bits in `BLOCKS` parts, so one part differs in at most
RADIUS // BLOCKS bits, and every item stands under all values that close to its own part's. Candidates are verified: weighted
Jaccard, sum of the smaller over sum of the greater weights, of at least `SIMILARITY`. Shingles one of a window and an
item hold is what similarity counts, so windows without a shingle of any item are not fingerprinted: their similarity is zero.

`RADIUS` follows from the similarity: weighted Jaccard 0.8 is a cosine of at least 0.89, an angle of 27 degrees, 9.7 of 64 bits
expected with a deviation of 2.9; 20 bits are over three and a half deviations away. An item with fewer than five words is one shingle of
all of them, found word for word in windows of as many words. Items without words match nothing.

Documents are never shuffled. The items travel with the tasks in blocks of at most `ITEMS` items and `ITEM_WORDS` words; a longer
benchmark takes one pass over the documents per block, and what a block found is stored before the next one's index is made.
"""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_name, quoted, stored

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
ITEMS = 20_000
ITEM_WORDS = 2_000_000
#: Windows that are fingerprinted at a time.
STRETCH = 2048

WORDS = re.compile(r"\w+")
FOUND = "array<struct<item_id:long,window_start:int,window_words:int,distance:int,similarity:double>>"


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in WORDS.findall((text or "").lower())], dtype=np.uint64)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of `width` words."""
    if not 0 < width <= len(words):
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - width + 1 + i]
    out ^= out >> np.uint64(29)  # low bits of a sum of products depend on low bits only
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Number of words, and one 64-bit hash per shingle."""
    words = word_hashes(text)
    return len(words), runs(words, width)


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of `size` hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=votes[1:])
    ones = votes[size:] - votes[:len(votes) - size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def near_values(value: int, bits: int, radius: int) -> list[int]:
    return [value ^ sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


class Items:
    """The items of a block by size in shingles: weights, fingerprints, and the index over fingerprint blocks."""

    def __init__(self, rows: list[tuple[int, str]], width: int, similarity: float, radius: int):
        self.width, self.similarity, self.radius = width, similarity, radius
        self.sizes: dict[int, list] = defaultdict(list)
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))  # by number of words, then by their hash
        for key, text in rows:
            words = word_hashes(text)
            hashes = runs(words, width)
            if 0 < len(words) < width:
                self.short[len(words)][int(runs(words, len(words))[0])].append(key)
            if len(hashes):
                self.sizes[len(hashes)].append((key, Counter(hashes.tolist()), fingerprints(hashes, len(hashes))[0]))
        held = {h for some in self.sizes.values() for _, weights, _ in some for h in weights}
        self.held = np.array(sorted(held), dtype=np.uint64)
        self.prints = {n: np.array([p for _, _, p in some], dtype=np.uint64) for n, some in self.sizes.items()}
        part = 64 // BLOCKS
        self.index = {}
        for n, prints in self.prints.items():
            table = np.zeros((BLOCKS, 1 << part, len(prints)), bool)
            for i, p in enumerate(prints.tolist()):
                for b in range(BLOCKS):
                    table[b, near_values(p >> (part * b) & ((1 << part) - 1), part, radius // BLOCKS), i] = True
            self.index[n] = table

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius, looked up by blocks."""
        part, table = 64 // BLOCKS, self.index[size]
        met = np.zeros((len(prints), table.shape[2]), bool)
        for b in range(BLOCKS):
            met |= table[b, (prints >> np.uint64(part * b)) & np.uint64((1 << part) - 1)]
        window, item = np.nonzero(met)
        distance = np.bitwise_count(prints[window] ^ self.prints[size][item])
        close = distance <= self.radius
        return window[close], item[close], distance[close]

    def found(self, text: str | None) -> list[dict]:
        """The best window of each item that the text holds: highest similarity, then the first."""
        every = word_hashes(text)
        words, hashes = len(every), runs(every, self.width)
        best = {(-n, place): m for n, known in self.short.items() for place, m in enumerate(self._whole(every, n, known))}
        if len(hashes) and len(self.held):
            best |= self._best(words, hashes)
        return sorted(best.values(), key=lambda x: (x["item_id"] is None, x["item_id"], x["window_start"]))

    @staticmethod
    def _whole(words: np.ndarray, n: int, known: dict[int, list]) -> list[dict]:
        """The first place of each item of n words, fewer than a shingle's: its one shingle is all of them."""
        distinct, first = np.unique(runs(words, n), return_index=True)
        return [{"item_id": key, "window_start": int(at), "window_words": n, "distance": 0, "similarity": 1.0}
                for h, at in zip(distinct.tolist(), first) if h in known for key in known[h]]

    def _best(self, words: int, hashes: np.ndarray) -> dict[tuple, dict]:
        place = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        shared = np.concatenate([[0], np.cumsum(self.held[place] == hashes)])
        if not shared[-1]:
            return {}
        best: dict[tuple, dict] = {}
        for n, items in self.sizes.items():
            size = min(n, len(hashes))
            starts = np.flatnonzero(shared[size:] > shared[:len(shared) - size])
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                for at in range(0, len(run), STRETCH):
                    some = run[at:at + STRETCH]
                    prints = fingerprints(hashes[some[0]:some[-1] + size], size)[some - some[0]]
                    for window, item, distance in zip(*self.candidates(n, prints)):
                        key, weights, _ = items[item]
                        start = int(some[window])
                        own = Counter(hashes[start:start + size].tolist())
                        both = sum(min(c, weights[h]) for h, c in own.items() if h in weights)
                        similarity = both / (size + n - both)
                        known = best.get((n, item))
                        if similarity >= self.similarity and (not known or similarity > known["similarity"]):
                            best[n, item] = {"item_id": key, "window_start": start, "window_words": min(size + self.width - 1, words),
                                             "distance": int(distance), "similarity": similarity}
        return best


def blocks(items: DataFrame, most: int = ITEMS, most_words: int = ITEM_WORDS):
    """The items block by block, each within both bounds (a longer single item is a block of its own)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"), F.coalesce(F.size(F.split("text", r"\s+")), F.lit(0)).alias("words"))
    out, held = [], 0
    for row in rows.toLocalIterator():
        if out and (len(out) >= most or held + row["words"] > most_words):
            yield out
            out, held = [], 0
        out.append((row["item_id"], row["text"]))
        held += row["words"]
    if out:
        yield out


def found_in(text: Column, rows: list[tuple[int, str]], width: int, similarity: float, radius: int) -> Column:
    @F.pandas_udf(FOUND)
    def matches(texts: pd.Series) -> pd.Series:
        return pd.Series([items.found(t) for t in texts])

    items = Items(rows, width, similarity, radius)
    return matches(text)


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document row and benchmark item (item_id, text) it holds: doc_id, item_id, window_start (in words), window_words,
    distance (bits) and similarity, of the item's best window.

    Null or short texts hold nothing; null ids come out as they are; repeated rows come out once each, items that share their text
    once each. No items, or no documents: no rows. Other columns are not read.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id LONG, item_id LONG, window_start INT, window_words INT, distance INT, similarity DOUBLE")
    for rows in blocks(items):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(found_in(F.col("text"), rows, width, similarity, radius)).alias("m"))
        out = out.union(stored(found.select("doc_id", "m.*"), "leaks"))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item."""
    mark = free_name(docs, "held")
    for number, rows in enumerate(blocks(items)):
        docs = stored(docs, "clean") if number else docs
        docs = docs.withColumn(mark, F.size(found_in(F.col("text"), rows, width, similarity, radius))).where(quoted(mark) == 0).drop(mark)
    return docs
