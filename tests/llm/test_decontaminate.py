"""Leaks against every window of every item compared."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from marquee.llm import decontaminate


def grams(words, width=5):
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def plain(rows, items, least=0.8):
    """(doc, item): some item-sized window's weighted Jaccard reaches `least`."""
    out = []
    for key, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for item, passage in items:
            asked = re.findall(r"\w+", (passage or "").lower())
            width = min(5, len(asked)) or 5  # a shorter item is one shingle
            own, theirs = grams(words, width), Counter(grams(asked, width))
            n = sum(theirs.values())
            if not n or not own or not theirs.keys() & set(own):
                continue
            size = min(n, len(own))
            for at in range(len(own) - size + 1):
                window = Counter(own[at:at + size])
                if sum((window & theirs).values()) >= least * sum((window | theirs).values()):
                    out.append((key, item))
                    break
    return sorted(out, key=str)


def got(docs, items):
    return sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=str)


def test_given_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert expected and got(docs, items) == expected
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in docs.collect()} - {d for d, _ in expected})


def test_changed_passages(spark):
    rng = random.Random(4)
    items, rows = [], []
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 12, 30, 90, 200]))]
        items.append((k, " ".join(words)))
        for changes in range(7):
            some = list(words)
            for _ in range(changes):
                at = rng.randrange(len(some))
                some[at:at + 1] = rng.choice([[], ["new"], [some[at], "more"]])
            around = [f"v{rng.randrange(3000)}" for _ in range(60)]
            rows.append((100 * k + changes, " ".join([*around[:30], *some, *around[30:]]) if changes % 2 else " ".join(some)))
    docs, given = spark.createDataFrame(rows, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING")
    assert got(docs, given) == plain(rows, items)


def test_awkward_rows(spark):
    passage = "The quick, brown fox; jumps over the LAZY dog and runs away"
    items = [(1, passage), (None, passage + " today"), (2, None), (3, ""), (4, "too short here"), (1, passage), (5, "a a a a a a a a")]
    rows = [(1, None), (2, ""), (3, passage.upper()), (3, passage.upper()), (None, "x " * 9 + passage), (4, "word " * 30000 + passage + " word" * 9),
            (5, "quick brown fox jumps"), (6, "a " * 40), (7, "too short here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id LONG, text STRING, item_id INT")
    given = spark.createDataFrame(items, "item_id LONG, text STRING")
    assert got(docs, given) == plain(rows, items)
    assert sorted((r.doc_id for r in decontaminate.without_leaks(docs, given).collect()), key=str) == [1, 2, 5]


def test_short_items(spark):
    """Items of one and four words are found word for word, and only so."""
    items = [(1, "Zyzzyva"), (2, "four words stand here"), (3, "two  words"), (4, "..."), (5, "zyzzyva!")]
    rows = [(1, "a zyzzyva flies"), (2, "here FOUR words, stand here today"), (3, "four words stand there"), (4, "two"), (5, "words two words two words"),
            (6, "zyzzyvas"), (7, "four words stand here and two words and " + "more " * 50 + "zyzzyva"), (8, None), (None, "Two words")]
    docs, given = spark.createDataFrame(rows, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING")
    assert got(docs, given) == plain(rows, items)
    found = {(r.doc_id, r.item_id): (r.window_start, r.window_words, r.similarity) for r in decontaminate.leaks(docs, given).collect()}
    assert found[2, 2] == (1, 4, 1.0) and found[5, 3] == (1, 2, 1.0)
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, given).collect()) == [3, 4, 6, 8]


def test_fingerprints_of_similar_windows_are_within_the_radius():
    """Recall of the search before verification, at similarities from 0.8 on: windows with words exchanged, held against brute force."""
    rng, met, close = np.random.default_rng(9), 0, 0
    for size in (8, 12, 30, 60, 120, 300):
        for _ in range(300):
            words = rng.integers(1 << 62, size=size, dtype=np.uint64)
            other = words.copy()
            other[rng.choice(size, rng.integers(1, max(2, size // 20)), replace=False)] = rng.integers(1 << 62, dtype=np.uint64)
            a, b = decontaminate.runs(words, 5), decontaminate.runs(other, 5)
            both = len(np.intersect1d(a, b))
            if both / (2 * len(a) - both) >= 0.8:
                met += 1
                close += int(np.bitwise_count(decontaminate.fingerprints(a, len(a))[0] ^ decontaminate.fingerprints(b, len(b))[0]) <= decontaminate.RADIUS)
    assert met > 200 and close >= 0.999 * met


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id LONG, text STRING"), spark.createDataFrame([(1, "a b c d e f")], "item_id LONG, text STRING")
    assert got(docs.limit(0), items) == [] and got(docs, items.limit(0)) == [] and got(docs, items) == [(1, 1)]
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 1


def test_blocks_of_items_lose_none(spark):
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(50)], "item_id LONG, text STRING")
    assert sorted(i for some in decontaminate.blocks(items, 7, 1000) for i, _ in some) == list(range(50))
    assert max(len(some) for some in decontaminate.blocks(items, 1000, 20)) <= 3


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    items = decontaminate.Items([(k, " ".join(f"u{k}x{i}" for i in range(12))) for k in range(60)], 5, 0.8, 20)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 30), replace=False)) for _ in range(600)], dtype=np.uint64)
    prints = items.prints[8][rng.integers(60, size=600)] ^ flips
    window, item, distance = items.candidates(8, prints)
    apart = np.bitwise_count(prints[:, None] ^ items.prints[8][None, :])
    assert sorted(zip(window, item)) == sorted(zip(*np.nonzero(apart <= 20))) and (distance == apart[window, item]).all()
