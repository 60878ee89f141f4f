"""Removed lines against all pairs of lines compared, on given and awkward texts."""

import random

import pytest

from marquee.llm import linejoin


def plain(rows, above=4, below=5):
    """The texts that stay, by comparing every line with every earlier one."""
    places = []
    for key, text in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            places.append(((key is None, key or 0, no), frozenset(w for w in line.split(" ") if w), line))
    sets = {}
    for place, words, _ in places:
        if words:
            sets[words] = min(place, sets.get(words, place))
    order = sorted(sets.items(), key=lambda x: x[1])
    repeated = {words for i, (words, place) in enumerate(order)
                if any(p < place and len(words & w) * below >= len(words | w) * above for w, p in order[:i])}
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, None))
            continue
        stay = []
        for no, line in enumerate(text.split("\n")):
            words = frozenset(w for w in line.split(" ") if w)
            if not words or words not in repeated and sets[words] == (key is None, key or 0, no):
                stay.append(line)
        out.append((key, "\n".join(stay)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in linejoin.without_repeats(df, **options).select("doc_id", "text").collect()), key=str)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("buckets", [1, 64])
def test_near_lines_at_the_border(spark, buckets):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(80)}" for _ in range(rng.choice([1, 4, 5, 9, 10, 18, 40]))]
        lines = [" ".join(base)]
        for _ in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(80)}"
            lines.append(" ".join(words + [f"x{k}"] * rng.randrange(2)))
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df, buckets=buckets) == plain(rows)


def test_awkward_rows(spark):
    long = " ".join(f"t{i}" for i in range(6000))
    rows = [(3, "a b c d e\n\n  \nA b c d e"), (1, None), (2, ""), (None, "a b c d e\nno id here"), (4, "e d c b a"), (4, "e d c b a"), (5, "x\nx\ny"),
            (6, long), (7, long + " more"), (8, "a\tb\rc  d"), (9, "a\tb\rc d d"), (None, None), (10, "ü ö ä ß é\n" * 300)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id LONG, text STRING, kept_lines STRING, `odd.name` INT")
    assert got(df) == plain(rows)
    assert linejoin.without_repeats(df).columns == df.columns


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "one two three"), (1, "four five six"), (2, "one two three\nnew line"), (2, "four five six")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df) == sorted([(1, "one two three"), (1, "four five six"), (2, "new line"), (2, "")], key=str)


def test_rows_without_id_are_texts_of_their_own(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 6, 12]))) for _ in range(4)) for _ in range(60)]
    rows = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts + texts[:40])] + [(None, "a copy of all\nof it")] * 3
    told = plain([(1000 + i if k is None else k, t) for i, (k, t) in enumerate(rows)])
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1)
    out = got(df)
    assert out == sorted(((None if k >= 1000 else k, t) for k, t in told), key=str)
    assert sum(t == "a copy of all\nof it" for _, t in out) == 1


def test_crowds_of_similar_lines(spark):
    """A template with one changing word in a third of all documents."""
    words = [f"k{i}" for i in range(20)]
    rows = [(i, " ".join([*words, f"n{i}"])) for i in range(400)] + [(i, f"own{i} text{i}") for i in range(400, 1200)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(7)
    out = dict(got(df))
    assert out[0] and not any(out[i] for i in range(1, 400)) and all(out[i] for i in range(400, 1200))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert got(df) == [] and linejoin.line_report(df).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = linejoin.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def sizes(monkeypatch):
    """The rows of each table that the join stores, by name."""
    rows, stored = {}, linejoin.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(linejoin, "stored", counted)
    return rows


def test_long_lines_with_one_rare_word_in_common_are_no_pairs(spark, monkeypatch):
    """Half of the 64 bits of parity differ between any two lines of 160 words, which is about as many as similar ones may."""
    stored = sizes(monkeypatch)
    rows = [(i, " ".join([f"rare{i // 4}"] + [f"c{i}x{k}" for k in range(159)] * 6)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df) == plain(rows)
    assert stored["pairs"] < 5


def test_settled_members_of_a_crowd_look_for_no_earlier_line(spark, monkeypatch):
    """Ten lines that are not similar to each other, and then a crowd that is similar to all of them."""
    stored, words = sizes(monkeypatch), [f"k{i}" for i in range(20)]
    rows = [(i, " ".join([*words, f"a{i}", f"b{i}", f"c{i}"])) for i in range(10)] + [(i, " ".join([*words, f"m{i}"])) for i in range(10, 160)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df) == plain(rows)
    assert stored["found"] < 300


def test_long_lines_with_three_rare_words_in_common_are_no_pairs(spark, monkeypatch):
    """They share tokens of their prefixes, and of 64 bits of parity no more differ than between similar lines."""
    stored = sizes(monkeypatch)
    rows = [(i, " ".join([f"rare{k}in{i // 4}" for k in range(3)] + [f"c{i}x{k}" for k in range(157)] * 6)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df) == plain(rows)
    assert stored["pairs"] < 5


def test_every_similar_pair_shares_neighbours(spark, monkeypatch):
    """Lines as far apart as similar ones may be, with the words that differ anywhere in the order."""
    rng, rows = random.Random(5), []
    for k in range(120):
        c = rng.randrange(4, 40)
        words, apart = [f"w{k}x{i}" for i in range(c)], c // 4
        u = rng.randrange(apart + 1)
        rows += [(2 * k, " ".join(words + [f"u{k}x{i}" for i in range(u)])), (2 * k + 1, " ".join(words + [f"v{k}x{i}" for i in range(apart - u)]))]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert got(df) == plain(rows) and sum(text == "" for _, text in got(df)) == 120
