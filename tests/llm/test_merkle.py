"""Manifests against a plain tree built with hashlib, and on rows made to be awkward."""

import hashlib
import zlib

import pytest

from marquee.llm import merkle


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """The root, and each leaf's proof as (left, right) per level."""
    level, place, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, at in enumerate(place):
            run = at // arity * arity
            proofs[leaf].append(("".join(level[run:at]), "".join(level[at + 1:run + arity])))
            place[leaf] = at // arity
        level = [sha(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def plain(rows, arity=2):
    """What the query returns, of rows (doc_id, text, lang, source, n_chars)."""
    def leaf(i, text, lang, source, n):
        return sha(told(i), told(source), told(lang), told(n), told(text))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = {}, []
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[lang] = tree([leaf(*r) for r in groups[lang]], arity)
    if not langs:
        return []
    root, above = tree([subs[lang][0] for lang in langs], arity)
    for lang, upper in zip(langs, above):
        subroot, proofs = subs[lang]
        for row, proof in zip(groups[lang], proofs):
            i, text, _, source, n = row
            touched = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            now = leaf(i, text, lang, source, n + 1) if touched else leaf(*row)
            for left, right in proof + upper:
                now = sha(left, now, right)
            out.append((i, leaf(*row), subroot, root, sha(*[a + b for a, b in proof + upper]), now, now == root))
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in merkle.verified_rows(df, **options).collect()), key=str)


@pytest.mark.parametrize("arity, chunk", [(2, 512), (3, 10), (5, 5)])
def test_given_documents(spark, sf_dir, arity, chunk):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert got(docs, arity=arity, chunk=chunk) == plain([tuple(r) for r in docs.collect()], arity)


@pytest.mark.parametrize("arity, chunk", [(2, 2), (2, 8), (4, 16)])
def test_awkward_rows(spark, arity, chunk):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(70)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, "größer ✓", "é", "s\n", 5), (103, "x" * 300_000, "z", "s", 300_000)]
    rows += [(None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (None, "other", None, "s", None), (7, "text 7", "en", "s", 7), (7, "again", "en", "s", 7)]
    rows += [(200 + i, "t", f"lang {i}", None, i) for i in range(9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, leaf STRING, at STRING").repartition(5)
    assert got(df, arity=arity, chunk=chunk) == plain(rows, arity)


def test_tampering_is_found(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(50)] + [(1000 + i, "t", "en", "s", None) for i in range(50)]
    out = merkle.verified_rows(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")).collect()
    touched = {i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert touched and {r["doc_id"] for r in out if not r["verified"]} == touched


def test_one_row_and_none(spark):
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    assert got(spark.createDataFrame([], schema)) == []
    one = [(3, "only", "en", "s", 4)]
    assert got(spark.createDataFrame(one, schema)) == plain(one)
    assert merkle.documents_manifest(spark.createDataFrame(one, schema)).collect()[0]["proof"] == []


def test_no_window_spans_a_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = merkle.verified_rows(docs)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(", chunk#" in line or "sum(size#" in line for line in windows)  # sizes: a row per group and sorted piece
