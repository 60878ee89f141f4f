"""Base spans against a plain reading of the patterns; added spans on planted ones."""

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marquee.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def expected(rows):
    out = []
    for key, text in rows:
        found = plain(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((key, *(sum(k == kind for k, _, _ in found) for kind in PATTERNS), sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, **options):
    out = pii.personal_data(df, **options).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == expected(rows)
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(text)
    for r in out:
        told = [s.split(":") for s in r.spans.split(",") if s]
        assert told == sorted(told, key=lambda s: (list(PATTERNS).index(s[0]), int(s[1]), int(s[2])))
        assert any({(k, a, b) for k, a, b in plain(t)} <= {(k, int(a), int(b)) for k, a, b in told} for t in texts[r.doc_id])
    return {r.doc_id: r.spans for r in out}


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a.b@c.d%e@f.g x@y@z.w .@-.- a@b..c @a.b a@b a@b.c."), (4, "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0255.01.1.1 999.1.1.1.1.1.1"),
            (5, "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 4111  1111"), (6, "+1 (234) 567-8901 +12 +1-2 +1234567890123456 ++4930 123456"),
            (7, "🤦🏽 é@x.y ü1.2.3.4ü 𝒜+1 234 567 890𝒜"), (8, "1" * 30000), (9, "1 " * 20000), (10, "a" * 60000 + "@x.y"), (11, "ab " * 20000 + "1.1.1.1 " * 3000),
            (None, "q@r.s"), (None, None), (12, "q@r.s"), (12, "q@r.s"), (13, "1.2.3.4\n5.6.7.8\r\n+49 30 1234567\t4222222222222")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id LONG, text STRING, spans STRING, `row` INT").repartition(4)
    check(df, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert pii.personal_data(df).collect() == [] and pii.redacted(df).collect() == []


def test_candidates_that_look_like_personal_data_are_added(spark):
    rows = [(i, f"please call +1 ({200 + i}) 555-{1000 + i} or write to user{i}@mail.example.com from 10.0.{i % 250}.7 now") for i in range(300)]
    rows += [(1000 + i, f"please call 1 ({200 + i}) 555-{1000 + i} or write to user{i} (at) mail.example.com now") for i in range(20)]
    rows += [(2000 + i, f"build ab{i:06d}cdef{7 * i:08d}ab at {1 + i}.{2 + i}.{i} of {10 ** 9 + 37 * i} items, {i}.5.3 too") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = check(df, rows, precision=0.8)
    added = sum("phone" in found[1000 + i] or "email" in found[1000 + i] for i in range(20))
    assert added >= 15 and sum(bool(found[2000 + i]) for i in range(300)) <= 30
    clean = {r.doc_id: r.text for r in pii.redacted(df, precision=0.8).collect()}
    assert clean[5] == "please call [PHONE] or write to [EMAIL] from [IP] now"


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_every_candidate_counts_for_the_threshold(spark):
    # counted score by score over all 60,000 rows
    rows = spark.range(60_000).select(((F.col("id") % 5_000) / 5_000).alias("score"), F.col("id").alias("i"))
    rows = rows.withColumn("truth", ((F.col("score") >= 0.3) | (F.col("i") % 2 == 0)).cast("double"))
    told = rows.groupBy("score").agg(F.sum("truth").alias("hits"), F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    for precision in (0.8, 0.95, 0.999):
        share = told["hits"].cumsum() / told["n"].cumsum()
        assert pii._cut(rows, precision) == told["score"][share >= precision].min()
    assert pii._cut(rows.where("truth = 0"), 0.5) is None and pii._cut(rows.limit(0), 0.5) is None


def test_the_trees_are_fitted_on_half_of_all_candidates(spark, monkeypatch):
    seen = []

    class Counted(pii.GBTClassifier):
        def fit(self, df):
            seen.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(pii, "GBTClassifier", Counted)
    rows = [(i, " ".join(f"1.2.{i}.{j} and 1.2.{j} is it" for j in range(30))) for i in range(2000)]
    pii.personal_data(spark.createDataFrame(rows, "doc_id LONG, text STRING")).count()
    assert len(seen) == 1 and seen[0] > 50_000
