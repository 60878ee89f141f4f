"""Held-out accuracy of the chain, what it is fitted on, and awkward rows."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import toxicity

LARGER = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_held_out_accuracy(spark):
    if not Path(LARGER).exists():
        pytest.skip("no larger tables here")
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    out = toxicity.scores(docs, labels.where(~fold)).join(labels.where(fold & F.col("toxic").isNotNull()), "doc_id")
    table = {(r["toxic"], r["rejected"]): r["count"] for r in out.groupBy("toxic", "rejected").count().collect()}
    caught, missed, false, right = (table.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    # some labels of these tables are turned over at random
    assert caught + missed > 50 and caught / (caught + missed) >= 0.92 and right / (right + false) >= 0.985


def fixture(spark, n=240):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(200)}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[3:3] = [["scum", "Idiot!", "scumbags"][i % 3], ["moron,", "idiots"][i % 2]]
        rows.append((i, " ".join(words), ["en", "de"][i % 2]))
        labels.append((i, int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"), spark.createDataFrame(labels, "doc_id LONG, toxic INT")


def test_chain_separates_and_keeps_columns(spark):
    rows, labels = fixture(spark)
    docs, known = frames(spark, rows, labels)
    found = {r.doc_id: r.rejected for r in toxicity.scores(docs, known).collect()}
    assert sum(found[i] != bool(t) for i, t in labels) <= 3
    wide = docs.withColumns({"verdict": F.lit("mine"), "p": F.lit(1)})
    clean = toxicity.without_toxic(wide, known)
    assert clean.columns == wide.columns and {r.doc_id for r in clean.collect()} == {i for i, r in found.items() if not r}


def test_awkward_rows(spark):
    rows, labels = fixture(spark)
    rows += [(1000, None, "en"), (1001, "", None), (None, "idiot moron scum", None), (None, "w1 w2", "en"), (3, rows[3][1], "en"),
             (1002, "w1 " * 100000, "de"), (1003, "w1 " * 100000 + "idiot moron scum", "de")]
    labels += [(None, 1), (5, None), (6, 1), (7777, 1), (6, 0)]
    docs, known = frames(spark, rows, labels)
    out = toxicity.scores(docs, known).collect()
    assert len(out) == len(rows)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r.rejected)
    assert found[1000] == found[1001] == [False] and sorted(found[None]) == [False, True] and found[3] == [False, False]
    assert found[1002] == [False] and found[1003] == [True]


def test_without_labels_nothing_is_rejected(spark):
    rows, labels = fixture(spark)
    docs, known = frames(spark, rows, labels)
    for some in (known.limit(0), known.where("toxic = 0"), known.where("toxic = 1")):
        assert rows_of(toxicity.scores(docs, some)) == rows_of(docs.selectExpr("doc_id", "CAST(NULL AS DOUBLE)", "false"))
    assert toxicity.scores(docs.limit(0), known).collect() == []


def test_later_models_learn_from_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    values = (rng.random((400, 6)) < 0.4).astype(float)
    first = rng.random(400) < 0.15 + 0.7 * values[:, 0]
    second = first & (rng.random(400) < 0.9 * values[:, 1])
    chain = toxicity.fit_chain(values, np.stack([first, second], axis=1).astype(int), np.ones(400), ["a", "b"], list(range(6)))
    assert [len(m) for m in chain.models] == [7, 8] and chain.models[1][6] > 0
    p = chain.probabilities(values)
    assert ((p[:, 1] >= chain.thresholds[1]) == second).mean() > 0.8


def test_calibration():
    p, truth = np.array([0.9, 0.8, 0.8, 0.2, 0.1]), np.array([1, 1, 1, 0, 0])
    assert 0.2 < toxicity.calibrate(p, truth, np.ones(5)) < 0.8
    assert toxicity.calibrate(p, np.zeros(5), np.ones(5)) > 1 and toxicity.calibrate(p[::-1], truth, np.ones(5)) > 1
    assert toxicity.calibrate(p / 10, truth, np.ones(5)) == toxicity.LEAST


def test_few_labels_do_not_reject_clean_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rejected = toxicity.scores(docs, labels).where("rejected").join(labels, "doc_id", "left").collect()
    assert sum(r.toxic == 0 for r in rejected) <= 2


def test_languages_past_the_sixth_have_a_category(spark):
    langs = ["a", "b", "c", "d", "e", "f", "g", "h", None]
    rows = [(10 * i + k, lang) for i, lang in enumerate(langs) for k in range(9 - i)]
    docs = spark.createDataFrame(rows, "doc_id LONG, lang STRING")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 10 < 5 AS INT) AS toxic")
    known, categories = toxicity.by_language(docs, labels)
    assert categories == ["toxic", *[f"toxic_{i}" for i in range(6)], "toxic_other"]
    other = {r.doc_id for r in known.where("toxic_other = 1").collect()}
    assert other == {i for i, lang in rows if lang in ("g", "h") and i % 10 < 5}
    few = docs.where("lang < 'g'")
    assert toxicity.by_language(few, labels)[1] == ["toxic", *[f"toxic_{i}" for i in range(6)]]
