"""Shrinkage against the same formulas by hand, held-out accuracy, and awkward rows."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import quality
from marquee.llm.toxicity import fit_linear, predict

LARGER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    if not Path(LARGER).exists():
        pytest.skip("no larger tables here")
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    out = quality.posteriors(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert len(bad) > 50 and good.keep.mean() >= 0.97
    better = (good.posterior.to_numpy()[:, None] > bad.posterior.to_numpy()[None, :]).mean()
    assert better >= 0.9


def test_posteriors_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(f"h{h}", f"p{p}", float(rng.beta(8 if h % 2 else 3, 3))) for h in range(6) for p in range(3) for _ in range(rng.integers(1, 30))]
    df = spark.createDataFrame(rows, "host STRING, path STRING, p DOUBLE")
    sites, mean, of_host, of_path = quality.site_posteriors(df)
    values = np.array([r[2] for r in rows])
    assert mean == pytest.approx(values.mean())

    def moments(groups, centre):
        n = np.array([len(g) for g in groups])
        rate, centre = np.array([np.mean(g) for g in groups]), np.broadcast_to(centre, len(groups))
        within = (n * centre * (1 - centre)).sum() / n.sum()
        between = (n * (rate - centre) ** 2).sum() / n.sum() - within * len(groups) / n.sum()
        return np.clip(within / between - 1, *quality.STRENGTH) if between > 0 else quality.STRENGTH[1]

    hosts = {h: [r[2] for r in rows if r[0] == h] for h, _, _ in rows}
    assert of_host == pytest.approx(moments(list(hosts.values()), mean))
    posterior = {h: (sum(g) + of_host * mean) / (len(g) + of_host) for h, g in hosts.items()}
    paths = {(h, p): [r[2] for r in rows if r[:2] == (h, p)] for h, p, _ in rows}
    assert of_path == pytest.approx(moments(list(paths.values()), np.array([posterior[h] for h, _ in paths])))
    for r in sites.collect():
        assert r.host_posterior == pytest.approx(posterior[r.host]) and r.n == len(paths[r.host, r.path])


def test_awkward_rows(spark):
    good, bad = "Some plain words stand here. They go on and on.", "BUY!! NOW!! $$$ ||| 1234"
    rows = [(i, good + f" {i}" if i % 3 else bad * 3, f"s{i % 5}", ["en", None][i % 2]) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "s1", "en"), (None, good, "s1", "en"), (3, rows[3][1], "s3", "en"), (202, good * 4000, "rare", "xx")]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id LONG, text STRING, source STRING, lang STRING, p DOUBLE, keep STRING")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(1, None), (None, 1), (5, 1), (5, 0), (900, 1)], "doc_id LONG, quality INT")
    out = quality.posteriors(docs, labels).collect()
    assert len(out) == len(rows) and all(0 < r.posterior < 1 for r in out)
    kept = {r.doc_id: r.keep for r in out if r.doc_id is not None and r.doc_id < 120}
    assert np.mean([kept[i] == (i % 3 > 0) for i in range(120)]) > 0.95
    stay = quality.keep_good(docs, labels)
    assert stay.columns == docs.columns and None in {r.doc_id for r in stay.collect()}


def test_without_labels_everything_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, None, None)], "doc_id LONG, text STRING, source STRING, lang STRING")
    labels = spark.createDataFrame([(1, 1)], "doc_id LONG, quality INT")
    for some in (labels, labels.limit(0)):
        assert {(r.evidence, r.keep) for r in quality.posteriors(docs, some).collect()} == {(0.5, True)}
    assert quality.posteriors(docs.limit(0), labels).collect() == []


def test_every_labelled_document_counts(spark):
    # 12,000 labelled documents of one kind, and 300 of another that are all bad: left out of a sample or not, each must move the fit
    rows = spark.range(12_300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 12_000, F.concat(F.lit("Plain words stand here "), F.col("id").cast("string")))
                                      .otherwise(F.lit("$$$ ||| !!")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = rows.select("doc_id", F.when(F.col("doc_id") < 12_000, (F.col("doc_id") % 5 > 0).cast("int")).otherwise(0).alias("quality"))
    measured = rows.select("doc_id", quality.evidence(F.col("text")).alias("measures"))
    model = quality.train(measured, quality.agreed(labels))
    told = measured.join(labels, "doc_id").toPandas().sort_values("doc_id")
    values = np.stack(told["measures"].to_list())
    z = np.clip((values - values.mean(axis=0)) / (values.std(axis=0) + 1e-9), -8, 8)
    whole = fit_linear(np.hstack([z, z ** 2]), told["quality"].to_numpy(float), np.ones(len(told)), ridge=1.0, steps=25)
    assert model.middle == pytest.approx(values.mean(axis=0))
    assert model.probability(values) == pytest.approx(predict(whole, np.hstack([z, z ** 2])), abs=2e-3)
